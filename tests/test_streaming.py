"""Streams against the batch operators on the same rows."""

import random

from pyspark.sql import functions as F

from canopy.operators import raster as R, tracking as Tr
from canopy.operators.matching import ClusterRules
from canopy.streaming import indices as I, tracking as S
from tests.test_tracking import COLS, _scene

START = 1_000_000


def _stream(spark, df, path, cuts):
    for lo, hi in zip(cuts, cuts[1:]):
        df.filter((F.col("frame") >= lo) & (F.col("frame") < hi)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _clusters_of(spark, path, det, pieces, rules, lateness):
    """All that the stream tells of the clusters of ``pieces``, one micro-batch each, and then a far row of another video."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STATE_STORE)
    end = det.limit(1).withColumn("video_id", F.lit("end")).withColumn("frame", F.lit(100_000))
    for p in [*pieces, end]:
        p.withColumn("ts", F.timestamp_seconds(START + F.col("frame") / 10.0)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    schema = det.withColumn("ts", F.current_timestamp()).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    save = lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/n={n}")
    out = S.stream_clusters(stream, rules, 10.0, lateness, START)
    out.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out").where("video_id = 'v'").collect()


def _same_as_batch(rows, det, limits):
    want = {r.cluster_id: r for r in Tr.cluster_summary(Tr.spatial_clusters(det, *limits)).collect()}
    last = {}
    for r in sorted(rows, key=lambda r: (r.n, r.last_frame, r.closed)):
        last[r.cluster_id] = r
    assert set(last) == set(want)
    for k, w in want.items():
        g = last[k]
        assert (g.frames, g.first_frame, g.last_frame, g.track_ids) == (w.frames, w.first_frame, w.last_frame, w.track_ids)
        assert abs(g.lat - w.lat) < 1e-12 and abs(g.lon - w.lon) < 1e-12 and abs(g.mean_conf - w.mean_conf) < 1e-12
    closed = [r.cluster_id for r in rows if r.closed]
    # Each is closed once, and nothing touches it after.
    assert sorted(closed) == sorted(want) and all(last[c].closed for c in closed)


def test_clusters(spark, tmp_path):
    """Last state per cluster equals the batch summary; every cluster is closed once the watermark has passed it."""
    det = spark.createDataFrame(_scene(21), COLS)
    pieces = [det.filter((F.col("frame") >= a) & (F.col("frame") < b)) for a, b in ((0, 100), (100, 200), (200, 500), (500, 901))]
    rows = _clusters_of(spark, tmp_path, det, pieces, ClusterRules(2.0, 15, 1, 4, 30.0), "1 second")
    _same_as_batch(rows, det, (2.0, 15, 1, 4, 30.0))


def test_clusters_of_shuffled_rows(spark, tmp_path):
    """Rows in any order within the lateness, early frames in later micro-batches: the same as the batch."""
    det = spark.createDataFrame(_scene(22), COLS)
    # A row comes up to 20 seconds of frames after its own time.
    come = F.col("frame") + F.pmod(F.xxhash64("det_id"), F.lit(200))
    pieces = [det.where((come >= a) & (come < a + 120)) for a in range(0, 1200, 120)]
    rows = _clusters_of(spark, tmp_path, det, pieces, ClusterRules(2.0, 15, 1, 4, 30.0), "40 seconds")
    _same_as_batch(rows, det, (2.0, 15, 1, 4, 30.0))


def test_attach_telemetry(spark, tmp_path):
    rng = random.Random(1)
    det = [(i, "v", rng.randrange(60)) for i in range(200)]
    d = spark.createDataFrame(det, "det_id int, video_id string, frame int").withColumn("ts", F.timestamp_seconds(START + F.col("frame")))
    g = spark.range(0, 60, 2).select(F.lit("v").alias("video_id"), F.col("id").cast("int").alias("frame"), (F.col("id") / 10).alias("lat"))
    g = g.withColumn("ts", F.timestamp_seconds(START + F.col("frame")))
    # A last detection far ahead moves the watermark past everything else.
    tail = spark.createDataFrame([(-1, "v", 10_000)], "det_id int, video_id string, frame int").withColumn("ts", F.timestamp_seconds(START + F.col("frame")))
    tailg = g.limit(1).withColumn("frame", F.lit(10_001)).withColumn("ts", F.timestamp_seconds(START + F.col("frame")))
    ds = _stream(spark, d.unionByName(tail), f"{tmp_path}/d", [0, 30, 60, 20_000])
    gs = _stream(spark, g.unionByName(tailg), f"{tmp_path}/g", [0, 30, 60, 20_000])
    out = S.stream_attach_telemetry(ds, gs, "5 seconds", "2 seconds")
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.det_id: r.t_lat for r in spark.read.parquet(f"{tmp_path}/o").collect() if r.det_id >= 0}
    assert got == {i: (f / 10 if f % 2 == 0 else None) for i, _, f in det}


def test_index_stats(spark, tmp_path):
    rng = random.Random(2)
    rows = [(2020 + i % 2, "ndvi", rng.randrange(3), 0, 100.0 + rng.random() if i % 9 else float("nan"), i) for i in range(300)]
    df = spark.createDataFrame(rows, "year int, index string, row int, col int, value double, frame int")
    stream = _stream(spark, df, f"{tmp_path}/in", [0, 90, 200, 300])
    I.stream_index_stats(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    want = {(r.year, r.row): r for r in R.pixel_stats(df).collect()}
    I.compact(spark, f"{tmp_path}/out", f"{tmp_path}/small")
    for path in ("out", "small"):
        got = {(r.year, r.row): r for r in I.index_stats(spark, f"{tmp_path}/{path}").collect()}
        assert set(got) == set(want)
        for k, w in want.items():
            assert got[k].n == w.n and abs(got[k].mean - w["mean"]) < 1e-9 and abs(got[k]["std"] - w["std"]) < 1e-9


def test_index_stats_in_levels(spark, tmp_path):
    """Eleven batches, three to a level: each batch is read once, from few folders, also when a batch is repeated."""
    rng = random.Random(3)
    rows = [(2020, "ndvi", rng.randrange(3), 0, 100.0 + rng.random(), i) for i in range(220)]
    df = spark.createDataFrame(rows, "year int, index string, row int, col int, value double, frame int")
    stream = _stream(spark, df, f"{tmp_path}/in", range(0, 221, 20))
    I.stream_index_stats(stream, f"{tmp_path}/out", f"{tmp_path}/cp", fan=3).awaitTermination()
    assert I.partial_folders(spark, f"{tmp_path}/out", 3) == [(0, 9), (0, 10), (2, 0)]
    want = {r.row: r for r in R.pixel_stats(df).collect()}
    for r in I.index_stats(spark, f"{tmp_path}/out", fan=3).collect():
        w = want[r.row]
        assert r.n == w.n and abs(r.mean - w["mean"]) < 1e-9 and abs(r["std"] - w["std"]) < 1e-9


def test_track_stats(spark, tmp_path):
    df = spark.createDataFrame([("v", f, f % 2, 0.5 + (f % 2) / 4) for f in range(40)], "video_id string, frame int, track_id int, conf double")
    df = df.withColumn("ts", F.timestamp_seconds(START + F.col("frame")))
    stats = S.stream_track_stats(_stream(spark, df, f"{tmp_path}/in", [0, 20, 40]), "10 seconds", "0 seconds")
    q = stats.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/o").collect()
    # The last window stays open until the watermark passes its end.
    assert len(rows) == 6 and all(r.frames == 5 and r.mean_conf == 0.5 + r.track_id / 4 for r in rows)


class _Held:
    """A state variable in memory that counts the calls made to it."""

    def __init__(self, calls):
        self.calls, self.value, self.map = calls, None, {}

    def __getattribute__(self, name):
        if name in ("calls", "value", "map"):
            return object.__getattribute__(self, name)
        self.calls.append(name)
        return {
            "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v),
            "clear": lambda: setattr(self, "value", None), "containsKey": lambda k: k in self.map, "getValue": self.map.get,
            "updateValue": self.map.__setitem__, "removeKey": self.map.pop, "keys": lambda: iter(list(self.map)),
            "iterator": lambda: iter(list(self.map.items())),
        }[name]


def test_state_calls_do_not_grow_with_rows():
    """Each call crosses to the state's process: a batch makes a few, not some for each row and cluster."""
    import types

    import pandas as pd

    def calls(rows):
        made = []
        held = lambda *_: _Held(made)
        handle = types.SimpleNamespace(getMapState=held, getValueState=held, registerTimer=lambda at: None, deleteTimer=lambda at: None)
        stream = S.ClusterStream(ClusterRules(2.0, 500), 1.0, 0.0)
        stream.init(handle)
        at = lambda ms: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
        n = range(rows)
        frame = [i // 2 for i in n]
        pdf = pd.DataFrame({"frame": frame, "conf": 0.5, "x1": 1.0, "y1": 1.0, "det_id": n, "lat": 54 + pd.Series(n) / 1000, "lon": 24.0, "track_id": 1})
        list(stream.handleInputRows(("v",), iter([pdf]), at(0)))
        out = pd.concat(stream.handleInputRows(("v",), iter([pdf.iloc[:0]]), at(1_000_000_000)))
        assert out["frames"].sum() == rows
        return len(made)

    assert calls(400) <= calls(20) + 10
