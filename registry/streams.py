"""Streams over files written from the given tables."""

from pyspark.sql import functions as F

from canopy.operators.matching import ClusterRules
from canopy.session import cut_lineage, scratch_path
from canopy.streaming import indices as I, tracking as S
from registry.core import query
from registry.wildlife import _located, clusters_sql

FPS = 1.0
# Any whole number of windows after the epoch, where a watermark starts.
START = 1_000_000
ROWS_PER_FILE = 250_000
ROWS_PER_STATE = 100_000


def _stamped(df):
    """Event time of a frame at one frame per second."""
    return df.withColumn("ts", F.timestamp_seconds(START + F.col("frame") / FPS))


def _as_stream(t, df, label: str, parts: list):
    """Write the table in the given pieces, one after another, and read it as a stream."""
    path, schema = scratch_path(t.spark, label), df.schema
    df = cut_lineage(df)  # read once for each piece
    t.streamed = max(getattr(t, "streamed", 0), df.count())
    # A piece is one micro-batch, in more files as the table grows.
    files = max(4, t.streamed // ROWS_PER_FILE)
    for p in parts:
        piece = df.filter(p)
        (piece.coalesce(files) if files == 4 else piece.repartition(files)).write.mode("append").parquet(path)
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _finish(t, stream, label: str, mode: str = "append"):
    """Run to the end of the input and return what was written."""
    out, mark = scratch_path(t.spark, label), scratch_path(t.spark, f"{label}-state")
    schema = stream.schema
    # The state of a query keeps the partition count it started with; few suit small tables, and
    # large ones need more, so that the state one task holds does not grow with them.
    usual = t.spark.conf.get("spark.sql.shuffle.partitions")
    t.spark.conf.set("spark.sql.shuffle.partitions", str(max(8, t.streamed // ROWS_PER_STATE)))
    try:
        _run(stream, out, mark, mode)
    finally:
        t.spark.conf.set("spark.sql.shuffle.partitions", usual)
    if mode == "append":
        return t.spark.read.schema(schema).parquet(out)
    return t.spark.read.option("recursiveFileLookup", "true").parquet(out)


def _run(stream, out: str, mark: str, mode: str) -> None:
    writer = stream.writeStream.option("checkpointLocation", mark).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").outputMode("append").start(out)
    else:
        save = lambda batch, n: batch.withColumn("batch_id", F.lit(n)).write.mode("overwrite").parquet(f"{out}/part={n}")
        q = writer.foreachBatch(save).outputMode(mode).start()
    q.awaitTermination()


CLOSING = 100_000
HALVES = ["frame < 12", "frame >= 12 AND frame < 30", "frame >= 30"]


@query("stream_track_stats", "start:ts video_id:s track_id:i frames:i mean_conf:d",
       """SELECT make_timestamp(1970, 1, 1, 0, 0, 0) + to_seconds(1000000 + frame // 10 * 10) AS start, video_id, track_id, count(*) AS frames, avg(conf) AS mean_conf
          FROM detections GROUP BY ALL""")
def _(t):
    """All windows: a last event, far beyond the others, lets the watermark pass them; its own stays open."""
    d = t.detections.select("video_id", "frame", "track_id", "conf")
    end = d.agg(F.max("video_id").alias("video_id"), (F.max("frame") + CLOSING).alias("frame"), F.max("track_id").alias("track_id"), F.max("conf").alias("conf"))
    d = _stamped(d.unionByName(end))
    last = t.detections.agg(F.max("frame")).first()[0]
    stream = _as_stream(t, d, "track-stream", ["frame < 12", "frame >= 12 AND frame < 30", f"frame >= 30 AND frame <= {last}", f"frame > {last}"])
    return _finish(t, S.stream_track_stats(stream, "10 seconds", "0 seconds"), "track-stats")


@query("stream_attach_telemetry", "det_id:i frame:i t_lat:d t_rel_alt:d",
       "SELECT det_id, frame, t.lat AS t_lat, t.rel_alt AS t_rel_alt FROM detections JOIN telemetry t USING (video_id, frame)")
def _(t):
    d = _stamped(t.detections.select("video_id", "frame", "det_id", "conf"))
    g = _stamped(t.telemetry.select("video_id", "frame", "lat", "lon", "rel_alt"))
    ds, gs = _as_stream(t, d, "det-stream", HALVES), _as_stream(t, g, "geo-stream", HALVES)
    return _finish(t, S.stream_attach_telemetry(ds, gs, "100 seconds", "2 seconds"), "attached")


@query("stream_attach_telemetry_gaps", "det_id:i frame:i t_lat:d",
       """SELECT det_id, frame, CASE WHEN frame % 3 > 0 THEN t.lat END AS t_lat FROM detections JOIN telemetry t USING (video_id, frame)""")
def _(t):
    """Frames without telemetry and frames with it twice; last events let the watermark pass all others."""
    d = t.detections.select("video_id", "frame", "det_id", "conf")
    g = t.telemetry.select("video_id", "frame", "lat").filter("frame % 3 > 0")
    far = lambda df: df.unionByName(df.agg(*[(F.max(c) + CLOSING if c == "frame" else F.max(c)).alias(c) for c in df.columns]))
    known = t.telemetry.select("video_id", "frame")
    d = far(d.join(known, ["video_id", "frame"], "left_semi"))
    g = far(g.unionByName(g))
    parts = [*HALVES[:2], f"frame >= 30 AND frame < {CLOSING}", f"frame >= {CLOSING}"]
    ds, gs = _as_stream(t, _stamped(d), "det-stream", parts), _as_stream(t, _stamped(g), "geo-stream", parts)
    got = _finish(t, S.stream_attach_telemetry(ds, gs, "100 seconds", "2 seconds"), "attached-gaps")
    return got.filter(f"frame < {CLOSING}")


@query("stream_index_stats", "year:i index:s row:i col:i mean:d std:d n:i",
       """SELECT "year", "index", "row", col, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n FROM indices GROUP BY ALL""")
def _(t):
    i = t.indices.select("acq_date", "year", "index", "row", "col", "value")
    stream = _as_stream(t, i, "index-stream", ["year < 1997", "year >= 1997 AND year < 1999", "year >= 1999"])
    out = scratch_path(t.spark, "index-partials")
    I.stream_index_stats(stream, out, scratch_path(t.spark, "index-state")).awaitTermination()
    return I.index_stats(t.spark, out)


@query("stream_clusters", "video_id:s cluster_id:i frames:i first_frame:i last_frame:i mean_conf:d max_conf:d lat:d lon:d track_ids:j",
       f"""SELECT video_id, cluster_id, count(*) AS frames, min(frame) AS first_frame, max(frame) AS last_frame, avg(conf) AS mean_conf, max(conf) AS max_conf,
             arg_max(cluster_lat, cluster_hits) AS lat, arg_max(cluster_lon, cluster_hits) AS lon, list_sort(list_distinct(list(track_id))) AS track_ids
           FROM ({clusters_sql(10)}) JOIN (SELECT det_id, video_id, frame, conf, track_id FROM detections) USING (det_id) GROUP BY video_id, cluster_id""")
def _(t):
    """All rows: a far last one, of no video, lets the watermark pass them."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STATE_STORE)
    d = _located(t).select("video_id", "frame", "det_id", "x1", "y1", "conf", "track_id", "lat", "lon")
    end = d.limit(1).withColumn("video_id", F.lit("")).withColumn("frame", F.lit(CLOSING).cast(d.schema["frame"].dataType))
    stream = _as_stream(t, _stamped(d.unionByName(end)), "cluster-stream", [*HALVES[:2], f"frame >= 30 AND frame < {CLOSING}", f"frame >= {CLOSING}"])
    got = _finish(t, S.stream_clusters(stream, ClusterRules(max_idle_frames=10), FPS, start=START), "clusters", mode="update")
    got = got.where("video_id != ''")
    last = F.max_by(F.struct(*[c for c in got.columns if c not in ("video_id", "cluster_id")]), F.struct("last_frame", "frames"))
    return got.groupBy("video_id", "cluster_id").agg(last.alias("s")).select("video_id", "cluster_id", "s.*")
