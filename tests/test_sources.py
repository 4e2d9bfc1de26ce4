import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.sources import envi, geojson, subtitles, sun_angles, text


@pytest.mark.parametrize("interleave,axes", [("bsq", (2, 0, 1)), ("bil", (0, 2, 1)), ("bip", (0, 1, 2))])
@pytest.mark.parametrize("code,dtype", [(4, "<f4"), (12, "<u2")])
def test_envi(spark, tmp_path, interleave, axes, code, dtype):
    cube = np.arange(4 * 3 * 5).reshape(4, 3, 5).astype(dtype)
    (tmp_path / "a.dat").write_bytes(b"xx" + np.ascontiguousarray(cube.transpose(axes)).tobytes())
    (tmp_path / "a.hdr").write_text(
        f"ENVI\ndescription = {{\n a cube}}\nsamples = 3\nlines = 4\nbands = 5\nheader offset = 2\ndata type = {code}\n"
        f"interleave = {interleave}\nbyte order = 0\nwavelength = {{\n 400.0, 500.0,\n 600.0, 700.0, 800.0}}\n"
    )
    for path in ("a.hdr", "a.dat"):
        df = envi.read_envi(spark, str(tmp_path / path), rows_per_split=3)
        got = {(r.row, r.col): r.spectrum for r in df.collect()}
        assert len(got) == 12
        assert all(got[y, x] == cube[y, x].tolist() for y in range(4) for x in range(3))
    assert [r.wavelength_nm for r in envi.read_wavelengths(spark, str(tmp_path)).orderBy("band").collect()] == [400, 500, 600, 700, 800]


@pytest.mark.parametrize("interleave,axes", [("bsq", (2, 0, 1)), ("bil", (0, 2, 1)), ("bip", (0, 1, 2))])
def test_envi_bands(spark, tmp_path, interleave, axes):
    """Only wanted bands come back, in the order asked for; of a cube by band nothing else is read."""
    cube = np.arange(4 * 3 * 5).reshape(4, 3, 5).astype("<f4")
    data = np.ascontiguousarray(cube.transpose(axes)).tobytes()
    head = f"samples = 3\nlines = 4\nbands = 5\ndata type = 4\ninterleave = {interleave}\n"
    (tmp_path / "a.hdr").write_text(head)
    (tmp_path / "a.dat").write_bytes(data)
    for bands in ([2], [3, 0], [4, 4, 1]):
        got = {(r.row, r.col): r.spectrum for r in envi.read_envi(spark, str(tmp_path), rows_per_split=3, bands=bands).collect()}
        assert got == {(y, x): cube[y, x, bands].tolist() for y in range(4) for x in range(3)}
    if interleave == "bsq":
        (tmp_path / "a.dat").write_bytes(data[: 2 * 4 * 3 * 4])
        got = envi.read_envi(spark, str(tmp_path), bands=[1]).collect()
        assert {(r.row, r.col): r.spectrum[0] for r in got} == {(y, x): cube[y, x, 1] for y in range(4) for x in range(3)}
    with pytest.raises(Exception, match="asked for"):
        envi.read_envi(spark, str(tmp_path), bands=[5]).collect()


def test_envi_push_down(tmp_path):
    """Only wanted cubes and rows become partitions."""
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    for cube in "abc":
        (tmp_path / f"{cube}.hdr").write_text("samples = 2\nlines = 10\nbands = 1\ndata type = 4\ninterleave = bsq\n")
    reader = envi.PruningReader({"path": str(tmp_path), "rows_per_split": "4"})
    asked = [In(("cube_id",), ("a", "c")), GreaterThanOrEqual(("row",), 3), LessThan(("row",), 9), EqualTo(("col",), 1)]
    assert list(reader.pushFilters(asked)) == asked
    assert [(p.cube_id, p.first, p.last) for p in reader.partitions()] == [("a", 3, 7), ("a", 7, 9), ("c", 3, 7), ("c", 7, 9)]


def test_envi_paths():
    assert envi.cube_paths("/x/c.hdr") == ("/x/c.hdr", "/x/c.dat")
    assert envi.cube_paths("/x/c.dat") == ("/x/c.hdr", "/x/c.dat")


SRT = """1
00:00:00,000 --> 00:00:00,033
FrameCnt: 1, DiffTime: 33ms
[focal_len: 24.00] [dzoom_ratio: 1.50] [latitude: 54.1] [longitude: 24.1] [rel_alt: 60.5 abs_alt: 160.0] [gb_yaw: 10.0 gb_pitch: -89.9 gb_roll: 0.0]

2
00:00:00,033 --> 00:00:00,066
55.5, 25.5 alt: 12.0
  
3
00:00:00,066 --> 00:00:00,100
no position

4
00:00:00.100 --> 00:00:00,133
lat = -54.3 lon = +24.3 abs_alt: 99

5
00:00:00,133 --> 00:00:00,166
Frame: 1
latitude: 54.9 longitude: 24.9
"""


def test_srt(spark, tmp_path):
    """Named position, bare pair, no position, missing counter, duplicate frame (the later block wins)."""
    (tmp_path / "a.SRT").write_bytes(SRT.replace("\n", "\r\n").encode())
    rows = subtitles.read_srt(spark, str(tmp_path)).orderBy("frame").collect()
    # Uncounted accepted blocks number 0 (the pair) and 1; the last block is counted as frame 0.
    assert [r.frame for r in rows] == [0, 1]
    assert (rows[0].lat, rows[0].lon, rows[0].alt, rows[0].utc) == (54.9, 24.9, None, "00:00:00.133")
    assert (rows[1].lat, rows[1].lon, rows[1].alt, rows[1].rel_alt, rows[1].abs_alt) == (-54.3, 24.3, 99.0, None, 99.0)


def test_srt_fields(spark, tmp_path):
    (tmp_path / "a.srt").write_text("\n".join(SRT.split("\n")[:9]))
    r = subtitles.read_srt(spark, str(tmp_path)).orderBy("frame").collect()
    # The counted block is frame 0, then the uncounted one takes 0 and replaces it.
    assert len(r) == 1 and (r[0].lat, r[0].alt, r[0].rel_alt, r[0].utc) == (55.5, 12.0, 12.0, "00:00:00.033")


def test_srt_legacy(spark, tmp_path):
    (tmp_path / "one.srt").write_text("1\n00:01:02,500 --> 00:00:03,000\nHOME\nGPS(54.8305,24.5078,0.0M) BAROMETER:88.3M\n\n")
    (tmp_path / "two.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\na\nb\nc\n[latitude: 54.830326] [longitude: 24.512186] [rel_alt: 79.053 abs_alt: 245.877]\n\n")
    (tmp_path / "three.srt").write_text(
        "1\n01:00:01,250 --> 01:00:02,000\na\nb\n[focal_len: 24.0] [dzoom_ratio: 1.0], [latitude: 54.5] [longitude: 24.25] [rel_alt: 70.5 abs_alt: 1.0] [gb_yaw: 1 gb_pitch: 2]\n\n"
    )
    (tmp_path / "none.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nnothing\n")
    rows, rejects = subtitles.read_srt_legacy(spark, str(tmp_path))
    got = {r.layout: (r.lat, r.lon, r.alt, r.ts) for r in rows.collect()}
    assert got == {1: (54.8305, 24.5078, 88.3, 62.5), 2: (54.830326, 24.512186, 79.053, 1.0), 3: (54.5, 24.25, 70.5, 3601.25)}
    assert [r.file.rsplit("/", 1)[1] for r in rejects.collect()] == ["none.srt"]


def test_lines_keep_order_over_splits(spark, tmp_path):
    """A file read in many small splits is numbered as written."""
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = text.numbered_lines(text.read_lines(spark, str(tmp_path)))
        assert got.select("line_no").distinct().count() == 5000
        assert got.filter(F.concat(F.lit("line "), F.col("line_no").cast("string")) != F.col("line")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_radiometer(spark, tmp_path):
    head = "Device\tX\nSome: 1\n"
    (tmp_path / "a.txt").write_text(head + text.RADIOMETER_MARKER + "\n400.0\t0.1\t0.2\n401.0\t0.3\t0.4\n402.0\t0.5\t0.6\n403.0\t0.7\t0.8\n")
    (tmp_path / "a.log").write_text(text.RADIOMETER_MARKER + "\n1\t2\n")
    rows = text.read_radiometer(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r.line, r.wavelength, r["values"]) for r in rows] == [
        (0, 400.0, [0.1, 0.2]), (1, 401.0, [0.3, 0.4]), (2, 402.0, [0.5, 0.6]), (3, 403.0, [0.7, 0.8])
    ]


@pytest.mark.parametrize("n,kept", [(23, 22), (5, 5)])
def test_sun_angles(spark, tmp_path, n, kept):
    line = lambda r, add: "<VALUES>" + " ".join(str(r * n + c + add) for c in range(n)) + "</VALUES>"
    grid = lambda tag, add: f"<{tag}><COL_STEP>5000</COL_STEP><Values_List>" + "\n".join(line(r, add) for r in range(n)) + f"</Values_List></{tag}>"
    xml = f"<g><n:General/><Geometric_Info><Tile_Angles><Sun_Angles_Grid>{grid('Zenith', 0)}{grid('Azimuth', 0.5)}</Sun_Angles_Grid></Tile_Angles></Geometric_Info></g>"
    (tmp_path / "MTD_T35ULA_20240506T094030_x.xml").write_text(xml)
    rows = sun_angles.read_sun_angles(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * kept * kept and {(r.tile, str(r.acq_date)) for r in rows} == {("T35ULA", "2024-05-06")}
    assert all(r.value == r.grid_row * n + r.grid_col + (0.5 if r.kind == "azimuth" else 0) for r in rows)


def test_telemetry_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,lat,lon,note\n2.0,54.2,24.2,x\n1.0,54.1,24.1,y\n")
    rows = text.read_telemetry_csv(spark, str(tmp_path / "a.csv")).orderBy("ts").collect()
    assert [(r.ts, r.lat, r.lon, r.alt) for r in rows] == [(1.0, 54.1, 24.1, 0.0), (2.0, 54.2, 24.2, 0.0)]


def test_geojson_collection(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        """{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3346"}}, "features": [
        {"type": "Feature", "id": "p", "properties": {"a": 1}, "geometry": {"type": "Polygon", "coordinates":
          [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]}},
        {"type": "Feature", "id": "m", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}},
        {"type": "Feature", "id": "q", "geometry": {"type": "Point", "coordinates": [7.5, 8.5]}}]}"""
    )
    rows = geojson.read_regions_geojson(spark, str(tmp_path)).collect()
    got = {(r.region_id, r.part, r.ring): (r.epsg, len(r.xy), r.xy[0].x) for r in rows}
    assert got == {("p", 0, 0): (3346, 4, 0.0), ("p", 0, 1): (3346, 4, 1.0), ("m", 0, 0): (3346, 4, 0.0), ("m", 1, 0): (3346, 4, 5.0), ("q", 0, 0): (3346, 1, 7.5)}


def test_stac_array(spark, tmp_path):
    (tmp_path / "s.json").write_text(
        """[{"id": "S1", "collection": "c", "bbox": [1, 2, 3, 4], "properties": {"datetime": "2024-05-06T01:02:03Z", "eo:cloud_cover": 12.5},
             "assets": {"B04_10m": {"href": "s3://b/k.jp2", "type": "image"}}}, {"id": "S2", "collection": "c", "properties": {}}]"""
    )
    rows = geojson.read_stac_items(spark, str(tmp_path)).orderBy("scene_id").collect()
    assert [r.scene_id for r in rows] == ["S1", "S2"]
    assert rows[0].cloud_cover == 12.5 and rows[0].bbox.maxy == 4.0 and rows[0].assets["B04_10m"].href == "s3://b/k.jp2"


def test_subtitle_positions_without_names(spark):
    """Two decimals next to each other, whatever stands around them."""
    cases = {
        "GPS (54.5, 24.25, 100)": (54.5, 24.25), "54.5,24.25": (54.5, 24.25), "at -1.5; +2.5 m": (-1.5, 2.5),
        "12 54.5 24.25": (54.5, 24.25), "v1.2.3 4.5": (2.3, 4.5), "[lat: 54.5] [lon: 24.25]": None, "54 24": None, "54.5": None,
        "": None, "7.5 x 54.5\t24.25": (54.5, 24.25), "1 2.5 3 4.5 5.5": (4.5, 5.5),
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    got = {r.text: None if r.p is None else (r.p.lat, r.p.lon) for r in df.select("text", subtitles._position(F.col("text")).alias("p")).collect()}
    assert got == cases


def test_named_lines(spark, tmp_path):
    """Many small files kept in few large ones give the lines that the files would, in order."""
    rows = spark.createDataFrame([(v, f, f"{f}\nline of {v}\n" if f != 3 else None) for v in range(40) for f in range(5)], "v int, f int, value string")
    named = rows.withColumn("value", text.name_lines(F.concat(F.lit("v="), "v", F.lit("/x.srt")), F.col("value")))
    named.repartition(3, "v").sortWithinPartitions("v", "f").select("value").write.text(str(tmp_path / "large"))
    assert len(list((tmp_path / "large").glob("part-*"))) <= 3
    rows.repartition(3, "v").sortWithinPartitions("v", "f").select("v", F.col("value")).write.partitionBy("v").text(str(tmp_path / "small"))
    got = text.numbered_lines(text.read_named_lines(spark, str(tmp_path / "large")))
    want = text.numbered_lines(text.read_lines(spark, str(tmp_path / "small")))
    video = F.regexp_extract("file", "v=([0-9]+)/", 1)
    both = [sorted(map(tuple, x.select(video, "line_no", "line").collect())) for x in (got, want)]
    assert both[0] == both[1] and len(both[0]) == 40 * 13


def test_subtitles_parsed_once(spark):
    """Blocks are parsed once, though what was parsed is filtered and read twice."""
    import io
    from contextlib import redirect_stdout

    blocks = spark.createDataFrame([("a", 0, "1 00:00:01,000 --> 00:00:02,000 [latitude: 54.5] [longitude: 24.5]")], "file string, block long, text string")
    parsed = subtitles.parse_subtitle_blocks(blocks)
    with redirect_stdout(io.StringIO()) as plan:
        parsed.explain()
    assert "regexp_extract_all" not in plan.getvalue()
    assert [(r.file, r.frame, r.lat, r.lon) for r in parsed.collect()] == [("a", 0, 54.5, 24.5)]


def test_uncounted_blocks_are_numbered_through_a_video(spark, tmp_path):
    """A video of many blocks keeps its frames, and a block without a time keeps its place."""
    from canopy.adapters import Tables
    from registry import load

    ts = lambda i: f"2024-01-02 00:00:{i // 60 % 60:02d}.{i % 60:03d}" if i != 7 else None
    rows = [(i, ts(i // 2), i % 2, "view", '{"k": 1}') for i in range(4200)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    cols = ["video_id", "frame", "utc", "lat", "lon", "rel_alt", "gb_yaw"]
    got = load()[0]["parse_srt_uncounted"](spark, str(tmp_path)).select(*cols).collect()
    want = Tables(spark, str(tmp_path)).telemetry.select(*cols).collect()
    key = lambda r: (r[0], r[1])
    near = lambda r: (*r[:3], round(r[3], 6), round(r[4], 6), *r[5:])
    assert len(got) == 4200 and max(r.frame for r in got) == 2099 and any(r.utc is None for r in got)
    assert [near(r) for r in sorted(got, key=key)] == [near(r) for r in sorted(want, key=key)]
