"""Table shapes that sources give, and the column order of reports."""

from pyspark.sql import types as T

_d, _i, _s, _l = T.DoubleType(), T.IntegerType(), T.StringType(), T.LongType()


def _struct(*pairs) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])


S2_BANDS = ["b02", "b03", "b04", "b05", "b06", "b07", "b08", "b8a", "b11", "b12"]

SPECTRA = _struct(("cube_id", _s), ("row", _i), ("col", _i), ("spectrum", T.ArrayType(_d)))
BBOX = _struct(("minx", _d), ("miny", _d), ("maxx", _d), ("maxy", _d))
SCENES = _struct(
    ("scene_id", _s), ("collection", _s), ("datetime", T.TimestampType()), ("cloud_cover", _d),
    ("instrument_mode", _s), ("orbit_state", _s), ("bbox", BBOX),
    ("assets", T.MapType(_s, _struct(("href", _s)))),
)
TELEMETRY = _struct(
    ("video_id", _s), ("frame", _i), ("ts", _d), ("lat", _d), ("lon", _d), ("alt", _d),
    ("rel_alt", _d), ("abs_alt", _d), ("focal_len", _d), ("dzoom_ratio", _d), ("gb_yaw", _d),
    ("gb_pitch", _d), ("gb_roll", _d), ("utc", _s),
)

# Column order of the written reports.
DETECTIONS_OUT = [
    "frame", "cls", "name", "entity_id", "cls_original", "name_original", "conf", "x1", "y1",
    "x2", "y2", "lat", "lon", "alt", "rel_alt", "abs_alt", "utc", "track_id",
    "track_id_original", "cluster_id", "lat_drone", "lon_drone", "grounded", "status",
    "reject_reason",
]
TRACKS_OUT = [
    "track_id", "cls", "name", "frames", "first_frame", "last_frame", "mean_conf", "max_conf",
    "lat", "lon", "alt", "utc",
]
CLUSTERS_OUT = [
    "cluster_id", "frames", "first_frame", "last_frame", "mean_conf", "max_conf", "lat", "lon",
    "track_ids",
]
