"""Detections and telemetry: cleaning, joins, camera geometry, motion."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from canopy.functions import detection as D
from canopy.operators.ordered import fill, row_numbers
from canopy.operators.quantiles import exact_quantiles

# Frames per bucket where rows are ordered by frame.
FRAMES_PER_CELL = 1024


def frame_cell(order: str = "frame") -> Column:
    return F.floor(F.col(order) / FRAMES_PER_CELL)


GEO_FIELDS = [
    "lat", "lon", "alt", "lat_drone", "lon_drone", "rel_alt", "abs_alt", "focal_len", "dzoom_ratio",
    "gb_yaw", "gb_pitch", "gb_roll",
]


def normalize_detection(det: DataFrame, class_names: Mapping[int, str] | Sequence[str] | None = None) -> DataFrame:
    """Numeric columns with safe defaults, class names, empty timestamps as NULL."""
    num = lambda c: F.col(c).cast("string").try_cast("double")
    out = det.withColumn("conf", D.clean_confidence("conf") if "conf" in det.columns else F.lit(0.0))
    cls = num("cls").cast("int") if "cls" in det.columns else F.lit(None).cast("int")
    out = out.withColumn("cls", F.coalesce(cls, F.lit(0)))
    if class_names is not None:
        out = out.withColumn("name", D.class_name("cls", class_names))
    for c in ("x1", "y1", "x2", "y2", "cx", "cy", "w", "h"):
        if c in det.columns:
            out = out.withColumn(c, F.coalesce(num(c), F.lit(0.0)))
    for c in GEO_FIELDS:
        if c in det.columns:
            out = out.withColumn(c, num(c))
    for c in ("track_id", "cluster_id"):
        if c in det.columns:
            out = out.withColumn(c, F.col(c).cast("string").try_cast("int"))
    stamps = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("utc", "ts", "timestamp") if c in det.columns]
    if stamps:
        stamp = F.coalesce(*stamps)
        out = out.withColumn("utc", F.when(F.trim(stamp) != "", stamp))
    return out


def stride_frames(df: DataFrame, n: int) -> DataFrame:
    return df.filter(F.col("frame") % n == 0)


def min_confidence(df: DataFrame, threshold: float) -> DataFrame:
    return df.filter(F.col("conf") >= threshold)


def allowed_classes(df: DataFrame, ids: Sequence[int]) -> DataFrame:
    return df.filter(F.col("cls").isin(*ids))


def first_per_frame(telemetry: DataFrame, order: str | None = None) -> DataFrame:
    """One telemetry row per frame, the first in ``order``; rows without an order value come last."""
    rest = [c for c in telemetry.columns if c not in ("video_id", "frame")]
    by = F.col(order or "ts")
    return (
        telemetry.groupBy("video_id", "frame").agg(F.min_by(F.struct(*rest), F.struct(by.isNull(), by)).alias("s"))
        .select("video_id", "frame", "s.*")
    )


def attach_telemetry(det: DataFrame, telemetry: DataFrame, order: str | None = None) -> DataFrame:
    """Detections with the telemetry of their frame, where there is one."""
    geo = first_per_frame(telemetry, order)
    return det.join(geo, ["video_id", "frame"], "left")


def nearest_telemetry(
    left: DataFrame,
    telemetry: DataFrame,
    ts: str = "ts",
    values: Sequence[str] = ("lat", "lon", "alt"),
    keys: Sequence[str] = ("video_id",),
    bucket_seconds: float = 3600.0,
) -> DataFrame:
    """Telemetry row nearest in time, either side; the earlier one on a tie.

    Both sides are stacked and filled along time, so the work is linear and no
    range join arises. Ends are clamped.
    """
    keys = list(keys)
    row = F.struct(F.col(ts).alias("at"), *[F.col(v) for v in values])
    marks = telemetry.select(*keys, F.col(ts).alias("__t"), row.alias("__m"), F.lit(1).alias("__side"),
                             F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"))
    asks = left.select(*keys, F.col(ts).alias("__t"), F.lit(None).cast(marks.schema["__m"].dataType).alias("__m"),
                       F.lit(0).alias("__side"), F.struct(*left.columns).alias("__row"))
    both = marks.unionByName(asks)
    # Questions sort before marks of the same time, so an exact hit is always "after".
    m = F.col("__m")
    filled = fill(both, keys, ["__t", "__side", "__m"], {"__b": m}, {"__a": m}, bucket=F.floor(F.col("__t") / bucket_seconds))
    closer_before = F.col("__a").isNull() | (
        F.col("__b").isNotNull() & (F.col("__t") - F.col("__b.at") <= F.col("__a.at") - F.col("__t"))
    )
    best = F.when(closer_before, F.col("__b")).otherwise(F.col("__a"))
    return (
        filled.filter("__side = 0").withColumn("__best", best)
        .select("__row.*", F.col("__best.at").alias("matched_ts"), *[F.col(f"__best.{v}").alias(v) for v in values])
    )


def nearest_by_frame(
    left: DataFrame, telemetry: DataFrame, fps: float, values: Sequence[str] = ("lat", "lon", "alt"),
) -> DataFrame:
    """Frames matched to the telemetry nearest to their rounded second."""
    # Half to even, as the rounding of the counter this follows.
    asked = left.withColumn("ts", F.rint(F.col("frame") / fps))
    return nearest_telemetry(asked, telemetry, "ts", values)


def heading(telemetry: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Viewing direction in radians: gimbal yaw, else the course minus a quarter turn;
    the last position takes the mean of the two before it."""
    cell = frame_cell() if bucket is None else bucket
    nxt = fill(telemetry, ["video_id"], ["frame"], after={"__n": F.struct("lat", "lon")}, inclusive=False, bucket=cell)
    course = F.atan2(F.col("__n.lat") - F.col("lat"), F.col("__n.lon") - F.col("lon")) - F.pi() / 2
    c = nxt.withColumn("__course", F.when(F.col("__n").isNotNull(), course))
    # The last two known courses per video, as a bounded aggregate.
    last = c.filter(F.col("__course").isNotNull()).groupBy("video_id").agg(
        F.max_by("__course", "frame").alias("__c1"), F.max("frame").alias("__f1")
    )
    prev = (
        c.filter(F.col("__course").isNotNull()).join(last, "video_id").filter(F.col("frame") < F.col("__f1"))
        .groupBy("video_id").agg(F.max_by("__course", "frame").alias("__c2"))
    )
    ends = last.join(prev, "video_id", "left").select(
        "video_id", ((F.col("__c1") + F.coalesce("__c2", "__c1")) / 2).alias("__end")
    )
    yaw = F.radians("gb_yaw")
    return (
        c.join(ends, "video_id", "left")
        .withColumn("heading", F.coalesce(yaw, F.col("__course"), F.col("__end")))
        .drop("__n", "__course", "__end")
    )


def geo_calibration(
    telemetry: DataFrame, radius_m: float = 5.0, reassoc_m: float = 30.0, freeze_after: int = 30
) -> DataFrame:
    """Pitch bias and clustering limits per video from median pitch and height."""
    q = exact_quantiles(telemetry, ["video_id"], "gb_pitch", {"median_pitch": 0.5})
    h = exact_quantiles(telemetry, ["video_id"], "rel_alt", {"median_rel_alt": 0.5})
    videos = telemetry.select("video_id").distinct()
    base = videos.join(q, "video_id", "left").join(h, "video_id", "left")
    both = F.col("median_pitch").isNotNull() & F.col("median_rel_alt").isNotNull()
    off = F.abs(F.col("median_pitch") + 90)
    bias = F.greatest(F.lit(-45.0), F.least(F.lit(45.0), F.col("median_pitch") + 90))
    span = F.when(both & (off > 0.5), F.col("median_rel_alt") * F.tan(F.radians(off))).otherwise(0.0)
    s = F.col("expected_span")
    return (
        base.withColumn("expected_span", span)
        .withColumn("pitch_bias", F.when(both & (off > 1), bias).otherwise(0.0))
        .withColumn("pitch_bias_applied", both & (off > 1))
        .withColumn("cluster_radius_m", F.lit(float(radius_m)))
        .withColumn("cluster_reassoc_m", F.when(
            s != 0, F.greatest(F.lit(float(reassoc_m)), F.least(F.lit(8.0), s * 0.4))).otherwise(float(reassoc_m)))
        .withColumn("cluster_freeze_after", F.when(both, min(freeze_after, 12)).otherwise(freeze_after))
        .withColumn("max_ground_distance", F.when(s != 0, F.greatest(F.lit(500.0), s * 2)))
    )


def locate_detections(
    det: DataFrame, width: int, height: int, hfov: float | None = None, vfov: float | None = None,
    ground_alt: float = 0.0,
) -> DataFrame:
    """Ground position of each detection; drone position kept as ``lat_drone, lon_drone``."""
    u, v = (F.col("x1") + F.col("x2")) * 0.5, (F.col("y1") + F.col("y2")) * 0.5
    nonzero = lambda c: F.when(F.col(c) != 0, F.col(c))
    alt = F.coalesce(nonzero("rel_alt"), nonzero("alt"), F.col("abs_alt"))
    flown = det.withColumn("lat_drone", F.col("lat")).withColumn("lon_drone", F.col("lon"))
    fx = D.focal_pixels(width, "focal_len", "dzoom_ratio", hfov)
    if hfov is None and vfov is not None:
        # Without a focal length a given vertical angle still fixes the camera.
        fx = F.coalesce(fx, F.lit(height / 2 / math.tan(math.radians(vfov) / 2) * width / height))
    # Each step is its own column: later steps use it several times.
    wx, wy, wz = D.ground_ray(u, v, width, height, F.col("__fx"), "gb_yaw", "gb_pitch", "gb_roll")
    rays = flown.withColumn("__fx", fx).withColumn("__h", alt).select(
        *flown.columns, "__h", wx.alias("__wx"), wy.alias("__wy"), wz.alias("__wz")
    )
    t = F.try_divide(F.lit(float(ground_alt)) - F.col("__h"), F.col("__wz"))
    reached = rays.withColumn("__t", t)
    lat, lon, hit = D.ground_point("lat_drone", "lon_drone", "__wx", "__wy", "__wz", "__t")
    # Emitted as a one-row inline: a later filter on the position then tests the value
    # instead of being pushed down with a copy of all the ray arithmetic.
    found = F.struct(lat.alias("lat"), lon.alias("lon"), F.coalesce(hit, F.lit(False)).alias("grounded"))
    rest = [c for c in flown.columns if c not in ("lat", "lon", "grounded")]
    return reached.select(*rest, F.inline(F.array(found)))


def chain_timestamps(telemetry: DataFrame, file_order: str = "file_no", gap: float = 20.0) -> DataFrame:
    """Consecutive recordings on one clock: each starts ``gap`` seconds after the last end."""
    ends = telemetry.groupBy("video_id", file_order).agg(F.max_by("ts", "frame").alias("__end"))
    w = W.partitionBy("video_id").orderBy(file_order).rowsBetween(W.unboundedPreceding, -1)
    shift = ends.withColumn("__shift", F.coalesce(F.sum(F.col("__end") + gap).over(w), F.lit(0.0)))
    return (
        telemetry.join(shift.drop("__end"), ["video_id", file_order])
        .withColumn("ts", F.col("ts") + F.col("__shift")).drop("__shift")
    )


def turning_points(
    track: DataFrame, keys: Sequence[str] = ("video_id",), order: str = "frame", bucket: Column | None = None
) -> DataFrame:
    """Direction changes per axis, forward and reversed, coded 1, 2, 4, 8 and summed.

    Equal neighbours are collapsed before looking at directions. A forward change
    sits at the run's last row, a reversed one at its first.
    """
    cell = frame_cell(order) if bucket is None else bucket
    both = F.struct("lat", "lon")
    n = fill(track, keys, [order], {"__p": both}, {"__n": both}, inclusive=False, bucket=cell)
    starts, ends = {}, {}
    for axis in ("lat", "lon"):
        v, p, q = F.col(axis), F.col(f"__p.{axis}"), F.col(f"__n.{axis}")
        n = n.withColumn(f"__s_{axis}", F.col("__p").isNull() | (p != v))
        n = n.withColumn(f"__e_{axis}", F.col("__n").isNull() | (q != v))
        # Value of the run before, known at a run's first row; of the run after, at its last.
        starts[f"__before_{axis}"] = F.when(F.col(f"__s_{axis}"), F.struct(p.alias("v")))
        ends[f"__after_{axis}"] = F.when(F.col(f"__e_{axis}"), F.struct(q.alias("v")))
    n = fill(n, keys, [order], starts, ends, bucket=cell)
    code = F.lit(0)
    for axis, forward, backward in (("lat", 1, 2), ("lon", 4, 8)):
        v, before, after = F.col(axis), F.col(f"__before_{axis}.v"), F.col(f"__after_{axis}.v")
        turn = F.when((before < v) & (after < v), -1).when((before > v) & (after > v), 1).otherwise(0)
        places = F.when(F.col(f"__e_{axis}"), forward).otherwise(0) + F.when(F.col(f"__s_{axis}"), backward).otherwise(0)
        code = code + turn * places
    return n.withColumn("turn", code.cast("int")).select(*track.columns, "turn")


def interpolate_positions(
    telemetry: DataFrame, keys: Sequence[str] = ("video_id",), order: str = "frame", bucket: Column | None = None
) -> DataFrame:
    """Positions between consecutive turning points replaced by a straight line over the
    row index; the first and last rows are anchors too, adjacent anchors change nothing."""
    keys = list(keys)
    cell = frame_cell(order) if bucket is None else bucket
    turned = row_numbers(turning_points(telemetry, keys, order, cell), keys, [order], "__i", cell)
    sizes = turned.groupBy(*keys).agg(F.max("__i").alias("__size"))
    t = turned.join(sizes, keys)
    anchor = (F.col("turn") != 0) | (F.col("__i") == 1) | (F.col("__i") == F.col("__size"))
    mark = F.when(anchor, F.struct(F.col("__i").alias("i"), "lat", "lon"))
    t = fill(t, keys, ["__i"], {"__a": mark}, {"__b": mark}, bucket=frame_cell("__i"))
    span = F.col("__b.i") - F.col("__a.i")
    line = lambda c: F.when(
        span > 0, F.col(f"__a.{c}") + (F.col(f"__b.{c}") - F.col(f"__a.{c}")) * (F.col("__i") - F.col("__a.i")) / span
    ).otherwise(F.col(c))
    return t.select(*[line(c).alias(c) if c in ("lat", "lon") else F.col(c) for c in telemetry.columns])
