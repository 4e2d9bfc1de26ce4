"""Track paths, latest points and bounds for maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from canopy.operators.folds import map_groups
from canopy.operators.ordered import row_numbers
from canopy.session import cut_lineage

VIDEO = "video_id"


def track_paths(det: DataFrame, track: str = "track_id", bucket: Column | None = None) -> DataFrame:
    """Ordered points of each track with at least two located detections: ``seq, lat, lon``.

    Points stay one row each, so a long track is never one row.
    """
    located = det.filter(F.col(track).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    cell = bucket if bucket is not None else F.floor(F.col("frame") / 1024)
    points = row_numbers(
        located.select(VIDEO, track, "frame", "det_id", "lat", "lon"), [VIDEO, track], ["frame", "det_id"], "seq", cell
    )
    long_enough = points.groupBy(VIDEO, track).agg(F.max("seq").alias("points")).filter("points >= 2")
    return points.join(long_enough, [VIDEO, track])


def smooth_path(points: DataFrame, track: str = "track_id", k: int = 5, slab: int = 4096) -> DataFrame:
    """Centred moving average over ``k`` points, shorter at the ends; two-point paths stay.

    A path is cut into slabs of ``slab`` points that carry copies of the neighbours
    they need, so no window holds a whole long path.
    """
    half = k // 2
    if k <= 1:
        return points
    at = F.floor((F.col("seq") - 1) / slab)
    first, last = F.floor((F.col("seq") - 1 - half) / slab), F.floor((F.col("seq") - 1 + half) / slab)
    copied = points.withColumn("__slab", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    w = W.partitionBy(VIDEO, track, "__slab").orderBy("seq").rangeBetween(-half, half)
    means = copied.withColumn("__lat", F.avg("lat").over(w)).withColumn("__lon", F.avg("lon").over(w))
    own = means.filter(F.col("__slab") == at)
    keep = F.col("points") <= 2
    return (
        own.withColumn("lat", F.when(keep, F.col("lat")).otherwise(F.col("__lat")))
        .withColumn("lon", F.when(keep, F.col("lon")).otherwise(F.col("__lon")))
        .drop("__lat", "__lon", "__slab")
    )


def _farthest(lat: np.ndarray, lon: np.ndarray) -> tuple[int, float]:
    """Inner point farthest from the line between the ends, the first on a tie."""
    d = _line_distance(lat[0], lon[0], lat[-1], lon[-1], lat[1:-1], lon[1:-1])
    i = int(np.argmax(d))
    return i + 1, float(d[i])


def _line_distance(x1, y1, x2, y2, x, y) -> np.ndarray:
    if x1 == x2 and y1 == y2:
        return np.hypot(x - x1, y - y1)
    area = np.abs((y2 - y1) * x - (x2 - x1) * y + x2 * y1 - y2 * x1)
    return area / np.hypot(y2 - y1, x2 - x1)


def simplify_path(points: DataFrame, eps: float = 1e-5, track: str = "track_id", limit: int = 50_000) -> DataFrame:
    """Ramer-Douglas-Peucker over paths of ``seq, lat, lon``.

    Stretches longer than ``limit`` points are split at their farthest point by
    grouped aggregates first, the same split the recursion makes; only stretches
    within the limit are handed to one Python call each.
    """
    key = [VIDEO, track]
    points = cut_lineage(points)
    ends = points.groupBy(*key).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    segments = ends
    big = segments.filter(F.col("hi") - F.col("lo") >= limit)
    final = segments.filter(F.col("hi") - F.col("lo") < limit)
    dropped = None
    while not big.isEmpty():
        split, flat = _split_long(points, big, key, eps)
        nxt = cut_lineage(split)
        dropped = flat if dropped is None else dropped.unionByName(flat)
        final = final.unionByName(nxt.filter(F.col("hi") - F.col("lo") < limit))
        big = nxt.filter(F.col("hi") - F.col("lo") >= limit)
    # Segments tile the path and share end points.
    cell = 4096
    cover = final.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    inside = (
        points.withColumn("__cell", F.floor(F.col("seq") / cell)).join(cover, [*key, "__cell"])
        .filter((F.col("seq") >= F.col("lo")) & (F.col("seq") <= F.col("hi"))).drop("__cell")
    )
    schema = points.select(*key, "seq").schema

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lat, lon, seq = pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), pdf["seq"].to_numpy()
        keep, stack = {0, len(seq) - 1}, [(0, len(seq) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            i, d = _farthest(lat[a : b + 1], lon[a : b + 1])
            if d > eps:
                keep.add(a + i)
                stack += [(a, a + i), (a + i, b)]
        picked = sorted(keep)
        return pd.DataFrame({VIDEO: k[0], track: k[1], "seq": seq[picked]})

    kept = map_groups(inside, [*key, "lo"], [F.col("seq")], schema, run)
    if dropped is not None:
        kept = kept.unionByName(dropped.select(*key, F.explode(F.array("lo", "hi")).alias("seq")))
    return points.join(kept.distinct(), [*key, "seq"], "left_semi")


def _split_long(points: DataFrame, big: DataFrame, key: list[str], eps: float) -> tuple[DataFrame, DataFrame]:
    """Long stretches cut at their farthest point; those within ``eps`` keep only their ends."""
    at = lambda n: points.select(*key, F.col("seq").alias(n), F.struct("lat", "lon").alias(f"__{n}"))
    framed = big.join(at("lo"), [*key, "lo"]).join(at("hi"), [*key, "hi"])
    cell = 4096
    cover = framed.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    inner = (
        points.withColumn("__cell", F.floor(F.col("seq") / cell)).join(cover, [*key, "__cell"])
        .filter((F.col("seq") > F.col("lo")) & (F.col("seq") < F.col("hi")))
    )
    x1, y1, x2, y2 = F.col("__lo.lat"), F.col("__lo.lon"), F.col("__hi.lat"), F.col("__hi.lon")
    x, y = F.col("lat"), F.col("lon")
    off = F.sqrt(F.pow(x - x1, F.lit(2.0)) + F.pow(y - y1, F.lit(2.0)))
    base = F.sqrt(F.pow(y2 - y1, F.lit(2.0)) + F.pow(x2 - x1, F.lit(2.0)))
    d = F.when((x1 == x2) & (y1 == y2), off).otherwise(
        F.try_divide(F.abs((y2 - y1) * x - (x2 - x1) * y + x2 * y1 - y2 * x1), base)
    )
    far = inner.groupBy(*key, "lo", "hi").agg(
        F.min(F.struct((-d).alias("neg"), "seq")).alias("f")
    )
    far = cut_lineage(far.select(*key, "lo", "hi", (-F.col("f.neg")).alias("d"), F.col("f.seq").alias("mid")))
    split = far.filter(F.col("d") > eps).select(*key, F.inline(F.array(
        F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi")), F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"))
    )))
    return split, far.filter(F.col("d") <= eps).select(*key, "lo", "hi")


def latest_points(features: DataFrame, keys: tuple[str, ...] = (VIDEO,)) -> DataFrame:
    """Last located point per cluster, else per track; points with neither all stay."""
    located = features.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    order = F.struct("frame", "det_id")

    def last(df: DataFrame, by: str) -> DataFrame:
        rest = [c for c in features.columns if c not in (*keys, by)]
        return df.groupBy(*keys, by).agg(F.max_by(F.struct(*rest), order).alias("s")).select(*keys, by, "s.*").select(
            *features.columns
        )

    in_cluster = F.col("cluster_id").isNotNull()
    on_track = F.col("track_id").isNotNull()
    return (
        last(located.filter(in_cluster), "cluster_id")
        .unionByName(last(located.filter(~in_cluster & on_track), "track_id"))
        .unionByName(located.filter(~in_cluster & ~on_track))
    )


def features_bounds(df: DataFrame) -> DataFrame:
    """Overall bounds; one row of NULLs when nothing is located."""
    ok = df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return ok.agg(
        F.min("lon").alias("lon_min"), F.min("lat").alias("lat_min"), F.max("lon").alias("lon_max"), F.max("lat").alias("lat_max")
    )
