"""Polygons against grids: scanline cells, clipping, burning, overlap, hulls.

A polygon becomes spans of cells per grid row (each edge emits the rows it
crosses), so the join with pixels is an equi-join on the cell instead of a
point-in-polygon test per pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from canopy.functions import geometry as G
from canopy.operators.folds import map_groups
from canopy.operators.ordered import row_numbers

CELL = ["row", "col"]


def _edges(regions: DataFrame, keep: Sequence[str]) -> DataFrame:
    return regions.select(*keep, F.inline(G.ring_edges("xy")))


def region_spans(regions: DataFrame, cell: float = 1.0) -> DataFrame:
    """Half-open column spans per region and row whose cell centres lie inside (even-odd)."""
    e = _edges(regions, ["region_id"])
    lo, hi = F.least("y1", "y2") / cell, F.greatest("y1", "y2") / cell
    # Rows whose centre y satisfies lo <= y < hi.
    first, last = F.ceil(lo - 0.5).cast("int"), (F.ceil(hi - 0.5) - 1).cast("int")
    crossed = e.filter(last >= first).withColumn("row", F.explode(F.sequence(first, last)))
    y = (F.col("row") + 0.5) * cell
    at = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    w = W.partitionBy("region_id", "row").orderBy("x")
    pairs = (
        crossed.select("region_id", "row", at.alias("x"))
        .withColumn("rank", F.row_number().over(w))
        .withColumn("x_out", F.lead("x").over(w))
        .filter(F.col("rank") % 2 == 1)
    )
    c0 = F.ceil(F.col("x") / cell - 0.5).cast("int")
    c1 = F.ceil(F.col("x_out") / cell - 0.5).cast("int")
    return pairs.select("region_id", "row", c0.alias("col_from"), c1.alias("col_to")).filter("col_to > col_from")


def _touched(regions: DataFrame, cell: float) -> DataFrame:
    """Cells an edge passes through."""
    e = _edges(regions, ["region_id"])
    ylo, yhi = F.least("y1", "y2") / cell, F.greatest("y1", "y2") / cell
    rows = F.sequence(F.floor(ylo).cast("int"), F.floor(yhi).cast("int"))
    r = e.withColumn("row", F.explode(rows))
    flat = F.col("y1") == F.col("y2")

    def x_at(yrow: Column) -> Column:
        # The edge's x where it meets the row border, held inside the edge.
        y = F.least(F.greatest(yrow * cell, F.least("y1", "y2")), F.greatest("y1", "y2"))
        return F.col("x1") + F.try_divide((y - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1"))

    a = F.when(flat, F.col("x1")).otherwise(x_at(F.col("row")))
    b = F.when(flat, F.col("x2")).otherwise(x_at(F.col("row") + 1))
    cols = F.sequence(F.floor(F.least(a, b) / cell).cast("int"), F.floor(F.greatest(a, b) / cell).cast("int"))
    return r.select("region_id", "row", F.explode(cols).alias("col"))


def region_cells(regions: DataFrame, cell: float = 1.0, all_touched: bool = False) -> DataFrame:
    """Grid cells of each region: by centre, or every cell it touches."""
    spans = region_spans(regions, cell)
    cols = F.sequence(F.col("col_from"), F.col("col_to") - 1)
    cells = spans.select("region_id", "row", F.explode(cols).alias("col"))
    if all_touched:
        cells = cells.unionByName(_touched(regions, cell)).distinct()
    return cells


def clip_to_region(
    pixels: DataFrame, regions: DataFrame, all_touched: bool = False, cell: float = 1.0
) -> DataFrame:
    """Pixels inside each region, tagged with its id; of the region's zone where pixels have one."""
    inside = region_cells(regions, cell, all_touched)
    if "epsg" not in pixels.columns:
        return pixels.join(inside, CELL)
    return pixels.join(inside.join(regions.select("region_id", "epsg").distinct(), "region_id"), ["epsg", *CELL])


def rasterize_regions(regions: DataFrame, field: str, order: str, cell: float = 1.0) -> DataFrame:
    """Region attribute per cell; the region last in ``order`` wins."""
    attrs = regions.groupBy("region_id").agg(F.first(field, True).alias("value"), F.max(order).alias("__o"))
    cells = region_cells(regions, cell).join(attrs, "region_id")
    return cells.groupBy(*CELL).agg(F.max_by("value", "__o").alias("value"))


def region_overlap(regions: DataFrame, cell: float = 1.0, threshold: float = 0.0) -> DataFrame:
    """Overlapping region pairs with shared cells and the share of the smaller region.

    Spans, not cells, are joined: each carries its length, and is cut at fixed
    column buckets so the join stays an equi-join.
    """
    spans = region_spans(regions, cell)
    area = spans.groupBy("region_id").agg(F.sum(F.col("col_to") - F.col("col_from")).alias("cells"))
    width = 64
    cut = spans.withColumn(
        "slab", F.explode(F.sequence(F.floor(F.col("col_from") / width), F.floor((F.col("col_to") - 1) / width)))
    )
    a = cut.select("row", "slab", F.col("region_id").alias("a"), F.col("col_from").alias("af"), F.col("col_to").alias("at"))
    b = cut.select("row", "slab", F.col("region_id").alias("b"), F.col("col_from").alias("bf"), F.col("col_to").alias("bt"))
    lo = F.greatest("af", "bf", F.col("slab") * width)
    hi = F.least("at", "bt", (F.col("slab") + 1) * width)
    shared = (
        a.join(b, ["row", "slab"])
        .filter((F.col("a") < F.col("b")) & (hi > lo))
        .groupBy("a", "b")
        .agg(F.sum(hi - lo).alias("shared_cells"))
    )
    res = (
        shared.join(area.select(F.col("region_id").alias("a"), F.col("cells").alias("cells_a")), "a")
        .join(area.select(F.col("region_id").alias("b"), F.col("cells").alias("cells_b")), "b")
        .withColumn("share", F.col("shared_cells") / F.least("cells_a", "cells_b"))
    )
    return res.withColumn("overlaps", F.col("share") >= threshold)


def pixel_grid(regions: DataFrame, meters: float = 300, contained: bool = False) -> DataFrame:
    """Points every ``meters`` over each region's bounds (longitude x, latitude y)."""
    per_degree = 111226.26
    b = bbox(regions)
    mid = F.radians((F.col("miny") + F.col("maxy")) / 2)
    step_y = F.lit(meters / per_degree)
    step_x = F.lit(meters / per_degree) / F.cos(mid)
    count = lambda lo, hi, step: F.greatest(F.ceil((F.col(hi) - F.col(lo)) / step), F.lit(1)).cast("int")
    grid = (
        b.withColumn("step_x", step_x).withColumn("step_y", step_y)
        .withColumn("iy", F.explode(F.sequence(F.lit(0), count("miny", "maxy", F.col("step_y")) - 1)))
        .withColumn("ix", F.explode(F.sequence(F.lit(0), count("minx", "maxx", F.col("step_x")) - 1)))
        .select(
            "region_id", "iy", "ix", (F.col("minx") + F.col("ix") * F.col("step_x")).alias("x"),
            (F.col("miny") + F.col("iy") * F.col("step_y")).alias("y"),
        )
    )
    if not contained:
        return grid
    rings = regions.select("region_id", "xy")
    odd = F.sum(G.in_ring("x", "y", "xy").cast("int")) % 2 == 1
    return (
        grid.join(rings, "region_id").groupBy("region_id", "iy", "ix", "x", "y").agg(odd.alias("inside"))
        .filter("inside").drop("inside")
    )


def bbox(regions: DataFrame) -> DataFrame:
    """Bounds per region over all its rings."""
    per_ring = regions.select(
        "region_id",
        *[
            f(F.transform("xy", lambda p: p[axis])).alias(n)
            for n, axis, f in [
                ("minx", "x", F.array_min), ("miny", "y", F.array_min),
                ("maxx", "x", F.array_max), ("maxy", "y", F.array_max),
            ]
        ],
    )
    return per_ring.groupBy("region_id").agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")
    )


def region_hash(regions: DataFrame) -> DataFrame:
    """md5 over the bounds written one after the other."""
    b = bbox(regions)
    text = F.concat(*[F.col(c).cast("string") for c in ("minx", "miny", "maxx", "maxy")])
    return b.withColumn("hash", F.md5(text))


def centroid_area(regions: DataFrame) -> DataFrame:
    """Area and area centroid; ring 0 of a part adds, further rings are holes."""
    sums = regions.withColumn("s", G.ring_cross_sums("xy"))
    # Orientation-free: an outer ring counts positive, a hole negative.
    sign = F.when(F.col("s.a") < 0, -1.0).otherwise(1.0) * F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    total = sums.groupBy("region_id").agg(
        F.sum(sign * F.col("s.a")).alias("a"), F.sum(sign * F.col("s.mx")).alias("mx"),
        F.sum(sign * F.col("s.my")).alias("my"),
    )
    return total.select(
        "region_id", (F.col("a") / 2).alias("area"),
        F.try_divide(F.col("mx"), 3 * F.col("a")).alias("cx"), F.try_divide(F.col("my"), 3 * F.col("a")).alias("cy"),
    )


def combine_regions(regions: DataFrame, by: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Rings of one group renumbered as parts of one region with the first member's
    properties; groups of mixed CRS and regions without the property ``by`` come back as the
    second result.

    Rings stay one row each, so a large group is never gathered into one row.
    """
    group = F.col("props")[by]
    tagged = regions.withColumn("__g", group)
    info = tagged.groupBy("__g").agg(
        F.count_distinct("epsg").alias("n_epsg"),
        F.min(F.struct(F.col(order), "region_id")).alias("__first"),
        F.max(F.when(F.size("xy") < 4, 1).otherwise(0)).alias("not_polygon"),
    )
    good = (F.col("n_epsg") == 1) & (F.col("not_polygon") == 0)
    ok = tagged.join(info.filter(good).select("__g", "__first"), "__g")
    members = ok.select("__g", F.col(order).alias("__o"), "region_id", "part").distinct()
    parts = row_numbers(members, ["__g"], ["__o", "region_id", "part"], "__p")
    first_props = (
        ok.filter(F.col("region_id") == F.col("__first.region_id")).groupBy("__g").agg(F.first("props").alias("__props"))
    )
    combined = (
        ok.join(parts.select("__g", "region_id", "part", "__p"), ["__g", "region_id", "part"])
        .join(first_props, "__g")
        .select(
            F.col("__g").alias("region_id"), "epsg", (F.col("__p") - 1).cast("int").alias("part"), "ring", "xy",
            F.col("__props").alias("props"), F.col("region_id").alias("member_id"),
        )
    )
    rejected = tagged.join(info.filter(~good).select("__g", "n_epsg", "not_polygon"), "__g")
    # A NULL group joins nothing above.
    without = tagged.filter(F.col("__g").isNull()).select(
        "*", F.lit(None).cast("long").alias("n_epsg"), F.lit(None).cast("int").alias("not_polygon")
    )
    return combined, rejected.unionByName(without).withColumnRenamed("__g", by)


def _hull(xy: np.ndarray) -> np.ndarray:
    """Convex hull by monotone chain, counter-clockwise."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def chain(points):
        out: list = []
        for p in points:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts.tolist()) + chain(pts[::-1].tolist()))


def footprint(pixels: DataFrame, key: str = "cube_id", block: int = 1024) -> DataFrame:
    """Convex hull vertices of the valid pixels' outlines per scene, in grid units.

    Rows reduce to their two end cells, blocks of rows to their hull, and only
    hull vertices of blocks meet per scene.
    """
    ends = pixels.groupBy(key, "row").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    corners = ends.select(
        key, F.floor(F.col("row") / block).alias("__block"),
        F.inline(F.array(*[
            F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
            for x in (F.col("c0"), F.col("c1") + 1) for y in (F.col("row"), F.col("row") + 1)
        ])),
    )
    key_type = pixels.schema[key].dataType.simpleString()

    def block_hull(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({key: k[0], "x": h[:, 0], "y": h[:, 1]})

    def scene_hull(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({key: k[0], "vertex": np.arange(len(h), dtype="int32"), "x": h[:, 0], "y": h[:, 1]})

    blocks = map_groups(
        corners, [key, "__block"], [], T.StructType.fromDDL(f"{key} {key_type}, x double, y double"), block_hull
    )
    schema = T.StructType.fromDDL(f"{key} {key_type}, vertex int, x double, y double")
    return map_groups(blocks, [key], [], schema, scene_hull)


def footprint_regions(hull: DataFrame, key: str, transform: Sequence[float], epsg: int) -> DataFrame:
    """Hull vertices as one WGS84 ring per scene with its centroid."""
    from canopy.functions.projection import reproject

    a, b, c, d, e, f = (float(v) for v in transform)
    placed = hull.withColumn("__x", a * F.col("x") + b * F.col("y") + c).withColumn(
        "__y", d * F.col("x") + e * F.col("y") + f
    )
    placed = placed.withColumn("x", F.col("__x")).withColumn("y", F.col("__y")).drop("__x", "__y")
    ring = lambda df: df.groupBy(F.col(key).alias("region_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("vertex", "x", "y"))),
                    lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("xy")
    )
    native = ring(placed).withColumn("ring", F.lit(0))
    centre = reproject(centroid_area(native), "cx", "cy", epsg, 4326)
    return ring(reproject(placed, "x", "y", epsg, 4326)).join(
        centre.select("region_id", F.col("cx").alias("lon"), F.col("cy").alias("lat")), "region_id"
    )


def scene_extent(cubes: DataFrame) -> DataFrame:
    """Whole-unit bounds of each cube and the map request that shows it."""
    t = lambda i: F.get("transform", i)
    x = lambda c, r: t(0) * c + t(1) * r + t(2)
    y = lambda c, r: t(3) * c + t(4) * r + t(5)
    zero, w, h = F.lit(0), F.col("width"), F.col("height")
    xs = [x(c, r) for c in (zero, w) for r in (zero, h)]
    ys = [y(c, r) for c in (zero, w) for r in (zero, h)]
    whole = lambda c: c.cast("long")
    out = cubes.select(
        "cube_id", "epsg", "width", "height",
        whole(F.floor(F.least(*xs))).alias("minx"), whole(F.floor(F.least(*ys))).alias("miny"),
        whole(F.ceil(F.greatest(*xs))).alias("maxx"), whole(F.ceil(F.greatest(*ys))).alias("maxy"),
        F.greatest("width", "height").alias("size_max"),
    )
    request = F.to_json(F.struct(
        F.concat(F.lit("EPSG:"), F.col("epsg").cast("string")).alias("crs"),
        F.concat_ws(",", "minx", "miny", "maxx", "maxy").alias("bbox"),
        F.col("width").alias("width"), F.col("height").alias("height"),
        F.lit("PNG").alias("format"), F.lit("RGB").alias("layers"), F.lit("").alias("styles"),
        F.lit("GetMap").alias("request"), F.lit("WMS").alias("service"), F.lit("1.3").alias("version"),
        F.lit("true").alias("transparent"),
    ))
    return out.withColumn("request", request)
