"""Operators over gridded observations and pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from canopy.schemas import S2_BANDS

CELL = ["row", "col"]
ZONE = "epsg"


def cell_of(*frames: DataFrame) -> list[str]:
    """What names a place in all of the frames: row and column, and the zone where all have one.

    Rows and columns of two zones are different places; a frame without a zone has one grid.
    """
    return [ZONE] * all(ZONE in f.columns for f in frames) + CELL


def upsample(obs: DataFrame, factor: int) -> DataFrame:
    """Nearest-neighbour replication onto a grid ``factor`` times finer."""
    if factor < 1:
        raise ValueError("factor must be at least 1")
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    fine = obs.withColumn("__dr", F.explode(steps)).withColumn("__dc", F.explode(steps))
    return (
        fine.withColumn("row", F.col("row") * factor + F.col("__dr"))
        .withColumn("col", F.col("col") * factor + F.col("__dc"))
        .drop("__dr", "__dc")
    )


def crop_to_smallest(obs: DataFrame, keys: Sequence[str] = ("tile", "acq_date")) -> DataFrame:
    """Shift and cut each band's grid at its low end to the smallest band of the scene."""
    size = obs.groupBy(*keys, "band").agg((F.max("row") + 1).alias("__h"), (F.max("col") + 1).alias("__w"))
    w = W.partitionBy(*keys)  # one row per band
    off = size.select(
        *keys, "band", (F.col("__h") - F.min("__h").over(w)).alias("__dr"), (F.col("__w") - F.min("__w").over(w)).alias("__dc")
    )
    # One row per scene and band: sent to the pixels, as a shuffle would leave a task for each band.
    return (
        obs.join(F.broadcast(off), [*keys, "band"])
        .filter((F.col("row") >= F.col("__dr")) & (F.col("col") >= F.col("__dc")))
        .withColumn("row", F.col("row") - F.col("__dr"))
        .withColumn("col", F.col("col") - F.col("__dc"))
        .drop("__dr", "__dc")
    )


def stack_bands(
    obs: DataFrame,
    bands: Sequence[str],
    keys: Sequence[str] = ("tile", "acq_date", "row", "col"),
    order: str | None = "scene_order",
) -> DataFrame:
    """Long observations to one column per band; the last in ``order`` wins.

    Conditional aggregates over primitive buffers give one hash aggregation.
    """
    def pick(b: str) -> Column:
        here = F.col("band") == b
        if order is None:
            return F.max(F.when(here, F.col("value")))
        return F.max_by("value", F.when(here, F.col(order)))

    wanted = obs.filter(F.col("band").isin(*bands))
    return wanted.groupBy(*keys).agg(*[pick(b).alias(b) for b in bands])


def unstack_bands(pixels: DataFrame, bands: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per band from band columns."""
    doubles = pixels.select(*keys, *[F.col(b).cast("double").alias(b) for b in bands])
    return doubles.unpivot(list(keys), list(bands), "band", "value")


def roi_filter(
    pixels: DataFrame,
    landcover: DataFrame,
    classes: Sequence[int] = (24,),
    mode: str = "zero",
    values: Sequence[str] = ("value",),
) -> DataFrame:
    """Keep the values of selected land-cover classes; others become 0 or are dropped."""
    cell = cell_of(pixels, landcover)
    chosen = landcover.filter(F.col("clc").isin(*classes)).select(*cell).distinct()
    if mode == "drop":
        return pixels.join(chosen, cell, "left_semi")
    marked = pixels.join(chosen.withColumn("__in", F.lit(True)), cell, "left")
    for v in values:
        marked = marked.withColumn(v, F.when(F.col("__in"), F.col(v)).otherwise(0))
    return marked.drop("__in")


def regrid_nearest(
    landcover: DataFrame, src_height: int, src_width: int, height: int, width: int
) -> DataFrame:
    """Class raster resampled to ``height`` x ``width``, nearest cell.

    Each source cell emits the target cells whose centre falls in it, so no
    target grid is built and joined.
    """
    def targets(pos: Column, n_src: int, n_dst: int) -> Column:
        # floor((t + 0.5) * n_src / n_dst) == pos, tested on a small covering range.
        lo = F.floor(pos * n_dst / n_src).cast("int") - 1
        hi = F.ceil((pos + 1) * n_dst / n_src).cast("int") + 1
        return F.filter(
            F.sequence(lo, hi),
            lambda t: (t >= 0) & (t < n_dst) & (F.floor((t + 0.5) * n_src / n_dst) == pos),
        )

    return (
        landcover.withColumn("__r", F.explode(targets(F.col("row"), src_height, height)))
        .withColumn("__c", F.explode(targets(F.col("col"), src_width, width)))
        .withColumn("row", F.col("__r"))
        .withColumn("col", F.col("__c"))
        .drop("__r", "__c")
    )


def mosaic(obs: DataFrame, by_date: bool = True, order: str = "scene_order", bands: Sequence[str] = ()) -> DataFrame:
    """Scenes merged per date and band (or over all dates); 0 is nodata, the last scene wins.

    ``bands`` names those that most rows have: they are picked side by side, so a cell is one row of
    the aggregate and of its shuffle, not one for each band. Rows of other bands count as well.
    """
    at = (["acq_date"] if by_date else []), cell_of(obs)
    keys = [*at[0], "band", *at[1]]
    seen = obs.filter(F.col("value") != 0)
    if not bands:
        return seen.groupBy(*keys).agg(F.max_by("value", order).alias("value"))
    listed = F.coalesce(F.col("band").isin(*bands), F.lit(False))
    other = F.when(~listed, F.col("band")).alias("__other")  # null for listed ones, which have places of their own
    places = [*((F.col("band") == b, F.lit(b)) for b in bands), (~listed, F.col("__other"))]
    met = F.coalesce(*[F.when(here, F.lit(1 << i)) for i, (here, _) in enumerate(places)])
    picks = [F.max_by("value", F.when(here, F.col(order))).alias(f"__v{i}") for i, (here, _) in enumerate(places)]
    wide = seen.groupBy(*at[0], *at[1], other).agg(F.bit_or(met).alias("__met"), *picks)
    # A place that no row met is none; one whose rows have no order keeps its null.
    each = [
        F.struct(F.col("__met").bitwiseAND(1 << i).alias("__in"), name.alias("band"), F.col(f"__v{i}").alias("value"))
        for i, (_, name) in enumerate(places)
    ]
    return wide.select(*at[0], *at[1], F.inline(F.array(*each))).where("__in != 0").select(*keys, "value")


def scl_score(scl: Column | str = "scl") -> Column:
    """Usability of a scene class: 3 clear ground, 2 other data, 0 none."""
    c = F.col(scl) if isinstance(scl, str) else scl
    return F.when(c.between(4, 6), 3).when(c > 0, 2).otherwise(0)


def best_pixel_composite(
    pixels: DataFrame,
    keys: Sequence[str] = ("tile", "row", "col"),
    bands: Sequence[str] = (*S2_BANDS, "scl", "zenith", "azimuth"),
    tie: str | None = None,
) -> DataFrame:
    """Every band from the first date with the highest score of its pixel.

    Score, date and tie order are packed into one long, so all buffers are
    primitive and the aggregate stays a hash aggregate with a map-side part.
    ``tie`` must be a non-negative integer below 2**42.
    """
    days = F.datediff("acq_date", F.lit("1970-01-01").cast("date")).cast("long")
    rank = (3 - scl_score()).cast("long") * F.lit(1 << 59) + days * F.lit(1 << 42)
    if tie:
        rank = rank + F.col(tie).cast("long")
    ranked = pixels.withColumn("__rank", rank)
    picks = [F.min_by(b, "__rank").alias(b) for b in bands]
    return ranked.groupBy(*keys).agg(F.min_by("acq_date", "__rank").alias("acq_date"), *picks)


def clear_fraction(pixels: DataFrame, cells: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Share of pixels whose best score over time is clear, cloudy, or the best present."""
    if cells is not None:
        cell = cell_of(pixels, cells)
        pixels = pixels.join(cells.select(*cell).distinct(), cell, "left_semi")
    best = pixels.groupBy(*dict.fromkeys([*by, *cell_of(pixels)])).agg(F.max(scl_score()).alias("score"))
    is_score = lambda s: F.avg(F.when(F.col("score") == s, 1.0).otherwise(0.0))
    shares = best.groupBy(*by).agg(
        is_score(3).alias("clear_fraction"), is_score(2).alias("cloud_fraction"),
        is_score(0).alias("__none"), F.count(F.lit(1)).alias("n"),
    )
    top = (
        F.when(F.col("clear_fraction") > 0, F.col("clear_fraction"))
        .when(F.col("cloud_fraction") > 0, F.col("cloud_fraction"))
        .otherwise(F.col("__none"))
    )
    return shares.withColumn("best_class_fraction", top).drop("__none")


def pixel_stats(indices: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Mean and population standard deviation over dates, NaN left out."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return indices.groupBy(*(by or ["year", "index", *cell_of(indices)])).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n")
    )


def anomaly(
    indices: DataFrame, stats: DataFrame, by: Sequence[str] | None = None
) -> DataFrame:
    """``(value - mean) / std`` per pixel and date; NULL where std is 0."""
    z = F.try_divide(F.col("value") - F.col("mean"), F.col("std"))
    return indices.join(stats, list(by or ["year", "index", *cell_of(indices, stats)])).withColumn("anomaly", z)


def anomalies(
    indices: DataFrame, by: Sequence[str] | None = None, least_std: float = 1e-12
) -> DataFrame:
    """``mean``, ``std``, ``n`` and ``anomaly`` beside each value, from one scan of the rows.

    A window holds one pixel's dates. A spread up to ``least_std`` is what sums in another order
    leave where all values are equal; it counts as 0 and the anomaly is NULL.
    """
    w = W.partitionBy(*(by or ["year", "index", *cell_of(indices)]))
    spread = F.stddev_pop("value").over(w)
    out = indices.withColumn("mean", F.avg("value").over(w)).withColumn("std", F.when(spread > least_std, spread).otherwise(spread * 0))
    out = out.withColumn("n", F.count("value").over(w))
    return out.withColumn("anomaly", F.try_divide(F.col("value") - F.col("mean"), F.col("std")))


def yearly_change(stats: DataFrame) -> DataFrame:
    """Difference of each pixel's mean to the year before it in the data."""
    w = W.partitionBy("index", *cell_of(stats)).orderBy("year")  # at most one row per year
    return (
        stats.withColumn("previous_year", F.lag("year").over(w))
        .withColumn("previous_mean", F.lag("mean").over(w))
        .withColumn("change", F.col("mean") - F.col("previous_mean"))
    )


def sample_points(
    pixels: DataFrame, points: DataFrame, transform: Sequence[float], value: str = "value", nodata: float | None = None
) -> DataFrame:
    """Raster value at each point; outside the raster ``nodata`` or 0.

    ``transform`` is ``(a, b, c, d, e, f)``: x = a col + b row + c, y = d col + e row + f.
    """
    a, b, c, d, e, f = (float(v) for v in transform)
    det = a * e - b * d
    dx, dy = F.col("x") - c, F.col("y") - f
    placed = points.withColumn("col", F.floor((e * dx - b * dy) / det).cast("int")).withColumn(
        "row", F.floor((a * dy - d * dx) / det).cast("int")
    )
    cell = cell_of(placed, pixels)
    got = placed.join(pixels.select(*cell, value), cell, "left")
    return got.withColumn(value, F.coalesce(F.col(value), F.lit(nodata if nodata is not None else 0)))
