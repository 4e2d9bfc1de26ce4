"""The most central observation of each entity, by bounds on mean distances."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

KEY = "__key"
GRID = 32  # cells along the longer side of an entity's positions
BLOCK = 256  # positions compared at once
BLOCKS = 64  # blocks that one salt holds


def _total(cells: Column, y: Column, x: Column, more: Callable[[Column], Column] = lambda b: F.lit(0.0)) -> Column:
    """Sum of the distances from (y, x) to weighted places, with ``more`` added to their squares."""
    off = lambda b: F.sqrt((y - b["y"]) * (y - b["y"]) + (x - b["x"]) * (x - b["x"]) + more(b))
    return F.aggregate(cells, F.lit(0.0), lambda s, b: s + b["m"] * off(b))


def placed(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``__key, y, x, m, first, total, n, width, cell``: one row for each position of an entity.

    ``m`` rows lie there, ``first`` being the earliest; ``total`` and ``n`` count the rows and the
    positions of the entity. Rows without a position are left out, but where an entity has no
    others they all count as lying in one place.
    """
    others = [F.col(f"`{c}`") for c in obs.columns if c not in keys]
    sound = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    keyed = obs.select(
        F.struct(*[F.col(f"`{k}`") for k in keys]).alias(KEY), sound("north").alias("north"), sound("east").alias("east"),
        F.struct("ts", "det_id").alias("early"), F.struct(*others).alias("row"),
    )
    known = F.col("north").isNotNull() & F.col("east").isNotNull()
    keyed = keyed.withColumn("north", F.when(known, F.col("north"))).withColumn("east", F.when(known, F.col("east")))
    points = keyed.groupBy(KEY, "north", "east").agg(
        F.count(F.lit(1)).alias("m"), F.min_by(F.struct("early", "row"), "early").alias("first")
    )
    here = F.col("north").isNotNull()
    extent = points.groupBy(KEY).agg(
        F.min("north").alias("n0"), F.min("east").alias("e0"),
        F.greatest(F.max("north") - F.min("north"), F.max("east") - F.min("east")).alias("size"),
        F.sum(F.when(here, F.col("m"))).alias("total"), F.count(F.when(here, 1)).alias("n"),
    )
    width = F.when(F.col("size") > 0, F.col("size") / GRID).otherwise(1.0)
    out = points.join(extent, KEY).where(here | F.col("n0").isNull()).select(
        KEY, F.coalesce(F.col("north") - F.col("n0"), F.lit(0.0)).alias("y"), F.coalesce(F.col("east") - F.col("e0"), F.lit(0.0)).alias("x"),
        "m", "first", F.coalesce("total", "m").alias("total"), F.greatest("n", F.lit(1)).alias("n"), width.alias("width"),
    )
    at = lambda c: F.floor(F.col(c) / F.col("width"))
    return out.withColumn("cell", at("y") * (GRID + 1) + at("x"))


def candidates(points: DataFrame) -> DataFrame:
    """The rows of ``placed`` that may have the least mean distance of their entity.

    A cell's points count as its weight at their mean: as distance is convex, that bounds the mean
    distance from below, and with the variance of the cells added to the squares from above. Both
    bounds move by no more than the way between two points, which rules out whole cells; the
    points of the others are held against the least upper bound of any of them.
    """
    m, y, x = F.col("m"), F.col("y"), F.col("x")
    mean = lambda v: F.sum(m * v) / F.sum(m)
    spread = lambda v: mean(v * v) - mean(v) * mean(v)
    side = F.first("width")
    # Rounding: squares of offsets within an extent of GRID widths.
    var = F.greatest(spread(y) + spread(x), F.lit(0.0)) + F.lit(1e-13 * GRID * GRID) * side * side
    cells = points.groupBy(KEY, "cell").agg(
        F.sum("m").alias("m"), mean(y).alias("y"), mean(x).alias("x"), var.alias("var"), side.alias("width")
    )
    # At most (GRID + 1) ** 2 cells.
    maps = cells.groupBy(KEY).agg(F.collect_list(F.struct("m", "y", "x", "var")).alias("cells"), F.sum("m").alias("all"))
    at_least, at_most = (
        (_total(F.col("cells"), y, x, more) / F.col("all")).alias(name)
        for name, more in (("least", lambda b: F.lit(0.0)), ("most", lambda b: b["var"]))
    )
    # Means that agree in nine digits are equal later on.
    wide = lambda c: c + F.abs(c) * 1e-9 + 2e-9
    seen = cells.join(maps, KEY).select(KEY, "cell", "width", "var", at_least, at_most)
    best = seen.groupBy(KEY).agg(wide(F.min(F.col("most") + F.sqrt("var"))).alias("best"))
    left = seen.join(best, KEY).where(F.col("least") - F.col("width") * 1.5 <= F.col("best")).select(KEY, "cell")
    near = points.join(left, [KEY, "cell"]).join(maps, KEY).select(*points.columns, at_least, at_most)
    best = near.groupBy(KEY).agg(wide(F.min("most")).alias("best"))
    return near.join(best, KEY).where("least <= best").select(*points.columns)


def medoid(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The observation with the least mean distance to those of its entity, one row an entity.

    Means count as equal when nine digits agree, as sums have no fixed order; then the first by
    ``ts`` and ``det_id`` is taken. Rows without a position take no part, but an entity that has
    no others gives its first row. Rows with null keys are entities too; an empty table gives an
    empty one.

    Bounds leave a few positions of each entity (see ``candidates``); only those are compared with
    all others, in blocks, and the blocks of a large entity are dealt to many tasks.
    """
    keys = list(keys)
    points = placed(obs, keys)
    salts = (F.floor(F.col("n") / (BLOCK * BLOCKS)) + 1).cast("int")
    block = F.pmod(F.xxhash64("y", "x"), F.floor(F.col("n") / BLOCK) + 1)
    packs = points.withColumn("block", block).withColumn("salt", F.pmod("block", salts).cast("int")).groupBy(
        KEY, "salt", "block"
    ).agg(F.collect_list(F.struct("m", "y", "x")).alias("cells"))
    asked = candidates(points).select(
        KEY, "y", "x", "first", "total", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    )
    parts = asked.join(packs.drop("block"), [KEY, "salt"]).select(
        KEY, "y", "x", "first", (_total(F.col("cells"), F.col("y"), F.col("x")) / F.col("total")).alias("part")
    )
    means = parts.groupBy(KEY, "y", "x").agg(F.sum("part").alias("d"), F.any_value("first").alias("first"))
    best = means.groupBy(KEY).agg(
        F.min_by("first.row", F.struct(F.round("d", 9).alias("d"), F.col("first.early").alias("early"))).alias("s")
    )
    return best.select(f"{KEY}.*", "s.*")
