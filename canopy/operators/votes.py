"""Running class votes as a segmented scan: pieces of a key are folded apart and composed.

What a vote shows after a row depends on the class shown before it and on the scores of all classes,
which are sums. So a piece of rows, given the scores at its start, is a map from the class shown
before it to the class shown after each of its rows, with one entry for each class. Pieces yield
these maps on all tasks; maps are composed in blocks of pieces, and blocks along the key. Inside a
piece scores add up row by row, as one pass would add them; across pieces sums are added.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from canopy.operators.ordered import row_numbers
from canopy.session import cut_lineage, passing

PIECE = 512


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), fn), 0)


def _outcomes(rows: Column, scores: Column, hits: Column, margin: float, min_hits: int) -> Column:
    """For each row the class (its index) shown after it, by the class shown before the piece."""
    same = F.transform(scores, lambda _, i: i)
    none = F.array().cast("array<array<int>>")

    def step(acc: Column, row: Column) -> Column:
        added = lambda c, by: F.transform(acc[c], lambda v, i: F.when(i == row["i"], v + by).otherwise(v))

        def shown(now: Column) -> Column:
            lead = (F.array_position(now["s"], F.array_max(now["s"])) - 1).cast("int")

            def moved(top: Column) -> Column:
                wins = lambda x: (top != x) & (F.get(now["h"], top) >= min_hits) & (F.get(now["s"], top) >= F.get(now["s"], x) + F.lit(margin))
                return F.transform(acc["m"], lambda x: F.when(wins(x), top).otherwise(x))

            return _let(_let(lead, moved), lambda m: F.struct(
                now["s"].alias("s"), now["h"].alias("h"), m.alias("m"), F.concat(acc["o"], F.array(m)).alias("o")
            ))

        return _let(F.struct(added("s", row["conf"]).alias("s"), added("h", F.lit(1).cast("long")).alias("h")), shown)

    start = F.struct(scores.alias("s"), hits.alias("h"), same.alias("m"), none.alias("o"))
    return F.aggregate(rows, start, step, lambda acc: acc["o"])


def _composed(maps: Column, first: Column) -> Column:
    """The map before each of ``maps`` and after the last, beginning with ``first``."""
    step = lambda acc, m: F.concat(acc, F.array(F.transform(F.element_at(acc, -1), lambda x: F.get(m, x))))
    return F.aggregate(maps, F.array(first), step)


def _sorted(by: str, value: str) -> Column:
    """``value`` of a group's rows in order of ``by``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(by, value))), lambda p: p[value])


def scan_votes(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, cls: Column, conf: Column,
    margin: float, min_hits: int, out: str, piece: int = PIECE,
) -> DataFrame:
    """``df`` with ``out``: the class that the running vote of its key shows after each row.

    The first class of a key is shown first; another one is shown when it leads (on a tie the one
    seen earlier), has ``min_hits`` rows and at least ``margin`` more than the one shown. ``bucket``
    must not decrease along ``order``. A task holds ``piece`` rows of a key.
    """
    names, keys = df.columns, list(keys)
    voted = df.withColumn("__cls", cls).withColumn("__conf", conf)
    numbered = row_numbers(voted, keys, order, "__rn", bucket).withColumn("__key", F.struct(*keys))
    numbered = numbered.withColumn("__piece", F.floor((F.col("__rn") - 1) / piece))
    row = F.struct("__rn", "__cls", F.col("__conf").alias("conf"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    by_number = lambda a, b: (a["__rn"] - b["__rn"]).cast("int")  # the rest of a row need not be comparable
    with passing(df.sparkSession) as lasting:  # pieces go when what they tell is written
        pieces = cut_lineage(numbered.groupBy("__key", "__piece").agg(F.array_sort(F.collect_list(row), by_number).alias("rows")))
        single = pieces.select("__key", "__piece", F.explode("rows").alias("r")).select("__key", "__piece", "r.__rn", "r.__cls", F.col("r.conf").alias("__conf"))

        # Classes of a key as they were first seen; every class has a sum at every piece.
        votes = single.groupBy("__key", "__piece", "__cls").agg(
            F.sum("__conf").alias("s"), F.count(F.lit(1)).alias("h"), F.min("__rn").alias("first")
        )
        seen = votes.groupBy("__key", "__cls").agg(F.min("first").alias("first"))
        classes = seen.groupBy("__key").agg(_sorted("first", "__cls").alias("classes"))
        all_sums = (
            votes.select("__key", "__piece").distinct().join(classes, "__key").select("__key", "__piece", F.posexplode("classes").alias("i", "__cls"))
            .join(votes.drop("first"), ["__key", "__piece", "__cls"], "left")
        )
        before = W.partitionBy("__key", "i").orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
        upto = lambda c, zero: F.coalesce(F.sum(F.coalesce(c, zero)).over(before), zero).alias(c)
        starts = all_sums.select("__key", "__piece", "i", upto("s", F.lit(0.0)), upto("h", F.lit(0).cast("long")))
        starts = starts.groupBy("__key", "__piece").agg(_sorted("i", "s").alias("s"), _sorted("i", "h").alias("h"))

        indexed = F.transform("rows", lambda r: F.struct((F.array_position("classes", r["__cls"]) - 1).cast("int").alias("i"), r["conf"].alias("conf")))
        told = pieces.join(starts, ["__key", "__piece"]).join(classes, "__key").withColumn("o", _outcomes(indexed, F.col("s"), F.col("h"), margin, min_hits))
        told = lasting(told.drop("s", "h").withColumn("__block", F.floor(F.col("__piece") / piece)))

    # The class shown before each piece: maps composed inside blocks, then blocks along the key from its first class.
    last = told.select("__key", "__block", "__piece", F.element_at("o", -1).alias("m"))
    inside = last.groupBy("__key", "__block").agg(_sorted("__piece", "m").alias("maps"))
    same = F.transform(F.get("maps", 0), lambda _, i: i)
    inside = inside.withColumn("maps", _composed(F.col("maps"), same))
    along = inside.withColumn("whole", F.element_at("maps", -1)).groupBy("__key").agg(
        F.array_sort(F.collect_list(F.struct("__block", "whole"))).alias("w")
    )
    first = F.array(F.lit(0))
    along = along.select("__key", F.posexplode(_composed(F.transform("w", lambda p: p["whole"]), first)).alias("__block", "shown"))
    shown = inside.join(along, ["__key", "__block"]).select(
        "__key", "__block", F.transform("maps", lambda m: F.get(m, F.get("shown", 0))).alias("shown")
    )
    known = told.join(shown, ["__key", "__block"]).withColumn("__now", F.get("shown", (F.col("__piece") % piece).cast("int")))
    results = F.zip_with("rows", "o", lambda r, o: F.struct(r["row"].alias("row"), F.get("classes", F.get(o, F.col("__now"))).alias("cls")))
    return known.select(F.explode(results).alias("r")).select("r.row.*", F.col("r.cls").alias(out))
