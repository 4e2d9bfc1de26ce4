"""Ordered computations that never sort one whole group in one task.

A plain window over a hot key sends all its rows to a single task. Here rows
are first cut into order-consistent buckets: the window runs inside
``(keys, bucket)``, and only one summary row per bucket is ordered per key.
The bucket must not decrease along the first order column; when none is given,
splitters come from a quantile sketch of that column, four times as many as the session
has shuffle partitions. Sketch error only moves rows between buckets, results stay exact.
Keys and bucket travel as one struct: rows with NULL keys meet their own group, and the way
back to the rows is a plain equi-join, which reuses the window's partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.window import WindowSpec

BUCKET = "__bucket"
KEY = "__key"


def bucket_count(spark: SparkSession) -> int:
    """Buckets for one key: more than partitions, so that a key alone still fills the cluster."""
    return max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def how_many_below(cuts: Column, value: Column, most: int) -> Column:
    """How many of the ascending ``cuts``, at most ``most``, lie at or below ``value``: a search by halves."""
    steps = F.array(*[F.lit(1 << i) for i in range(most.bit_length() - 1, -1, -1)])
    fits = lambda at, step: (at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= value)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))


def bucket_by_splits(df: DataFrame, col: str, parts: int | None = None) -> DataFrame:
    """Add ``__bucket``: how many of ``parts - 1`` splitters lie at or below ``col``."""
    parts = parts or bucket_count(df.sparkSession)
    probs = [i / parts for i in range(1, parts)]
    number = F.col(col).cast("double")
    splits = df.agg(F.percentile_approx(number, probs, max(2000, 32 * parts)).alias("__splits")).scalar()
    # A scalar subquery of parts - 1 numbers: its size does not depend on the data.
    below = how_many_below(F.coalesce("__splits", F.array().cast("array<double>")), number, parts)
    return df.withColumn("__splits", splits).withColumn(BUCKET, below).drop("__splits")


def _bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None) -> DataFrame:
    """Rows with ``__key``: their keys and bucket."""
    if bucket is None:
        df = bucket_by_splits(df, order[0])
    else:
        # Rows without an order value come first, so their bucket lies below all others.
        df = df.withColumn(BUCKET, F.coalesce(bucket.cast("long"), F.lit(-(1 << 62))))
    return df.withColumn(KEY, F.struct(*keys, BUCKET)).drop(BUCKET)


def _across(keys: Sequence[str]) -> WindowSpec:
    """The buckets of a key in order."""
    return W.partitionBy(*[F.col(f"{KEY}.`{k}`") for k in keys]).orderBy(f"{KEY}.{BUCKET}")


def _order(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    out: str = "rn",
    bucket: Column | None = None,
) -> DataFrame:
    """1-based row number per key, exact, computed in two levels."""
    keys = list(keys)
    b = _bucketed(df, keys, order, bucket)
    counts = b.groupBy(KEY).agg(F.count(F.lit(1)).alias("__n"))
    before = _across(keys).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(KEY, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inner = W.partitionBy(KEY).orderBy(*_order(order))
    numbered = b.withColumn("__place", F.row_number().over(inner))
    return numbered.join(starts, KEY).withColumn(out, F.col("__start") + F.col("__place")).drop("__start", "__place", KEY)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    value: Column,
    out: str,
    bucket: Column | None = None,
) -> DataFrame:
    """Inclusive cumulative sum of ``value`` in order."""
    keys = list(keys)
    b = _bucketed(df, keys, order, bucket).withColumn("__v", value)
    sums = b.groupBy(KEY).agg(F.sum("__v").alias("__n"))
    before = _across(keys).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(KEY, F.sum("__n").over(before).alias("__start"))
    inner = W.partitionBy(KEY).orderBy(*_order(order)).rowsBetween(W.unboundedPreceding, 0)
    summed = b.withColumn("__cum", F.sum("__v").over(inner))
    return (
        summed.join(starts, KEY)
        .withColumn(out, F.coalesce(F.col("__start"), F.lit(0)) + F.col("__cum"))
        .drop("__start", "__cum", "__v", KEY)
    )


def fill(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
    inclusive: bool = True,
    bucket: Column | None = None,
) -> DataFrame:
    """Nearest non-null value at or before each row (``before``) and at or after it
    (``after``), all in one pass; ``inclusive=False`` leaves the row itself out."""
    keys, before, after = list(keys), dict(before or {}), dict(after or {})
    b = _bucketed(df, keys, order, bucket)
    for n, v in (before | after).items():
        b = b.withColumn(f"__v_{n}", v)
    edge = 0 if inclusive else 1
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    here = lambda n: F.when(F.col(f"__v_{n}").isNotNull(), at)
    summary = b.groupBy(KEY).agg(
        *[F.max_by(f"__v_{n}", here(n)).alias(f"__e_{n}") for n in before],
        *[F.min_by(f"__v_{n}", here(n)).alias(f"__e_{n}") for n in after],
    )
    across = _across(keys)
    past, future = across.rowsBetween(W.unboundedPreceding, -1), across.rowsBetween(1, W.unboundedFollowing)
    summary = summary.select(
        KEY,
        *[F.last(f"__e_{n}", True).over(past).alias(f"__c_{n}") for n in before],
        *[F.first(f"__e_{n}", True).over(future).alias(f"__c_{n}") for n in after],
    )
    up = W.partitionBy(KEY).orderBy(*order).rowsBetween(W.unboundedPreceding, -edge)
    # Reading the order backwards keeps the frame growing one row at a time.
    down = W.partitionBy(KEY).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(
        W.unboundedPreceding, -edge
    )
    for names, w in ((before, up), (after, down)):
        for n in names:
            b = b.withColumn(f"__i_{n}", F.last(f"__v_{n}", True).over(w))
    res = b.join(summary, KEY)
    names = [*before, *after]
    for n in names:
        res = res.withColumn(n, F.coalesce(f"__i_{n}", f"__c_{n}"))
    return res.drop(KEY, *[f"__{p}_{n}" for p in "vic" for n in names])
