"""Per-pixel index statistics kept up to date as acquisitions arrive."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ("year", "index", "row", "col")
FAN = 8


def _partials(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    v = F.when(~F.isnan("value"), F.col("value"))
    return batch.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2")
    ).filter("n > 0")


def _folder(path: str, level: int, first: int) -> str:
    return f"{path}/level={level}/first={first}"


def stream_index_stats(
    pixels: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = KEYS, trigger: dict | None = None, fan: int = FAN
) -> StreamingQuery:
    """Append each micro-batch's count, mean and squared deviations under ``path``.

    A batch writes its own partials (level 0); each ``fan`` folders of a level are merged into one of
    the next when the last of them is there, so a reader opens less than ``fan`` folders a level.
    Folders are named by level and first batch and never changed: a repeated batch writes the same
    again. Merged folders stay; whatever a higher level covers may be deleted later.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        partials = _partials(batch, keys)
        partials.write.mode("overwrite").parquet(_folder(path, 0, batch_id))
        level, size = 1, fan
        while (batch_id + 1) % size == 0:
            first = batch_id + 1 - size
            parts = [_folder(path, level - 1, at) for at in range(first, batch_id + 1, size // fan)]
            below = batch.sparkSession.read.schema(partials.schema).parquet(*parts)
            _merged(below, keys).write.mode("overwrite").parquet(_folder(path, level, first))
            level, size = level + 1, size * fan

    return (
        pixels.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def partial_folders(spark: SparkSession, path: str, fan: int = FAN) -> list[tuple[int, int]]:
    """``(level, first)`` of the folders that hold each batch once: those that no higher level covers."""
    there = {(r.level, r.first) for r in spark.read.parquet(path).select("level", "first").distinct().collect()}  # one row for each folder
    top = max((level for level, _ in there), default=0)
    covered = lambda level, first: any((up, first - first % fan**up) in there for up in range(level + 1, top + 1))
    return sorted(f for f in there if not covered(*f))


def index_stats(spark: SparkSession, path: str, keys: Sequence[str] = KEYS, fan: int = FAN) -> DataFrame:
    """Current mean and population standard deviation from the fewest partials."""
    parts = spark.read.parquet(path)
    chosen = [(F.col("level") == level) & (F.col("first") == first) for level, first in partial_folders(spark, path, fan)]
    return merge_partials(parts.where(reduce(Column.__or__, chosen, F.lit(False))).drop("level", "first"), keys)


def _merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact merge: deviations within parts plus those of part means around the whole mean."""
    w = W.partitionBy(*keys)  # one row per folder that touched the pixel
    whole = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    spread = parts.withColumn("__mean", whole).withColumn(
        "__d", F.col("m2") + F.col("n") * (F.col("mean") - F.col("__mean")) * (F.col("mean") - F.col("__mean"))
    )
    return spread.groupBy(*keys).agg(F.sum("n").alias("n"), F.first("__mean").alias("mean"), F.sum("__d").alias("m2"))


def merge_partials(parts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean, standard deviation and count of partials of any level."""
    return _merged(parts, keys).select(*keys, "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"), "n")


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str] = KEYS) -> None:
    """Fold all partials into one set under ``target``."""
    merged = index_stats(spark, path, keys)
    merged = merged.select(*keys, "n", "mean", (F.col("std") * F.col("std") * F.col("n")).alias("m2"))
    merged.write.mode("overwrite").parquet(_folder(target, 0, 0))
