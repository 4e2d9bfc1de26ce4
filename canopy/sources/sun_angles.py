"""Sun-angle grids of satellite granule metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_VALUES = "struct<Values_List:struct<VALUES:array<string>>>"

# Fixed value: a square grid of this size has its last row and column dropped.
FULL_GRID = 23


def read_sun_angles(spark: SparkSession, path: str, row_tag: str = "Sun_Angles_Grid") -> DataFrame:
    """``tile, acq_date, kind, grid_row, grid_col, value`` per granule; tile and date from the path."""
    grids = (
        spark.read.format("xml").option("rowTag", row_tag).option("recursiveFileLookup", "true")
        .schema(f"Zenith {_VALUES}, Azimuth {_VALUES}").load(path)
    )
    file = F.col("_metadata.file_path")
    tile = F.regexp_extract(file, r"_(T[0-9A-Z]{5})(?:_|\.|/)", 1)
    day = F.regexp_extract(file, r"_(\d{8})(?:T\d{6})?(?:_|\.)", 1)
    kinds = F.array(*[
        F.struct(F.lit(k.lower()).alias("kind"), F.col(f"{k}.Values_List.VALUES").alias("lines")) for k in ("Zenith", "Azimuth")
    ])
    rows = grids.select(
        tile.alias("tile"), F.try_to_timestamp(day, F.lit("yyyyMMdd")).cast("date").alias("acq_date"), F.inline(kinds)
    )
    rows = rows.withColumn("n", F.size("lines")).select("tile", "acq_date", "kind", "n", F.posexplode("lines").alias("grid_row", "line"))
    values = F.split(F.trim("line"), r"\s+")
    cells = rows.withColumn("m", F.size(values)).select(
        "tile", "acq_date", "kind", "grid_row", "n", "m", F.posexplode(values).alias("grid_col", "value")
    )
    full = (F.col("n") == FULL_GRID) & (F.col("m") == FULL_GRID)
    inside = ~full | ((F.col("grid_row") < FULL_GRID - 1) & (F.col("grid_col") < FULL_GRID - 1))
    return cells.filter(inside).select(
        "tile", "acq_date", "kind", "grid_row", "grid_col", F.col("value").try_cast("double").alias("value")
    )
