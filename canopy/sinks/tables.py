"""Written results: pixel tables, detection reports, GeoJSON, map tiles."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from canopy.functions.geometry import lonlat_to_tile, tile_bounds
from canopy.schemas import CLUSTERS_OUT, DETECTIONS_OUT, TRACKS_OUT


def _present(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    """The partitions of a written table; None where there is no table yet."""
    try:
        return spark.read.parquet(path).select(*keys).distinct()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_pixels(df: DataFrame, path: str, partition_by: Sequence[str] = ("index", "year"), overwrite: bool = False) -> None:
    """Parquet by index and year. Of results that exist already only the partitions of
    ``df`` that are new are added; ``overwrite`` replaces those that are present, and no others.

    Files of a partition follow blocks of the grid, and the tile where there is one.
    """
    keys = list(partition_by)
    blocks = [F.floor(F.col(c) / 1024) for c in ("row", "col") if c in df.columns]
    rows = df
    if not overwrite and (present := _present(df.sparkSession, path, keys)) is not None:
        rows = rows.alias("n").join(
            present.alias("p"), functools.reduce(lambda a, b: a & b, [F.col(f"n.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]), "left_anti"
        )
    if blocks:
        rows = rows.repartition(*keys, *[F.col("tile")] * ("tile" in df.columns), *blocks)
    writer = rows.write.partitionBy(*keys)
    if overwrite:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def _in_columns(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ("video_id",)) -> DataFrame:
    """The report's columns in order, missing ones empty; arrays as text."""
    types = dict(df.dtypes)

    def col(n: str) -> Column:
        if n not in types:
            return F.lit(None).cast("string").alias(n)
        if types[n].startswith("array"):
            return F.array_join(F.transform(n, lambda v: v.cast("string")), ",").alias(n)
        return F.col(n)

    return df.select(*[c for c in keep if c in types], *[col(n) for n in names])


def write_detections_csv(
    path: str, detections: DataFrame, tracks: DataFrame | None = None, clusters: DataFrame | None = None
) -> None:
    """``detections``, ``tracks`` and ``clusters`` folders of CSV with fixed column order."""
    for name, df, cols in (("detections", detections, DETECTIONS_OUT), ("tracks", tracks, TRACKS_OUT), ("clusters", clusters, CLUSTERS_OUT)):
        if df is not None:
            _in_columns(df, cols).write.mode("overwrite").csv(f"{path}/{name}", header=True)


def as_features(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One GeoJSON feature per located row; every other column is a property."""
    props = F.struct(*[F.col(c) for c in df.columns if c not in (lat, lon)])
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), props.alias("properties"))
    return df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.to_json(feature).alias("value"))


def write_geojson(df: DataFrame, path: str, lat: str = "lat", lon: str = "lon") -> None:
    """Newline-delimited features, written in parallel."""
    as_features(df, lat, lon).write.mode("overwrite").text(path)


def tile_features(df: DataFrame, zoom: int = 14, chunk: int = 4096) -> DataFrame:
    """Features by web tile, TMS row counted from the south.

    A tile's features come in chunks of at most about ``chunk``, so a tile holding much
    of the data is several rows instead of one huge one.
    """
    located = df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    t = lonlat_to_tile("lon", "lat", zoom)
    tagged = located.withColumn("__t", t).withColumn("x", F.col("__t.x")).withColumn("y", F.col("__t.y")).drop("__t")
    counts = tagged.groupBy("x", "y").agg(F.count(F.lit(1)).alias("features"))
    props = F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in ("lat", "lon")]))
    rows = tagged.withColumn("properties", props).select("x", "y", "lat", "lon", "properties").join(counts, ["x", "y"])
    spread = F.pmod(F.xxhash64("lat", "lon", "properties"), F.ceil(F.col("features") / chunk)).cast("int")
    grouped = rows.withColumn("chunk", spread).groupBy("x", "y", "chunk", "features").agg(
        F.sort_array(F.collect_list(F.struct("properties", "lat", "lon"))).alias("items")
    )
    return grouped.select(
        F.lit(zoom).alias("zoom"), "x", (F.lit(2**zoom - 1) - F.col("y")).alias("tms_row"), "chunk", "features", "items",
        tile_bounds("x", "y", zoom).alias("bounds"),
    )


def write_tiles(df: DataFrame, path: str, zoom: int = 14) -> None:
    tile_features(df, zoom).write.mode("overwrite").partitionBy("zoom").parquet(path)
