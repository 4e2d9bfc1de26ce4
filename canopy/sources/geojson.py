"""Region and scene catalogues saved as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from canopy.functions.geometry import parse_epsg
from canopy.schemas import SCENES

_FEATURE = """type string, id string, properties map<string,string>, prop map<string,string>,
              geometry struct<type:string, coordinates:string>"""


def read_regions_geojson(spark: SparkSession, path: str, lines: bool = False, default_epsg: int = 4326) -> DataFrame:
    """Rings of every polygon (or single points) with the feature's properties.

    A file holds a collection, or with ``lines`` one feature per line, which Spark splits.
    Coordinates are kept as text first because their depth depends on the type.
    """
    crs = T.StructType.fromDDL("crs struct<properties:struct<name:string>>")
    schema = _item_or_collection(T.StructType.fromDDL(_FEATURE), crs.fields)
    raw = spark.read.schema(schema).json(path, multiLine=not lines)
    one = F.struct("type", "id", "properties", "prop", "geometry")
    items = F.when(F.col("features").isNotNull(), F.col("features")).otherwise(F.array(one))
    feats = raw.select(
        F.col("_metadata.file_path").alias("__file"),
        F.coalesce(parse_epsg("crs.properties.name"), F.lit(default_epsg)).alias("epsg"),
        F.posexplode(items).alias("__no", "f"),
    )
    geo, coords = F.lower("f.geometry.type"), F.col("f.geometry.coordinates")
    point = "array<double>"
    parts = (
        F.when(geo == "polygon", F.array(F.from_json(coords, f"array<array<{point}>>")))
        .when(geo == "multipolygon", F.from_json(coords, f"array<array<array<{point}>>>"))
        .when(geo == "point", F.array(F.array(F.array(F.from_json(coords, point)))))
    )
    named = feats.select(
        F.coalesce("f.id", "f.properties.region_id", F.concat_ws("#", "__file", F.col("__no").cast("string"))).alias("region_id"),
        "epsg", F.coalesce("f.properties", "f.prop").alias("props"), parts.alias("parts"),
    )
    rings = named.select("region_id", "epsg", "props", F.posexplode("parts").alias("part", "rings")).select(
        "region_id", "epsg", "props", "part", F.posexplode("rings").alias("ring", "points")
    )
    xy = F.transform("points", lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    return rings.select("region_id", "epsg", "part", "ring", xy.alias("xy"), "props")


def _item_or_collection(item: T.StructType, extra: list[T.StructField] = ()) -> T.StructType:
    """Fields of one item beside a ``features`` array of the same items."""
    return T.StructType([*item.fields, *extra, T.StructField("features", T.ArrayType(item))])


_ITEM = """id string, collection string, bbox array<double>, assets map<string,struct<href:string>>,
           properties struct<datetime:timestamp, `eo:cloud_cover`:double, `sar:instrument_mode`:string,
                             `sat:orbit_state`:string, `sar:polarizations`:array<string>>"""


def read_stac_items(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Scenes from saved catalogue items: an array, a collection, or one item per line."""
    schema = _item_or_collection(T.StructType.fromDDL(_ITEM))
    raw = spark.read.schema(schema).json(path, multiLine=not lines)
    one = F.struct("id", "collection", "bbox", "assets", "properties")
    items = F.when(F.col("features").isNotNull(), F.col("features")).otherwise(F.array(one))
    i = raw.select(F.explode(items).alias("i"))
    p = lambda n: F.col("i.properties").getField(n)
    box = F.struct(*[F.get("i.bbox", k).alias(n) for k, n in enumerate(("minx", "miny", "maxx", "maxy"))])
    scenes = i.select(
        F.col("i.id").alias("scene_id"), F.col("i.collection").alias("collection"), p("datetime").alias("datetime"),
        p("eo:cloud_cover").alias("cloud_cover"), p("sar:instrument_mode").alias("instrument_mode"),
        p("sat:orbit_state").alias("orbit_state"), box.alias("bbox"), F.col("i.assets").alias("assets"),
        p("sar:polarizations").alias("polarisations"),
    )
    return scenes.select(*SCENES.fieldNames(), "polarisations")
