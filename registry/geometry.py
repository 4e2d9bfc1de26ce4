"""Projections, tiles and polygon measures."""

from pyspark.sql import functions as F

from canopy.functions import geometry as G
from canopy.functions.projection import reproject
from canopy.operators import regions as R
from registry.core import query


@query("utm_epsg", "k:i epsg:i",
       """SELECT k, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CASE
            WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32
            WHEN lat >= 72 AND lat <= 84 AND lon >= 0 AND lon < 9 THEN 31 WHEN lat >= 72 AND lat <= 84 AND lon >= 9 AND lon < 21 THEN 33
            WHEN lat >= 72 AND lat <= 84 AND lon >= 21 AND lon < 33 THEN 35 WHEN lat >= 72 AND lat <= 84 AND lon >= 33 AND lon < 42 THEN 37
            ELSE CAST(floor((lon + 180) / 6) + 1 AS INT) END AS epsg
          FROM (SELECT o_orderkey AS k, o_orderkey % 359 - 179.5::DOUBLE AS lon, o_custkey % 160 - 79.5::DOUBLE AS lat FROM orders)""")
def _(t):
    o = t.raw("orders").select(
        F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 359 - 179.5).alias("lon"), (F.col("o_custkey") % 160 - 79.5).alias("lat")
    )
    return o.withColumn("epsg", G.utm_epsg("lon", "lat"))


@query("epsg_of_tile", "item_no:i epsg:i",
       """SELECT item_no, CASE WHEN item_no % 2 = 0 THEN 32600 ELSE 32700 END + CAST(substr(tile0, 2, 2) AS INT) AS epsg FROM scenes""")
def _(t):
    from canopy.operators.catalog import with_tile_id

    s = with_tile_id(t.scenes)
    tile = F.when(F.col("item_no") % 2 == 0, F.col("tile")).otherwise(F.concat(F.substring("tile", 2, 2), F.lit("MLA")))
    return s.withColumn("epsg", G.epsg_of_tile(tile))


@query("parse_epsg", "k:i epsg:n",
       """SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 3 THEN 4326 WHEN 5 THEN NULL ELSE 32600 + o_custkey % 60 END AS epsg FROM orders""")
def _(t):
    c, k = (32600 + F.col("o_custkey") % 60).cast("string"), F.col("o_orderkey")
    text = (
        F.when(k % 6 == 0, c).when(k % 6 == 1, F.concat(F.lit("EPSG:"), c)).when(k % 6 == 2, F.concat(F.lit(" epsg:"), c))
        .when(k % 6 == 3, "urn:ogc:def:crs:OGC:1.3:CRS84").when(k % 6 == 4, F.concat(F.lit("urn:ogc:def:crs:EPSG::"), c))
        .otherwise("local")
    )
    text = F.when(k % 12 == 3, "CRS84").when(k % 12 == 9, "urn:ogc:def:crs:OGC::CRS84").otherwise(text)
    return t.raw("orders").select(k.alias("k"), G.parse_epsg(text).alias("epsg"))


ROUND_TRIP = "SELECT event_id, 24 + (event_id % 11)::DOUBLE / 10 AS x, 54 + (event_id % 7)::DOUBLE / 5 AS y FROM events"


def _lonlat(t):
    e = F.col("event_id")
    return t.raw("events").select("event_id", (24 + (e % 11) / 10).alias("x"), (54 + (e % 7) / 5).alias("y"))


@query("reproject_utm_round_trip", "event_id:i x:d y:d", ROUND_TRIP)
def _(t):
    return reproject(reproject(_lonlat(t), "x", "y", 4326, 32635), "x", "y", 32635, 4326)


@query("reproject_lks_round_trip", "event_id:i x:d y:d", ROUND_TRIP)
def _(t):
    return reproject(reproject(_lonlat(t), "x", "y", 4326, 3346), "x", "y", 3346, 4326)


@query("reproject_mercator", "event_id:i x:d y:d",
       f"""SELECT event_id, 6378137.0::DOUBLE * radians(x) AS x, 6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(y) / 2)) AS y FROM ({ROUND_TRIP})""")
def _(t):
    return reproject(_lonlat(t), "x", "y", 4326, 3857)


# The classic transverse Mercator series of the printed manuals, zone 35.
UTM_SERIES = f"""SELECT event_id,
     round(500000 + 0.9996::DOUBLE * nu * (A + (1 - T + C) * pow(A, 3) / 6 + (5 - 18 * T + T * T + 72 * C - 58 * ep) * pow(A, 5) / 120), 0) AS x,
     round(0.9996::DOUBLE * (M + nu * tan(p) * (A * A / 2 + (5 - T + 9 * C + 4 * C * C) * pow(A, 4) / 24
       + (61 - 58 * T + T * T + 600 * C - 330 * ep) * pow(A, 6) / 720)), 0) AS y
   FROM (SELECT *, 6378137.0::DOUBLE / sqrt(1 - e2 * pow(sin(p), 2)) AS nu, pow(tan(p), 2) AS T, ep * pow(cos(p), 2) AS C, radians(x - 27) * cos(p) AS A,
       6378137.0::DOUBLE * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * pow(e2, 3) / 256) * p - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * pow(e2, 3) / 1024) * sin(2 * p)
         + (15 * e2 * e2 / 256 + 45 * pow(e2, 3) / 1024) * sin(4 * p) - (35 * pow(e2, 3) / 3072) * sin(6 * p)) AS M
     FROM (SELECT event_id, x, radians(y) AS p, 0.0066943799901413165::DOUBLE AS e2, 0.006739496742276434::DOUBLE AS ep FROM ({ROUND_TRIP})))"""


@query("reproject_utm", "event_id:i x:d y:d", UTM_SERIES)
def _(t):
    out = reproject(_lonlat(t), "x", "y", 4326, 32635)
    return out.select("event_id", F.round("x", 0).alias("x"), F.round("y", 0).alias("y"))


@query("bbox", "region_id:s minx:d miny:d maxx:d maxy:d",
       "SELECT region_id, cx - h AS minx, cy - h AS miny, cx + h AS maxx, cy + h AS maxy FROM regions")
def _(t):
    return R.bbox(t.regions)


@query("region_hash", "region_id:s hash:s",
       """SELECT region_id, md5(a || b || c || d) AS hash FROM (
            SELECT region_id, CAST(CAST(cx AS BIGINT) - h AS VARCHAR) AS a, CAST(CAST(cy AS BIGINT) - h AS VARCHAR) AS b,
                   CAST(CAST(cx AS BIGINT) + h AS VARCHAR) AS c, CAST(CAST(cy AS BIGINT) + h AS VARCHAR) AS d FROM regions)""")
def _(t):
    whole = F.transform("xy", lambda p: F.struct(F.rint(p["x"]).alias("x"), F.rint(p["y"]).alias("y")))
    return R.region_hash(t.regions.withColumn("xy", whole))


@query("centroid_area", "region_id:s area:d cx:d cy:d",
       "SELECT region_id, CASE WHEN n % 2 = 0 THEN 4 ELSE 2 END * h * h AS area, cx, cy FROM regions")
def _(t):
    return R.centroid_area(t.regions)


@query("combine_regions", "region_id:s part:i member_id:s first_order:i",
       """SELECT CAST(n % 4 AS VARCHAR) AS region_id, row_number() OVER (PARTITION BY n % 4 ORDER BY n) - 1 AS part,
                 region_id AS member_id, min(n) OVER (PARTITION BY n % 4) AS first_order FROM regions WHERE n % 4 <> 3""")
def _(t):
    mixed = F.when((F.col("props")["group"] == "3") & (F.col("props")["order"] == "7"), 3346).otherwise(F.col("epsg"))
    r = t.regions.withColumn("epsg", mixed).withColumn("order", F.col("props")["order"].cast("int"))
    combined, _ = R.combine_regions(r, "group", "order")
    return combined.withColumn("first_order", F.col("props")["order"])


@query("combine_regions_rejects", "region_id:s",
       "SELECT region_id FROM regions WHERE n % 4 = 3")
def _(t):
    mixed = F.when((F.col("props")["group"] == "3") & (F.col("props")["order"] == "7"), 3346).otherwise(F.col("epsg"))
    r = t.regions.withColumn("epsg", mixed).withColumn("order", F.col("props")["order"].cast("int"))
    return R.combine_regions(r, "group", "order")[1]


@query("combine_regions_without_group", "region_id:s without:i",
       "SELECT region_id, CAST(n % 5 = 0 AS INT) AS without FROM regions WHERE n % 5 = 0 OR n % 4 = 3")
def _(t):
    gone = F.map_filter("props", lambda k, v: (k != "group") | (F.col("props")["order"].cast("int") % 5 != 0))
    mixed = F.when((F.col("props")["group"] == "3") & (F.col("props")["order"].cast("int") % 8 == 7), 3346).otherwise(F.col("epsg"))
    r = t.regions.withColumn("epsg", mixed).withColumn("order", F.col("props")["order"].cast("int")).withColumn("props", gone)
    return R.combine_regions(r, "group", "order")[1].withColumn("without", F.col("group").isNull())


@query("footprint", "cube_id:s vertex:i x:d y:d")
def _(t):
    from canopy.functions.spectral import is_valid

    return R.footprint(t.spectra.filter(is_valid("spectrum", 31.5)), block=4)


@query("scene_extent", "cube_id:s minx:i miny:i maxx:i maxy:i size_max:i",
       """SELECT cube_id, CAST(floor(500000.3::DOUBLE) AS INT) AS minx, CAST(floor(6000000.7::DOUBLE - 2.5::DOUBLE * h) AS INT) AS miny,
                 CAST(ceil(500000.3::DOUBLE + 2.5::DOUBLE * w) AS INT) AS maxx, 6000001 AS maxy, greatest(w, h) AS size_max
          FROM (SELECT cube_id, max(col) + 1 AS w, max("row") + 1 AS h FROM spectra GROUP BY cube_id)""")
def _(t):
    cubes = t.spectra.groupBy("cube_id").agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"))
    cubes = cubes.withColumn("epsg", F.lit(32635)).withColumn(
        "transform", F.array(*[F.lit(v) for v in (2.5, 0.0, 500000.3, 0.0, -2.5, 6000000.7)])
    )
    return R.scene_extent(cubes)


PAIR = """SELECT event_id, 54 + (event_id % 7)::DOUBLE / 5 AS a, 24 + (event_id % 11)::DOUBLE / 10 AS b,
                 54 + (event_id % 13)::DOUBLE / 7 AS c, 24 + (event_id % 5)::DOUBLE / 3 AS d FROM events"""


def _pair(t):
    e = F.col("event_id")
    return t.raw("events").select(
        "event_id", (54 + (e % 7) / 5).alias("a"), (24 + (e % 11) / 10).alias("b"), (54 + (e % 13) / 7).alias("c"), (24 + (e % 5) / 3).alias("d")
    )


@query("haversine_m", "event_id:i m:d",
       f"""SELECT event_id, 2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(c - a) / 2), 2)
             + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))) AS m FROM ({PAIR})""")
def _(t):
    return _pair(t).withColumn("m", G.haversine_m("a", "b", "c", "d"))


@query("local_offset_m", "event_id:i east:d north:d",
       f"""SELECT event_id, (d - b) * 111320.0::DOUBLE * cos(radians((a + c) / 2)) AS east, (c - a) * 111320.0::DOUBLE AS north FROM ({PAIR})""")
def _(t):
    return _pair(t).select("event_id", G.local_offset_m("c", "d", "a", "b").alias("o")).select("event_id", "o.*")


@query("to_local_m", "video_id:s frame:i east:d north:d",
       """SELECT video_id, frame, (lon - lon0) * 111320.0::DOUBLE * cos(radians(lat0)) AS east, (lat - lat0) * 111320.0::DOUBLE AS north
          FROM telemetry JOIN (SELECT video_id, lat AS lat0, lon AS lon0 FROM telemetry WHERE frame = 0) USING (video_id)""")
def _(t):
    origin = t.telemetry.groupBy("video_id").agg(F.min_by(F.struct("lat", "lon"), "frame").alias("o"))
    o = t.telemetry.join(origin, "video_id")
    return o.select("video_id", "frame", G.to_local_m("lat", "lon", "o.lat", "o.lon").alias("m")).select("video_id", "frame", "m.*")


@query("lonlat_to_tile", "event_id:i x:i y:i",
       f"""SELECT event_id, CAST(floor((b + 180) / 360 * 16384) AS INT) AS x,
             CAST(floor((1 - asinh(tan(radians(a))) / pi()) / 2 * 16384) AS INT) AS y FROM ({PAIR})""")
def _(t):
    return _pair(t).select("event_id", G.lonlat_to_tile("b", "a", 14).alias("t")).select("event_id", "t.*")


@query("tile_bounds", "event_id:i lon_min:d lat_min:d lon_max:d lat_max:d",
       f"""SELECT event_id, x / 1024.0::DOUBLE * 360 - 180 AS lon_min, degrees(2 * atan(exp(pi() * (1 - 2 * (y + 1) / 1024.0::DOUBLE))) - pi() / 2) AS lat_min,
             (x + 1) / 1024.0::DOUBLE * 360 - 180 AS lon_max, degrees(2 * atan(exp(pi() * (1 - 2 * y / 1024.0::DOUBLE))) - pi() / 2) AS lat_max
           FROM (SELECT event_id, floor((b + 180) / 360 * 1024) AS x, floor((1 - asinh(tan(radians(a))) / pi()) / 2 * 1024) AS y FROM ({PAIR}))""")
def _(t):
    tiles = _pair(t).select("event_id", G.lonlat_to_tile("b", "a", 10).alias("t"))
    return tiles.select("event_id", G.tile_bounds("t.x", "t.y", 10).alias("b")).select("event_id", "b.*")
