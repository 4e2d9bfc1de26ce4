"""Scene catalogue."""

from pyspark.sql import functions as F

from canopy.operators import catalog as C
from registry.core import query


@query("search_scenes", "scene_id:s datetime:ts cloud_cover:d item_no:i",
       """SELECT scene_id, datetime, cloud_cover, item_no FROM scenes
          WHERE collection = 'sentinel-2-l2a' AND datetime >= TIMESTAMP '1996-04-01' AND datetime <= TIMESTAMP '1998-09-01'
            AND minx <= 25.5 AND maxx >= 23.5 AND miny <= 55.5 AND maxy >= 53.5 AND cloud_cover < 40""")
def _(t):
    return C.search_scenes(t.scenes, "sentinel-2-l2a", "1996-04-01", "1998-09-01", (23.5, 53.5, 25.5, 55.5), 40)


@query("search_scenes_polygon", "item_no:i",
       """WITH e(x1, y1, x2, y2) AS (VALUES (21.5, 53.2, 28.4, 54.1), (28.4, 54.1, 23.3, 56.9), (23.3, 56.9, 21.5, 53.2)),
               s AS (SELECT item_no, minx, miny, minx + 1 AS maxx, miny + 1 AS maxy FROM scenes),
               c AS (SELECT s.*, e.*, (x2 - x1) * (miny - y1) - (y2 - y1) * (minx - x1) AS a, (x2 - x1) * (miny - y1) - (y2 - y1) * (maxx - x1) AS b,
                            (x2 - x1) * (maxy - y1) - (y2 - y1) * (minx - x1) AS c, (x2 - x1) * (maxy - y1) - (y2 - y1) * (maxx - x1) AS d FROM s, e)
          SELECT item_no FROM c GROUP BY item_no
          HAVING bool_or(maxx >= least(x1, x2) AND minx <= greatest(x1, x2) AND maxy >= least(y1, y2) AND miny <= greatest(y1, y2)
                         AND least(a, b, c, d) <= 0 AND greatest(a, b, c, d) >= 0)
              OR bool_and(a >= 0) OR bool_and(a <= 0)""")
def _(t):
    """A triangle: boxes that its edges reach, and boxes inside it."""
    s = t.scenes.withColumn("collection", F.lit("any"))
    return C.search_scenes(s, "any", polygon=[(21.5, 53.2), (28.4, 54.1), (23.3, 56.9)])


@query("search_scenes_radar", "scene_id:s datetime:ts orbit_state:s item_no:i",
       """SELECT scene_id, datetime, orbit_state, item_no FROM scenes
          WHERE collection = 'sentinel-1-grd' AND datetime >= TIMESTAMP '1996-01-01'
            AND instrument_mode = 'IW' AND lower(orbit_state) = 'ascending'""")
def _(t):
    return C.search_scenes(t.scenes, "sentinel-1-grd", "1996-01-01", mode="IW", orbit="ASCENDING")


@query("with_tile_id", "item_no:i tile:s utm_zone:i",
       "SELECT item_no, tile0 AS tile, CAST(substr(tile0, 2, 2) AS INT) AS utm_zone FROM scenes")
def _(t):
    return C.with_tile_id(t.scenes)


@query("filter_tiles", "item_no:i tile:s",
       "SELECT item_no, tile0 AS tile FROM scenes WHERE tile0 IN ('T34UKA','T35ULA') AND substr(tile0, 2, 2) = '35'")
def _(t):
    return C.filter_tiles(t.scenes, ["T34UKA", "T35ULA"], [35])


@query("single_tile", "item_no:i tile:s",
       """SELECT item_no, tile0 AS tile FROM scenes WHERE tile0 =
          (SELECT tile0 FROM scenes GROUP BY tile0 ORDER BY count(*) DESC, tile0 LIMIT 1)""")
def _(t):
    return C.single_tile(t.scenes)


@query("single_tile_allowed", "item_no:i tile:s",
       """SELECT item_no, tile0 AS tile FROM scenes WHERE tile0 =
          (SELECT tile0 FROM scenes WHERE tile0 IN ('T34UKA','T35ULA','T34UMA')
           GROUP BY tile0 ORDER BY count(*), tile0 LIMIT 1)""")
def _(t):
    return C.single_tile(t.scenes, ["T34UKA", "T35ULA", "T34UMA"])


@query("dedupe_scenes", "scene_id:s item_no:i cloud_cover:d",
       """SELECT scene_id, item_no, cloud_cover FROM scenes
          QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY datetime, item_no) = 1""")
def _(t):
    return C.dedupe_scenes(t.scenes.drop("assets"), ["datetime", "item_no"])


@query("distinct_tiles", "tile:s", "SELECT DISTINCT tile0 AS tile FROM scenes")
def _(t):
    return C.distinct_tiles(t.scenes)


@query("resolve_assets", "item_no:i band:s object_key:s",
       """SELECT item_no, b AS band, scene_id || '/' || k || '.jp2' AS object_key
          FROM scenes, (VALUES ('B04','B04_10m'), ('B08','B08_10m'), ('SCL','SCL_20m')) v(b, k)""")
def _(t):
    return C.resolve_assets(t.scenes, ["B04", "B08", "SCL", "B11", "zenith"])[0]


@query("resolve_assets_rejects", "item_no:i band:s", "SELECT item_no, 'B11' AS band FROM scenes")
def _(t):
    return C.resolve_assets(t.scenes, ["B04", "B08", "SCL", "B11", "zenith"])[1]


@query("required_assets", "scene_id:s band:s",
       """SELECT DISTINCT scene_id, b AS band FROM scenes, (VALUES ('B04'), ('B08'), ('B12')) v(b)""")
def _(t):
    return C.required_assets(t.scenes, ["NDVI", "NBR"])


@query("season_slices", "item_no:i season:i slice:i",
       """SELECT item_no, season, CAST(floor((s - lo) * 3.0::DOUBLE / (hi - lo)) + 1 AS INT) AS slice FROM (
            SELECT item_no, year(datetime) AS season, epoch(datetime) AS s,
                   epoch(make_timestamp(year(datetime), 4, 1, 0, 0, 0)) AS lo,
                   epoch(make_timestamp(year(datetime), 9, 1, 0, 0, 0)) AS hi FROM scenes)
          WHERE s >= lo AND s < hi""")
def _(t):
    return C.season_slices(t.scenes, "datetime", 4, 9, 4)


@query("search_scenes_inclusive", "scene_id:s cloud_cover:d item_no:i",
       """SELECT scene_id, cloud_cover, item_no FROM scenes WHERE collection = 'sentinel-1-grd' AND datetime <= TIMESTAMP '1999-06-30'
            AND cloud_cover <= 50.5 AND item_no % 3 = 0""")
def _(t):
    """Rules of the second catalogue service: limit included, every polarisation present."""
    from pyspark.sql import functions as F

    both = F.when(F.col("item_no") % 3 == 0, F.array(F.lit("VV"), F.lit("VH"))).otherwise(F.array(F.lit("VV")))
    s = t.scenes.withColumn("polarisations", both)
    return C.search_scenes(s, "sentinel-1-grd", end="1999-06-30", max_cloud=50.5, cloud_inclusive=True, polarisations=["VV", "VH"])
