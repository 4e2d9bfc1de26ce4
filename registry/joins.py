"""Alignment of tables: grids, land cover, regions, telemetry."""

from pyspark.sql import functions as F

from canopy.adapters import OBSERVED
from canopy.operators import raster as R, regions as G, telemetry as T
from registry.core import query


@query("attach_telemetry", "det_id:i frame:i lat:d lon:d rel_alt:d",
       """SELECT det_id, frame, lat, lon, rel_alt FROM detections LEFT JOIN
          (SELECT video_id, frame, lat, lon, rel_alt FROM telemetry) USING (video_id, frame)""")
def _(t):
    return T.attach_telemetry(t.detections, t.telemetry.select("video_id", "frame", "ts", "lat", "lon", "rel_alt"))


@query("nearest_telemetry", "event_id:i matched_ts:d lat:d alt:d",
       """SELECT event_id, tt AS matched_ts, lat, alt FROM (
            SELECT a.event_id, b.ts AS tt, b.lat, b.alt FROM
              (SELECT CAST(user_id AS VARCHAR) AS video_id, event_id, event_id * 259.2::DOUBLE + 1000 AS ts FROM events) a
              JOIN telemetry b USING (video_id)
            QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.ts - a.ts), b.ts) = 1)""")
def _(t):
    asked = t.raw("events").select(
        F.col("user_id").cast("string").alias("video_id"), "event_id", (F.col("event_id") * 259.2 + 1000).alias("ts")
    )
    return T.nearest_telemetry(asked, t.telemetry, "ts", ["lat", "alt"])


@query("nearest_telemetry_by_frame", "det_id:i matched_ts:d",
       """SELECT det_id, tt AS matched_ts FROM (
            SELECT a.det_id, b.ts AS tt FROM detections a JOIN
              (SELECT video_id, frame * 2.0::DOUBLE AS ts FROM telemetry) b USING (video_id)
            QUALIFY row_number() OVER (PARTITION BY a.det_id ORDER BY abs(b.ts - round_even(a.frame / 0.7::DOUBLE, 0)), b.ts) = 1)""")
def _(t):
    marks = t.telemetry.withColumn("ts", F.col("frame") * 2.0).select("video_id", "ts", "lat")
    return T.nearest_by_frame(t.detections, marks, 0.7, ["lat"])


@query("upsample", "tile:s band:s row:i col:i value:d scene_order:i",
       """SELECT tile, band, "row" * 2 + dr AS "row", col * 2 + dc AS col, value, scene_order
          FROM observations, range(2) a(dr), range(2) b(dc)""")
def _(t):
    return R.upsample(t.observations, 2)


@query("stack_bands", "tile:s acq_date:t row:i col:i b04:d b08:d scl:d",
       """SELECT tile, acq_date, "row", col, max_by(b04, scene_order) AS b04, max_by(b08, scene_order) AS b08,
                 max_by(scl, scene_order) AS scl FROM pixels GROUP BY ALL""")
def _(t):
    return R.stack_bands(t.observations, ["b04", "b08", "scl"])


@query("crop_to_smallest", "band:s row:i col:i scene_order:i",
       """WITH o AS (SELECT band, "row" + CASE band WHEN 'b04' THEN 7 WHEN 'scl' THEN 2 ELSE 0 END AS "row",
                            col + CASE band WHEN 'b08' THEN 5 WHEN 'scl' THEN 1 ELSE 0 END AS col, scene_order FROM observations),
               s AS (SELECT band, max("row") + 1 AS h, max(col) + 1 AS w FROM o GROUP BY band),
               m AS (SELECT min(h) AS mh, min(w) AS mw FROM s)
          SELECT o.band, "row" - (h - mh) AS "row", col - (w - mw) AS col, scene_order
          FROM o JOIN s ON o.band = s.band, m WHERE "row" >= h - mh AND col >= w - mw""")
def _(t):
    """All bands, three of them on larger grids."""
    band = F.col("band")
    o = t.observations.withColumn("row", F.col("row") + F.when(band == "b04", 7).when(band == "scl", 2).otherwise(0))
    o = o.withColumn("col", F.col("col") + F.when(band == "b08", 5).when(band == "scl", 1).otherwise(0))
    return R.crop_to_smallest(o, [])


@query("unstack_bands", "tile:s band:s row:i col:i value:d scene_order:i",
       """SELECT tile, band, "row", col, value, scene_order FROM observations""")
def _(t):
    return t.observations


@query("roi_filter", "scene_order:i row:i col:i b04:d",
       """SELECT scene_order, p."row", p.col, CASE WHEN l."row" IS NOT NULL THEN b04 ELSE 0 END AS b04 FROM pixels p
          LEFT JOIN (SELECT DISTINCT "row", col FROM landcover WHERE clc IN (11, 23, 24)) l ON p."row" = l."row" AND p.col = l.col""")
def _(t):
    return R.roi_filter(t.pixels, t.landcover, [11, 23, 24], values=["b04"])


@query("roi_filter_drop", "scene_order:i row:i col:i",
       """SELECT scene_order, "row", col FROM pixels WHERE ("row", col) IN (SELECT ("row", col) FROM landcover WHERE clc = 24)""")
def _(t):
    return R.roi_filter(t.pixels, t.landcover, [24], mode="drop")


@query("regrid_nearest", "row:i col:i clc:i",
       """SELECT r AS "row", c AS col, clc FROM range(75) a(r), range(33) b(c) JOIN landcover l
          ON l."row" = floor((r + 0.5::DOUBLE) * 40 / 75) AND l.col = floor((c + 0.5::DOUBLE) * 50 / 33)""")
def _(t):
    return R.regrid_nearest(t.landcover, 40, 50, 75, 33)


@query("clip_to_region", "region_id:s scene_order:i row:i col:i",
       """SELECT region_id, scene_order, p."row", p.col FROM pixels p JOIN region_cells c ON p."row" = c."row" AND p.col = c.col""")
def _(t):
    return G.clip_to_region(t.pixels, t.regions)


TOUCHED = """
    SELECT DISTINCT region_id, "row", col FROM (
      SELECT region_id, "row", col FROM region_cells
      UNION ALL
      SELECT region_id, "row", col FROM (
        SELECT region_id, ex1, ex2, ey1, ey2, "row", col,
               greatest(least(ey1, ey2), "row") AS ya, least(greatest(ey1, ey2), "row" + 1) AS yb FROM edges, cells
        WHERE "row" >= floor(least(ey1, ey2)) AND "row" <= floor(greatest(ey1, ey2)))
      WHERE CASE WHEN ey1 = ey2 THEN col >= floor(least(ex1, ex2)) AND col <= floor(greatest(ex1, ex2))
              ELSE col >= floor(least(ex1 + (ya - ey1) * (ex2 - ex1) / (ey2 - ey1), ex1 + (yb - ey1) * (ex2 - ex1) / (ey2 - ey1)))
               AND col <= floor(greatest(ex1 + (ya - ey1) * (ex2 - ex1) / (ey2 - ey1), ex1 + (yb - ey1) * (ex2 - ex1) / (ey2 - ey1))) END)"""


@query("clip_to_region_touched", "region_id:s scene_order:i row:i col:i",
       f"""SELECT region_id, scene_order, p."row", p.col FROM pixels p JOIN ({TOUCHED}) c ON p."row" = c."row" AND p.col = c.col""")
def _(t):
    return G.clip_to_region(t.pixels, t.regions, all_touched=True)


@query("rasterize_regions", "row:i col:i value:s",
       """SELECT "row", col, max_by(region_id, n) AS value FROM region_cells GROUP BY "row", col""")
def _(t):
    from pyspark.sql import functions as F

    r = t.regions.withColumn("order", F.col("props")["order"].cast("int")).withColumn("name", F.col("region_id"))
    return G.rasterize_regions(r, "name", "order")


@query("sample_points", "p_partkey:i row:i col:i value:d",
       """SELECT p_partkey, "row", col, coalesce(m.value, 0) AS value FROM (
            SELECT p_partkey, CAST(floor((600000.0::DOUBLE - y) / 10) AS INT) AS "row", CAST(floor((x - 500000.0::DOUBLE) / 10) AS INT) AS col FROM (
              SELECT p_partkey, 500000.0::DOUBLE + 3.7::DOUBLE * (p_partkey % 150) AS x, 600000.0::DOUBLE - 2.3::DOUBLE * (p_partkey % 200) AS y FROM part))
          LEFT JOIN (SELECT "row", col, max(b04) AS value FROM pixels GROUP BY "row", col) m USING ("row", col)""")
def _(t):
    grid = t.pixels.groupBy("row", "col").agg(F.max("b04").alias("value"))
    k = F.col("p_partkey")
    pts = t.raw("part").select(
        "p_partkey", (500000.0 + 3.7 * (k % 150)).alias("x"), (600000.0 - 2.3 * (k % 200)).alias("y")
    )
    return R.sample_points(grid, pts, (10, 0, 500000, 0, -10, 600000))


@query("pixel_grid", "region_id:s iy:i ix:i x:d y:d",
       """WITH b AS (SELECT region_id, cx - h AS x0, cy - h AS y0, cx + h AS x1, cy + h AS y1,
                 20000.0::DOUBLE / 111226.26::DOUBLE AS sy, 20000.0::DOUBLE / 111226.26::DOUBLE / cos(radians(((cy - h) + (cy + h)) / 2)) AS sx FROM regions)
          SELECT region_id, iy, ix, x0 + ix * sx AS x, y0 + iy * sy AS y FROM b, range(200) r(iy), range(200) q(ix)
          WHERE iy < ceil((y1 - y0) / sy) AND ix < ceil((x1 - x0) / sx)""")
def _(t):
    return G.pixel_grid(t.regions, 20000)


@query("pixel_grid_contained", "region_id:s iy:i ix:i",
       """WITH b AS (SELECT region_id, n, cx, cy, h, cx - h AS x0, cy - h AS y0, cx + h AS x1, cy + h AS y1,
                 20000.0::DOUBLE / 111226.26::DOUBLE AS sy, 20000.0::DOUBLE / 111226.26::DOUBLE / cos(radians(((cy - h) + (cy + h)) / 2)) AS sx FROM regions),
               g AS (SELECT region_id, n, cx, cy, h, iy, ix, x0 + ix * sx AS x, y0 + iy * sy AS y, x0, y0, x1, y1 FROM b, range(200) r(iy), range(200) q(ix)
          WHERE iy < ceil((y1 - y0) / sy) AND ix < ceil((x1 - x0) / sx))
          SELECT g.region_id, iy, ix FROM g JOIN edges e ON g.region_id = e.region_id
          WHERE (ey1 <= y AND y < ey2) OR (ey2 <= y AND y < ey1)
          GROUP BY g.region_id, iy, ix
          HAVING sum(CASE WHEN x < ex1 + (y - ey1) * (ex2 - ex1) / (ey2 - ey1) THEN 1 ELSE 0 END) % 2 = 1""")
def _(t):
    return G.pixel_grid(t.regions, 20000, contained=True)


@query("region_overlap", "a:s b:s shared_cells:i share:d overlaps:b",
       """WITH s AS (SELECT region_id, count(*) AS k FROM region_cells GROUP BY region_id),
               j AS (SELECT x.region_id AS a, y.region_id AS b, count(*) AS shared_cells
                     FROM region_cells x JOIN region_cells y ON x."row" = y."row" AND x.col = y.col AND x.region_id < y.region_id GROUP BY ALL)
          SELECT a, b, shared_cells, shared_cells / least(sa.k, sb.k) AS share, shared_cells / least(sa.k, sb.k) >= 0.3 AS overlaps
          FROM j JOIN s sa ON sa.region_id = a JOIN s sb ON sb.region_id = b""")
def _(t):
    return G.region_overlap(t.regions, threshold=0.3)


@query("label_map", "cube_id:s row:i col:i label:i",
       """SELECT cube_id, "row", col, p.label FROM spectra JOIN (
            SELECT cube_id, "row" // 3 AS pr, col // 5 AS pc, min(class) AS label FROM class_map GROUP BY ALL) p
          USING (cube_id) WHERE p.pr = "row" // 3 AND p.pc = col // 5""")
def _(t):
    from canopy.operators.learning import label_map

    labels = t.class_map.groupBy(
        "cube_id", F.floor(F.col("row") / 3).cast("int").alias("patch_row"), F.floor(F.col("col") / 5).cast("int").alias("patch_col")
    ).agg(F.min("class").alias("label"))
    return label_map(t.spectra, labels, 3, 5)


# --- two zones that share rows and columns ------------------------------------

ZONE = """CASE WHEN CAST(substr(tile, 2) AS INT) % 2 = 0 THEN 32634 ELSE 32635 END"""
ZONED_COVER = """(SELECT 32634 AS epsg, "row", col, clc FROM landcover UNION ALL SELECT 32635, "row", col, (clc + 25) % 50 FROM landcover)"""


def _zoned(df):
    return df.withColumn("epsg", F.when(F.substring("tile", 2, 5).cast("int") % 2 == 0, 32634).otherwise(32635))


def _zoned_cover(t):
    other = t.landcover.withColumn("epsg", F.lit(32635)).withColumn("clc", (F.col("clc") + 25) % 50)
    return t.landcover.unionByName(other)


@query("roi_filter_zones", "scene_order:i index:s value:d",
       f"""SELECT i.scene_order, i."index", CASE WHEN c.clc BETWEEN 20 AND 29 THEN i.value ELSE 0 END AS value
           FROM (SELECT *, {ZONE} AS epsg FROM indices) i LEFT JOIN {ZONED_COVER} c USING (epsg, "row", col)""")
def _(t):
    return R.roi_filter(_zoned(t.indices), _zoned_cover(t), range(20, 30))


@query("mosaic_zones", "epsg:i acq_date:t band:s row:i col:i value:d",
       f"""SELECT epsg, acq_date, band, "row", col, max_by(value, scene_order) AS value
           FROM (SELECT *, {ZONE} AS epsg FROM observations) WHERE value <> 0 GROUP BY ALL""")
def _(t):
    return R.mosaic(_zoned(t.observations), bands=OBSERVED)


@query("roi_health_zones", "epsg:i year:i index:s row:i col:i mean:d n:i",
       f"""SELECT epsg, "year", "index", "row", col, avg(value) AS mean, count(value) AS n
           FROM (SELECT *, {ZONE} AS epsg FROM indices) SEMI JOIN (SELECT * FROM {ZONED_COVER} WHERE clc BETWEEN 20 AND 29) AS c USING (epsg, "row", col)
           GROUP BY ALL""")
def _(t):
    from canopy.plans.satellite import roi_health

    return roi_health(_zoned(t.indices), _zoned_cover(t), None, range(20, 30))[0]


@query("clip_to_region_zones", "region_id:s scene_order:i",
       f"""SELECT region_id, scene_order FROM (SELECT *, {ZONE} AS epsg FROM pixels) p
           JOIN region_cells c ON c."row" = p."row" AND c.col = p.col WHERE epsg = CASE WHEN CAST(substr(region_id, 2) AS INT) % 3 = 0 THEN 32635 ELSE 32634 END""")
def _(t):
    from canopy.operators.regions import clip_to_region

    n = F.substring("region_id", 2, 9).cast("int")
    return clip_to_region(_zoned(t.pixels), t.regions.withColumn("epsg", F.when(n % 3 == 0, 32635).otherwise(32634)))
