"""End-to-end results."""

from pyspark.sql import functions as F

from canopy.adapters import CLASS_NAMES, WAVELENGTHS
from canopy.functions.color import SRGB_MATRIX
from canopy.operators.spectra import explode_spectrum
from canopy.plans import drone, satellite, wildlife as W
from registry.core import query
from registry.signal import _enc, _ramp_sql, _xyz_sql
from registry.stats import FIT, SCORE

SCENE_LIST = """SELECT DISTINCT tile, acq_date FROM (SELECT tile, acq_date, sum(scene_order) % 100 AS cloud FROM pixels GROUP BY ALL)
                WHERE acq_date >= DATE '1996-04-01' AND acq_date <= DATE '1999-09-01' AND cloud < 60"""


def _scenes(t):
    s = t.pixels.groupBy("tile", "acq_date").agg((F.sum("scene_order") % 100).cast("double").alias("cloud_cover"))
    sid = F.concat_ws("_", F.lit("S2A_MSIL2A"), F.date_format("acq_date", "yyyyMMdd"), F.lit("N0511_R036"), F.col("tile"), F.lit("x"))
    return s.select(
        sid.alias("scene_id"), F.lit("sentinel-2-l2a").alias("collection"), F.col("acq_date").cast("timestamp").alias("datetime"), "cloud_cover"
    )


@query("s2_composite", "row:i col:i acq_date:t b04:d b08:d b12:d scl:n ndvi:d nbr:d",
       f"""WITH s AS ({SCENE_LIST}), o AS (SELECT p.* FROM pixels p JOIN s USING (tile, acq_date)),
             m AS (SELECT acq_date, "row", col, max_by(b04, scene_order) AS b04, max_by(b08, scene_order) AS b08, max_by(b12, scene_order) AS b12,
                     max_by(scl, CASE WHEN scl <> 0 THEN scene_order END) AS scl FROM o GROUP BY ALL),
             c AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY "row", col ORDER BY {SCORE} DESC, acq_date) = 1)
           SELECT "row", col, acq_date, b04, b08, b12, scl, greatest(0, least(1, (b08 - b04) / nullif(b08 + b04, 0))) AS ndvi,
             greatest(0, least(1, (b08 - b12) / nullif(b08 + b12, 0))) AS nbr FROM c""")
def _(t):
    search = {"collection": "sentinel-2-l2a", "start": "1996-04-01", "end": "1999-09-01", "max_cloud": 60}
    return satellite.s2_composite(_scenes(t), t.observations, search, ["NDVI", "NBR"])


ROI = """SELECT i.* FROM indices i WHERE "year" = 1998 AND ("row", col) IN (SELECT ("row", col) FROM landcover WHERE clc BETWEEN 20 AND 29)"""
ROI_STATS = f"""SELECT "year", "index", "row", col, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n FROM ({ROI}) GROUP BY ALL"""


@query("roi_health_stats", "year:i index:s row:i col:i mean:d std:d n:i", ROI_STATS)
def _(t):
    return satellite.roi_health(t.indices, t.landcover, 1998, range(20, 30))[0]


@query("roi_health_anomaly", "index:s scene_order:i row:i col:i anomaly:d",
       """WITH roi AS MATERIALIZED (SELECT "year", "index", scene_order, "row", col, value FROM indices
               SEMI JOIN (SELECT "row", col FROM landcover WHERE clc BETWEEN 20 AND 29) AS l USING ("row", col) WHERE "year" = 1998)
          SELECT "index", scene_order, "row", col,
                 CASE WHEN stddev_pop(value) OVER w > 1e-12 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END AS anomaly
          FROM roi WINDOW w AS (PARTITION BY "year", "index", "row", col)""")
def _(t):
    return satellite.roi_health(t.indices, t.landcover, 1998, range(20, 30))[1]


@query("xyz_image_normalized", "cube_id:s row:i col:i x:d y:d z:d",
       f"""SELECT cube_id, "row", col, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) AS x, (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) AS y,
             (z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w) AS z FROM ({_xyz_sql(1.2)}) WINDOW w AS (PARTITION BY cube_id)""")
def _(t):
    return drone.xyz_image(t.spectra, WAVELENGTHS, normalize=True, y_gain=1.2)


@query("rgb_image", "cube_id:s row:i col:i r:d g:d b:d",
       f"""SELECT cube_id, "row", col, {_enc(SRGB_MATRIX[0])} AS r, {_enc(SRGB_MATRIX[1])} AS g, {_enc(SRGB_MATRIX[2])} AS b FROM ({_xyz_sql()})""")
def _(t):
    return drone.rgb_image(t.spectra, WAVELENGTHS)


def _products_sql():
    ramp = lambda c: _ramp_sql("u", c)
    return f"""WITH x AS ({_xyz_sql()}), c AS (SELECT cube_id, "row", col, {_enc(SRGB_MATRIX[0])} AS r, {_enc(SRGB_MATRIX[1])} AS g, {_enc(SRGB_MATRIX[2])} AS b FROM x),
               m AS (SELECT cube_id, greatest(max(r), max(g), max(b)) AS top FROM c GROUP BY cube_id),
               q AS (SELECT cube_id, "row", col, spectrum[29] AS re, spectrum[43] AS ni, list_sum(spectrum) AS s FROM spectra),
               k AS (SELECT cube_id, least(min(re), min(ni)) AS lo FROM q GROUP BY cube_id),
               v AS (SELECT cube_id, "row", col, s, greatest(0, coalesce((ni - re) / nullif(ni + re - 2 * lo, 0), 0)) AS v FROM q JOIN k USING (cube_id)),
               e AS (SELECT cube_id, min(v) AS a, max(v) AS z FROM v GROUP BY cube_id),
               u AS (SELECT *, (v - a) / (z - a) AS u FROM v JOIN e USING (cube_id))
          SELECT cube_id, "row", col, s > 0 AS valid, floor(greatest(0, least(1, r / top)) * 255) AS rgb_r,
                 CASE WHEN s > 0 THEN floor(greatest(0, least(1, g / top)) * 255) END AS rect_rgb_g, floor(u * 255) AS ndvi, CASE WHEN s > 0 THEN v END AS rect_ndvi,
                 floor({ramp(0)} * 255) AS ndvi_rgb_r, CASE WHEN s > 0 THEN floor({ramp(2)} * 255) END AS rect_ndvi_rgb_b
          FROM u JOIN c USING (cube_id, "row", col) JOIN m USING (cube_id)"""


@query("drone_products", "cube_id:s row:i col:i valid:b rgb_r:n rect_rgb_g:n ndvi:n rect_ndvi:d ndvi_rgb_r:n rect_ndvi_rgb_b:n", _products_sql())
def _(t):
    return drone.drone_products(t.spectra, WAVELENGTHS)


@query("drone_ndvi", "cube_id:s row:i col:i rect_ndvi:d ndvi:n",
       """WITH b AS (SELECT cube_id, "row", col, spectrum[29] AS r, spectrum[43] AS n, list_sum(spectrum) AS s FROM spectra),
               k AS (SELECT cube_id, least(min(r), min(n)) AS lo FROM b GROUP BY cube_id),
               v AS (SELECT cube_id, "row", col, s, greatest(0, coalesce((n - r) / nullif(n + r - 2 * lo, 0), 0)) AS v FROM b JOIN k USING (cube_id)),
               e AS (SELECT cube_id, min(v) AS a, max(v) AS z FROM v GROUP BY cube_id)
          SELECT cube_id, "row", col, CASE WHEN s > 0 THEN v END AS rect_ndvi, floor((v - a) / (z - a) * 255) AS ndvi FROM v JOIN e USING (cube_id)""")
def _(t):
    return drone.drone_products(t.spectra, WAVELENGTHS, ["ndvi", "rect_ndvi"])


@query("reflectance", "cube_id:s row:i col:i band:i value:d",
       f"""SELECT cube_id, "row", col, band, value * a + b AS value FROM long_spectra JOIN ({FIT}) USING (band)""")
def _(t):
    return explode_spectrum(drone.reflectance(t.spectra, t.spectra, t.class_map, t.spectra.filter("cube_id = 'c0'")))


PARAMS = W.WildlifeParams(min_detection_conf=0.35, min_track_frames=3, min_track_conf=0.4)


def _run(t):
    return W.wildlife(t.detections, t.telemetry, PARAMS, CLASS_NAMES)


@query("wildlife_detections", "det_id:i video_id:s frame:i entity_id:i cluster_id:n cls:i status:s reject_reason:s lat:d lon:d")
def _(t):
    return _run(t)["detections"]


@query("wildlife_tracks", "video_id:s track_id:i frames:i first_frame:i last_frame:i mean_conf:d max_conf:d")
def _(t):
    return _run(t)["tracks"]


@query("wildlife_clusters", "video_id:s cluster_id:i frames:i first_frame:i last_frame:i mean_conf:d track_ids:j")
def _(t):
    return _run(t)["clusters"]


@query("wildlife_entities", "video_id:s animals:i")
def _(t):
    return _run(t)["entities"]


@query("composite_ndvi_stats", "year:i row:i col:i mean:d std:d n:i best_score:i",
       f"""WITH c AS (SELECT *, {SCORE} AS s FROM pixels QUALIFY row_number() OVER (PARTITION BY tile, "row", col, year(acq_date)
                  ORDER BY {SCORE} DESC, acq_date, scene_order) = 1)
           SELECT year(acq_date) AS "year", "row", col, avg(v) AS mean, stddev_pop(v) AS std, count(v) AS n, max(s) AS best_score FROM (
             SELECT *, greatest(0, least(1, (b08 - b04) / nullif(b08 + b04, 0))) AS v FROM c) GROUP BY ALL""")
def _(t):
    """Best date per tile, pixel and year, its NDVI, and the spread over tiles."""
    from canopy.functions.vegetation import s2_ndvi
    from canopy.operators import raster as R

    yearly = t.pixels.withColumn("year", F.year("acq_date"))
    best = R.best_pixel_composite(yearly, ["tile", "year", "row", "col"], ["b04", "b08", "scl"], tie="scene_order")
    scored = best.withColumn("value", s2_ndvi()).withColumn("score", R.scl_score())
    v = F.col("value")
    return scored.groupBy("year", "row", "col").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"), F.max("score").alias("best_score")
    )
