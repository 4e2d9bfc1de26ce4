"""Mosaics, composites, statistics and sliding windows."""

from pyspark.sql import functions as F

from canopy.adapters import OBSERVED
from canopy.operators import raster as R, stats as St
from canopy.operators.spectra import explode_spectrum
from registry.core import query


@query("mosaic", "acq_date:t band:s row:i col:i value:d",
       """SELECT acq_date, band, "row", col, max_by(value, scene_order) AS value FROM observations WHERE value <> 0 GROUP BY ALL""")
def _(t):
    return R.mosaic(t.observations, bands=OBSERVED)


@query("mosaic_all_dates", "band:s row:i col:i value:d",
       """SELECT band, "row", col, max_by(value, scene_order) AS value FROM observations WHERE value <> 0 GROUP BY ALL""")
def _(t):
    return R.mosaic(t.observations, by_date=False, bands=OBSERVED)


SCORE = "CASE WHEN scl BETWEEN 4 AND 6 THEN 3 WHEN scl > 0 THEN 2 ELSE 0 END"


@query("scl_score", "scene_order:i row:i col:i score:i", f"""SELECT scene_order, "row", col, {SCORE} AS score FROM pixels""")
def _(t):
    return t.pixels.withColumn("score", R.scl_score())


COMPOSITE = f"""SELECT * FROM pixels QUALIFY row_number() OVER (PARTITION BY tile, "row", col
                ORDER BY {SCORE} DESC, acq_date, scene_order) = 1"""


@query("best_pixel_composite", "tile:s row:i col:i acq_date:t b02:d b03:d b04:d b08:d b8a:d b11:d b12:d scl:i",
       f"""SELECT tile, "row", col, acq_date, b02, b03, b04, b08, b8a, b11, b12, scl FROM ({COMPOSITE})""")
def _(t):
    return R.best_pixel_composite(t.pixels, tie="scene_order")


@query("clear_fraction", "tile:s clear_fraction:d cloud_fraction:d best_class_fraction:d n:i",
       f"""WITH b AS (SELECT tile, "row", col, max({SCORE}) AS s FROM pixels GROUP BY ALL),
                f AS (SELECT tile, avg(CASE WHEN s = 3 THEN 1 ELSE 0 END) AS clear_fraction, avg(CASE WHEN s = 2 THEN 1 ELSE 0 END) AS cloud_fraction,
                  count(*) AS n FROM b GROUP BY tile)
           SELECT tile, clear_fraction, cloud_fraction, CASE WHEN clear_fraction > 0 THEN clear_fraction WHEN cloud_fraction > 0 THEN cloud_fraction ELSE 1 END
             AS best_class_fraction, n FROM f""")
def _(t):
    return R.clear_fraction(t.pixels, by=["tile"])


@query("clear_fraction_region", "region_id:s clear_fraction:d cloud_fraction:d n:i",
       f"""WITH b AS (SELECT region_id, "row", col, max({SCORE}) AS s FROM pixels JOIN region_cells USING ("row", col) GROUP BY ALL)
           SELECT region_id, avg(CASE WHEN s = 3 THEN 1 ELSE 0 END) AS clear_fraction, avg(CASE WHEN s = 2 THEN 1 ELSE 0 END) AS cloud_fraction,
                  count(*) AS n FROM b GROUP BY region_id""")
def _(t):
    from canopy.operators.regions import region_cells

    inside = t.pixels.join(region_cells(t.regions).select("region_id", "row", "col"), ["row", "col"])
    return R.clear_fraction(inside, by=["region_id"])


STATS = """SELECT "year", "index", "row", col, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n FROM indices GROUP BY ALL"""


@query("pixel_stats", "year:i index:s row:i col:i mean:d std:d n:i", STATS)
def _(t):
    return R.pixel_stats(t.indices)


@query("anomaly", "index:s scene_order:i row:i col:i anomaly:d",
       f"""SELECT "index", scene_order, "row", col, CASE WHEN std > 1e-12 THEN (value - mean) / std END AS anomaly
           FROM indices JOIN ({STATS}) USING ("year", "index", "row", col)""")
def _(t):
    stats = R.pixel_stats(t.indices)
    # Sums in another order leave a spread of rounding size where all values are equal.
    settled = stats.withColumn("std", F.when(F.col("std") > 1e-12, F.col("std")).otherwise(0.0))
    return R.anomaly(t.indices, settled)


@query("yearly_change", "index:s row:i col:i year:i previous_year:n change:d",
       f"""SELECT "index", "row", col, "year", lag("year") OVER w AS previous_year, mean - lag(mean) OVER w AS change
           FROM ({STATS}) WINDOW w AS (PARTITION BY "index", "row", col ORDER BY "year")""")
def _(t):
    return R.yearly_change(R.pixel_stats(t.indices))


@query("global_minmax", "scene_order:i row:i col:i b04:d b08:d",
       """SELECT scene_order, "row", col, (b04 - lo) / (hi - lo) AS b04, (b08 - lo) / (hi - lo) AS b08
          FROM pixels, (SELECT least(min(b04), min(b08)) AS lo, greatest(max(b04), max(b08)) AS hi FROM pixels)""")
def _(t):
    return St.global_minmax(t.pixels, ["b04", "b08"])


@query("global_minmax_percentiles", "cube_id:s row:i col:i band:i value:d",
       """SELECT cube_id, "row", col, band, (value - lo) / (hi - lo) * 2 - 1 AS value FROM long_spectra,
            (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM long_spectra)""")
def _(t):
    return explode_spectrum(St.global_minmax(t.spectra, ["spectrum"], (-1, 1), percentiles=(2, 98)))


@query("global_minmax_inverse", "cube_id:s row:i col:i band:i value:d",
       """SELECT cube_id, "row", col, band, value FROM long_spectra""")
def _(t):
    scaled = St.global_minmax(t.spectra, ["spectrum"], forced_min=-0.5, forced_max=1.5)
    return explode_spectrum(St.global_minmax_inverse(scaled, ["spectrum"], -0.5, 1.5))


@query("tumbling_windows", "window:i total:d top:i n:i",
       """SELECT (rn - 1) // 7 AS "window", sum(l_quantity) AS total, max(o) AS top, count(*) AS n FROM (
            SELECT l_quantity, l_orderkey * 8 + l_linenumber AS o,
                   row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM lineitem) GROUP BY ALL""")
def _(t):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    top = F.max(F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return St.tumbling_apply(
        t.raw("lineitem"), order, 7, [F.sum("l_quantity").alias("total"), top.alias("top"), F.count(F.lit(1)).alias("n")]
    )


@query("hopping_windows", "window:i mean:d n:i",
       """WITH r AS (SELECT o_totalprice AS v, o_orderkey AS i FROM orders), t AS (SELECT count(*) AS n FROM orders),
               f AS (SELECT (n - 10) // 4 + 1 AS k, n FROM t), w AS (
            SELECT w AS "window", w * 4 AS a, w * 4 + 10 AS z FROM f, range(0, 1000000) q(w) WHERE w < k
            UNION ALL SELECT k, (k - 1) * 4 + 10, n FROM f WHERE (k - 1) * 4 + 10 < n)
          SELECT "window", avg(v) AS mean, count(*) AS n FROM w JOIN r ON i >= a AND i < z GROUP BY "window" """)
def _(t):
    return St.hopping_apply(t.raw("orders"), ["o_orderkey"], 10, 4, [F.avg("o_totalprice").alias("mean"), F.count(F.lit(1)).alias("n")])


@query("block_windows", "i:i j:i total:d n:i",
       """WITH p AS (SELECT "row", col, max(b04) AS v FROM pixels GROUP BY ALL),
               z AS (SELECT (max("row") + 1) // 5 AS ni, (max(col) + 1) // 6 AS nj FROM p),
               a AS (SELECT unnest(range(ni)) AS i FROM z), b AS (SELECT unnest(range(nj)) AS j FROM z),
               w AS (SELECT i, j, i * 5 AS r0, i * 5 + 7 AS r1, j * 6 AS c0, j * 6 + 8 AS c1 FROM a, b
                     UNION ALL SELECT i, nj, ni * 5, 1 << 30, nj * 6, 1 << 30 FROM a, z
                     UNION ALL SELECT ni, j, ni * 5, 1 << 30, j * 6, j * 6 + 8 FROM b, z)
          SELECT i, j, sum(v) AS total, count(*) AS n FROM w JOIN p ON "row" >= r0 AND "row" < r1 AND col >= c0 AND col < c1 GROUP BY i, j""")
def _(t):
    p = t.pixels.groupBy("row", "col").agg(F.max("b04").alias("v"))
    height, length = t.pixels.agg(F.max("row") + 1, F.max("col") + 1).first()
    return St.block_apply(p, (7, 8), (5, 6), height, length, [F.sum("v").alias("total"), F.count(F.lit(1)).alias("n")])


BANDSTATS = {
    "standard": "SELECT band, avg(value) AS a, stddev_pop(value) AS s FROM long_spectra GROUP BY band",
    "minmax": "SELECT band, min(value) AS a, max(value) - min(value) AS s FROM long_spectra GROUP BY band",
    "maxabs": "SELECT band, 0 AS a, max(abs(value)) AS s FROM long_spectra GROUP BY band",
    "robust": """SELECT band, quantile_cont(value, 0.5) AS a, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS s
                 FROM long_spectra GROUP BY band""",
}


def _scaler(kind):
    @query(f"scale_{kind}", "cube_id:s row:i col:i band:i value:d",
           f"""SELECT cube_id, "row", col, band, (value - a) / s AS value FROM long_spectra JOIN ({BANDSTATS[kind]}) USING (band)""")
    def _(t):
        return explode_spectrum(St.scale(t.spectra, kind))


for _k in BANDSTATS:
    _scaler(_k)


@query("scale_normalizer", "cube_id:s row:i col:i band:i value:d",
       """SELECT cube_id, "row", col, band, value / sum(abs(value)) OVER (PARTITION BY cube_id, "row", col) AS value FROM long_spectra""")
def _(t):
    return explode_spectrum(St.scale(t.spectra, "normalizer", norm="l1"))


PLATES = """SELECT class, band, avg(value) AS raw, CASE class WHEN 1 THEN 0.1 WHEN 2 THEN 0.15 WHEN 3 THEN 0.4 WHEN 4 THEN 0.05
              WHEN 5 THEN 0.5 ELSE 0.94 END::DOUBLE AS reflectance
            FROM long_spectra JOIN class_map USING (cube_id, "row", col) WHERE class > 0 GROUP BY class, band"""
DARK = "SELECT 0 AS class, band, avg(value) AS raw, 0.0::DOUBLE AS reflectance FROM long_spectra WHERE cube_id = 'c0' GROUP BY band"


@query("plate_spectra", "class:i band:i raw:d reflectance:d", PLATES)
def _(t):
    return St.plate_spectra(t.spectra, t.class_map)


@query("dark_spectrum", "class:i band:i raw:d reflectance:d", f"{PLATES} UNION ALL {DARK}")
def _(t):
    dark = St.dark_spectrum(t.spectra.filter("cube_id = 'c0'"))
    return St.plate_spectra(t.spectra, t.class_map).unionByName(dark)


FIT = f"""SELECT band, regr_slope(reflectance, raw) AS a, regr_intercept(reflectance, raw) AS b FROM ({PLATES} UNION ALL {DARK}) GROUP BY band"""


def _plates(t):
    return St.plate_spectra(t.spectra, t.class_map).unionByName(St.dark_spectrum(t.spectra.filter("cube_id = 'c0'")))


@query("fit_calibration", "band:i a:d b:d", FIT)
def _(t):
    fit = St.fit_calibration(_plates(t))
    return fit.select("band", F.get("coeffs", 0).alias("a"), F.get("coeffs", 1).alias("b"))


@query("fit_calibration_median", "band:i a:d b:d",
       """SELECT band, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM (
            SELECT class, band, median(value) AS x, CASE class WHEN 1 THEN 0.1 WHEN 2 THEN 0.15 WHEN 3 THEN 0.4 WHEN 4 THEN 0.05
              WHEN 5 THEN 0.5 ELSE 0.94 END::DOUBLE AS y
            FROM long_spectra JOIN class_map USING (cube_id, "row", col) WHERE class > 0 GROUP BY class, band) GROUP BY band""")
def _(t):
    from canopy.constants import PLATE_REFLECTANCE

    known = F.create_map(*[F.lit(v) for kv in PLATE_REFLECTANCE.items() for v in kv])
    samples = explode_spectrum(t.spectra.join(t.class_map.filter("class > 0"), ["cube_id", "row", "col"]))
    fit = St.fit_calibration(samples.select("class", "band", F.col("value").alias("raw"), known[F.col("class")].alias("reflectance")), method="median")
    return fit.select("band", F.get("coeffs", 0).alias("a"), F.get("coeffs", 1).alias("b"))


@query("fit_calibration_quadratic", "band:i residual:d slope_of_raw:d",
       "SELECT DISTINCT band, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS slope_of_raw FROM long_spectra")
def _(t):
    """Residuals of the quadratic fit are orthogonal to 1 and raw: both sums are 0."""
    p = _plates(t)
    fit = St.fit_calibration(p, degree=2)
    k = lambda i: F.get("coeffs", i)
    r = F.col("reflectance") - (k(0) * F.col("raw") * F.col("raw") + k(1) * F.col("raw") + k(2))
    return p.join(fit, "band").groupBy("band").agg(
        F.round(F.sum(r), 3).alias("residual"), F.round(F.sum(r * F.col("raw")), 3).alias("slope_of_raw")
    )


@query("fit_calibration_quadratic_coefficients", "band:i a:d b:d c:d",
       f"""WITH p AS (SELECT band, raw AS x, reflectance AS y FROM ({PLATES} UNION ALL {DARK})),
          u AS (SELECT band, y, x - avg(x) OVER w AS u, avg(x) OVER w AS m, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY band)),
          s AS (SELECT *, sum(u * u * u) OVER w / sum(u * u) OVER w AS k, sum(u * u) OVER w / n AS q FROM u WINDOW w AS (PARTITION BY band)),
          f AS (SELECT band, m, k, q, avg(y) AS y0, sum(u * y) / sum(u * u) AS b1,
                  sum((u * u - k * u - q) * y) / sum((u * u - k * u - q) * (u * u - k * u - q)) AS a FROM s GROUP BY band, m, k, q)
          SELECT band, a, b1 - a * k - 2 * a * m AS b, y0 - b1 * m + a * (m * m + k * m - q) AS c FROM f""")
def _(t):
    """Against polynomials that are orthogonal over the plates, which need no determinants."""
    fit = St.fit_calibration(_plates(t), degree=2)
    return fit.select("band", *[F.get("coeffs", i).alias(n) for i, n in enumerate("abc")])


@query("apply_calibration", "cube_id:s row:i col:i band:i value:d",
       f"""SELECT cube_id, "row", col, band, value * a + b AS value FROM long_spectra JOIN ({FIT}) USING (band)""")
def _(t):
    return explode_spectrum(St.apply_calibration(t.spectra, St.fit_calibration(_plates(t))))
