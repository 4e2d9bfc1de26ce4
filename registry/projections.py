"""Pixel-wise operators over spectra and detections."""

from pyspark.sql import functions as F

from canopy.adapters import CLASS_NAMES, WAVELENGTHS
from canopy.functions import detection as D, geometry as G, spectral as S
from canopy.operators import spectra as X
from registry.core import query

SPEC = "cube_id:s row:i col:i"


def _bands(t):
    """Band axis of the cube, read from the spectra themselves."""
    axis = t.spectra.select(F.explode(F.sequence(F.lit(0), F.size("spectrum") - 1)).alias("band")).distinct()
    return axis.select(
        F.lit("camera").alias("sensor"), "band", (F.lit(397.66) + F.lit(9.6) * F.col("band")).alias("wavelength_nm")
    )


@query("read_blocks", "cube_id:s block_row:i block_col:i n:i first_value:d",
       """SELECT cube_id, "row" // 4 AS block_row, col // 10 AS block_col, count(*) AS n, sum(spectrum[1]) AS first_value
          FROM spectra GROUP BY ALL""")
def _(t):
    blocks = X.read_blocks(t.spectra, 4, 10)
    return blocks.groupBy("cube_id", "block_row", "block_col").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.get("spectrum", 0)).alias("first_value")
    )


@query("band_index", "wanted_nm:d band:i",
       """SELECT w AS wanted_nm, (SELECT band FROM wl ORDER BY abs(wavelength_nm - w), band LIMIT 1) AS band
          FROM (VALUES (450.0::DOUBLE), (531.0::DOUBLE), (670.0::DOUBLE), (800.0::DOUBLE), (1200.0::DOUBLE)) v(w)
          WHERE EXISTS (SELECT 1 FROM spectra)""")
def _(t):
    return X.band_index(_bands(t), [450, 531, 670, 800, 1200])


@query("extract_bands", SPEC + " band:i value:d",
       """SELECT cube_id, "row", col, unnest([0,1,2]) AS band, unnest([spectrum[29], spectrum[43], spectrum[29]]) AS value
          FROM spectra""")
def _(t):
    return X.explode_spectrum(X.extract_bands(t.spectra, wavelengths=[670, 800, 668], axis=WAVELENGTHS))


@query("align_spectra", SPEC + " band:i value:d",
       """SELECT cube_id, "row", col, m.k AS band, spectrum[m.band + 1] AS value FROM spectra, (
            SELECT k, band FROM (SELECT CAST(k AS INT) AS k, 400 + 20.0::DOUBLE * k AS w FROM range(30) r(k)), wl
            QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(wavelength_nm - w), band) = 1) m""")
def _(t):
    return X.explode_spectrum(X.align_spectra(t.spectra, WAVELENGTHS, [400 + 20.0 * k for k in range(30)]))


@query("crop", SPEC + " cut:i",
       """SELECT cube_id, "row", col, 0 AS cut FROM spectra WHERE col >= 2 AND col < 12 AND "row" >= 1 AND "row" < 9
          UNION ALL SELECT cube_id, "row", col, 1 FROM spectra WHERE col >= 8 AND col < 20 AND "row" >= 5 AND "row" < 30""")
def _(t):
    return X.crop(t.spectra, [[2, 12, 1, 9], [8, 20, 5, 30]])


@query("valid_mask", SPEC + " valid:b",
       """SELECT cube_id, "row", col, list_sum(spectrum) > 32 AS valid FROM spectra""")
def _(t):
    return X.valid_mask(t.spectra, 32)


@query("fix_band_count", SPEC + " n:i last_value:d",
       """SELECT cube_id, "row", col, 60 AS n, spectrum[60] AS last_value FROM spectra""")
def _(t):
    kept, _ = X.fix_band_count(t.spectra, 60)
    return kept.withColumn("n", F.size("spectrum")).withColumn("last_value", F.get("spectrum", 59))


@query("fix_band_count_rejects", SPEC + " n_bands:i",
       """SELECT cube_id, "row", col, len(spectrum) AS n_bands FROM (
            SELECT cube_id, "row", col, CASE WHEN col % 3 = 0 THEN spectrum[1:40] ELSE spectrum END AS spectrum FROM spectra)
          WHERE len(spectrum) < 50""")
def _(t):
    cut = F.when(F.col("col") % 3 == 0, F.slice("spectrum", 1, 40)).otherwise(F.col("spectrum"))
    return X.fix_band_count(t.spectra.withColumn("spectrum", cut), 50)[1]


@query("gain_offset", SPEC + " band:i value:d",
       """SELECT cube_id, "row", col, band, value * (1 + band * 0.01::DOUBLE) + band * 0.5::DOUBLE AS value FROM long_spectra""")
def _(t):
    n = range(64)
    return X.explode_spectrum(X.gain_offset(t.spectra, [1 + i * 0.01 for i in n], [i * 0.5 for i in n]))


@query("explode_spectrum", SPEC + " band:i value:d", """SELECT cube_id, "row", col, band, value FROM long_spectra""")
def _(t):
    return X.explode_spectrum(t.spectra)


@query("to_uint8", "scene_order:i row:i col:i v:n",
       """SELECT scene_order, "row", col, CAST(floor(greatest(0, least(1, (b08 - b04) / nullif(b08 + b04, 0))) * 255) AS INT) AS v
          FROM pixels""")
def _(t):
    ratio = F.try_divide(F.col("b08") - F.col("b04"), F.col("b08") + F.col("b04"))
    return t.pixels.withColumn("v", S.to_uint8(ratio))


@query("amplitude", SPEC + " amplitude:d",
       """SELECT cube_id, "row", col, abs(list_max(spectrum) - list_min(spectrum)) AS amplitude FROM spectra""")
def _(t):
    return t.spectra.withColumn("amplitude", S.amplitude())


@query("band_amplitude", "band:i amplitude:d",
       "SELECT band, max(value) - min(value) AS amplitude FROM long_spectra GROUP BY band")
def _(t):
    return X.band_amplitude(t.spectra)


@query("vector_norm", SPEC + " l1:d l2:d linf:d l3:d",
       """SELECT cube_id, "row", col, sum(abs(value)) AS l1, sqrt(sum(value * value)) AS l2, max(abs(value)) AS linf,
                 pow(sum(pow(abs(value), 3)), 1.0::DOUBLE / 3) AS l3 FROM long_spectra GROUP BY ALL""")
def _(t):
    return t.spectra.select(
        "cube_id", "row", "col", S.vector_norm(ord=1).alias("l1"), S.vector_norm().alias("l2"),
        S.vector_norm(ord=float("inf")).alias("linf"), S.vector_norm(ord=3).alias("l3"),
    )


@query("normalize_detection", "det_id:i conf:d cls:i name:s x1:d utc:s",
       """SELECT det_id, CASE WHEN c > 1.5 THEN c / 100 ELSE greatest(0, least(c, 1)) END AS conf, coalesce(k, 0) AS cls,
                 CASE coalesce(k, 0) WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup'
                   ELSE CAST(coalesce(k, 0) AS VARCHAR) END AS name, x1,
                 CASE WHEN det_id % 5 = 0 THEN NULL ELSE 'u' || CAST(det_id AS VARCHAR) END AS utc
          FROM (SELECT det_id, x1, CASE WHEN det_id % 3 = 0 THEN conf * 100 WHEN det_id % 7 = 0 THEN 0.0::DOUBLE ELSE conf END AS c,
                       CASE WHEN det_id % 11 = 0 THEN NULL ELSE cls END AS k FROM detections)""")
def _(t):
    from canopy.operators.telemetry import normalize_detection

    e = F.col("det_id")
    raw = t.detections.select(
        "det_id",
        F.when(e % 3 == 0, (F.col("conf") * 100).cast("string")).when(e % 7 == 0, "none").otherwise(F.col("conf").cast("string")).alias("conf"),
        F.when(e % 11 != 0, F.col("cls").cast("string")).alias("cls"), F.col("x1").cast("string").alias("x1"),
        F.when(e % 5 == 0, " ").otherwise(F.concat(F.lit("u"), e.cast("string"))).alias("utc"),
    )
    return normalize_detection(raw, ["view", "click", "purchase", "signup"])


@query("stride_frames", "det_id:i frame:i", "SELECT det_id, frame FROM detections WHERE frame % 3 = 0")
def _(t):
    from canopy.operators.telemetry import stride_frames

    return stride_frames(t.detections, 3)


@query("min_confidence", "det_id:i conf:d", "SELECT det_id, conf FROM detections WHERE NOT conf < 0.35")
def _(t):
    from canopy.operators.telemetry import min_confidence

    return min_confidence(t.detections, 0.35)


@query("allowed_classes", "det_id:i cls:i", "SELECT det_id, cls FROM detections WHERE cls IN (0, 2)")
def _(t):
    from canopy.operators.telemetry import allowed_classes

    return allowed_classes(t.detections, [0, 2])


@query("confidence_style", "det_id:i style:s",
       """SELECT det_id, CASE WHEN det_id % 9 = 0 THEN '#3388ff' WHEN conf >= 0.8 THEN '#2ecc71' WHEN conf >= 0.5 THEN '#f1c40f'
            ELSE '#e74c3c' END AS style FROM detections""")
def _(t):
    conf = F.when(F.col("det_id") % 9 != 0, F.col("conf"))
    return t.detections.withColumn("style", D.confidence_style(conf))


@query("dms_to_decimal", "video_id:s frame:i lat:d lon:d",
       """SELECT video_id, frame, -(54 + (frame % 60) / 60.0::DOUBLE + (frame % 7) / 3600.0::DOUBLE) AS lat,
                 24 + (frame % 50) / 60.0::DOUBLE + 1.5::DOUBLE / 3600 AS lon FROM telemetry""")
def _(t):
    f = F.col("frame")
    return t.telemetry.select(
        "video_id", "frame",
        G.dms_to_decimal(F.lit(54), f % 60, f % 7, F.lit("S")).alias("lat"),
        G.dms_to_decimal(F.lit(24), f % 50, F.lit(1.5), F.lit("E")).alias("lon"),
    )


@query("class_names", "det_id:i name:s", "SELECT det_id, name FROM detections")
def _(t):
    return t.detections.select("det_id", D.class_name("cls", CLASS_NAMES).alias("name"))
