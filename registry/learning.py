"""Dataflow around models."""

import numpy as np
from pyspark.sql import functions as F

from canopy.functions import spectral as S
from canopy.operators import learning as L, spectra as X
from registry.core import query

KEY = "cube_id:s row:i col:i"


def _linear_model():
    """Scores of four classes: sums over four stretches of the spectrum."""
    w = np.zeros((64, 4))
    for k in range(4):
        w[k * 16 : (k + 1) * 16, k] = 1.0
    return lambda x: x @ w


SUMS = ", ".join(f"list_sum(spectrum[{k * 16 + 1}:{k * 16 + 16}])" for k in range(4))


@query("score_pixels", KEY + " class:i score:d",
       f"""SELECT cube_id, "row", col, unnest([0,1,2,3]) AS class, unnest([{SUMS}]) AS score FROM spectra""")
def _(t):
    scored = L.score_pixels(t.spectra, _linear_model)
    return scored.select("cube_id", "row", "col", F.posexplode("scores").alias("class", "score"))


@query("argmax_class", KEY + " class:i",
       f"""SELECT cube_id, "row", col, list_position(s, list_max(s)) - 1 AS class FROM (
             SELECT cube_id, "row", col, list_transform([{SUMS}], lambda x: round(x, 0)) AS s FROM spectra)""")
def _(t):
    scores = L.score_pixels(t.spectra, _linear_model)
    return scores.withColumn("class", S.argmax(F.transform("scores", lambda x: F.round(x, 0))))


@query("l2_normalize_spectra", KEY + " band:i value:d",
       """SELECT cube_id, "row", col, band, value / sqrt(sum(value * value) OVER (PARTITION BY cube_id, "row", col)) AS value FROM long_spectra""")
def _(t):
    return X.explode_spectrum(X.l2_normalize_spectra(t.spectra))


@query("patches", "cube_id:s patch_row:i patch_col:i n:i total:d",
       """WITH p AS (SELECT 'all' AS cube_id, "row" // 2 AS patch_row, col // 4 AS patch_col, count(*) AS n, sum(list_sum(spectrum)) AS total FROM spectra GROUP BY ALL)
          SELECT * FROM p WHERE n = 8""")
def _(t):
    # The two cubes interleave; together they fill the grid.
    p = L.patches(t.spectra.withColumn("cube_id", F.lit("all")), 2, 4)
    return p.select("cube_id", "patch_row", "patch_col", F.size("patch").alias("n"),
                    F.aggregate(F.flatten("patch"), F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("patches_dense", "patch_row:i patch_col:i n:i first_value:d last_value:d",
       """WITH p AS (SELECT pr.i AS patch_row, pc.j AS patch_col, count(*) AS n, min_by(spectrum[1], ("row", col)) AS first_value, max_by(spectrum[64], ("row", col)) AS last_value
                     FROM spectra, range(100) pr(i), range(30) pc(j) WHERE "row" >= i * 2 AND "row" < i * 2 + 3 AND col >= j * 2 AND col < j * 2 + 4 GROUP BY ALL)
          SELECT * FROM p WHERE n = 12""")
def _(t):
    one = t.spectra.withColumn("cube_id", F.lit("all"))
    p = L.patches(one, 3, 4, stride=2)
    return p.select("patch_row", "patch_col", F.size("patch").alias("n"), F.get(F.get("patch", 0), 0).alias("first_value"), F.get(F.get("patch", 11), 63).alias("last_value"))


@query("kmeans_clusters", "cluster:i dim:i value:d")
def _(t):
    model = L.kmeans_clusters(t.spectra, 4, n_init=3, max_iter=20)
    centers = L.cluster_centers(model)
    assigned = t.spectra.withColumn("cluster", S.argmax(L_soft(centers)))
    return X.explode_spectrum(assigned).groupBy("cluster", F.col("band").alias("dim")).agg(F.avg("value").alias("value"))


def L_soft(centers):
    known = F.array(*[F.lit(c) for c in centers])
    near = lambda c: -F.aggregate(F.zip_with("spectrum", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v)
    return F.transform(known, near)


CENTERS = [[0.5 + 0.02 * k * (1 if i % 2 else -1) for i in range(64)] for k in range(3)]
_Q = " , ".join(
    "1 / (1 + " + " + ".join(f"pow(spectrum[{i + 1}] - {c[i]!r}::DOUBLE, 2)" for i in range(64)) + ")" for c in CENTERS
)
SOFT = f"""SELECT cube_id, "row", col, list_transform(s, lambda x: x / list_sum(s)) AS q FROM (SELECT cube_id, "row", col, [{_Q}] AS s FROM spectra)"""


@query("soft_assign", KEY + " cluster:i q:d", f"""SELECT cube_id, "row", col, unnest([0,1,2]) AS cluster, unnest(q) AS q FROM ({SOFT})""")
def _(t):
    return L.soft_assign(t.spectra, CENTERS).select("cube_id", "row", "col", F.posexplode("q").alias("cluster", "q"))


@query("target_distribution", KEY + " cluster:i p:d",
       f"""SELECT cube_id, "row", col, cluster, w / sum(w) OVER (PARTITION BY cube_id, "row", col) AS p FROM (
             SELECT *, q * q / sum(q) OVER (PARTITION BY cluster) AS w FROM (SELECT cube_id, "row", col, unnest([0,1,2]) AS cluster, unnest(q) AS q FROM ({SOFT})))""")
def _(t):
    q = L.soft_assign(t.spectra, CENTERS)
    return L.target_distribution(q).select("cube_id", "row", "col", F.posexplode("p").alias("cluster", "p"))
