"""Spectral and vegetation indices."""

from canopy.adapters import WAVELENGTHS
from canopy.functions import spectral as S, vegetation as V
from canopy.operators import spectra as X
from registry.core import query

KEY = "cube_id:s row:i col:i"


def b(nm):
    """SQL for the band nearest to nm on the 9.6 nm axis."""
    i = min(63, max(0, round((nm - 397.66) / 9.6)))
    return f"spectrum[{i + 1}]"


def nd(p, q):
    return f"coalesce(({p} - {q}) / nullif({p} + {q}, 0), 0)"


def rt(p, q):
    return f"coalesce({p} / nullif({q}, 0), 0)"


SQL = {
    "ndvi": nd(b(800), b(670)),
    "cci": nd(b(532), b(630)),
    "ari1": f"{rt('1', b(550))} - {rt('1', b(700))}",
    "cri1": f"{rt('1', b(510))} - {rt('1', b(550))}",
    "sipi": rt(f"({b(800)} - {b(445)})", f"({b(800)} - {b(680)})"),
    "pri": nd(b(531), b(570)),
    "wbi": rt(b(970), b(900)),
    "vri1": rt(b(740), b(720)),
    "rep": f"""CASE WHEN abs(700 + 40 * ((({b(670)} + {b(780)}) / 2 - {b(700)}) / nullif({b(740)} - {b(700)}, 0))) <= 10000
               THEN 700 + 40 * ((({b(670)} + {b(780)}) / 2 - {b(700)}) / nullif({b(740)} - {b(700)}, 0)) ELSE 0 END""",
    "yi": f"({b(580)} - 2 * {b(624)} + {b(668)}) / (0.044::DOUBLE * 0.044::DOUBLE)",
    "pssr_1": rt(b(800), b(680)), "pssr_2": rt(b(800), b(635)), "pssr_3": rt(b(800), b(470)),
}


def _register(name):
    @query(f"index_{name}", f"{KEY} {name}:d", f'SELECT cube_id, "row", col, {SQL[name]} AS {name} FROM spectra')
    def _(t):
        return t.spectra.withColumn(name, S.INDICES[name](S.band_reader(WAVELENGTHS)))


for _name in ("ndvi", "cci", "ari1", "cri1", "sipi", "pri", "wbi", "vri1", "rep", "yi"):
    _register(_name)


@query("index_ndvi_threshold", f"{KEY} ndvi:d",
       f'SELECT cube_id, "row", col, CASE WHEN {SQL["ndvi"]} < 0.05 THEN 0 ELSE {SQL["ndvi"]} END AS ndvi FROM spectra')
def _(t):
    return t.spectra.withColumn("ndvi", S.ndvi(S.band_reader(WAVELENGTHS), threshold=0.05))


@query("index_pssr", f"{KEY} pssr_1:d pssr_2:d pssr_3:d",
       f'SELECT cube_id, "row", col, {SQL["pssr_1"]} AS pssr_1, {SQL["pssr_2"]} AS pssr_2, {SQL["pssr_3"]} AS pssr_3 FROM spectra')
def _(t):
    return t.spectra.withColumn("p", S.pssr(S.band_reader(WAVELENGTHS))).select("cube_id", "row", "col", "p.*")


@query("all_indices", f"{KEY} index:s value:d",
       " UNION ALL ".join(f"""SELECT cube_id, "row", col, '{n}' AS "index", {e} AS value FROM spectra""" for n, e in SQL.items()))
def _(t):
    return X.all_indices(t.spectra, list(S.INDICES), WAVELENGTHS)


P = "scene_order:i row:i col:i"


@query("s2_ndvi", f"{P} v:d v8:n",
       """SELECT scene_order, "row", col, v, floor(v * 255) AS v8 FROM (
            SELECT scene_order, "row", col, greatest(0, least(1, (b08 - b04) / nullif(b08 + b04, 0))) AS v FROM pixels)""")
def _(t):
    return t.pixels.withColumn("v", V.s2_ndvi()).withColumn("v8", V.s2_ndvi(scaled=True))


@query("s2_nbr", f"{P} v:d v8:n",
       """SELECT scene_order, "row", col, v, floor(v * 255) AS v8 FROM (
            SELECT scene_order, "row", col, greatest(0, least(1, (b08 - b12) / nullif(b08 + b12, 0))) AS v FROM pixels)""")
def _(t):
    return t.pixels.withColumn("v", V.s2_nbr()).withColumn("v8", V.s2_nbr(scaled=True))


@query("s2_msi", f"{P} v:d v8:n",
       """SELECT scene_order, "row", col, v, floor(v * 85) AS v8 FROM (
            SELECT scene_order, "row", col, greatest(0, least(3, b11 / nullif(b08, 0))) AS v FROM pixels)""")
def _(t):
    return t.pixels.withColumn("v", V.s2_msi()).withColumn("v8", V.s2_msi(scaled=True))


def _lai_sql():
    raw = {k: f"{k} / 10000" for k in list(V.LAI_INPUTS)[:8]}
    raw["view_zenith"], raw["sun_zenith"] = "cos(radians(zenith))", "cos(radians(azimuth))"
    raw["relative_azimuth"] = "cos(radians(zenith - azimuth))"
    norm = ", ".join(
        f"2 * ({raw[k]} - {lo!r}::DOUBLE) / ({hi!r}::DOUBLE - {lo!r}::DOUBLE) - 1 AS x{i}"
        for i, (k, (lo, hi, _)) in enumerate(V.LAI_INPUTS.items())
    )
    weights = [w for _, _, w in V.LAI_INPUTS.values()]
    neurons = ", ".join(
        f"tanh({V.LAI_BIAS[j]!r}::DOUBLE + " + " + ".join(f"({w[j]!r}::DOUBLE) * x{i}" for i, w in enumerate(weights)) + f") AS n{j}"
        for j in range(5)
    )
    out = f"{V.LAI_OUTPUT_BIAS!r}::DOUBLE + " + " + ".join(f"({w!r}::DOUBLE) * n{j}" for j, w in enumerate(V.LAI_OUTPUT_WEIGHTS))
    lo, hi = V.LAI_RANGE
    return f"""SELECT scene_order, "row", col, CASE WHEN b03 <> 0 THEN greatest(0, least(3,
                 (0.5::DOUBLE * ({out} + 1) * ({hi!r}::DOUBLE - {lo!r}::DOUBLE) + {lo!r}::DOUBLE) / 3)) END AS lai
               FROM (SELECT *, {neurons} FROM (SELECT *, {norm} FROM pixels))"""


@query("s2_lai", f"{P} lai:d", _lai_sql())
def _(t):
    return V.with_lai(t.pixels)
