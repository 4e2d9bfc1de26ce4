"""Signal filters and colour over spectra."""

import math
from fractions import Fraction

from pyspark.sql import functions as F

from canopy.adapters import WAVELENGTHS
from canopy.constants import NDVI_COLORS, NDVI_STOPS
from canopy.functions import color as C, signal as G, vegetation as V
from canopy.operators.spectra import explode_spectrum
from registry.core import query

KEY = "cube_id:s row:i col:i"


def _matrix_sql(m):
    """Product of each spectrum with a literal matrix, given as rows of numbers."""
    cells = ", ".join(f"({i}, {j}, {v!r}::DOUBLE)" for i, row in enumerate(m) for j, v in enumerate(row) if abs(v) > 1e-15)
    return f"""SELECT cube_id, "row", col, i AS band, sum(value * w) AS value FROM long_spectra JOIN (VALUES {cells}) k(i, j, w) ON band = j GROUP BY ALL"""


def _response(f):
    return 0.5 if f < 0.05 else 0.0 if f > 0.3 else 1.0


def _convolution(n=64):
    """The filter as a circular convolution with its impulse response."""
    full = [_response(min(k, n - k) / n) for k in range(n)]
    h = [sum(full[k] * math.cos(2 * math.pi * k * d / n) for k in range(n)) / n for d in range(n)]
    return [[h[(i - j) % n] for j in range(n)] for i in range(n)]


@query("fft_filter", KEY + " band:i value:d", _matrix_sql(_convolution()))
def _(t):
    response = [_response(f) for f in G.fft_frequencies(64)]
    return explode_spectrum(t.spectra.withColumn("spectrum", G.fft_filter("spectrum", response)))


@query("fft_filter_pass", KEY + " part:i band:i value:d", """SELECT cube_id, "row", col, part, band,
            CASE WHEN band < 50 THEN spectrum[band + 1 + part * 14] ELSE 0 END AS value
       FROM spectra, range(2) p(part), range(64) b(band)""")
def _(t):
    """An all-pass response gives the first and the last 50 bands back, padded with zeros to 64."""
    parts = F.array(F.slice("spectrum", 1, 50), F.slice("spectrum", 15, 50))
    cut = t.spectra.select("cube_id", "row", "col", F.posexplode(parts).alias("part", "spectrum"))
    done = cut.withColumn("spectrum", G.fft_filter("spectrum", [1.0] * 33))
    return done.select("cube_id", "row", "col", "part", F.posexplode("spectrum").alias("band", "value"))


def _solve(a, rhs):
    """Exact Gauss elimination over fractions."""
    n = len(a)
    rows = [[Fraction(v) for v in r] + [Fraction(x)] for r, x in zip(a, rhs)]
    for i in range(n):
        p = next(k for k in range(i, n) if rows[k][i] != 0)
        rows[i], rows[p] = rows[p], rows[i]
        rows[i] = [v / rows[i][i] for v in rows[i]]
        for k in range(n):
            if k != i:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i])]
    return [r[n] for r in rows]


def _polynomial_matrix(n, window, order, deriv=0):
    """Least-squares polynomial of each window from exact normal equations."""
    half, out, weights = window // 2, [], {}
    for i in range(n):
        start = min(max(i - half, 0), n - window)
        at = i - start
        if at not in weights:
            gram = [[sum(Fraction(t) ** (p + q) for t in range(window)) for q in range(order + 1)] for p in range(order + 1)]
            powers = [Fraction(math.perm(p, deriv)) * Fraction(at) ** (p - deriv) if p >= deriv else Fraction(0) for p in range(order + 1)]
            c = _solve(gram, powers)
            weights[at] = [float(sum(c[p] * Fraction(t) ** p for p in range(order + 1))) for t in range(window)]
        row = [0.0] * n
        row[start : start + window] = weights[at]
        out.append(row)
    return out


@query("savgol", KEY + " band:i value:d", _matrix_sql(_polynomial_matrix(64, 15, 3)))
def _(t):
    return explode_spectrum(t.spectra.withColumn("spectrum", G.savgol("spectrum", 64, 15, 3)))


@query("savgol_derivative", KEY + " band:i value:d", _matrix_sql(_polynomial_matrix(64, 9, 2, 1)))
def _(t):
    return explode_spectrum(t.spectra.withColumn("spectrum", G.savgol("spectrum", 64, 9, 2, deriv=1)))


def _xyz_sql(y_gain=1.0):
    w = C.xyz_weights(WAVELENGTHS, y_gain)
    terms = lambda i: " + ".join(f"{float(w[i, k])!r}::DOUBLE * spectrum[{k + 1}]" for k in range(64) if w[i, k] != 0)
    return f"""SELECT cube_id, "row", col, {terms(0)} AS x, {terms(1)} AS y, {terms(2)} AS z FROM spectra"""


@query("spectrum_to_xyz", KEY + " x:d y:d z:d", _xyz_sql(1.2))
def _(t):
    return t.spectra.select("cube_id", "row", "col", C.spectrum_to_xyz(WAVELENGTHS, y_gain=1.2).alias("c")).select("cube_id", "row", "col", "c.*")


def _enc(m):
    lin = " + ".join(f"({v}) * {c}" for v, c in zip(m, "xyz"))
    return f"CASE WHEN {lin} <= 0.0031308 THEN 12.92 * ({lin}) ELSE 1.055 * pow(greatest({lin}, 0), 1 / 2.4) - 0.055 END"


@query("spectrum_to_rgb", KEY + " r:d g:d b:d",
       f"""SELECT cube_id, "row", col, {_enc(C.SRGB_MATRIX[0])} AS r, {_enc(C.SRGB_MATRIX[1])} AS g, {_enc(C.SRGB_MATRIX[2])} AS b
           FROM (SELECT cube_id, "row", col, x / 200 AS x, y / 200 AS y, z / 200 AS z FROM ({_xyz_sql()}))""")
def _(t):
    xyz = t.spectra.select("cube_id", "row", "col", C.spectrum_to_xyz(WAVELENGTHS).alias("c"))
    rgb = C.xyz_to_srgb(F.col("c.x") / 200, F.col("c.y") / 200, F.col("c.z") / 200)
    return xyz.select("cube_id", "row", "col", rgb.alias("o")).select("cube_id", "row", "col", "o.*")


def _ramp_sql(v, channel):
    stops = [s / 255 for s in NDVI_STOPS]
    level = [C.hex_rgb(c)[channel] for c in NDVI_COLORS]
    e = f"CASE WHEN {v} <= {stops[0]!r}::DOUBLE THEN {level[0]!r}::DOUBLE"
    for a, b, la, lb in zip(stops, stops[1:], level, level[1:]):
        e += f" WHEN {v} <= {b!r}::DOUBLE THEN {la!r}::DOUBLE + ({v} - {a!r}::DOUBLE) * ({lb!r}::DOUBLE - {la!r}::DOUBLE) / ({b!r}::DOUBLE - {a!r}::DOUBLE)"
    return e + f" ELSE {level[-1]!r}::DOUBLE END"


NDVI = """SELECT scene_order, "row", col, greatest(0, least(1, (b08 - b04) / nullif(b08 + b04, 0))) AS v FROM pixels"""


@query("colorize", "scene_order:i row:i col:i r:d g:d b:d",
       f"""SELECT scene_order, "row", col, {_ramp_sql('v', 0)} AS r, {_ramp_sql('v', 1)} AS g, {_ramp_sql('v', 2)} AS b FROM ({NDVI})""")
def _(t):
    c = C.colorize(F.col("v"), NDVI_COLORS, NDVI_STOPS)
    return t.pixels.withColumn("v", V.s2_ndvi()).select("scene_order", "row", "col", c.alias("c")).select("scene_order", "row", "col", "c.*")


def _gauss_sql(channel, at):
    stops = [s / 255 for s in NDVI_STOPS]
    return "(" + " + ".join(
        f"{C.hex_rgb(c)[channel]!r}::DOUBLE * exp(-pow({at} - {s!r}::DOUBLE, 2) / (2 * pow(1 / {len(stops)}.0::DOUBLE, 2)))" for c, s in zip(NDVI_COLORS, stops)
    ) + ")"


def _gauss_channel(i, n):
    a, b = "lo + k * st", "lo + (k + 1) * st"
    return f"least(1, {_gauss_sql(i, a)} + ({_gauss_sql(i, b)} - {_gauss_sql(i, a)}) * (p - k)) AS {n}"


@query("colorize_gaussian", "scene_order:i row:i col:i r:d g:d b:d",
       f"""SELECT scene_order, "row", col, {_gauss_channel(0, 'r')}, {_gauss_channel(1, 'g')}, {_gauss_channel(2, 'b')} FROM (
             SELECT *, least(floor(p), 98) AS k FROM (SELECT *, (v - lo) / st AS p FROM (
               SELECT *, (max(v) OVER () - min(v) OVER ()) / 99 AS st, min(v) OVER () AS lo FROM ({NDVI}))))""")
def _(t):
    p = t.pixels.select("scene_order", "row", "col", V.s2_ndvi().alias("v"))
    edge = p.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    p = p.withColumn("e", edge)
    c = C.colorize_gaussian(F.col("v"), F.col("e.lo"), F.col("e.hi"), NDVI_COLORS, NDVI_STOPS)
    return p.select("scene_order", "row", "col", c.alias("c")).select("scene_order", "row", "col", "c.*")


@query("colorize_lut", "scene_order:i row:i col:i r:i g:i b:i",
       f"""SELECT scene_order, "row", col, lut[i + 1][1] AS r, lut[i + 1][2] AS g, lut[i + 1][3] AS b FROM (
             SELECT scene_order, "row", col, CAST(floor(v * 255) AS INT) AS i, {C.ramp_lut(NDVI_COLORS)} AS lut FROM ({NDVI}))""")
def _(t):
    c = C.colorize_lut(F.col("v"), C.ramp_lut(NDVI_COLORS))
    return t.pixels.withColumn("v", V.s2_ndvi()).select("scene_order", "row", "col", c.alias("c")).select("scene_order", "row", "col", "c.*")
