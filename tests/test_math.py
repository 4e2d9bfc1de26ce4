"""Projections, filters, colours and indices against published values and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.functions import color as C, detection as D, geometry as G, signal as S, spectral as Sp, vegetation as V
from canopy.functions.projection import reproject
from canopy.operators import learning as L, regions as R, stats as St
from canopy.plans import drone


def _points(spark, rows):
    return spark.createDataFrame([(float(a), float(b)) for a, b in rows], "x double, y double")


def test_utm_control_points(spark):
    """The point where zone 35's central meridian meets the equator, and the published
    Toronto tower example (zone 17: 630084 E, 4833438 N)."""
    a = reproject(_points(spark, [(27, 0)]), "x", "y", 4326, 32635).first()
    assert (a.x, a.y) == pytest.approx((500000, 0), abs=1e-6)
    b = reproject(_points(spark, [(-(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600)]), "x", "y", 4326, 32617).first()
    assert (b.x, b.y) == pytest.approx((630084, 4833438), abs=1.0)


def test_meridian_arc(spark):
    """On the central meridian the northing is the scaled meridian arc (numerical integral)."""
    e2 = 2 / 298.257223563 - 1 / 298.257223563**2
    phi = np.linspace(0, math.radians(55), 200001)
    m = 6378137 * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    arc = np.trapezoid(m, phi)
    got = reproject(_points(spark, [(27, 55)]), "x", "y", 4326, 32635).first()
    assert got.y == pytest.approx(0.9996 * arc, abs=1e-3)


@pytest.mark.parametrize("epsg", [32634, 32735, 3346, 3857])
def test_round_trip(spark, epsg):
    lat = -30 if epsg == 32735 else 54
    pts = [(lon, lat + d) for lon in (21.5, 24, 26.4) for d in (-2, 0, 1.7)]
    df = _points(spark, pts).withColumn("a", F.col("x")).withColumn("b", F.col("y"))
    out = reproject(reproject(df, "x", "y", 4326, epsg), "x", "y", epsg, 4326).collect()
    assert all(abs(r.x - r.a) * 111320 < 1e-3 and abs(r.y - r.b) * 111320 < 1e-3 for r in out)


def test_unknown_projection(spark):
    with pytest.raises(ValueError):
        reproject(_points(spark, [(1, 2)]), "x", "y", 4326, 27700)


def test_fft_filter(spark):
    x = np.sin(np.arange(50)) + 0.1 * np.arange(50)
    w = np.linspace(1, 0, 33)
    df = spark.createDataFrame([(x.tolist(),), (x[:40].tolist(),)], "v array<double>")
    got = [r.o for r in df.select(S.fft_filter("v", w.tolist()).alias("o")).collect()]
    for g, n in zip(got, (50, 40)):
        assert g == pytest.approx(np.fft.irfft(np.fft.rfft(x[:n], 64) * w).tolist())
    assert df.select(S.fft_filter("v", None).alias("o")).first().o == pytest.approx(x.tolist())
    with pytest.raises(Exception, match="33 are needed"):
        df.select(S.fft_filter("v", [1.0]).alias("o")).collect()


@pytest.mark.parametrize("window,order,deriv", [(15, 3, 0), (5, 2, 0), (9, 2, 1)])
def test_savgol(spark, window, order, deriv):
    """Polynomial fit per window, the end windows evaluated at their own points."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=40)
    half, want = window // 2, []
    for i in range(40):
        a = min(max(i - half, 0), 40 - window)
        p = np.polynomial.Polynomial.fit(np.arange(window), x[a : a + window], order)
        want.append(p.deriv(deriv)(i - a) if deriv else p(i - a))
    df = spark.createDataFrame([(x.tolist(),)], "v array<double>")
    got = df.select(S.savgol("v", 40, window, order, deriv).alias("o")).first().o
    assert got == pytest.approx(want, abs=1e-9)


def test_matching_functions():
    """Peaks and the equal-energy white point of the fitted curves."""
    nm = np.arange(380, 781.0)
    x, y, z = C.color_matching(nm)
    assert abs(nm[y.argmax()] - 555) < 6 and abs(nm[x.argmax()] - 599) < 6 and abs(nm[z.argmax()] - 446) < 6
    s = [np.trapezoid(v, nm) for v in (x, y, z)]
    assert s[0] / sum(s) == pytest.approx(1 / 3, abs=1e-2) and s[1] / sum(s) == pytest.approx(1 / 3, abs=1e-2)


def test_spectrum_to_xyz(spark):
    axis = [370.0 + 10 * i for i in range(45)]
    spike = [0.0] * 45
    spike[19] = 1.0  # 560 nm
    df = spark.createDataFrame([(spike,)], "spectrum array<double>")
    got = df.select(C.spectrum_to_xyz(axis).alias("c")).select("c.*").first()
    want = C.color_matching([560.0])[:, 0] * 10
    assert (got.x, got.y, got.z) == pytest.approx(tuple(want))
    assert C.xyz_weights(axis)[:, 0].tolist() == [0, 0, 0] and C.xyz_weights(axis)[1, 2] > 0


def test_colorize(spark):
    df = _points(spark, [(0, 0), (0.5, 0), (1, 0), (2, 0), (-1, 0), (0.25, 0)])
    got = [(r.r, r.g, r.b) for r in df.select(C.colorize(F.col("x"), ["#FF0000", "#00FF00", "#0000FF"]).alias("c")).select("c.*").collect()]
    assert np.allclose(got, [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 1), (1, 0, 0), (0.5, 0.5, 0)])


def test_quadratic_calibration(spark):
    """Plates on a known parabola give back its coefficients, and plate means map to reflectance."""
    rng = np.random.default_rng(2)
    raw = rng.uniform(0.2, 0.9, size=(6, 4))
    a, b, c = 0.3, 0.5, -0.02
    rows = [(k + 1, band, float(raw[k, band]), float(a * raw[k, band] ** 2 + b * raw[k, band] + c)) for k in range(6) for band in range(4)]
    fit = St.fit_calibration(spark.createDataFrame(rows, "class int, band int, raw double, reflectance double"), 2)
    assert all(r.coeffs == pytest.approx([a, b, c], abs=1e-8) for r in fit.collect())
    cubes = spark.createDataFrame([("c", 0, 0, raw[2].tolist())], "cube_id string, row int, col int, spectrum array<double>")
    got = St.apply_calibration(cubes, fit).first().spectrum
    assert got == pytest.approx([r[3] for r in rows if r[0] == 3])


def test_lai_matches_numpy(spark):
    rng = np.random.default_rng(3)
    bands = {b: rng.uniform(100, 4000, 20) for b in list(V.LAI_INPUTS)[:8]}
    zen, azi = rng.uniform(20, 60, 20), rng.uniform(100, 200, 20)
    x = [bands[b] / 1e4 for b in bands] + [np.cos(np.radians(zen)), np.cos(np.radians(azi)), np.cos(np.radians(zen - azi))]
    norm = np.array([2 * (v - lo) / (hi - lo) - 1 for v, (lo, hi, _) in zip(x, V.LAI_INPUTS.values())])
    weights = np.array([w for _, _, w in V.LAI_INPUTS.values()])
    hidden = np.tanh(weights.T @ norm + np.array(V.LAI_BIAS)[:, None])
    out = V.LAI_OUTPUT_BIAS + np.array(V.LAI_OUTPUT_WEIGHTS) @ hidden
    lo, hi = V.LAI_RANGE
    want = np.clip((0.5 * (out + 1) * (hi - lo) + lo) / 3, 0, 3)
    rows = [tuple(float(bands[b][i]) for b in bands) + (float(zen[i]), float(azi[i])) for i in range(20)]
    df = spark.createDataFrame(rows, ", ".join(f"{b} double" for b in [*bands, "zenith", "azimuth"]))
    assert [r.v for r in df.select(V.s2_lai().alias("v")).collect()] == pytest.approx(want.tolist())


def test_footprint(spark):
    """Hull of an L of pixels; the same over one-row blocks."""
    cells = [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2)]
    px = spark.createDataFrame([("s", r, c) for r, c in cells], "cube_id string, row int, col int")
    for block in (1, 1024):
        pts = {(r.x, r.y) for r in R.footprint(px, block=block).collect()}
        assert pts == {(0, 0), (1, 0), (3, 2), (3, 3), (0, 3)}
    ring = R.footprint_regions(R.footprint(px), "cube_id", (10, 0, 500000, 0, -10, 6000000), 32635).first()
    assert len(ring.xy) == 5 and 26.9 < ring.lon < 27.1 and 54 < ring.lat < 54.2


def test_polygon_with_hole(spark):
    """Even-odd over rings: the hole's cells are out, with an exact centre on the border once."""
    sq = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    rows = [("r", 0, 0, [dict(x=float(x), y=float(y)) for x, y in sq(0, 6)]), ("r", 0, 1, [dict(x=float(x), y=float(y)) for x, y in sq(2, 4)])]
    reg = spark.createDataFrame(rows, "region_id string, part int, ring int, xy array<struct<x:double,y:double>>")
    cells = {(r.row, r.col) for r in R.region_cells(reg).collect()}
    assert cells == {(y, x) for y in range(6) for x in range(6)} - {(y, x) for y in (2, 3) for x in (2, 3)}
    got = R.centroid_area(reg).first()
    assert got.area == 32 and (got.cx, got.cy) == pytest.approx((3, 3))


def test_ground_projection(spark):
    """Straight down hits below the drone; a level camera does not hit."""
    df = spark.createDataFrame([(320.0, 256.0, -90.0), (320.0, 256.0, 0.0), (320.0, 256.0, 90.0)], "u double, v double, pitch double")
    fx = D.focal_pixels(640, F.lit(24.0), F.lit(1.0))
    g = D.project_to_ground("u", "v", 640, 512, F.lit(54.0), F.lit(24.0), F.lit(60.0), F.lit(0.0), "pitch", F.lit(0.0), fx)
    down, level, up = [r.g for r in df.select(g.alias("g")).collect()]
    assert (down.lat, down.lon) == pytest.approx((54.0, 24.0)) and level is None and up is None


def test_haversine_symmetric(spark):
    df = _points(spark, [(24, 54), (25.5, 55)])
    a = df.select(G.haversine_m("y", "x", F.lit(54.5), F.lit(24.2)).alias("a"), G.haversine_m(F.lit(54.5), F.lit(24.2), "y", "x").alias("b")).collect()
    assert all(r.a == pytest.approx(r.b) for r in a)
    d = _points(spark, [(0, 0)]).select(G.haversine_m("y", "x", F.lit(1.0), F.lit(0.0)).alias("d")).first().d
    assert d == pytest.approx(6371000 * math.pi / 180)


def test_tile_bounds_hold_the_point(spark):
    df = _points(spark, [(24.1, 54.7), (-179.999, 85.2), (179.999, -86), (0, 0)])
    t = df.withColumn("t", G.lonlat_to_tile("x", "y", 9)).select("x", "y", G.tile_bounds("t.x", "t.y", 9).alias("b")).collect()
    for r in t:
        y = max(min(r.y, 85.05112878), -85.05112878)
        assert r.b.lon_min - 1e-9 <= r.x <= r.b.lon_max + 1e-9 and r.b.lat_min - 1e-6 <= y <= r.b.lat_max + 1e-6


def test_kmeans_and_models(spark):
    rng = np.random.default_rng(4)
    rows = [("c", i, 0, (rng.normal(scale=0.05, size=4) + (i % 3)).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "cube_id string, row int, col int, spectrum array<double>")
    model = L.kmeans_clusters(df, 3, n_init=4)
    assert sorted(round(c[0]) for c in L.cluster_centers(model)) == [0, 1, 2]
    scored = L.score_pixels(df, model)
    assert scored.select("prediction").distinct().count() == 3
    one = L.score_pixels(df, lambda: lambda x: x.sum(axis=1), "score double").orderBy("row").first()
    assert one.score == pytest.approx(sum(rows[0][3]))


def test_drone_products(spark):
    rng = np.random.default_rng(5)
    axis = Sp.camera_wavelengths(64)
    x = rng.uniform(0.1, 0.9, size=(30, 64))
    x[7] = 0
    rows = [("c", i // 6, i % 6, x[i].tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "cube_id string, row int, col int, spectrum array<double>")
    got = drone.drone_products(df, axis).orderBy("row", "col").collect()
    red, nir = x[:, Sp.nearest_band(axis, 670)], x[:, Sp.nearest_band(axis, 800)]
    lo = min(red.min(), nir.min())
    v = np.nan_to_num(np.clip((nir - red) / np.where(nir + red - 2 * lo == 0, np.nan, nir + red - 2 * lo), 0, None))
    unit = (v - v.min()) / (v.max() - v.min())
    assert [r.ndvi for r in got] == [int(u * 255) for u in unit]
    assert got[7].rect_ndvi is None and got[7].rect_rgb_r is None and not got[7].valid
    assert [r.rect_ndvi for i, r in enumerate(got) if i != 7] == pytest.approx([a for i, a in enumerate(v) if i != 7])
    assert max(max(r.rgb_r, r.rgb_g, r.rgb_b) for r in got) == 255
