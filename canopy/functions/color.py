"""Spectra to colour, and colour ramps, as native columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, functions as F


def _lobe(nm: np.ndarray, mean: float, low: float, high: float) -> np.ndarray:
    t = (nm - mean) * np.where(nm < mean, low, high)
    return np.exp(-0.5 * t * t)


def color_matching(wavelengths: Sequence[float]) -> np.ndarray:
    """CIE 1931 colour-matching functions by the published multi-lobe fit (3 x bands)."""
    nm = np.asarray(wavelengths, dtype=float)
    # Amplitude, mean and inverse widths of each lobe.
    x = (0.362 * _lobe(nm, 442.0, 0.0624, 0.0374) + 1.056 * _lobe(nm, 599.8, 0.0264, 0.0323)
         - 0.065 * _lobe(nm, 501.1, 0.0490, 0.0382))
    y = 0.821 * _lobe(nm, 568.8, 0.0213, 0.0247) + 0.286 * _lobe(nm, 530.9, 0.0613, 0.0322)
    z = 1.217 * _lobe(nm, 437.0, 0.0845, 0.0278) + 0.681 * _lobe(nm, 459.0, 0.0385, 0.0725)
    return np.stack([x, y, z])


def xyz_weights(wavelengths: Sequence[float], y_gain: float = 1.0) -> np.ndarray:
    """Trapezoid weights times matching functions for 380 < nm < 780, zero elsewhere."""
    nm = np.asarray(wavelengths, dtype=float)
    use = np.flatnonzero((nm > 380) & (nm < 780))
    w = np.zeros(len(nm))
    step = np.diff(nm[use]) / 2
    w[use[:-1]] += step
    w[use[1:]] += step
    out = color_matching(nm) * w
    out[1] *= y_gain
    return out


def spectrum_to_xyz(wavelengths: Sequence[float], spectrum: str = "spectrum", y_gain: float = 1.0) -> Column:
    """Integrated X, Y, Z: one weighted sum per channel."""
    weights = xyz_weights(wavelengths, y_gain)

    def channel(i: int) -> Column:
        w = F.lit([float(v) for v in weights[i]])
        return F.aggregate(F.zip_with(spectrum, w, lambda s, k: s * k), F.lit(0.0), lambda a, v: a + v)

    return F.struct(channel(0).alias("x"), channel(1).alias("y"), channel(2).alias("z"))


# XYZ to linear sRGB, D65 white.
SRGB_MATRIX = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))


def xyz_to_srgb(x: Column, y: Column, z: Column) -> Column:
    def encode(v: Column) -> Column:
        bent = 1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055
        return F.when(v <= 0.0031308, 12.92 * v).otherwise(bent)

    return F.struct(*[
        encode(a * x + b * y + c * z).alias(n) for n, (a, b, c) in zip(("r", "g", "b"), SRGB_MATRIX)
    ])


def spectrum_to_rgb(wavelengths: Sequence[float], spectrum: str = "spectrum", y_gain: float = 1.0) -> Column:
    xyz = spectrum_to_xyz(wavelengths, spectrum, y_gain)
    return xyz_to_srgb(xyz["x"], xyz["y"], xyz["z"])


def hex_rgb(color: str) -> tuple[float, float, float]:
    return tuple(int(color[i : i + 2], 16) / 255 for i in (1, 3, 5))


def _unit_stops(n: int, values: Sequence[float] | None) -> list[float]:
    if values is None:
        return [i / (n - 1) for i in range(n)]
    if len(values) != n:
        raise ValueError("as many stop values as colours are needed")
    v = sorted(float(x) for x in values)
    return [(x - v[0]) / (v[-1] - v[0]) for x in v]


def _interpolate(c: Column, stops: Sequence[float], levels: Sequence[float]) -> Column:
    """Piecewise-linear, held constant outside the stops."""
    out = F.when(c <= stops[0], float(levels[0]))
    for a, b, la, lb in zip(stops, stops[1:], levels, levels[1:]):
        if b > a:
            out = out.when(c <= b, la + (c - a) * ((lb - la) / (b - a)))
    return out.when(c > stops[-1], float(levels[-1]))


def colorize(c: Column, colors: Sequence[str], values: Sequence[float] | None = None) -> Column:
    """Colour ramp over 0..1 as ``struct(r, g, b)``; stop values are scaled to 0..1."""
    stops = _unit_stops(len(colors), values)
    rgb = [hex_rgb(x) for x in colors]
    return F.struct(*[_interpolate(c, stops, [p[i] for p in rgb]).alias(n) for i, n in enumerate("rgb")])


def colorize_gaussian(
    c: Column, lo: Column, hi: Column, colors: Sequence[str], values: Sequence[float] | None = None, steps: int = 100
) -> Column:
    """Sum of Gaussian bumps around the stops, tabulated over ``steps`` points between
    the global minimum ``lo`` and maximum ``hi``, interpolated and clipped at 1."""
    stops = _unit_stops(len(colors), values)
    rgb = [hex_rgb(x) for x in colors]
    sigma = 1 / len(colors)

    def bump(at: Column, channel: int) -> Column:
        total = F.lit(0.0)
        for s, p in zip(stops, rgb):
            d = (at - s) / sigma
            total = total + p[channel] * F.exp(-d * d / 2)
        return total

    step = (hi - lo) / (steps - 1)
    pos = F.when(step > 0, (c - lo) / step).otherwise(0.0)
    k = F.least(F.greatest(F.floor(pos), F.lit(0)), F.lit(steps - 2))
    frac = F.least(F.greatest(pos - k, F.lit(0.0)), F.lit(1.0))
    left, right = lo + k * step, lo + (k + 1) * step
    blend = lambda i: F.least(F.lit(1.0), bump(left, i) + (bump(right, i) - bump(left, i)) * frac)
    return F.struct(*[blend(i).alias(n) for i, n in enumerate("rgb")])


def colorize_lut(c: Column, lut: Sequence[Sequence[int]]) -> Column:
    """Colour of a 0..1 value from a 256-entry table."""
    table = F.lit([int(v) for row in lut for v in row])
    i = F.least(F.greatest(F.floor(c * 255), F.lit(0)), F.lit(len(lut) - 1)).cast("int")
    return F.struct(*[F.get(table, i * 3 + k).alias(n) for k, n in enumerate("rgb")])


def ramp_lut(colors: Sequence[str], size: int = 256) -> list[list[int]]:
    """Table sampled from a ramp of evenly spaced colours, 0..255 truncated."""
    rgb = np.array([hex_rgb(c) for c in colors])
    at = np.linspace(0, 1, size)
    stops = np.linspace(0, 1, len(colors))
    return [[int(math.floor(np.interp(t, stops, rgb[:, i]) * 255)) for i in range(3)] for t in at]
