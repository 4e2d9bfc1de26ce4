"""Column expressions over one spectrum and over band values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from canopy.constants import CAMERA_BANDS, CAMERA_FIRST_NM, CAMERA_LAST_NM

# nm -> value of the band nearest to that wavelength
BandAt = Callable[[float], Column]


def camera_wavelengths(n: int = CAMERA_BANDS) -> list[float]:
    """Evenly spaced axis over the camera's range; pass measured axes where known."""
    step = (CAMERA_LAST_NM - CAMERA_FIRST_NM) / (n - 1)
    return [CAMERA_FIRST_NM + i * step for i in range(n)]


def nearest_band(wavelengths: Sequence[float], nm: float) -> int:
    """Index of the nearest wavelength, the lowest index on a tie."""
    return min(range(len(wavelengths)), key=lambda i: (abs(wavelengths[i] - nm), i))


def band_reader(wavelengths: Sequence[float], spectrum: str = "spectrum") -> BandAt:
    return lambda nm: F.get(F.col(spectrum), nearest_band(wavelengths, nm))


def ratio(num: Column, den: Column, on_zero: str = "zero") -> Column:
    """``num / den``; a zero denominator gives 0 or NULL."""
    q = F.try_divide(num, den)
    return F.when(den == 0, 0.0).otherwise(q) if on_zero == "zero" else q


def _normalized(a: Column, b: Column, on_zero: str) -> Column:
    return ratio(a - b, a + b, on_zero)


def ndvi(b: BandAt, on_zero: str = "zero", threshold: float | None = None) -> Column:
    v = _normalized(b(800), b(670), on_zero)
    return v if threshold is None else F.when(v < threshold, 0.0).otherwise(v)


def cci(b: BandAt, on_zero: str = "zero") -> Column:
    return _normalized(b(532), b(630), on_zero)


def ari1(b: BandAt, on_zero: str = "zero") -> Column:
    return ratio(F.lit(1.0), b(550), on_zero) - ratio(F.lit(1.0), b(700), on_zero)


def cri1(b: BandAt, on_zero: str = "zero") -> Column:
    return ratio(F.lit(1.0), b(510), on_zero) - ratio(F.lit(1.0), b(550), on_zero)


def sipi(b: BandAt, on_zero: str = "zero") -> Column:
    return ratio(b(800) - b(445), b(800) - b(680), on_zero)


def pri(b: BandAt, on_zero: str = "zero") -> Column:
    return _normalized(b(531), b(570), on_zero)


def wbi(b: BandAt, on_zero: str = "zero") -> Column:
    return ratio(b(970), b(900), on_zero)


def vri1(b: BandAt, on_zero: str = "zero") -> Column:
    return ratio(b(740), b(720), on_zero)


def pssr(b: BandAt, on_zero: str = "zero") -> Column:
    """Three pigment ratios as a struct."""
    return F.struct(*[ratio(b(800), b(nm), on_zero).alias(f"pssr_{i}") for i, nm in enumerate((680, 635, 470), 1)])


def rep(b: BandAt, on_zero: str = "zero") -> Column:
    """Red edge position; undefined and out-of-range values become 0."""
    raw = 700 + 40 * F.try_divide((b(670) + b(780)) / 2 - b(700), b(740) - b(700))
    return F.when(raw.isNull() | (F.abs(raw) > 10000), 0.0).otherwise(raw)


def yi(b: BandAt, on_zero: str = "zero") -> Column:
    return (b(580) - 2 * b(624) + b(668)) / (0.044 * 0.044)


INDICES: dict[str, Callable[..., Column]] = {
    "ndvi": ndvi, "cci": cci, "ari1": ari1, "cri1": cri1, "sipi": sipi, "pri": pri, "wbi": wbi,
    "vri1": vri1, "pssr": pssr, "rep": rep, "yi": yi,
}


def total(spectrum: str | Column = "spectrum") -> Column:
    return F.aggregate(spectrum, F.lit(0.0), lambda a, x: a + x)


def is_valid(spectrum: str = "spectrum", value: float = 0) -> Column:
    return total(spectrum) > value


def to_uint8(c: Column) -> Column:
    """0..1 to 0..255, truncated."""
    return F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def amplitude(spectrum: str = "spectrum") -> Column:
    return F.abs(F.array_max(spectrum) - F.array_min(spectrum))


def vector_norm(spectrum: str | Column = "spectrum", ord: float = 2) -> Column:
    if ord == 2:
        return F.sqrt(F.aggregate(spectrum, F.lit(0.0), lambda a, x: a + x * x))
    if ord == 1:
        return F.aggregate(spectrum, F.lit(0.0), lambda a, x: a + F.abs(x))
    if ord == float("inf"):
        return F.aggregate(spectrum, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    return F.pow(F.aggregate(spectrum, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x), F.lit(float(ord)))), F.lit(1.0 / ord))


def unit_spectrum(spectrum: str = "spectrum", ord: float = 2) -> Column:
    """Scaled to norm 1; a zero vector stays as it is."""
    n = vector_norm(spectrum, ord)
    return F.when(n == 0, F.col(spectrum)).otherwise(F.transform(spectrum, lambda x: F.try_divide(x, n)))


def argmax(scores: str | Column) -> Column:
    """0-based position of the highest score, the first on a tie."""
    c = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")
