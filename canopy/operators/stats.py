"""Scaling, sliding windows and calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from canopy.constants import PLATE_REFLECTANCE
from canopy.functions import spectral as S
from canopy.operators.ordered import row_numbers
from canopy.operators.quantiles import exact_quantiles
from canopy.operators.spectra import explode_spectrum


# --- scaling -----------------------------------------------------------------

def value_bounds(
    df: DataFrame,
    cols: Sequence[str],
    percentiles: tuple[float, float] | None = None,
    forced_min: float | None = None,
    forced_max: float | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """``lo, hi`` over all values of all columns (per ``by`` key); NaN counts as 0."""
    is_array = {c: df.schema[c].dataType.typeName() == "array" for c in cols}
    clean = lambda v: F.when(F.isnan(v), 0.0).otherwise(v)
    if percentiles is not None:
        parts = F.concat(*[
            F.transform(c, clean) if is_array[c] else F.array(clean(F.col(c))) for c in cols
        ])
        long = df.select(*by, F.explode(parts).alias("v"))
        q = exact_quantiles(long, by, "v", {"lo": percentiles[0] / 100, "hi": percentiles[1] / 100})
    else:
        low = [F.array_min(F.transform(c, clean)) if is_array[c] else clean(F.col(c)) for c in cols]
        high = [F.array_max(F.transform(c, clean)) if is_array[c] else clean(F.col(c)) for c in cols]
        q = df.groupBy(*by).agg(
            F.least(*[F.min(v) for v in low], F.min(low[0])).alias("lo"),
            F.greatest(*[F.max(v) for v in high], F.max(high[0])).alias("hi"),
        )
    lo = F.lit(float(forced_min)) if forced_min is not None else F.col("lo")
    hi = F.lit(float(forced_max)) if forced_max is not None else F.col("hi")
    return q.select(*by, lo.alias("lo"), hi.alias("hi"))


def global_minmax(
    df: DataFrame,
    cols: Sequence[str],
    feature_range: tuple[float, float] = (0, 1),
    percentiles: tuple[float, float] | None = None,
    forced_min: float | None = None,
    forced_max: float | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Columns (numbers or arrays) scaled by one common minimum and maximum (per ``by`` key)."""
    a, b = feature_range
    if a >= b:
        raise ValueError("feature_range must rise")
    bounds = value_bounds(df, cols, percentiles, forced_min, forced_max, by)
    if by:
        df = df.join(bounds.select(*by, F.struct("lo", "hi").alias("__bounds")), list(by))
    else:
        df = df.withColumn("__bounds", bounds.select(F.struct("lo", "hi").alias("s")).scalar())
    lo, hi = F.col("__bounds.lo"), F.col("__bounds.hi")
    for c in cols:
        array = df.schema[c].dataType.typeName() == "array"

        def scaled(v: Column) -> Column:
            v = F.when(F.isnan(v), 0.0).otherwise(v)
            return F.try_divide(v - lo, hi - lo) * (b - a) + a

        df = df.withColumn(c, F.transform(c, scaled) if array else scaled(F.col(c)))
    return df.drop("__bounds")


def minmax_groups(
    df: DataFrame, groups: Sequence[tuple[Sequence[str], float | None]], by: Sequence[str]
) -> DataFrame:
    """Number columns scaled to 0..1, each group ``(columns, forced minimum)`` by bounds of its own; NaN counts as 0.

    One aggregate gives the bounds of all groups, so the rows are read twice whatever their number.
    """
    aggs = []
    for i, (cols, forced) in enumerate(groups):
        known = [F.when(F.isnan(c), 0.0).otherwise(F.col(c)) for c in cols]
        low = F.lit(float(forced)) if forced is not None else F.min(F.least(*known) if len(cols) > 1 else known[0])
        high = F.max(F.greatest(*known) if len(cols) > 1 else known[0])
        aggs += [low.alias(f"__lo{i}"), high.alias(f"__hi{i}")]
    out = df.join(df.groupBy(*by).agg(*aggs), list(by))
    for i, (cols, _) in enumerate(groups):
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        for c in cols:
            out = out.withColumn(c, F.try_divide(F.when(F.isnan(c), 0.0).otherwise(F.col(c)) - lo, hi - lo))
    return out.drop(*[f"__{b}{i}" for i in range(len(groups)) for b in ("lo", "hi")])


def global_minmax_inverse(
    df: DataFrame, cols: Sequence[str], lo: float, hi: float, feature_range: tuple[float, float] = (0, 1)
) -> DataFrame:
    a, b = feature_range
    back = lambda v: (v - a) / (b - a) * (hi - lo) + lo
    for c in cols:
        array = df.schema[c].dataType.typeName() == "array"
        df = df.withColumn(c, F.transform(c, back) if array else back(F.col(c)))
    return df


def scale(spectra: DataFrame, scaler: str, norm: str = "l2") -> DataFrame:
    """Per-band ``standard``, ``minmax``, ``maxabs`` or ``robust`` scaling, or per-row ``normalizer``.

    Bands without spread keep a divisor of 1.
    """
    if scaler == "normalizer":
        n = {"l1": S.vector_norm("spectrum", 1), "l2": S.vector_norm("spectrum", 2),
             "max": S.vector_norm("spectrum", float("inf"))}[norm]
        unit = F.transform("spectrum", lambda x: F.try_divide(x, n))
        return spectra.withColumn("spectrum", F.when(n == 0, F.col("spectrum")).otherwise(unit))
    long = explode_spectrum(spectra.select("spectrum"))
    if scaler == "robust":
        q = exact_quantiles(long, ["band"], "value", {"q1": 0.25, "shift": 0.5, "q3": 0.75})
        stats = q.select("band", "shift", (F.col("q3") - F.col("q1")).alias("size"))
    else:
        shift, size = {
            "standard": (F.avg("value"), F.stddev_pop("value")),
            "minmax": (F.min("value"), F.max("value") - F.min("value")),
            "maxabs": (F.lit(0.0), F.max(F.abs("value"))),
        }[scaler]
        stats = long.groupBy("band").agg(shift.alias("shift"), size.alias("size"))
    # One struct per band: a few hundred numbers whatever the number of pixels.
    one = stats.agg(F.sort_array(F.collect_list(F.struct("band", "shift", "size"))).alias("s")).scalar()
    divisor = lambda p: F.when(p["size"] == 0, 1.0).otherwise(p["size"])
    scaled = F.zip_with("spectrum", "__stats", lambda x, p: (x - p["shift"]) / divisor(p))
    return spectra.withColumn("__stats", one).withColumn("spectrum", scaled).drop("__stats")


# --- sliding windows ---------------------------------------------------------

def tumbling_apply(
    df: DataFrame, order: Sequence[str], width: int, aggs: Sequence[Column], bucket: Column | None = None
) -> DataFrame:
    """Aggregates over consecutive windows of ``width`` rows; the last may be shorter."""
    if width <= 1:
        raise ValueError("width must be above 1")
    n = row_numbers(df, [], order, "__rn", bucket)
    return n.groupBy(F.floor((F.col("__rn") - 1) / width).cast("long").alias("window")).agg(*aggs)


def hopping_apply(
    df: DataFrame, order: Sequence[str], width: int, step: int, aggs: Sequence[Column], bucket: Column | None = None
) -> DataFrame:
    """Full windows every ``step`` rows; rows after the last full window form one more."""
    if width <= 1 or step < 1:
        raise ValueError("width must be above 1 and step above 0")
    n = row_numbers(df, [], order, "__rn", bucket).withColumn("__i", F.col("__rn") - 1)
    total = n.agg(F.count(F.lit(1)).alias("n")).scalar()
    full = F.greatest(F.floor((total - width) / step) + 1, F.lit(0))
    end = (full - 1) * step + width
    first = F.greatest(F.ceil((F.col("__i") - width + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col("__i") / step), full - 1)
    ids = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    tail = F.when((F.col("__i") >= end) & (end < total), F.array(full)).otherwise(F.array().cast("array<bigint>"))
    w = n.withColumn("window", F.explode(F.concat(ids, tail)))
    return w.groupBy("window").agg(*aggs)


def block_apply(
    pixels: DataFrame, width: int | tuple[int, int], step: int | tuple[int, int], height: int, length: int,
    aggs: Sequence[Column], keys: Sequence[str] = (),
) -> DataFrame:
    """Aggregates over 2-D windows, ``floor(size / step)`` per axis plus edge remainders.

    Inner windows reach ``width`` cells (cut at the border). A column remainder
    makes one more window per window row holding only the corner beyond both
    axes' steps; a row remainder makes one more window per window column.
    """
    kh, kw = (width, width) if isinstance(width, int) else width
    sh, sw = (step, step) if isinstance(step, int) else step
    ni, nj = height // sh, length // sw
    empty = F.array().cast("array<bigint>")

    def hits(pos: Column, k: int, s: int, count: int) -> Column:
        first = F.greatest(F.ceil((pos - k + 1) / s), F.lit(0)).cast("long")
        last = F.least(F.floor(pos / s), F.lit(count - 1)).cast("long")
        return F.when(last >= first, F.sequence(first, last)).otherwise(empty)

    rows, cols = hits(F.col("row"), kh, sh, ni), hits(F.col("col"), kw, sw, nj)
    pair = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    inner = F.flatten(F.transform(rows, lambda i: F.transform(cols, lambda j: pair(i, j))))
    beyond_r, beyond_c = F.col("row") >= ni * sh, F.col("col") >= nj * sw
    none = F.array().cast("array<struct<i:bigint,j:bigint>>")
    corner = F.when(
        beyond_r & beyond_c, F.transform(F.sequence(F.lit(0), F.lit(max(ni - 1, 0))), lambda i: pair(i, F.lit(nj)))
    ).otherwise(none) if nj * sw < length and ni > 0 else none
    side = F.when(beyond_r, F.transform(cols, lambda j: pair(F.lit(ni), j))).otherwise(none) if ni * sh < height else none
    tagged = pixels.withColumn("__w", F.explode(F.concat(inner, corner, side)))
    return tagged.groupBy(*keys, F.col("__w.i").alias("i"), F.col("__w.j").alias("j")).agg(*aggs)


# --- calibration -------------------------------------------------------------

def plate_spectra(spectra: DataFrame, class_map: DataFrame) -> DataFrame:
    """Mean raw value per calibration plate and band, with the plate's reflectance."""
    plates = class_map.filter(F.col("class").isin(*PLATE_REFLECTANCE))
    known = F.create_map(*[F.lit(v) for kv in PLATE_REFLECTANCE.items() for v in kv])
    joined = spectra.join(plates, ["cube_id", "row", "col"]).select("class", "spectrum")
    return (
        explode_spectrum(joined).groupBy("class", "band").agg(F.avg("value").alias("raw"))
        .withColumn("reflectance", known[F.col("class")])
    )


def dark_spectrum(spectra: DataFrame) -> DataFrame:
    """Mean spectrum of a closed-shutter cube as the 0 % plate, class 0."""
    mean = explode_spectrum(spectra.select("spectrum")).groupBy("band").agg(F.avg("value").alias("raw"))
    return mean.select(F.lit(0).alias("class"), "band", "raw", F.lit(0.0).alias("reflectance"))


def fit_calibration(plates: DataFrame, degree: int = 1, method: str = "mean") -> DataFrame:
    """Least-squares reflectance from raw value per band, highest power first."""
    if degree not in (1, 2):
        raise ValueError("degree must be 1 or 2")
    if method == "median":
        x = exact_quantiles(plates, ["class", "band"], "raw", {"x": 0.5})
        y = exact_quantiles(plates, ["class", "band"], "reflectance", {"y": 0.5})
        pts = x.join(y, ["class", "band"])
    else:
        pts = plates.groupBy("class", "band").agg(F.avg("raw").alias("x"), F.avg("reflectance").alias("y"))
    if degree == 1:
        return pts.groupBy("band").agg(
            F.array(F.regr_slope("y", "x"), F.regr_intercept("y", "x")).alias("coeffs")
        )
    mean = pts.groupBy("band").agg(F.avg("x").alias("m"))
    u, y = F.col("x") - F.col("m"), F.col("y")
    sums = pts.join(mean, "band").groupBy("band").agg(
        F.first("m").alias("m"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(u).alias("s1"),
        F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"), F.sum(u * u * u * u).alias("s4"),
        F.sum(y).alias("t0"), F.sum(u * y).alias("t1"), F.sum(u * u * y).alias("t2"),
    )

    def det(r0, r1, r2) -> Column:
        c = lambda v: F.col(v)
        (a, b, d), (e, f, g), (h, i, j) = [[c(v) for v in r] for r in (r0, r1, r2)]
        return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)

    whole = det(("s4", "s3", "s2"), ("s3", "s2", "s1"), ("s2", "s1", "n"))
    qa = F.try_divide(det(("t2", "s3", "s2"), ("t1", "s2", "s1"), ("t0", "s1", "n")), whole)
    qb = F.try_divide(det(("s4", "t2", "s2"), ("s3", "t1", "s1"), ("s2", "t0", "n")), whole)
    qc = F.try_divide(det(("s4", "s3", "t2"), ("s3", "s2", "t1"), ("s2", "s1", "t0")), whole)
    m = F.col("m")
    solved = sums.withColumn("qa", qa).withColumn("qb", qb).withColumn("qc", qc)
    a, b, c = F.col("qa"), F.col("qb"), F.col("qc")
    return solved.select("band", F.array(a, b - 2 * a * m, a * m * m - b * m + c).alias("coeffs"))


def apply_calibration(spectra: DataFrame, coeffs: DataFrame, bands: Sequence[int] | None = None) -> DataFrame:
    """Evaluate each band's polynomial; ``bands`` names the fitted band of each position."""
    one = coeffs.agg(F.sort_array(F.collect_list(F.struct("band", "coeffs"))).alias("s")).scalar()
    curves = F.transform("__fit", lambda p: p["coeffs"])
    if bands is not None:
        curves = F.array(*[F.element_at(curves, b + 1) for b in bands])
    # Horner's rule from the highest power down.
    value = lambda x, k: F.aggregate(k, F.lit(0.0), lambda acc, c: acc * x + c)
    fitted = spectra.withColumn("__fit", one)
    return fitted.withColumn("spectrum", F.zip_with("spectrum", curves, value)).drop("__fit")
