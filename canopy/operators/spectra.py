"""Operators over hyperspectral pixels (one row per pixel, spectrum as an array)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from canopy.functions import spectral as S

PIXEL = ["cube_id", "row", "col"]


def read_blocks(spectra: DataFrame, block_rows: int, block_cols: int) -> DataFrame:
    """Block ids per pixel, rows of a block kept together and in raster order."""
    tagged = spectra.withColumn("block_row", F.floor(F.col("row") / block_rows).cast("int")).withColumn(
        "block_col", F.floor(F.col("col") / block_cols).cast("int")
    )
    order = ["cube_id", "block_row", "block_col", "row", "col"]
    return tagged.repartitionByRange(*order).sortWithinPartitions(*order)


def band_index(bands: DataFrame, wavelengths: Sequence[float]) -> DataFrame:
    """Nearest band per sensor for each wanted wavelength, lowest index on a tie."""
    targets = F.explode(F.array(*[F.lit(float(w)) for w in wavelengths])).alias("wanted_nm")
    gap = F.abs(F.col("wavelength_nm") - F.col("wanted_nm"))
    return (
        bands.select("*", targets)
        .groupBy("sensor", "wanted_nm")
        .agg(F.min_by("band", F.struct(gap.alias("gap"), "band")).alias("band"))
    )


def extract_bands(
    spectra: DataFrame,
    bands: Sequence[int] | None = None,
    wavelengths: Sequence[float] | None = None,
    axis: Sequence[float] | None = None,
    n_bands: int | None = None,
) -> DataFrame:
    """Ordered band subset; duplicates are allowed."""
    if (bands is None) == (wavelengths is None):
        raise ValueError("give either bands or wavelengths")
    if bands is None:
        if axis is None:
            raise ValueError("wavelengths need the axis of the cube")
        bands = [S.nearest_band(axis, w) for w in wavelengths]
    size = n_bands if n_bands is not None else (len(axis) if axis is not None else None)
    if any(b < 0 or (size is not None and b >= size) for b in bands):
        raise IndexError(f"band out of range in {list(bands)}")
    # element_at raises for a band beyond a row's spectrum.
    picked = F.array(*[F.element_at("spectrum", b + 1) for b in bands])
    return spectra.withColumn("spectrum", picked)


def match_bands(axis_a: Sequence[float], axis_b: Sequence[float]) -> tuple[list[int], list[int]]:
    """Bands of two axes brought to the shorter one, by nearest wavelength."""
    if len(axis_a) >= len(axis_b):
        return [S.nearest_band(axis_a, w) for w in axis_b], list(range(len(axis_b)))
    return list(range(len(axis_a))), [S.nearest_band(axis_b, w) for w in axis_a]


def align_spectra(spectra: DataFrame, axis: Sequence[float], other_axis: Sequence[float]) -> DataFrame:
    """Spectra measured on ``axis`` reduced to the band set shared with ``other_axis``."""
    return extract_bands(spectra, bands=match_bands(axis, other_axis)[0], n_bands=len(axis))


def crop(spectra: DataFrame, cuts: Sequence[Sequence[int]]) -> DataFrame:
    """Pixels of half-open windows ``[x0, x1, y0, y1]``, one copy per window, tagged ``cut``."""
    rows = (min(c[2] for c in cuts), max(c[3] for c in cuts))
    cols = (min(c[0] for c in cuts), max(c[1] for c in cuts))
    near = (
        (F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1])
    )

    def inside(c: Sequence[int]) -> Column:
        x0, x1, y0, y1 = c
        return (F.col("col") >= x0) & (F.col("col") < x1) & (F.col("row") >= y0) & (F.col("row") < y1)

    hits = F.array_compact(F.array(*[F.when(inside(c), F.lit(i)) for i, c in enumerate(cuts)]))
    return spectra.filter(near).withColumn("cut", F.explode(hits))


def crop_bbox(spectra: DataFrame, boxes: Sequence[Sequence[int]]) -> DataFrame:
    """The same with boxes ``[x1, y1, x2, y2]``."""
    return crop(spectra, [[x1, x2, y1, y2] for x1, y1, x2, y2 in boxes])


def valid_mask(spectra: DataFrame, value: float = 0) -> DataFrame:
    return spectra.withColumn("valid", S.is_valid("spectrum", value))


def fix_band_count(spectra: DataFrame, expected: int = 224) -> tuple[DataFrame, DataFrame]:
    """Spectra trimmed to ``expected`` bands, and the rejected shorter ones."""
    enough = F.size("spectrum") >= expected
    return (
        spectra.filter(enough).withColumn("spectrum", F.slice("spectrum", 1, expected)),
        spectra.filter(~F.coalesce(enough, F.lit(False))).withColumn("n_bands", F.size("spectrum")),
    )


def gain_offset(spectra: DataFrame, gain: Sequence[float], offset: Sequence[float]) -> DataFrame:
    """Per band ``x * gain + offset``."""
    a = F.array(*[F.lit(float(g)) for g in gain])
    b = F.array(*[F.lit(float(o)) for o in offset])
    scaled = F.zip_with("spectrum", a, lambda x, g: x * g)
    return spectra.withColumn("spectrum", F.zip_with(scaled, b, lambda x, o: x + o))


def explode_spectrum(spectra: DataFrame) -> DataFrame:
    """One row per pixel and band."""
    keep = [c for c in spectra.columns if c != "spectrum"]
    return spectra.select(*keep, F.posexplode("spectrum").alias("band", "value"))


def band_amplitude(spectra: DataFrame) -> DataFrame:
    """Per band largest minus smallest value over all pixels."""
    return explode_spectrum(spectra).groupBy("band").agg(F.abs(F.max("value") - F.min("value")).alias("amplitude"))


def l2_normalize_spectra(spectra: DataFrame) -> DataFrame:
    return spectra.withColumn("spectrum", S.unit_spectrum("spectrum"))


def all_indices(
    spectra: DataFrame, names: Sequence[str], axis: Sequence[float], on_zero: str = "zero"
) -> DataFrame:
    """Named indices in long form from one pass over the spectra."""
    b = S.band_reader(axis)
    cols: list[Column] = []
    for n in names:
        c = S.INDICES[n](b, on_zero)
        if n == "pssr":
            cols += [c[f"pssr_{i}"].alias(f"pssr_{i}") for i in (1, 2, 3)]
        else:
            cols.append(c.alias(n))
    keys = [c for c in spectra.columns if c != "spectrum"]
    wide = spectra.select(*keys, *cols)
    return wide.unpivot(keys, [c for c in wide.columns if c not in keys], "index", "value")
