"""Drone cube results: colour, vegetation and reflectance products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from canopy.constants import NDVI_COLORS, NDVI_STOPS
from canopy.functions import color as C, spectral as S
from canopy.operators import stats as St

VARIANTS = ("rgb", "rect_rgb", "ndvi", "rect_ndvi", "ndvi_rgb", "rect_ndvi_rgb")


def drone_products(spectra: DataFrame, axis: Sequence[float], variants: Sequence[str] = VARIANTS) -> DataFrame:
    """Colour and NDVI products per pixel of every cube, scaled per cube.

    Rectified variants (``rect_``) are NULL where the pixel is empty. Bounds come
    from two per-cube aggregates, the second over NDVI, which needs the first: four scans in all.
    """
    unknown = set(variants) - set(VARIANTS)
    if unknown:
        raise ValueError(f"unknown variants {sorted(unknown)}")
    b = S.band_reader(axis)
    keys = ["cube_id", "row", "col"]
    base = spectra.select(
        *keys, C.spectrum_to_rgb(axis).alias("c"), b(670).alias("red"), b(800).alias("nir"), S.is_valid().alias("valid")
    )
    base = base.select(*keys, "valid", "red", "nir", "c.*")
    scaled = St.minmax_groups(base, [(["r", "g", "b"], 0), (["red", "nir"], None)], ["cube_id"])
    raw = F.try_divide(F.col("nir") - F.col("red"), F.col("nir") + F.col("red"))
    ndvi = scaled.withColumn("ndvi", F.greatest(F.coalesce(raw, F.lit(0.0)), F.lit(0.0)))
    unit = St.minmax_groups(ndvi.withColumn("unit", F.col("ndvi")), [(["unit"], None)], ["cube_id"])
    painted = unit.withColumn("p", C.colorize(F.col("unit"), NDVI_COLORS, NDVI_STOPS))
    out = []
    for v in variants:
        rect = v.startswith("rect_")
        kind = v.removeprefix("rect_")
        if kind == "rgb":
            cols = {f"{v}_{c}": S.to_uint8(F.col(c)) for c in "rgb"}
        elif kind == "ndvi":
            cols = {v: F.col("ndvi") if rect else S.to_uint8(F.col("unit"))}
        else:
            cols = {f"{v}_{c}": S.to_uint8(F.col(f"p.{c}")) for c in "rgb"}
        out += [(F.when(F.col("valid"), c) if rect else c).alias(n) for n, c in cols.items()]
    return painted.select(*keys, "valid", *out)


def xyz_image(
    spectra: DataFrame, axis: Sequence[float], normalize: bool = False, y_gain: float = 1.0
) -> DataFrame:
    """X, Y, Z per pixel; ``normalize`` stretches each channel of a cube to 0..1 on its own."""
    xyz = spectra.select("cube_id", "row", "col", C.spectrum_to_xyz(axis, y_gain=y_gain).alias("c"))
    out = xyz.select("cube_id", "row", "col", "c.*")
    return St.minmax_groups(out, [([c], None) for c in "xyz"], ["cube_id"]) if normalize else out


def rgb_image(spectra: DataFrame, axis: Sequence[float], normalize: bool = False, y_gain: float = 1.0) -> DataFrame:
    """sRGB per pixel from the integrated channels."""
    xyz = xyz_image(spectra, axis, normalize, y_gain)
    rgb = C.xyz_to_srgb(F.col("x"), F.col("y"), F.col("z"))
    return xyz.select("cube_id", "row", "col", rgb.alias("c")).select("cube_id", "row", "col", "c.*")


def reflectance(
    cubes: DataFrame, plate_cube: DataFrame, class_map: DataFrame, dark: DataFrame | None = None, degree: int = 1
) -> DataFrame:
    """Raw cubes to reflectance: plate means, optional dark spectrum, fit per band, applied to every cube."""
    plates = St.plate_spectra(plate_cube, class_map)
    if dark is not None:
        plates = plates.unionByName(St.dark_spectrum(dark))
    return St.apply_calibration(cubes, St.fit_calibration(plates, degree))
