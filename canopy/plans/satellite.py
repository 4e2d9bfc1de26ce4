"""Satellite results end to end: composites with indices, health of a region of interest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from canopy.constants import INDEX_BANDS
from canopy.functions import vegetation as V
from canopy.operators import catalog as C, raster as R

_FORMULA = {
    "NDVI": lambda scaled: V.s2_ndvi(scaled=scaled), "NBR": lambda scaled: V.s2_nbr(scaled=scaled),
    "MSI": lambda scaled: V.s2_msi(scaled=scaled),
}


def s2_composite(
    scenes: DataFrame,
    obs: DataFrame,
    search: dict,
    indices: Sequence[str],
    cells: DataFrame | None = None,
    scaled: bool = False,
) -> DataFrame:
    """Cloud-free composite of the scenes found, with the named indices.

    The search prunes observations by a semi join on tile and date. Mosaicking and
    band stacking are one aggregate: per cell and date the last non-zero value of
    each band. Only bands the indices need are read.
    """
    found = C.with_tile_id(C.search_scenes(scenes, **search, ordered=False))
    wanted = found.select("tile", F.to_date("datetime").alias("acq_date")).distinct()
    bands = sorted({b.lower() for i in indices for b in INDEX_BANDS[i]} | {"scl"})
    kept = obs.filter(F.col("band").isin(*bands) & (F.col("value") != 0)).join(wanted, ["tile", "acq_date"], "left_semi")
    if cells is not None:
        cell = R.cell_of(kept, cells)
        kept = kept.join(cells.select(*cell).distinct(), cell, "left_semi")
    stacked = R.stack_bands(kept, bands, keys=["acq_date", *R.cell_of(kept)])
    best = R.best_pixel_composite(stacked, keys=R.cell_of(kept), bands=bands)
    if "LAI" in indices:
        best = V.with_lai(best, scaled=scaled)
    return best.select("*", *[_FORMULA[i](scaled).alias(i.lower()) for i in indices if i in _FORMULA])


def roi_health(
    indices: DataFrame, landcover: DataFrame, year: int | None = None, classes: Sequence[int] = (24,)
) -> tuple[DataFrame, DataFrame]:
    """Yearly statistics per pixel of the selected land cover, and each date's anomaly."""
    chosen = indices if year is None else indices.filter(F.col("year") == year)
    inside = R.roi_filter(chosen, landcover, classes, mode="drop")
    return R.pixel_stats(inside), R.anomalies(inside)
