"""Dataflow around models: scoring, patches, clustering, soft assignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def score_pixels(
    spectra: DataFrame,
    load_model: Callable[[], Callable],
    schema: str = "scores array<double>",
    spectrum: str = "spectrum",
    batch: int = 20000,
) -> DataFrame:
    """Apply a per-pixel model in batches; ``load_model`` runs once per Python worker task.

    The model maps a 2-D array (pixels x bands) to one row of output per pixel.
    A pixel without a spectrum gets no score. A fitted ``pyspark.ml`` model is used with its own
    ``transform`` instead.
    """
    if hasattr(load_model, "transform"):
        from pyspark.ml.functions import array_to_vector

        return load_model.transform(spectra.withColumn("features", array_to_vector(spectrum)))
    out = T.StructType.fromDDL(schema)
    keep = [f for f in spectra.schema.fields if f.name != spectrum]
    name = out.fields[0].name

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        model = load_model()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                known = part[spectrum].notna().to_numpy()
                scores: list = [None] * len(part)
                if known.any():
                    given = np.asarray(model(np.stack(part[spectrum][known].to_numpy())))
                    for i, row in zip(np.flatnonzero(known), given):
                        scores[i] = row
                done = part[[f.name for f in keep]].copy()
                done[name] = pd.Series(scores, index=part.index, dtype=object)
                yield done

    return spectra.mapInPandas(run, T.StructType(keep + [out.fields[0]]))


def patches(spectra: DataFrame, ph: int, pw: int, stride: int | None = None) -> DataFrame:
    """Whole ``ph`` x ``pw`` patches per cube with their pixels in raster order.

    ``stride`` is the step between patches (patch size when not given); patches
    that would pass the border are dropped. A patch holds ``ph * pw`` pixels.
    """
    def starts(pos: Column, size: int, step: int) -> Column:
        first = F.greatest(F.ceil((pos - size + 1) / step), F.lit(0)).cast("int")
        return F.sequence(first, F.floor(pos / step).cast("int"))

    sh, sw = (stride, stride) if stride else (ph, pw)
    first_r = F.ceil((F.col("row") - ph + 1) / sh)
    # A pixel between patches (step larger than the patch) belongs to none.
    near = (F.greatest(first_r, F.lit(0)) <= F.floor(F.col("row") / sh)) & (
        F.greatest(F.ceil((F.col("col") - pw + 1) / sw), F.lit(0)) <= F.floor(F.col("col") / sw)
    )
    placed = (
        spectra.filter(near)
        .withColumn("patch_row", F.explode(starts(F.col("row"), ph, sh)))
        .withColumn("patch_col", F.explode(starts(F.col("col"), pw, sw)))
    )
    ordered = F.sort_array(F.collect_list(F.struct("row", "col", "spectrum")))
    return (
        placed.groupBy("cube_id", "patch_row", "patch_col").agg(ordered.alias("__px"))
        .filter(F.size("__px") == ph * pw)
        .select("cube_id", "patch_row", "patch_col", F.transform("__px", lambda p: p["spectrum"]).alias("patch"))
    )


def label_map(spectra: DataFrame, patch_labels: DataFrame, ph: int, pw: int) -> DataFrame:
    """Each patch's label on all its pixels."""
    placed = spectra.withColumn("patch_row", F.floor(F.col("row") / ph).cast("int")).withColumn(
        "patch_col", F.floor(F.col("col") / pw).cast("int")
    )
    return placed.join(patch_labels, ["cube_id", "patch_row", "patch_col"])


def kmeans_clusters(features: DataFrame, k: int, n_init: int = 10, column: str = "spectrum", max_iter: int = 50):
    """Best of ``n_init`` k-means fits by training cost, over all rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from pyspark.storagelevel import StorageLevel

    data = features.select(array_to_vector(column).alias("features")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        best = None
        for seed in range(n_init):
            model = KMeans(k=k, seed=seed, maxIter=max_iter).fit(data)
            cost = model.summary.trainingCost
            if best is None or cost < best[0]:
                best = (cost, model)
    finally:
        data.unpersist()
    return best[1]


def cluster_centers(model) -> list[list[float]]:
    return [[float(v) for v in c] for c in model.clusterCenters()]


def soft_assign(
    features: DataFrame, centers: Sequence[Sequence[float]], alpha: float = 1.0, column: str = "spectrum"
) -> DataFrame:
    """Student-t similarity to each centre, summing to 1 per row, in ``q``."""
    known = F.array(*[F.lit([float(v) for v in c]) for c in centers])

    def similarity(c: Column) -> Column:
        d2 = F.aggregate(F.zip_with(column, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v)
        return F.pow(1 / (1 + d2 / alpha), F.lit((alpha + 1) / 2))

    raw = features.withColumn("__s", F.transform(known, similarity))
    total = F.aggregate("__s", F.lit(0.0), lambda a, v: a + v)
    return raw.withColumn("q", F.transform("__s", lambda v: v / total)).drop("__s")


def target_distribution(assigned: DataFrame, column: str = "q") -> DataFrame:
    """``q**2 / column sum`` normalised per row, in ``p``."""
    sums = (
        assigned.select(F.posexplode(column).alias("c", "v")).groupBy("c").agg(F.sum("v").alias("s"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "s"))), lambda x: x["s"]).alias("t"))
    ).scalar()  # one number per cluster
    weighted = F.zip_with(column, "__sums", lambda q, s: F.try_divide(q * q, s))
    raw = assigned.withColumn("__sums", sums).withColumn("__w", weighted)
    total = F.aggregate("__w", F.lit(0.0), lambda a, v: a + v)
    return raw.withColumn("p", F.transform("__w", lambda v: F.try_divide(v, total))).drop("__w", "__sums")
