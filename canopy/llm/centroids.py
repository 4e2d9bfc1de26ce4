"""Centroid clustering over zone maps: vectors in Hilbert order, in blocks with the box of each.

Vectors become integers, are dealt out along a Hilbert curve through all dimensions and packed in
blocks with their smallest and largest components. In each round a block takes as candidates the
centroids whose least distance to its box does not exceed the smallest greatest distance of any
centroid; only these are compared with its vectors, all at once and exactly, in integers. A task
sends one sum for each centroid, so a round moves ``k`` rows a task and the driver holds ``k``
centroids, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from canopy.llm.common import written

#: Integer components beyond this have squared distances that a long may not hold.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Clustering:
    """``k`` centroids, ``rounds`` of moves; ``bits`` of each component on the curve, ``block`` vectors a box."""

    dim: int = 64
    k: int = 40
    rounds: int = 5
    scale: int = 256
    seed: str = "2"
    bits: int = 4
    block: int = 256


def integers(df: DataFrame, p: Clustering, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v array<long>``: floored components of the vectors that take part."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    fine = lambda c: ~F.isnan(c) & (c * p.scale).between(-float(LARGEST), float(LARGEST))
    kept = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("x").isNotNull() & (F.size("x") == p.dim) & F.forall("x", lambda c: F.coalesce(fine(c), F.lit(False)))
    )
    return kept.select("vec_id", F.transform("x", lambda c: F.floor(c * p.scale).cast("long")).alias("v"))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve as big-endian bytes; ``cells`` has a row of ``bits``-bit numbers for each point.

    Bit planes are unrotated from the highest to the lowest, then Gray-decoded, all points at once.
    """
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for row in x:
            up = (row >> level) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ row) & low)
            x[0] ^= np.where(up, low, swap)
            row ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    planes = np.stack([(x >> level) & 1 for level in range(bits - 1, -1, -1)])  # plane, dimension, point
    return np.packbits(planes.reshape(-1, x.shape[1]).T.astype(np.uint8), axis=1)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def blocks(vectors: DataFrame, p: Clustering) -> DataFrame:
    """``ids, values, low, high``: vectors along the curve in blocks, little-endian integers packed as bytes."""
    edges = vectors.select(F.posexplode("v").alias("at", "c")).groupBy("at").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    rows = {r.at: (r.low, r.high) for r in edges.collect()}  # one row for each dimension
    low = np.array([rows[i][0] if rows else 0 for i in range(p.dim)])
    span = np.array([rows[i][1] - rows[i][0] + 1 if rows else 1 for i in range(p.dim)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = (_matrix(batch.column(1), p.dim) - low << p.bits) // span
                keys = hilbert_keys(cells, p.bits)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], ["vec_id", "v", "place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(ids: list, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(ids), p.block):
                part = v[at : at + p.block]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[at : at + p.block]], pa.list_(pa.int64())),
                     *(pa.array([a.astype("<i4").tobytes()], pa.binary()) for a in (part, part.min(0), part.max(0)))],
                    ["ids", "values", "low", "high"],
                )

        ids, v = [], np.empty((0, p.dim), dtype=np.int64)
        for batch in batches:
            ids, v = ids + batch.column(0).to_pylist(), np.concatenate([v, _matrix(batch.column(1), p.dim)])
            whole = len(ids) // p.block * p.block
            yield from packed(ids[:whole], v[:whole])
            ids, v = ids[whole:], v[whole:]
        yield from packed(ids, v)

    placed = vectors.mapInArrow(place, "vec_id long, v array<long>, place binary")
    # Equal vectors share a place; their ids let a range be cut among them.
    along = placed.repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id").drop("place")
    return written(along.mapInArrow(pack, "ids array<long>, values binary, low binary, high binary"), "centroids-blocks")


def candidates(low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Centroids that may be nearest to some vector of the box ``low .. high``, in order."""
    least = np.maximum(np.maximum(low - centres, centres - high), 0)
    most = np.maximum(np.abs(centres - low), np.abs(centres - high))
    return np.flatnonzero((least * least).sum(1) <= (most * most).sum(1).min())


def nearest(v: np.ndarray, centres: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest of the centroids ``among`` (the smaller on a tie) and its squared distance."""
    best = np.full(len(v), np.iinfo(np.int64).max)
    found = np.zeros(len(v), dtype=np.int64)
    for i in among.tolist():
        apart = v - centres[i]
        d = np.einsum("ij,ij->i", apart, apart)
        closer = d < best
        best[closer], found[closer] = d[closer], i
    return found, best


def _assigned(batch: pa.RecordBatch, centres: np.ndarray) -> Iterator[tuple]:
    dim = centres.shape[1]
    for ids, *packs in zip(*(c.to_pylist() for c in batch.columns)):
        v, low, high = (np.frombuffer(x, dtype="<i4").astype(np.int64).reshape(-1, dim) for x in packs)
        yield ids, v, *nearest(v, centres, candidates(low, high, centres))


def _moved(packed: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centroids after one round."""
    k, dim = centres.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for _, v, found, _ in _assigned(batch, centres):
                np.add.at(total, found, v)
                n += np.bincount(found, minlength=k)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), pa.array(n[met]), pa.array(total[met].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"]
        )

    parts = packed.mapInArrow(sums, "cluster long, n long, total array<long>")
    whole = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    moved = centres.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *whole).collect():  # at most k rows
        moved[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dim)]
    return moved


def first_centres(vectors: DataFrame, p: Clustering) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of seed and id; equal ids in order of their components."""
    drawn = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(drawn.alias("h"), "v").orderBy("h", "v").limit(p.k).collect()
    return np.array([r.v for r in rows], dtype=np.int64).reshape(-1, p.dim)


def centroid_hash(centre: np.ndarray) -> str:
    return sha256(",".join(str(c) for c in centre.tolist()).encode()).hexdigest()


def _wide_sum(c: str) -> Column:
    """A sum as a long, null where it is beyond one."""
    return F.expr(f"try_cast(sum(cast(`{c}` AS decimal(38,0))) AS bigint)")


def cluster_vectors(
    df: DataFrame, p: Clustering = Clustering(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id, cluster int, distance, cluster_inertia, inertia (long), centroid_sha256``, a row for each vector kept.

    Kept are vectors of exactly ``dim`` components, none null or non-finite; null vectors go, and so
    do those with a component beyond 2^27 after scaling, as their distances may not fit a long.
    A null id is hashed as the empty one and stays null; repeated rows and repeated ids are vectors
    of their own; with fewer than ``k`` vectors each is a centroid. An empty table, or one without
    kept vectors, gives an empty one. Equal distances go to the smaller number. An inertia beyond a
    long is null. Other columns are left out, so their names cannot clash.
    """
    spark = df.sparkSession
    vectors = written(integers(df, p, id_col, vector_col), "centroids-vectors")
    centres = first_centres(vectors, p)
    columns = "vec_id long, cluster int, distance long"
    if not len(centres):
        return spark.createDataFrame([], f"{columns}, cluster_inertia long, inertia long, centroid_sha256 string")
    packed = blocks(vectors, p)
    for _ in range(p.rounds):
        centres = _moved(packed, centres)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, found, distance in _assigned(batch, centres):
                arrays = [pa.array(ids, pa.int64()), pa.array(found.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "cluster", "distance"])

    told = written(packed.mapInArrow(tell, columns), "centroids-told")
    of_cluster = told.groupBy("cluster").agg(_wide_sum("distance").alias("cluster_inertia"))
    total = told.agg(_wide_sum("distance").alias("inertia"))
    hashes = spark.createDataFrame([(i, centroid_hash(c)) for i, c in enumerate(centres)], "cluster int, centroid_sha256 string")
    of_cluster = of_cluster.join(hashes, "cluster").withColumn("inertia", total.scalar())
    # At most k rows.
    return told.join(F.broadcast(of_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
