"""Approximate nearest neighbours by inner product, over balanced posting lists.

Vectors get one more coordinate, ``sqrt(M - |x|^2)`` with the largest squared norm ``M``, so that
the largest inner product becomes the least distance. A bounded sample is halved again and again,
each time by the median between two means, into lists of equal size, whose means are the
centroids. Every vector goes to its nearest list, and vectors near a border also to the others
that are nearly as near (unless those lie closer to a list it has already). Centroids are searched
over a graph of their neighbours, held in memory. A query reads the lists whose centroid is at
most ``ratio`` times as far as its nearest one; the ratio is set on the sample, such that it
reaches ``recall`` of the true neighbours there. Lists longer than ``shard`` are dealt to several
shards, all of which are read, so nothing is left out of a list. A query whose lists give fewer
neighbours than asked for goes on to the next nearest lists that hold enough, at last to all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from canopy.llm.common import drawn, written


@dataclass(frozen=True)
class Lists:
    """About ``sample`` vectors fit the index; ``most`` bounds the centroids that every task holds."""

    sample: int = 20_000
    size: int = 512
    most: int = 8192
    copies: int = 4
    border: float = 0.15
    degree: int = 24
    beam: int = 16
    recall: float = 0.98
    probes: int = 400
    shard: int = 4096
    seed: int = 1


def halved(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of ``lists`` equal parts of ``x`` (a power of two of them at most)."""
    parts = [np.arange(len(x))]
    while len(parts) * 2 <= lists and min(map(len, parts)) >= 2:
        cut = []
        for rows in parts:
            y = x[rows]
            a, b = y[rng.choice(len(y), 2, replace=False)]
            for _ in range(8):
                side = y @ (b - a)
                order = np.argsort(side, kind="stable")
                a, b = y[order[: len(y) // 2]].mean(0), y[order[len(y) // 2 :]].mean(0)
            cut += [rows[order[: len(y) // 2]], rows[order[len(y) // 2 :]]]
        parts = cut
    return np.stack([x[rows].mean(0) for rows in parts])


class Centroids:
    """Centroids with a graph: the nearest others of each, and a few picked at random."""

    def __init__(self, points: np.ndarray, lists: Lists) -> None:
        self.points, self.beam = points, lists.beam
        n, rng = len(points), np.random.default_rng(lists.seed)
        near = min(lists.degree, n)
        edges = np.empty((n, near + 4), dtype=np.int64)
        norm = (points**2).sum(1)
        for at in range(0, n, 1024):
            d = norm[None, :] - 2 * points[at : at + 1024] @ points.T
            edges[at : at + 1024, :near] = np.argsort(d, axis=1, kind="stable")[:, :near]
        edges[:, near:] = rng.integers(0, n, (n, 4))
        self.edges = edges
        self.norm = norm
        self.entries = rng.choice(n, min(n, 8), replace=False)

    def search(self, x: np.ndarray, ratio: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row the centroids within ``ratio`` times the least distance: (numbers, distances), nearest first.

        A centroid is opened if it lies within that ratio or among the ``beam`` nearest seen.
        """
        out = []
        for at in range(0, len(x), 256):
            out += self._search(x[at : at + 256], ratio)
        return out

    def _search(self, x: np.ndarray, ratio: float) -> list[tuple[np.ndarray, np.ndarray]]:
        m, n = len(x), len(self.points)
        far = np.full((m, n), np.inf)
        opened = np.zeros((m, n), dtype=bool)
        own = (x**2).sum(1)

        def see(q: np.ndarray, c: np.ndarray) -> None:
            d = own[q] + self.norm[c] - 2 * np.einsum("ij,ij->i", x[q], self.points[c])
            far[q, c] = np.sqrt(np.maximum(d, 0))

        q, c = np.repeat(np.arange(m), len(self.entries)), np.tile(self.entries, m)
        see(q, c)
        beam = min(self.beam, n) - 1
        while True:
            limit = np.maximum(far.min(1) * ratio, np.partition(far, beam, axis=1)[:, beam])
            q, c = np.nonzero((far <= limit[:, None]) & ~opened & np.isfinite(far))
            if not len(q):
                break
            opened[q, c] = True
            code = np.unique(np.repeat(q, self.edges.shape[1]) * n + self.edges[c].ravel())
            q, c = code // n, code % n
            new = np.isinf(far[q, c])
            see(q[new], c[new])
        best = far.min(1)
        found = []
        for i in range(m):
            c = np.flatnonzero(far[i] <= best[i] * ratio)
            c = c[np.lexsort((c, far[i, c]))]
            found.append((c, far[i, c]))
        return found

    def homes(self, x: np.ndarray, lists: Lists) -> list[np.ndarray]:
        """The lists of each vector: the nearest, then border lists that no chosen list shields."""
        out = []
        for c, d in self.search(x, 1 + lists.border):
            chosen = [0]
            for j in range(1, len(c)):
                if len(chosen) == lists.copies:
                    break
                gap = np.sqrt(((self.points[c[chosen]] - self.points[c[j]]) ** 2).sum(1)).min()
                if gap >= d[j]:
                    chosen.append(j)
            out.append(c[chosen])
        return out


@dataclass
class Index:
    lists: Lists
    largest: float  # squared norm
    dim: int
    ratio: float
    centroids: Centroids

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.largest - (x**2).sum(1), 0))])

    def plain(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.zeros(len(x))])


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vector array<double>`` of the rows that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("vector"))
    v = F.col("vector")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(sound).where(F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, dim).astype(np.float64)


def fit(rows: DataFrame, lists: Lists = Lists()) -> Index | None:
    """The index of ``rows (vec_id, vector)``; None for no rows. Vectors of the most frequent length take part."""
    lengths = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.orderBy(F.desc("n"), "dim").first()
    if top is None:
        return None
    dim, n = top.dim, top.n
    rows = rows.where(F.size("vector") == dim)
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    largest = rows.agg(F.max(norm)).first()[0]
    sample = drawn(rows, F.col("vec_id"), n, lists.sample).select("vec_id", "vector").toArrow().sort_by("vec_id")
    x = _matrix(sample.column(1).combine_chunks(), dim)
    index = Index(lists, float(largest), dim, 1.0, None)
    lifted = index.lifted(x)
    rng = np.random.default_rng(lists.seed)
    index.centroids = Centroids(halved(lifted, max(1, min(lists.most, -(-n // lists.size))), rng), lists)
    # How far a query has to look for its neighbours' lists, over queries from the sample.
    homes = index.centroids.homes(lifted, lists)
    need = []
    for i in rng.choice(len(x), min(len(x), lists.probes), replace=False):
        s = x @ x[i]
        s[i] = -np.inf
        near = np.argsort(-s)[:20]
        d = np.sqrt(((index.centroids.points - index.plain(x[i : i + 1])) ** 2).sum(1))
        need += [d[homes[j]].min() / max(d.min(), 1e-300) for j in near if j != i]
    index.ratio = float(np.quantile(need, lists.recall)) if need else 1.0
    return index


def _nearest_holding(x: np.ndarray, points: np.ndarray, held: np.ndarray, room: int) -> list[np.ndarray]:
    """For each row the nearest points that together hold ``room``, or all that hold anything."""
    some = np.flatnonzero(held)
    out = []
    for at in range(0, len(x), 256):
        d = (points[some] ** 2).sum(1) - 2 * x[at : at + 256] @ points[some].T
        order = some[np.argsort(d, axis=1, kind="stable")]
        n = (np.cumsum(held[order], axis=1) < room).sum(1) + 1
        out += [row[:m] for row, m in zip(order, n.tolist())]
    return out


def _dealt(rows: DataFrame, index: Index, kind: int, held: np.ndarray | None = None, room: int = 0) -> DataFrame:
    """Rows to their lists: postings (kind 0) to their homes, queries (kind 1) to those in reach.

    With ``held``, the postings of each list, queries go to the nearest lists that hold ``room`` of them.
    """
    sent = rows.sparkSession.sparkContext.broadcast(index)  # at most ``most`` centroids and their graph

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column(1), own.dim)
                if held is not None:
                    found = _nearest_holding(own.plain(x), own.centroids.points, held, room)
                elif kind:
                    found = [c for c, _ in own.centroids.search(own.plain(x), own.ratio)]
                else:
                    found = own.centroids.homes(own.lifted(x), own.lists)
                rows_ = pa.array(np.repeat(np.arange(len(found)), list(map(len, found))))
                homes = pa.array(np.concatenate(found).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [homes, part.column(0).take(rows_), part.column(1).take(rows_)], ["list", "vec_id", "vector"]
                )

    return rows.mapInArrow(deal, "list int, vec_id long, vector array<double>")


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, summed from the first coordinate on: equal vectors score equal."""
    out = q[:, 0] * x[:, 0]
    for d in range(1, q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, an id once by its best score, ties to the smaller id."""
    order = np.lexsort((-score, vec, query))
    if not len(order):
        return order
    a, b = query[order], vec[order]
    again = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
    order = order[~again]
    order = order[np.lexsort((vec[order], -score[order], query[order]))]
    a = query[order]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], a[1:] != a[:-1]]), np.arange(len(a)), 0))
    return order[np.arange(len(a)) - first < k]


def search(df: DataFrame, every: int = 20, k: int = 20, lists: Lists = Lists(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose id is divisible by ``every``.

    Nearness is the inner product in double precision; a row is no neighbour of its own id, and
    an id that occurs again is found once, by the nearest of its vectors. Ties go to the smaller id. Null, zero, null-holding or
    non-finite vectors, null ids and vectors of another than the most frequent length take no
    part; fewer than ``k`` candidates give fewer rows; an empty table gives none.
    """
    spark = df.sparkSession
    rows = vectors(df, id_col, vector_col)
    index = fit(rows, lists)
    out = "query_id long, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = index.dim
    rows = rows.where(F.size("vector") == dim)
    postings = written(_dealt(rows, index, 0), "ann-postings")
    sizes = [(x.list, x.n) for x in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()]  # one row for each centroid
    filled = np.zeros(len(index.centroids.points), dtype=np.int64)
    filled[[x for x, _ in sizes]] = [n for _, n in sizes]
    counts = spark.createDataFrame([(x, -(-n // lists.shard)) for x, n in sizes], "list int, shards int")
    counts = F.broadcast(counts)
    held = postings.join(counts, "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), "shards").cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "vector"
    )
    queries = rows.where(F.col("vec_id") % every == 0)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settle() -> None:
            q, v, s = (np.concatenate(c) for c in zip(*kept))
            place = _best(q, v, s, k)
            kept[:] = [(q[place], v[place], s[place])]

        def given() -> Iterator[pa.RecordBatch]:
            for q, v, s in kept:
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])
            kept.clear()

        def compare(ids: np.ndarray, x: np.ndarray, asked_ids: np.ndarray, y: np.ndarray) -> None:
            """``ids`` ascend; rows of one id count once, so however many there are they push no other out."""
            s = y @ x.T
            s[asked_ids[:, None] == ids[None, :]] = -np.inf
            first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
            by_id = s if len(first) == len(ids) else np.maximum.reduceat(s, first, axis=1)
            top = np.partition(by_id, max(len(first) - k, 0), axis=1)[:, max(len(first) - k, 0)]
            room = 1e-9 * (1 + np.abs(top))
            q, c = np.nonzero((s >= (top - room)[:, None]) & np.isfinite(s))
            score = _exact(y[q], x[c])
            place = _best(asked_ids[q], ids[c], score, k)
            kept.append((asked_ids[q][place], ids[c][place], score[place]))

        def batches_of() -> Iterator[tuple[tuple[int, int], int, np.ndarray, np.ndarray]]:
            """Runs of one list, shard and kind."""
            for batch in batches:
                key = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                code = (key[0].astype(np.int64) << 32) + (key[1].astype(np.int64) << 1) + key[2]
                edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
                ids, x = batch.column(3).to_numpy(zero_copy_only=False), _matrix(batch.column(4), dim)
                for a, b in zip(edges, edges[1:]):
                    if b > a:
                        yield int(code[a] >> 1), int(code[a] & 1), ids[a:b], x[a:b]

        for _, runs in groupby(batches_of(), key=itemgetter(0)):
            own: list[tuple[np.ndarray, np.ndarray]] = []  # a shard of a list
            ids = x = None
            for _, kind, some, y in runs:
                if not kind:
                    own.append((some, y))
                    continue
                if ids is None:
                    if not own:
                        break
                    ids, x = np.concatenate([o[0] for o in own]), np.concatenate([o[1] for o in own])
                    order = np.argsort(ids, kind="stable")
                    ids, x = ids[order], x[order]
                for at in range(0, len(some), 256):
                    compare(ids, x, some[at : at + 256], y[at : at + 256])
            if sum(len(p[0]) for p in kept) > 1_000_000:
                settle()
                if len(kept[0][0]) > 500_000:
                    yield from given()
        if kept:
            settle()
            yield from given()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compared(dealt: DataFrame) -> DataFrame:
        asked = dealt.join(counts, "list").select(
            "list", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), "vec_id", "vector"
        )
        both = held.unionByName(asked).repartition(parts, "list", "shard").sortWithinPartitions("list", "shard", "kind")
        return both.mapInArrow(nearest, out)

    def ranked(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    best = written(ranked(compared(_dealt(queries, index, 1))), "ann-best")
    room, whole, others = lists.copies * (k + 1), int(filled.sum()), None
    while True:
        got = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("got"))
        least = k if others is None else others
        short = queries.join(got, F.col("vec_id") == F.col("query_id"), "left").where(F.coalesce("got", F.lit(0)) < least)
        short = written(short.select("vec_id", "vector"), "ann-short")
        if short.isEmpty():
            return best
        if others is None:  # no query can find more than all ids but its own
            others = min(k, rows.select("vec_id").distinct().limit(k + 1).count() - 1)
            if others < k:
                continue
        more = compared(_dealt(short, index, 1, filled, room))
        best = written(ranked(best.drop("rank").unionByName(more)), "ann-best")
        if room >= whole:
            return best
        room *= 8  # ids that occur again and again may fill the nearest lists
