"""Centroid clustering against plain Lloyd rounds in Python integers; curve and boxes by themselves."""

import math
import random
from hashlib import sha256

import numpy as np
import pytest

from canopy.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>, cluster string, place int, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 3, "v") for i, v in rows], SCHEMA)


def plain(rows, p):
    fine = lambda v: v is not None and len(v) == p.dim and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(p.scale * float(np.float32(x))) for x in v]) for i, v in rows if fine(v)]
    kept = [(i, v) for i, v in kept if max(map(abs, v)) <= ce.LARGEST]
    name = lambda i: sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[: p.k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))

    def assign():
        return [min((far(v, c), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(p.rounds):
        found = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    inertia = sum(d for d, _ in found)
    of = lambda j: sum(d for d, c in found if c == j)
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, j, d, of(j), inertia, digest[j]) for (i, _), (d, j) in zip(kept, found)]


def vectors(n, dim, seed, groups=6):
    r = random.Random(seed)
    middle = [[r.uniform(-2, 2) for _ in range(dim)] for _ in range(groups)]
    return [(i, [r.gauss(m, 0.2) for m in middle[i % groups]]) for i in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("dim,k,block", [(8, 5, 16), (64, 40, 256), (3, 9, 4)])
def test_equals_plain(spark, dim, k, block):
    rows = vectors(300, dim, dim)
    p = ce.Clustering(dim=dim, k=k, block=block)
    assert rows_of(ce.cluster_vectors(table(spark, rows).repartition(6), p)) == sorted(plain(rows, p), key=str)


def test_odd_vectors(spark):
    """Nulls, wrong lengths, non-finite and huge components, null and repeated ids, copies, ties."""
    rows = vectors(60, 4, 1)
    rows += [(1000, None), (1001, []), (1002, [1.0, 2.0, 3.0]), (1003, [1.0, None, 0.0, 0.0]), (1004, [math.nan] * 4),
             (1005, [math.inf, 0.0, 0.0, 0.0]), (1006, [-math.inf, 0.0, 0.0, 0.0]), (1007, [1e30, 0.0, 0.0, 0.0]),
             (1008, [0.0] * 4), (None, [0.5] * 4), (None, [0.25] * 4), (3, [1.0] * 4), (3, [1.0] * 4), (1009, [-0.0001] * 4)]
    rows += [(2000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(200)]
    p = ce.Clustering(dim=4, k=7, block=8)
    assert rows_of(ce.cluster_vectors(table(spark, rows).repartition(5), p)) == sorted(plain(rows, p), key=str)


def test_few_and_none(spark):
    p = ce.Clustering(dim=4)
    few = vectors(3, 4, 2)
    assert rows_of(ce.cluster_vectors(table(spark, few), p)) == sorted(plain(few, p), key=str)
    for rows in ([], [(1, None)]):
        got = ce.cluster_vectors(table(spark, rows), p)
        assert got.collect() == [] and got.columns[:3] == ["vec_id", "cluster", "distance"]


@pytest.mark.parametrize("dim,bits", [(2, 4), (3, 3), (5, 2)])
def test_curve_steps_to_neighbours(dim, bits):
    """All cells of a cube lie on the curve once, and consecutive ones share a face."""
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim, indexing="ij"), -1).reshape(-1, dim)
    keys = [k.tobytes() for k in ce.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    along = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_boxes_keep_the_nearest_and_prune():
    r = np.random.default_rng(4)
    centres = r.integers(-500, 500, (50, 6))
    pruned = 0
    for _ in range(200):
        v = r.integers(-500, 500, 6) + r.integers(0, 60, (32, 6))
        among = ce.candidates(v.min(0), v.max(0), centres)
        pruned += len(centres) - len(among)
        every = ce.nearest(v, centres, np.arange(len(centres)))
        some = ce.nearest(v, centres, among)
        assert (every[0] == some[0]).all() and (every[1] == some[1]).all()
    assert pruned > 200 * 40
