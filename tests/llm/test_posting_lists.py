import numpy as np
import pytest

from canopy.llm import posting_lists as P


def brute(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).cumsum(1)[:, -1]  # summed from the first coordinate on
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df, **how):
    out = {}
    for r in sorted(P.search(df, **how).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], "clash") for i, row in zip(ids, x)], "vec_id long, embedding array<double>, list string")


def test_recall_on_noise(spark):
    """Without clusters, at several lists, the ratio set on the sample still reaches the recall."""
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 16)) * r.uniform(0.2, 3, (3000, 1))  # lengths differ: inner product is not angle
    ids = np.arange(3000)
    got = found(frame(spark, ids, x), lists=P.Lists(size=100, shard=64))
    want = brute(ids, x, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95
    exact = {q: {i: s for i, s in v} for q, v in want.items()}
    assert all(s == pytest.approx(exact[q][i], abs=1e-12) for q, v in got.items() for i, s in v if i in exact[q])


def test_hot_copies_and_ties(spark):
    """A third of all rows are one vector: ties go to smaller ids, over all shards of its list."""
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 8))
    x[::3] = x[0]
    ids = np.arange(900)
    got = found(frame(spark, ids, x), lists=P.Lists(size=100, shard=32), every=60, k=5)
    want = brute(ids, x, 60, 5)
    assert got[0] == want[0]
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9


def isolated(seed):
    """Tight clusters of many vectors, and one of twelve vectors far from all, which fills a list of its own."""
    r = np.random.default_rng(seed)
    centers = np.eye(12)[:10]
    x = centers[np.arange(3000) % 10] + r.normal(size=(3000, 12)) * 0.01
    x[:12] = np.eye(12)[10] + r.normal(size=(12, 12)) * 0.01
    return np.arange(3000), x


@pytest.mark.parametrize("lists", [P.Lists(size=8), P.Lists(size=8, copies=1, shard=4)])
def test_isolated_queries(spark, lists):
    """Queries in small lists go on to others, until they have as many neighbours as asked for."""
    ids, x = isolated(6)
    got = found(frame(spark, ids, x), lists=lists)
    assert got.keys() == {i for i in range(0, 3000, 20)}
    assert all(len(v) == 20 and len({i for i, _ in v}) == 20 and q not in dict(v) for q, v in got.items())
    assert {i for i, _ in got[0][:11]} == set(range(1, 12))
    assert all(s == pytest.approx(x[q] @ x[i], abs=1e-12) for q, v in got.items() for i, s in v)


def test_repeated_ids_fill_lists(spark):
    """One id many times is one neighbour; the search goes on beyond the lists it fills."""
    r = np.random.default_rng(7)
    x = np.concatenate([np.eye(6)[np.zeros(500, dtype=int)], np.eye(6)[1 + np.arange(100) % 5]]) + r.normal(size=(600, 6)) * 0.01
    ids = np.concatenate([np.where(np.arange(500) == 0, 0, 1), 2 + np.arange(100)])
    got = found(frame(spark, ids, x), lists=P.Lists(size=16, copies=1), every=200, k=30)
    assert got.keys() == {0} and len(got[0]) == 30


def test_repeated_ids_push_no_other_out(spark):
    """Many rows of one id in one list, with one vector or several, beside forty others: twenty neighbours."""
    r = np.random.default_rng(8)
    ids = np.concatenate([np.full(60, 1), 2 + np.arange(40), [200, 201], np.full(30, 0)])
    x = r.normal(size=(len(ids), 8)) * 0.1 + 1
    x[:60] = x[0] * 5
    x[40:60] += r.normal(size=(20, 8))
    got = found(frame(spark, ids, x), every=200, k=20)
    score = x @ x.T
    for q in (0, 200):
        best = {}
        for i in np.flatnonzero(ids == q):
            for j in np.flatnonzero(ids != q):
                best[int(ids[j])] = max(best.get(int(ids[j]), -np.inf), score[i, j])
        want = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:20]
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=1e-12)


def test_nearest_holding():
    points, held = np.array([[0.0], [1.0], [3.0], [9.0]]), np.array([2, 0, 3, 4])
    got = [c.tolist() for room in (1, 2, 3, 6, 100) for c in P._nearest_holding(np.array([[0.4], [8.0]]), points, held, room)]
    assert got == [[0], [3], [0], [3], [0, 2], [3], [0, 2, 3], [3, 2], [0, 2, 3], [3, 2, 0]]


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1),
        (6, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (7, [1.0, 2.0, 3.0], 1), (8, [], 1), (20, [2.0, 0.0], 1), (20, [2.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = found(df)
    assert got == {0: [(20, 2.0), (1, 0.5)], 20: [(0, 2.0), (1, 1.0)]}
    assert P.search(df.where("vec_id = 2")).count() == 0
    assert P.search(df.where("vec_id = 0")).count() == 0


def test_given_table(spark):
    from tests.conftest import DATA

    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in P.vectors(df).select("vec_id", P.F.col("vector").alias("embedding")).collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got, want = found(df, lists=P.Lists(size=50)), brute(ids, x, 20, 20)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_fitted_on_a_sample(spark):
    """A sixth of the rows fit the index, all are indexed."""
    r = np.random.default_rng(4)
    centers = r.normal(size=(30, 12)) * 3
    x = centers[r.integers(0, 30, 3000)] + r.normal(size=(3000, 12))
    ids = np.arange(3000)
    got = found(frame(spark, ids, x), lists=P.Lists(sample=500, size=100), every=50, k=10)
    want = brute(ids, x, 50, 10)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_drawn(spark):
    from canopy.llm.common import drawn

    df = spark.range(10_000)
    assert drawn(df, P.F.col("id"), 10_000, 20_000).count() == 10_000
    some = drawn(df, P.F.col("id"), 10_000, 1_000)
    assert 1_000 <= some.count() <= 1_250
    assert {r.id for r in some.collect()} == {r.id for r in drawn(df.repartition(3), P.F.col("id"), 10_000, 1_000).collect()}
