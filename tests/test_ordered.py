"""Two-level ordered operators against plain Python, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import quantiles
from canopy.operators.folds import fold_sorted, independent_parts
from canopy.operators.ordered import fill, row_numbers, running_sum
from canopy.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.randrange(400), rng.choice([None, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id long, t long, v double").cache()
    return df, rows


def _by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width", [None, 7, 1000])
def test_row_numbers_and_sums(skewed, width):
    df, rows = skewed
    bucket = None if width is None else F.floor(F.col("t") / width)
    got = {(r.k, r.id): r.rn for r in row_numbers(df, ["k"], ["t", "id"], "rn", bucket).collect()}
    sums = {(r.k, r.id): r.s for r in running_sum(df, ["k"], ["t", "id"], F.col("t"), "s", bucket).collect()}
    for k, rs in _by_key(rows).items():
        total = 0
        for n, r in enumerate(rs, 1):
            total += r[2]
            assert got[k, r[1]] == n and sums[k, r[1]] == total


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("width", [None, 5])
def test_fill(skewed, inclusive, width):
    df, rows = skewed
    bucket = None if width is None else F.floor(F.col("t") / width)
    got = fill(df, ["k"], ["t", "id"], {"b": F.col("v")}, {"a": F.col("v")}, inclusive, bucket)
    got = {(r.k, r.id): (r.b, r.a) for r in got.collect()}
    for k, rs in _by_key(rows).items():
        vals = [r[3] for r in rs]
        for i, r in enumerate(rs):
            e = 1 if inclusive else 0
            before = next((v for v in reversed(vals[: i + e]) if v is not None), None)
            after = next((v for v in vals[i + 1 - e :] if v is not None), None)
            assert got[k, r[1]] == (before, after)


def test_null_keys(spark):
    """Rows without a key are a group of their own in all three operators."""
    rows = [(None, i, float(i) if i % 3 else None) for i in range(6)] + [("a", i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    for bucket in (None, F.floor(F.col("t") / 2)):
        assert sorted((str(r.k), r.t, r.rn) for r in row_numbers(df, ["k"], ["t"], "rn", bucket).collect()) == sorted(
            (str(k), t, t + 1) for k, t, _ in rows
        )
        sums = {(r.k, r.t): r.s for r in running_sum(df, ["k"], ["t"], F.lit(1), "s", bucket).collect()}
        assert sums == {(k, t): t + 1 for k, t, _ in rows}
        back = {(r.k, r.t): r.b for r in fill(df, ["k"], ["t"], {"b": F.col("v")}, bucket=bucket).collect()}
        assert back[None, 3] == 2.0 and back[None, 0] is None and len(back) == 9


def test_buckets_follow_partitions(spark):
    from canopy.operators.ordered import bucket_count

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "500")
    try:
        assert bucket_count(spark) == 2000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_quantiles(skewed):
    df, rows = skewed
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"q1": 0.25, "m": 0.5, "p": 0.983}).collect()}
    for k, rs in _by_key(rows).items():
        v = [r[3] for r in rs if r[3] is not None]
        assert (got[k].q1, got[k].m, got[k].p) == pytest.approx(tuple(np.quantile(v, [0.25, 0.5, 0.983])))
    one = exact_quantiles(df, [], "t", {"m": 0.37}).collect()[0].m
    assert one == pytest.approx(np.quantile([r[2] for r in rows], 0.37))


@pytest.mark.parametrize("share", [quantiles.SHARE, 0.0])
def test_quantiles_of_odd_values(spark, monkeypatch, share):
    """Ties, infinite values, one value, null keys; brackets that miss their ranks."""
    monkeypatch.setattr(quantiles, "SHARE", share)
    rng = np.random.default_rng(2)
    groups = {
        "ties": np.repeat([1.0, 2.0, 50.0], [500, 1, 499]), "one": np.array([3.0]), "wide": rng.lognormal(0, 9, 4001),
        "ends": np.concatenate([[-np.inf] * 3, rng.normal(size=994), [np.inf] * 3]), None: rng.integers(0, 9, 300).astype(float),
        "many": np.arange(30000.0),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("ties", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = {"a": 0.0, "b": 0.137, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        ordered = np.sort(v)
        for name, p in probs.items():
            at = p * (len(v) - 1)
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            if np.isfinite(low):
                assert got[k][name] == pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12)
    whole = exact_quantiles(df.where("k = 'many'"), [], "v", probs).collect()
    assert len(whole) == 1 and whole[0].c == 14999.5


def test_independent_parts(spark):
    """Rows in different parts are farther apart than the gap on some axis; ids do not depend on cell width."""
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 50, 300]) + rng.random() * 20, rng.choice([0, 100]) + rng.random() * 10) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    for cell in (1.0, 9.0):
        got = independent_parts(df.withColumn("k", F.lit(1)), ["k"], [("x", "x", 10.0, cell), ("y", "y", 10.0, cell)]).collect()
        assert len({r.part for r in got}) == 6
        for a in got[:60]:
            for b in got:
                if a.part != b.part:
                    assert abs(a.x - b.x) > 10 or abs(a.y - b.y) > 10


def test_fold_keeps_order_across_batches(spark):
    """A running count over a group larger than one Arrow batch."""
    df = spark.range(30000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t")).repartition(7)

    def start():
        seen = []

        def step(t):
            ok = not seen or t > seen[-1]
            seen[:] = [t]
            return (ok,)

        return step

    out = fold_sorted(df, ["k"], [F.col("t")], ["t"], "ok boolean", start)
    assert out.filter("NOT ok").count() == 0 and out.count() == 30000


def test_missing_order_values_keep_their_rows(spark):
    df = spark.createDataFrame([("k", i, None if i < 3 else i) for i in range(10)], "k string, id int, t int")
    for bucket in (None, F.floor(F.col("t") / 4)):
        got = {r.id: r.rn for r in row_numbers(df, ["k"], ["t", "id"], "rn", bucket).collect()}
        assert got == {i: i + 1 for i in range(10)}
    parts = independent_parts(df, ["k"], [("t", "t", 2.0, 2.0)])
    assert parts.count() == 10
