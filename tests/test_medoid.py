"""Medoids against plain Python; how many positions the bounds leave."""

import numpy as np
from pyspark.sql import functions as F

from canopy.operators import medoid as M
from canopy.operators.tracking import representative_obs


def brute(rows):
    """Least rounded mean distance, then time and id; rows without a position only where there is no other."""
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for k, own in by.items():
        sound = [r for r in own if r[3] is not None and r[4] is not None and not np.isnan(r[3])]
        if not sound:
            out[k] = min((r[2], r[1]) for r in own)[1]
            continue
        at = np.array([r[3:5] for r in sound])
        means = [round(float(np.hypot(*(at - p).T).mean()), 9) for p in at]
        out[k] = min((m, r[2], r[1]) for m, r in zip(means, sound))[2]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "entity long, det_id long, ts double, north double, east double")


def test_medoid(spark):
    rng = np.random.default_rng(1)
    rows = []

    def add(entity, places, ts=None):
        for i, (n, e) in enumerate(places):
            rows.append((entity, len(rows), float(ts[i] if ts is not None else i % 7), n, e))

    far = np.array([5_400_000.0, 432_000.0])
    add(1, (rng.normal(0, 30, (1500, 2)) + far).tolist())
    add(2, np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(500, 9, (299, 2))]).tolist())
    add(3, [(4.0, 5.0)] * 400)  # one place
    add(4, [(0.0, 0.0), (0.0, 2.0), (2.0, 0.0), (2.0, 2.0)])  # all alike
    add(5, [(1.0, 1.0)])
    add(6, [(None, 1.0), (None, None), (float("nan"), 2.0)])
    add(7, [(None, 1.0), (3.0, 3.0), (float("nan"), 2.0), (3.0, 4.0), (3.0, 5.0)])
    add(None, rng.integers(0, 4, (90, 2)).astype(float).tolist())
    add(8, [(0.0, float(i)) for i in range(60)])
    add(9, (rng.normal(0, 1e-7, (50, 2)) + 51.0).tolist())
    df = table(spark, rows).repartition(5)
    got = {r.entity: r.det_id for r in representative_obs(df, "medoid", keys=["entity"]).collect()}
    assert got == brute(rows)
    assert representative_obs(df, "medoid", keys=["entity"]).columns == df.columns
    assert representative_obs(df.limit(0), "medoid", keys=["entity"]).count() == 0


def test_large_entities_are_dealt(spark, monkeypatch):
    """Several salts and blocks give the same."""
    monkeypatch.setattr(M, "BLOCK", 16)
    monkeypatch.setattr(M, "BLOCKS", 2)
    rng = np.random.default_rng(4)
    rows = [(1, i, float(i), *map(float, p)) for i, p in enumerate(rng.normal(0, 5, (900, 2)))]
    got = M.medoid(table(spark, rows), ["entity"]).collect()
    assert [r.det_id for r in got] == [brute(rows)[1]]


def test_bounds_leave_few(spark):
    df = spark.range(40_000).select(
        F.lit(1).alias("entity"), F.col("id").alias("det_id"), F.col("id").cast("double").alias("ts"),
        (F.randn(1) * 40).alias("north"), (F.randn(2) * 40).alias("east"),
    ).cache()
    points = M.placed(df, ["entity"])
    assert points.count() == 40_000
    assert 0 < M.candidates(points).count() < 1500
