"""The scan of class votes against the vote taken row by row."""

import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import tracking as Tr
from canopy.operators.matching import ClassVote
from canopy.operators.votes import scan_votes


def _rows(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        key = r.choice(["hot", "hot", "hot", "b", "c", None])
        # Eighths add up alike in any order, so no sum is off by rounding.
        rows.append((i, key, i // 2, r.choice([1, 2, 3, 7]) if (i // 40) % 2 else r.choice([3, 3, 9]), r.randrange(0, 9) / 8 * (1 + i // 60)))
    return rows


@pytest.mark.parametrize("piece,margin,min_hits", [(1, 0.5, 1), (3, 1.0, 3), (7, 0.0, 1), (512, 1.5, 2)])
def test_scan(spark, piece, margin, min_hits):
    rows = _rows(piece, 700)
    want, books = {}, {}
    for i, key, _, cls, conf in rows:
        want[i] = books.setdefault(key, ClassVote(margin, min_hits)).add(cls, conf)
    df = spark.createDataFrame(rows, "id int, key string, t int, cls int, conf double").repartition(5)
    got = scan_votes(df, ["key"], ["t", "id"], F.floor(F.col("t") / 16), F.col("cls"), F.col("conf"), margin, min_hits, "shown", piece)
    assert got.columns == [*df.columns, "shown"]
    assert {r.id: r.shown for r in got.collect()} == want
    assert len(set(want.values())) > 2  # later classes take over


def test_smooth_class_stays_in_spark(spark):
    df = spark.createDataFrame([(1, "v", 0, 1.0, 1.0, 0.5, None, 1)], "det_id long, video_id string, frame int, x1 double, y1 double, conf double, cls int, track_id int")
    out = Tr.smooth_class(df, "track_id")
    assert out.first().cls == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and "Python" not in plan
    assert Tr.smooth_class(df.limit(0), "track_id").collect() == []
