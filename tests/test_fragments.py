import math
import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import fragments as Fr
from canopy.operators.matching import metres_between


def by_hand(edges):
    """The chain rule of one video over all its edges, best first."""
    above, followed, preceded = {}, set(), set()

    def top(n):
        while n in above:
            n = above[n]
        return n

    for src, dst, *_ in sorted(edges, key=lambda e: (e[4], e[5], e[0], e[1])):
        a, b = top(src), top(dst)
        if a != b and a not in followed and b not in preceded:
            above[max(a, b)] = min(a, b)
            followed.add(min(a, b))
            preceded.add(max(a, b))
    return {n: top(n) for n in above}


@pytest.mark.parametrize("frames", [400, 40_000])
def test_compat_heads(spark, frames):
    """Crowded and sparse videos, fragments that outlive many others: parts give what one pass gives."""
    r = random.Random(frames)
    rows, want = [], set()
    for video in ("a", "b"):
        life = {}
        for n in r.sample(range(1000), 120):
            start = r.randrange(frames)
            life[n] = (start, start + r.choice([5, 50, frames // 4]))
        edges = []
        for src, (_, end) in life.items():
            for dst, (start, _) in life.items():
                if src != dst and 0 < start - end <= 220 and r.random() < 0.5:
                    edges.append((src, dst, end, start, round(r.random(), 1), 1.0))
        rows += [(video, *e) for e in edges]
        want |= {(video, n, m) for n, m in by_hand(edges).items()}
    schema = "video_id string, src long, dst long, end_frame long, start_frame long, score double, distance_m double"
    assert len(want) > 10
    assert {tuple(x) for x in Fr.compat_heads(spark.createDataFrame(rows, schema)).collect()} == want
    assert Fr.compat_heads(spark.createDataFrame([], schema)).count() == 0


def test_candidates_by_brute_force(spark):
    """Every pair in reach is found once, by drone offset or, where one is missing, by position; frames and places straddle cells."""
    r = random.Random(5)
    rows = []
    for n in range(260):
        start = r.randrange(-40, 900)
        rel = lambda: None if r.random() < 0.3 else (r.uniform(-60, 60), r.uniform(-60, 60))
        at = lambda: (None, None) if r.random() < 0.1 else (54 + r.uniform(-1, 1) / 1500, 24 + r.uniform(-1, 1) / 1500)
        rows.append((r.choice("ab"), n, start, start + r.choice([0, 3, 50]), at(), at(), rel(), rel(), r.choice(["", "boar", "deer"])))
    at, rel = "struct<lat:double,lon:double>", "struct<east:double,north:double>"
    schema = f"video_id string, entity_id long, start_frame int, end_frame int, start_abs {at}, end_abs {at}, start_rel {rel}, end_rel {rel}, name string"
    got = Fr.fragment_candidates(spark.createDataFrame(rows, schema), 25.0, 110, 6.0, 4.0).collect()
    want = {}
    for v, a, _, end, _, p, _, x, name in rows:
        for w, b, start, _, q, _, y, _, other in rows:
            gap, named = start - end, name and other and name != other
            if v == w and a != b and 0 < gap <= 110 and not named:
                apart = None
                if x and y:
                    apart = math.hypot(x[0] - y[0], x[1] - y[1])
                elif p[0] is not None and q[0] is not None:
                    apart = metres_between(*p, *q)
                if apart is not None and apart <= 6 + 4 * gap / 25:
                    want[(v, a, b)] = apart
    assert len(want) > 100 and len(got) == len(want)
    assert {(x.video_id, x.src, x.dst): x.distance_m for x in got} == pytest.approx(want, rel=1e-6)


def test_candidates_are_read_twice_but_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        made.add(1)
        return x

    schema = "video_id string, src long, dst long, end_frame long, start_frame long, score double, distance_m double"
    edges = spark.createDataFrame([("a", n, n + 1, 10 * n, 10 * n + 5, n % 7 / 7, 1.0) for n in range(50)], schema)
    assert Fr.greedy_links(edges.withColumn("end_frame", counted("end_frame"))).count() == 50
    assert made.value == 50


def test_few_copies_of_a_fragment_are_sent(spark):
    """A fragment goes to the cells that its reach touches: 8 at most, not 18."""
    n = 400
    rows = [("a", i, 7 * i, 7 * i, (54.0, 24.0), (54.0, 24.0), (3.7 * i, 1.3 * i), (3.7 * i, 1.3 * i), "") for i in range(n)]
    at, rel = "struct<lat:double,lon:double>", "struct<east:double,north:double>"
    schema = f"video_id string, entity_id long, start_frame int, end_frame int, start_abs {at}, end_abs {at}, start_rel {rel}, end_rel {rel}, name string"
    pairs = Fr.fragment_candidates(spark.createDataFrame(rows, schema))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = pairs._jdf.queryExecution().executedPlan()
        rows_of = lambda: [x for x in _nodes(made) if x.nodeName() == "Generate"]
        made.execute().count()
        sent = sum(x.longMetric("numOutputRows").value() for x in rows_of() if "__cy" in x.simpleString(999))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < sent <= 8 * n


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))
