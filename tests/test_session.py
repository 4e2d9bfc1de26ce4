"""Scratch tables and shuffles go when nothing reads them any more."""

import time
from pathlib import Path

import pytest

from canopy import session
from canopy.adapters import Tables
from canopy.plans.wildlife import wildlife
from tests.conftest import DATA


def _tables(spark):
    return set(Path(session.scratch_root(spark)).glob("table-*"))


def test_passing_tables(spark):
    before = _tables(spark)
    with session.passing(spark) as outer:
        with session.passing(spark) as inner:
            first = session.cut_lineage(spark.range(5))
            second = inner(first.selectExpr("id * 2 AS id"))
        assert len(_tables(spark) - before) == 1
        last = outer(second.selectExpr("id + 1 AS id"))
    assert len(_tables(spark) - before) == 1
    assert sorted(r.id for r in last.collect()) == [1, 3, 5, 7, 9]
    with pytest.raises(RuntimeError), session.passing(spark):
        session.cut_lineage(spark.range(5))
        raise RuntimeError
    kept = session.cut_lineage(spark.range(3))
    assert len(_tables(spark) - before) == 2 and kept.count() == 3


def test_shuffles_behind_a_table_go(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {name for name in map(str, _items(manager.getAllFiles())) if "/shuffle_" in name}
    before, asked = shuffles(), spark.conf.get(session.SHUFFLES_GO)
    table = session.cut_lineage(spark.range(1000).repartition(5, "id"))
    until = time.time() + 30
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before and table.count() == 1000
    assert spark.conf.get(session.SHUFFLES_GO) == asked


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_wildlife_leaves_two_tables(spark):
    before, t = _tables(spark), Tables(spark, DATA)
    found = wildlife(t.detections, t.telemetry)
    assert len(_tables(spark) - before) == 2  # of the clusters and of all that follows
    assert found["clusters"].count() and found["detections"].count() and found["entities"].count()
