"""Plans and settings that keep the work of one task from growing with the tables."""

import math
import random

from pyspark.sql import functions as F

from canopy.operators import raster as R
from canopy.operators.matching import MotionBook
from registry import core, load
from tests.conftest import DATA

ROWS = [
    ("2024-01-01", "b03", 1, 1, 5.0, 1), ("2024-01-01", "b03", 1, 1, 7.0, 3), ("2024-01-01", "b03", 1, 1, 0.0, 9),
    ("2024-01-01", "scl", 1, 1, 4.0, 2), ("2024-01-01", "other", 1, 1, 8.0, 2), ("2024-01-01", "other", 1, 1, 9.0, 4),
    ("2024-01-01", "more", 1, 1, 6.0, 4), ("2024-01-01", None, 1, 1, 3.0, 5), ("2024-01-01", None, None, 1, 2.0, 5),
    ("2024-01-02", "b03", 1, 1, 1.0, None), ("2024-01-02", "b03", 1, 2, None, 3), ("2024-01-02", "scl", 1, 2, float("nan"), 3),
    (None, "b03", 1, 1, -2.0, 3), ("2024-01-02", "scl", 2, 2, 1.5, None), ("2024-01-02", "scl", 2, 2, 2.5, 1),
]


def test_mosaic_of_listed_bands_is_the_mosaic(spark):
    """Listed bands are picked side by side; other and null bands, and null orders, give the rows they gave."""
    obs = spark.createDataFrame(ROWS, "acq_date string, band string, row int, col int, value double, scene_order long")
    for by_date in (True, False):
        want = R.mosaic(obs, by_date)
        for bands in (["b03", "scl"], ["b03", "scl", "b08", "more"], ["b11"]):
            got = R.mosaic(obs, by_date, bands=bands)
            assert got.columns == want.columns and got.dtypes == want.dtypes
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert R.mosaic(obs.limit(0), by_date, bands=["b03"]).count() == 0


def test_mosaic_sends_a_cell_once(spark):
    """Six bands of a cell, in any order, leave a task as one row."""
    obs = spark.range(0, 600, 1, 2).select(
        F.lit("d").alias("acq_date"), (F.col("id") % 6).cast("string").alias("band"), (F.col("id") % 100).alias("row"), F.lit(1).alias("col"),
        (F.col("id") + 1.0).alias("value"), F.col("id").alias("scene_order"),
    )
    plan = R.mosaic(obs, bands=list("012345"))._jdf.queryExecution().executedPlan().toString()
    assert "band" not in plan.split("Exchange hashpartitioning(")[1].split(")")[0] and plan.count("Exchange") == 1


def test_medoid_blocks_in_no_fixed_number_of_tasks(spark):
    plan = load()[0]["representative_medoid_blocks"](spark, DATA)._jdf.queryExecution().analyzed().toString()
    assert [x for x in plan.splitlines() if "RepartitionByExpression" in x and not x.rstrip().endswith(", 7")]


def test_partitions_of_large_tables_stay_small_together(spark, monkeypatch):
    """Adaptive execution joins partitions up to a bound, and one that the session has set lower stays."""
    before = spark.conf.get(core.TOGETHER)
    monkeypatch.setattr(core, "BYTES_PER_PARTITION", 1 << 10)
    try:
        core._partitioned(spark, DATA)
        assert spark.conf.get(core.TOGETHER) == str(8 << 20)
        spark.conf.set(core.TOGETHER, "1m")
        core._partitioned(spark, DATA)
        assert spark.conf.get(core.TOGETHER) == str(1 << 20)
    finally:
        spark.conf.set(core.TOGETHER, before)
        spark.conf.unset(core.INITIAL)


def test_motion_book_takes_the_first_of_equally_near_entities():
    """Against a scan of all entities, on a grid where many lie equally near; entities move through cells."""
    r = random.Random(4)
    for speed, limit in ((12.0, 30.0), (1.0, 5.0), (30.0, 3.0)):
        book, last = MotionBook(speed, limit), []
        for k in range(600):
            north, east, t = float(r.randrange(-20, 20)), float(r.randrange(-20, 20)), k // 3 * 0.5
            near = [(math.hypot(n - north, e - east), i) for i, (n, e, seen) in enumerate(last) if seen != t]
            i = min(near)[1] if near and book.reach(t - last[min(near)[1]][2]) > min(near)[0] else len(last)
            assert book.place(north, east, t) == (i, i == len(last))
            last[i:i + 1] = [(north, east, t)]
        assert {i for own in book.cells.values() for i in own} == set(range(len(last))) and all(book.cells.values())
