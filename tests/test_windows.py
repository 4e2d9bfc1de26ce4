import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators.stats import block_apply, hopping_apply, tumbling_apply

AGGS = lambda: [F.avg("v").alias("mean"), F.max("v").alias("top")]


def _series(spark, n):
    return spark.range(n).select(F.col("id").alias("v"))


def _rows(df):
    return df.orderBy("window").collect()


@pytest.mark.parametrize("width,windows", [(3, 7), (5, 4)])
def test_tumbling(spark, width, windows):
    rows = _rows(tumbling_apply(_series(spark, 20), ["v"], width, AGGS()))
    assert len(rows) == windows and rows[-1].top == 19


def test_hopping(spark):
    rows = _rows(hopping_apply(_series(spark, 20), ["v"], 3, 1, AGGS()))
    assert len(rows) == 18 and rows[-1].top == 19


def test_hopping_equals_tumbling(spark):
    a = _rows(tumbling_apply(_series(spark, 20), ["v"], 3, AGGS()))
    b = _rows(hopping_apply(_series(spark, 20), ["v"], 3, 3, AGGS()))
    assert a == b


@pytest.mark.parametrize("n,width,step", [(2, 5, 2), (7, 4, 3), (10, 3, 4), (9, 9, 2)])
def test_hopping_tails(spark, n, width, step):
    x, want, i = np.arange(n), [], 0
    while i * step + width <= n:
        want.append(x[i * step : i * step + width].mean())
        i += 1
    end = (i - 1) * step + width
    if end < n:
        want.append(x[end:].mean())
    got = [r.mean for r in _rows(hopping_apply(_series(spark, n), ["v"], width, step, AGGS()))]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("h,w,width,step", [(11, 9, 3, 3), (11, 10, 4, 3), (6, 7, (3, 5), (2, 4))])
def test_blocks(spark, h, w, width, step):
    x = np.arange(h * w).reshape(h, w)
    kh, kw = (width, width) if isinstance(width, int) else width
    sh, sw = (step, step) if isinstance(step, int) else step
    ni, nj, want = h // sh, w // sw, {}
    for i in range(ni):
        for j in range(nj):
            want[i, j] = x[i * sh : i * sh + kh, j * sw : j * sw + kw].sum()
        if nj * sw < w and x[ni * sh :, nj * sw :].size:
            want[i, nj] = x[ni * sh :, nj * sw :].sum()
    if ni * sh < h:
        for j in range(nj):
            want[ni, j] = x[ni * sh :, j * sw : j * sw + kw].sum()
    px = spark.range(h * w).select((F.col("id") / w).cast("int").alias("row"), (F.col("id") % w).cast("int").alias("col"), F.col("id").alias("v"))
    got = block_apply(px, width, step, h, w, [F.sum("v").alias("s")]).collect()
    assert {(r.i, r.j): r.s for r in got} == want


def test_blocks_shape(spark):
    px = spark.range(99).select((F.col("id") / 9).cast("int").alias("row"), (F.col("id") % 9).cast("int").alias("col"), F.col("id").alias("v"))
    got = block_apply(px, 3, 3, 11, 9, [F.avg("v").alias("m")]).collect()
    assert {r.i for r in got} == set(range(4)) and {r.j for r in got} == set(range(3))
