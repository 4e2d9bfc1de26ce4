"""Every registered query against its SQL on the smallest tables."""

import pytest

from registry import load
from registry.check import compare, duck
from tests.conftest import DATA

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert not [n for n in QUERIES if "pipeline" in n or n.startswith("op")]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if name not in ORACLES:
        assert rows
        return
    rel = con.execute(ORACLES[name])
    have = [d[0] for d in rel.description]
    order = [have.index(c) for c in cols]
    assert compare(rows, [tuple(r[i] for i in order) for r in rel.fetchall()]) == ""


def test_crop_sends_no_band_to_one_task(spark):
    """Pixels stay where they are, however few bands there are."""
    import io
    from contextlib import redirect_stdout

    from canopy.operators import raster

    obs = spark.range(1000).selectExpr("CAST(id % 2 AS STRING) AS band", "CAST(id % 37 AS INT) AS row", "CAST(id % 41 AS INT) AS col", "id")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with redirect_stdout(io.StringIO()) as plan:
            raster.crop_to_smallest(obs, []).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert "SortMergeJoin" not in plan.getvalue() and "BroadcastHashJoin" in plan.getvalue()


def test_partitions_grow_with_the_tables(spark, tmp_path):
    """Tables of many bytes are shuffled in more parts than the session's; small ones as it says."""
    from registry import core

    (tmp_path / "a.parquet").write_bytes(b"x" * 100)
    core._partitioned(spark, str(tmp_path))
    assert spark.conf.get(core.INITIAL, None) is None
    (tmp_path / "b.parquet").write_bytes(bytes(core.BYTES_PER_PARTITION * 9))
    core._partitioned(spark, str(tmp_path))
    assert spark.conf.get(core.INITIAL) == "9"
    (tmp_path / "b.parquet").write_bytes(b"")
    core._partitioned(spark, str(tmp_path))
    assert spark.conf.get(core.INITIAL, None) is None
