"""Registration of queries and the shared output form of both engines.

Each query states its columns as ``name:kind`` words; Spark results and oracle
SQL are finished from the same words, so rounding and casts agree:
``i`` integer, ``n`` nullable integer (NULL becomes -999), ``d`` double rounded
to 6 places, ``s`` text, ``t`` date as text, ``ts`` timestamp as text, ``b``
boolean as 0/1, ``j`` integer array joined by commas.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from canopy.adapters import VIEW_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _finish(df: DataFrame, words: list[tuple[str, str]]) -> DataFrame:
    out = []
    for name, kind in words:
        c = F.col(f"`{name}`")
        c = {
            "i": lambda: c.cast("long"),
            "n": lambda: F.coalesce(c.cast("long"), F.lit(-999)),
            "d": lambda: F.round(c.cast("double"), 6) + F.lit(0.0),
            "s": lambda: c.cast("string"),
            "t": lambda: F.date_format(c, "yyyy-MM-dd"),
            "ts": lambda: F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
            "b": lambda: c.cast("long"),
            "j": lambda: F.array_join(F.transform(c, lambda x: x.cast("string")), ","),
        }[kind]()
        out.append(c.alias(name))
    return df.select(*out)


def _finish_sql(body: str, words: list[tuple[str, str]]) -> str:
    out = []
    for name, kind in words:
        q = f'"{name}"'
        e = {
            "i": f"CAST({q} AS BIGINT)",
            "n": f"coalesce(CAST({q} AS BIGINT), -999)",
            "d": f"round(CAST({q} AS DOUBLE), 6) + 0.0::DOUBLE",
            "s": f"CAST({q} AS VARCHAR)",
            "t": f"strftime({q}, '%Y-%m-%d')",
            "ts": f"strftime({q}, '%Y-%m-%d %H:%M:%S')",
            "b": f"CAST({q} AS BIGINT)",
            "j": f"array_to_string(list_transform({q}, lambda x: CAST(x AS VARCHAR)), ',')",
        }[kind]
        out.append(f"{e} AS {q}")
    return f"SELECT {', '.join(out)} FROM ({body}) AS result"


def _needed_views(sql: str) -> list[str]:
    found: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEW_SQL.items():
            if name not in found and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def oracle(body: str, columns: str) -> str:
    words = [tuple(w.split(":")) for w in columns.split()]
    text = _finish_sql(body, words)
    views = _needed_views(body)
    if not views:
        return text
    return "WITH " + ",\n".join(f"{v} AS ({VIEW_SQL[v]})" for v in views) + "\n" + text


# Bytes of the given tables for each shuffle partition; derived rows are many times larger.
BYTES_PER_PARTITION = 4 << 20
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# Bytes of a shuffle that one task reads, where the tables are large: every sort and aggregate of its stage holds them.
TOGETHER, MOST_TOGETHER = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 8 << 20


def _bytes(spark: SparkSession, size: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)


def _partitioned(spark: SparkSession, path: str) -> None:
    """Shuffles in as many partitions as the tables ask for, so that what one task holds does not grow with them.

    Adaptive execution puts small partitions together again, up to a size that does not grow with
    the tables either; tables that the session's own number of partitions suits keep it.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(at).getLength()
    parts = size // BYTES_PER_PARTITION
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL, str(parts))
        spark.conf.set(TOGETHER, str(min(MOST_TOGETHER, _bytes(spark, spark.conf.get(TOGETHER)))))
    else:
        spark.conf.unset(INITIAL)


def query(name: str, columns: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    words = [tuple(w.split(":")) for w in columns.split()]

    def register(fn):
        def run(spark: SparkSession, path: str) -> DataFrame:
            _partitioned(spark, path)
            return _finish(fn(Tables(spark, path)), words)

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, columns)
        return fn

    return register
