"""Session helpers: settings, the shared scratch folder, tables written to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_shared: list[DataFrame] = []
_open = threading.local()
# Whether Spark removes the shuffle files of a query when it has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int = 8, shuffle_partitions: int = 8, name: str = "canopy") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # The JVM does not compile methods above this size; fall back to short ones instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Each application has its own folder there, so that it can be removed when the application
    has ended. Without the setting a folder is made for a local master only, where driver and
    executors share one disk; it goes when the interpreter exits.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/canopy-{spark.sparkContext.applicationId}"
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="canopy-")
        atexit.register(shutil.rmtree, _local_roots[sc.applicationId], ignore_errors=True)
    return _local_roots[sc.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def _scopes() -> list[list[str]]:
    """Tables made inside each ``passing`` that this thread is in, the innermost last."""
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    return _open.scopes


def _table(df: DataFrame, scopes: list[list[str]]) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    if scopes:
        scopes[-1].append(path)
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: computed once, and safe from lost executors.

    Parquet keeps columns apart, so what reads the table reads only what it needs. The shuffles behind
    it leave the executors' disks when it is written.
    """
    return _table(df, _scopes())


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``cut_lineage`` makes inside are removed at the end.

    What is to last goes through the function given, a ``cut_lineage`` whose table is not: frames
    built on the others can't be read afterwards.
    """
    made: list[str] = []
    _scopes().append(made)
    try:
        yield lambda df: _table(df, _scopes()[:-1])
    finally:
        _scopes().pop()
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def shared(df: DataFrame) -> DataFrame:
    """The same rows, computed once when some query first needs them, and no job before.

    They are kept on the executors' disks with their lineage: what a lost executor held is computed
    again. ``release`` lets go of them.
    """
    kept = df.persist(StorageLevel.DISK_ONLY)
    _shared.append(kept)
    return kept


def release() -> None:
    """Let go of all that ``shared`` keeps; frames built on it compute it again if they are used."""
    while _shared:
        _shared.pop().unpersist()
