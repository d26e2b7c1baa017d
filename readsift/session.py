"""Session defaults and the staging helper that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Collection, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed side even where that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended runtime settings to a session somebody else built."""
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)
    return spark


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir``.

    A local master without that setting gets a fresh temporary folder. On a
    cluster a machine-local folder would lose data with its executor, so a
    missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="readsift-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


# Folders written by ``stage``, per shared root, in the order of writing.
_STAGED: list[str] = []


def staged_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, which :func:`released` takes away again."""
    path = f"{staging_root(spark).rstrip('/')}/readsift/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def staged() -> tuple[str, ...]:
    """Paths of the staged copies that nobody has released yet."""
    return tuple(_STAGED)


def release(spark: SparkSession, kept: Collection[str] = ()) -> None:
    """Delete all staged copies but the ``kept`` ones. Frames built on them can't be read any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in [s for s in _STAGED if s not in kept]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        _STAGED.remove(name)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Owns what is staged inside: write or collect results before the block ends. Blocks of one process nest;
    threads that stage side by side share the block around them."""
    before = set(staged())
    try:
        yield
    finally:
        release(spark, before)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITING, _LOCK = [0], Lock()


@contextmanager
def _shuffles_go_at_the_end(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files. Threads may write side by side; the last one puts the setting back."""
    with _LOCK:
        _WRITING[0] += 1
        if _WRITING[0] == 1:
            _WRITING[1:] = [spark.conf.get(_CLEANUP, "false")]
            spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            _WRITING[0] -= 1
            if not _WRITING[0]:
                spark.conf.set(_CLEANUP, _WRITING[1])


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the copy.

    Later uses read the stored columns they need, never recompute the lineage,
    and see the true size, from which adaptive execution picks join strategies.
    The copy outlives any executor; :func:`released` removes it. What was shuffled for it goes as soon as it is written.
    """
    spark = df.sparkSession
    path = staged_path(spark, name)
    with _shuffles_go_at_the_end(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_threads(tasks: list[Callable], spark: SparkSession, parallelism: int) -> list:
    """Results of the tasks, in order; each driver thread submits its own Spark jobs."""
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return list(pool.map(lambda task: inheritable_thread_target(spark)(task)(), tasks))
