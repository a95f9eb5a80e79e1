"""Written intermediates in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local session may fall back to a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="caseloom-"))
    return spark.sparkContext.getCheckpointDir()


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


_notes: list[list[str]] = []


@contextmanager
def given_paths() -> Iterator[list[str]]:
    """The paths that :func:`fresh_path` gives out meanwhile, for :func:`remove_paths`."""
    _notes.append([])
    try:
        yield _notes[-1]
    finally:
        _notes.pop()


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    for notes in _notes:
        notes.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives lost executors, gives exact size statistics."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind; they wait for the driver's garbage collection otherwise."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def pages_by_size(spark: SparkSession) -> None:
    """Writers of Parquet files look at the size of a page after 10 rows from now on, if the session says nothing else.

    They would look after 100, and hold so many of any size until then. (After every row, the many buffers of
    different sizes took more memory than they saved.)
    """
    name = "parquet.page.size.row.check.min"
    if spark.conf.get(name, None) is None and spark._jsc.hadoopConfiguration().get(name) is None:
        spark.conf.set(name, "10")


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it isn't there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(folder) if s.isDirectory()) if system.exists(folder) else []


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    """Remove written intermediates; DataFrames that read them are of no use afterwards."""
    for name in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_stored(spark: SparkSession) -> None:
    """Remove all that this application has written so far."""
    remove_paths(spark, [_own_folder(spark)])
