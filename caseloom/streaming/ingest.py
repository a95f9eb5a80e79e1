"""Files that keep arriving: every distinct content is sent on once, or counted, also after a restart."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from caseloom.functions.text import file_extension

ONCE_SCHEMA = "md5 string, ext string, stored_name string, name string, arrived timestamp"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_SCHEMA = "md5 string, ext string, name string, copies long, run string, batch_id long"


def arriving_files(spark: SparkSession, path: str, files_per_batch: int = 10_000) -> DataFrame:
    """Stream of ``(name, md5, ext)``; the bytes are digested in the scan stage and go no further."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = (
        spark.readStream.format("binaryFile").schema(schema)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    )
    return digested(files.select(F.substring_index("path", "/", -1).alias("name"), "content"))


def arriving_rows(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000, oldest: str = "7d") -> DataFrame:
    """Stream of ``(name, md5, ext)`` from Parquet files of uploads ``(name, content)``, and of ``arrived`` where they have it.

    A file is left out if its time is more than ``oldest`` before that of the newest one.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", oldest).parquet(path)
    return digested(rows)


def digested(uploads: DataFrame) -> DataFrame:
    times = ["arrived"] if "arrived" in uploads.columns else []
    return uploads.select("name", F.md5("content").alias("md5"), file_extension(F.col("name")).alias("ext"), *times)


def once(arrivals: DataFrame, within: str = "30 days", spread: int = 16) -> DataFrame:
    """Stream of ``(md5, ext, stored_name, name, arrived)``: every content and ending once, as soon as it first arrives.

    The time of an arrival is that of its batch (``arrived`` where the arrivals
    bring a time of their own), so that a file is never too late for being old.
    The state holds the digests of what arrived ``within`` that time and no more; a
    content that comes again later than that is sent on again.

    Copies are told apart in two steps. The first spreads a content over ``spread``
    keys by its name, so that one that makes up a third of the arrivals meets in
    ``spread`` tasks; the second gets at most so many rows of it. The state is thus
    at most ``spread + 1`` rows per content, two where it comes once.
    """
    timed = arrivals if "arrived" in arrivals.columns else arrivals.withColumn("arrived", F.current_timestamp())
    part = F.pmod(F.xxhash64("name"), F.lit(spread))
    few = timed.withWatermark("arrived", within).withColumn("part", part).dropDuplicatesWithinWatermark(["md5", "ext", "part"]).drop("part")
    return few.dropDuplicatesWithinWatermark(["md5", "ext"]).select(
        "md5", "ext", F.concat_ws(".", "md5", "ext").alias("stored_name"), "name", "arrived")


def emit_once(arrivals: DataFrame, store: str, checkpoint: str, within: str = "30 days", spread: int = 16,
              partitions: int | None = None) -> StreamingQuery:
    """Start a run that appends to ``store`` what :func:`once` sends on, takes everything there is, and stops.

    The store is read as it is (:func:`emitted`), no row of it is ever looked at
    again. A batch that is run again after a failure replaces its own files. What
    has been seen lives in the checkpoint, on disk and not on the heap; it is in
    ``partitions`` parts (the session's shuffle partitions if none are given),
    which stay as many as long as the checkpoint lasts. A run with a new checkpoint
    knows nothing of earlier ones.
    """
    spark = arrivals.sparkSession
    # Old entries go with the next batch that brings anything; no batch is run for them alone.
    settings = {_PROVIDER: _ON_DISK, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    before = {key: spark.conf.get(key) for key in settings}     # a query keeps the settings it was started with
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        return (
            once(arrivals, within, spread).writeStream.format("parquet").outputMode("append").option("path", store)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def emitted(spark: SparkSession, store: str) -> DataFrame:
    """What has been sent on so far; files of failed batches are not among it."""
    return spark.read.schema(ONCE_SCHEMA).parquet(store)


def ingest_store(spark: SparkSession, store: str) -> DataFrame:
    """What has been stored so far: ``(md5, ext, name, copies)``, one row per content and ending, over all batches and runs."""
    rows = spark.read.schema(STORE_SCHEMA).parquet(store)
    return rows.groupBy("md5", "ext").agg(F.min("name").alias("name"), F.sum("copies").alias("copies"))


def incremental_ingest(arrivals: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Start a run that takes everything there is and stops.

    A batch writes one row per content and ending with the number of its copies,
    combined before the shuffle, so that a file that makes up a third of the
    arrivals costs one row per task. Nothing stored before is read or changed:
    :func:`ingest_store` adds the batches up. A batch has a folder of its own,
    named by checkpoint and number: run again, it replaces that folder and counts
    once; a new checkpoint on an old store adds folders beside the old ones, and
    what it is given counts as arriving.
    """
    run = hashlib.md5(checkpoint.encode()).hexdigest()

    def add(batch: DataFrame, batch_id: int) -> None:
        found = batch.groupBy("md5", "ext").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("copies"))
        found.write.mode("overwrite").parquet(f"{store}/run={run}/batch_id={batch_id}")

    return (
        arrivals.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
