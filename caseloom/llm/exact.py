"""Exact duplicates against a digest index that outlives the run.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced
to one row per digest, the digests the index knows already are taken out by a
sort-merge anti join, for which the index is not shuffled, and the rest is
appended. The index is found again by its folder, in any later session; how many
buckets it has is written there.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm.tables import ROW, stored_with_row
from caseloom.plans.store import fresh_path, stored

WHITE = " \t\n\x0b\x0c\r"
BUCKETS = 32
MARK = "_buckets_"


def text_digest(text: Column) -> Column:
    """SHA-256, in lowercase hex, of the text without white space (0x20, 0x09-0x0D); NULL counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE, ""), 256)


class DigestIndex:
    """``(digest, keep_id, batch)``, one row per digest ever seen.

    A new index gets ``buckets`` (``BUCKETS`` if none are given). An index that is
    there keeps its own number, whatever session opens it; another one asked for is
    refused, as digests would be looked for in the wrong buckets. An index that
    outgrew its buckets is written anew by :meth:`rewritten`.
    """

    def __init__(self, spark, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._settled(buckets)
        self.name = "digests_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(
            f"create table if not exists {self.name} (keep_id bigint, batch string, digest string) using parquet "
            f"clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{path}'")

    def _settled(self, buckets: int | None) -> int:
        """The number that stands in the index's folder; written there if the folder is new or empty."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(self.path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
        marks = [int(n.removeprefix(MARK)) for n in names if n.startswith(MARK)]
        if not marks:
            if any(n.endswith(".parquet") for n in names):
                raise ValueError(f"{self.path} holds files but does not say in how many buckets")
            marks = [buckets or BUCKETS]
            system.mkdirs(folder)
            system.create(hadoop.Path(folder, f"{MARK}{marks[0]}"), False).close()    # one file, empty, its name says it
        if len(marks) > 1 or buckets not in (None, marks[0]):
            raise ValueError(f"the index in {self.path} has {marks} buckets, not {buckets}")
        return marks[0]

    def rewritten(self, path: str, buckets: int) -> DigestIndex:
        """A copy in another folder with another number of buckets."""
        new = DigestIndex(self.spark, path, buckets)
        new.append(self.read())
        return new

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, first: DataFrame) -> None:
        rows = first.select(F.col("keep_id").cast("long").alias("keep_id"), "batch", "digest")
        (rows.repartition(self.buckets, "digest").write.mode("append").format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name))


def exact_duplicates(docs: DataFrame, index: DigestIndex, text: str = "text", id_col: str = "doc_id",
                     batch: str | None = None) -> DataFrame:
    """Mark the duplicates of a batch, within it and against all earlier ones, and add its new digests to the index.

    One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``. Of
    equal texts in the batch the one with the most code points stays, then the
    smallest id (NULL last), then any one of the rows; a text known from an
    earlier batch never stays, and ``keep_id`` is that of the earlier batch.
    ``group_size`` counts the batch. A batch that failed may be run again under
    the same name. NULL counts as the empty text; an empty batch adds nothing;
    other columns play no part.
    """
    batch = batch or uuid.uuid4().hex
    narrow = stored_with_row(docs.select(
        F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("chars"),
        text_digest(F.col(text)).alias("digest")), "digests")
    first = stored(
        narrow.groupBy("digest").agg(
            F.min(F.struct(-F.col("chars"), F.col("id").isNull(), "id", ROW)).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("first.id").alias("keep_id"), F.col(f"first.{ROW}").alias("keep_row"), "group_size"),
        "representatives")
    known = index.read().filter(F.col("batch") != batch)
    marked = stored(
        first.join(known.select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known")).hint("merge"), "digest", "left"),
        "representatives")
    index.append(first.withColumn("batch", F.lit(batch)).join(index.read().select("digest").hint("merge"), "digest", "left_anti"))
    return narrow.join(marked, "digest").select(
        F.col("id").alias("doc_id"), F.when(F.col("known"), F.col("known_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        "group_size", (F.col("known").isNull() & (F.col(ROW) == F.col("keep_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"))


def new_index(spark, buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, fresh_path(spark, "digest-index"), buckets)
