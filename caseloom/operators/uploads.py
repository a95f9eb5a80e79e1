"""Uploaded files: content address, duplicates, routing by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.functions.tabletext import csv_records, markdown_of
from caseloom.functions.text import file_extension
from caseloom.plans.parts import ordered_texts
from caseloom.plans.store import stored


def upload_ingest(uploads: DataFrame, content: str = "content") -> DataFrame:
    """``(doc_id, name, md5, ext, stored_name)``. ``content`` is text or bytes; it is digested in the scan stage and dropped."""
    digested = uploads.select("doc_id", "name", F.md5(F.col(content)).alias("md5"), file_extension(F.col("name")).alias("ext"))
    return digested.withColumn("stored_name", F.concat_ws(".", "md5", "ext"))


def content_dedup(ingested: DataFrame) -> DataFrame:
    """``(md5, ext, doc_id, copies)``: one row per stored file, the lowest id standing for its copies.

    Counted before the shuffle, so a file uploaded very often costs one row per task.
    """
    return ingested.groupBy("md5", "ext").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def route_by_format(uploads: DataFrame) -> DataFrame:
    """``(doc_id, name, route)``: ``text`` for .pdf, ``table`` for .csv, NULL for the rest. The ending is case-sensitive."""
    name = F.col("name")
    return uploads.select(
        "doc_id", "name", F.when(name.endswith(".pdf"), "text").when(name.endswith(".csv"), "table").alias("route")
    )


def upload_texts(uploads: DataFrame, elements: DataFrame) -> DataFrame:
    """``(doc_id, name, text)``: what an upload says to a prompt, by the branch of :func:`route_by_format` that its name takes.

    A .pdf gives the texts of its ``elements (doc_id, elem_no, text)``, an empty line
    between; a .csv its content as a pipe table, decoded with its quotes; all else
    NULL. The uploads are scanned once, contents are looked at in the table branch
    only and go no further than the scan stage.
    """
    routed = uploads.select("doc_id", "name", "content", F.when(F.col("name").endswith(".pdf"), "text").when(F.col("name").endswith(".csv"), "table").alias("__route"))
    decoded = routed.withColumn("__records", F.when(F.col("__route") == "table", csv_records(F.col("content").cast("string"))))
    tables = decoded.withColumn("__table", markdown_of("__records")).select("doc_id", "name", "__route", "__table")
    texts = stored(elements.groupBy("doc_id").agg(F.array_join(ordered_texts(["elem_no"], "text"), "\n\n").alias("__text")), "element-texts")
    return tables.join(texts, "doc_id", "left").select(
        "doc_id", "name", F.when(F.col("__route") == "text", F.coalesce("__text", F.lit(""))).otherwise(F.col("__table")).alias("text"))
