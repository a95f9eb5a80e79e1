"""Captured portal pages: status, case id, history; every failure is a value, never a failed job. Row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions import cases as C

# Fixed value: the message for a reply other than 200.
BAD_RESPONSE = "An error occurred with IRCC. Form submission failed"
NO_STATUS = "no status link on the page"
NO_CASE_ID = "no case id in the status link"


def _error(status: Column, case_id: Column) -> Column:
    return (
        F.when(F.coalesce(F.col("status_code") != 200, F.lit(True)), BAD_RESPONSE)
        .when(status.isNull(), NO_STATUS)
        .when(case_id.isNull(), NO_CASE_ID)
    )


def _read(status_pages: DataFrame) -> DataFrame:
    """The pages with ``__status`` and ``__id``. Step by step, so that no expression is worked out twice."""
    linked = status_pages.withColumn("__plain", C.plain_link(F.col("html"))).withColumn("__link", C.status_link(F.col("html"), F.col("__plain")))
    return linked.withColumn("__id", C.case_id(F.col("__link.tag"))).withColumn("__status", C.status_text(F.col("__link.text"))).drop("__plain", "__link")


def case_status_extract(status_pages: DataFrame) -> DataFrame:
    """``(case_key, status, case_id)``; NULL where the page does not hold it."""
    return _read(status_pages).select("case_key", F.col("__status").alias("status"), F.col("__id").alias("case_id"))


def case_history(status_pages: DataFrame) -> DataFrame:
    """``(case_key, pos, item)``: history items in page order; an item of mixed content is NULL."""
    return status_pages.select("case_key", F.posexplode(C.history_items(F.col("html"))).alias("pos", "item"))


def case_status(status_pages: DataFrame) -> DataFrame:
    """``(case_key, status_code, status, case_id, detail, error)``: the outcome per page.

    With an error, ``status`` holds its message and ``detail`` is empty. The
    reply code is looked at first.
    """
    read = _read(status_pages).withColumn("error", _error(F.col("__status"), F.col("__id")))
    failed = F.col("error").isNotNull()
    return read.select(
        "case_key", "status_code",
        F.when(failed, F.col("error")).otherwise(F.col("__status")).alias("status"),
        F.when(~failed, F.col("__id")).alias("case_id"),
        F.when(failed, F.array().cast("array<string>")).otherwise(C.history_items(F.col("html"))).alias("detail"),
        "error",
    )


def error_capture(status_pages: DataFrame) -> DataFrame:
    """``(case_key, status_code, error)`` of the pages that could not be read; their history is not looked at.

    An explode picks them: a filter on ``error`` would be pushed below the extraction and run it twice.
    """
    errors = F.array_compact(F.array(_error(F.col("__status"), F.col("__id"))))
    return _read(status_pages).select("case_key", "status_code", F.explode(errors).alias("error"))
