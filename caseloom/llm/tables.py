"""Helpers shared by the operators of this package."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from caseloom.plans.store import stored

ROW = "__row"


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored_with_row(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` with a number that is unique to each row and read it back.

    The numbers are drawn in the stage that writes, so that they are fixed from
    then on; rows stay apart even where ids are NULL or repeat.
    """
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), label)


_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Send this package to the Python workers, once per application, in case they can't import it by themselves."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        top = pathlib.Path(__file__).resolve().parents[1]
        path = pathlib.Path(tempfile.mkdtemp(prefix="ship-")) / "caseloom_package.zip"
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(top.rglob("*.py")):
                out.write(file, file.relative_to(top.parent))
        context.addPyFile(str(path))
        _SHIPPED.add(context.applicationId)


def map_texts(df: DataFrame, text: str, carry: list[str], result: T.StructType,
              work: Callable[[pa.BinaryArray], list[pa.Array]], slice_bytes: int = 1 << 20) -> DataFrame:
    """Columns ``carry`` next to what ``work`` makes of the texts, row by row.

    ``work`` gets some rows' texts as UTF-8 (NULL as the empty text) and gives one
    array per result field. A slice ends as soon as it holds ``slice_bytes``, so
    that memory follows the longest text and not the batch.
    """
    ship(df.sparkSession)
    picked = df.select(*[F.col(c) for c in carry], F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*picked.schema.fields[:-1], *result.fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary()).fill_null(b"")
            at, end = 0, batch.num_rows
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + end + 1]
            while at < end:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + slice_bytes, side="left")))
                to = min(to, end)
                made = work(texts.slice(at, to - at))
                kept = [batch.column(i).slice(at, to - at) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=names)
                at = to

    return picked.mapInArrow(run, schema)
