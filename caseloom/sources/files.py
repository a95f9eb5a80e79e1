"""File scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from caseloom import schemas
from caseloom.plans.store import folders_in, remove_paths, stored


def uploaded_files(spark: SparkSession, path: str) -> DataFrame:
    """``(name, length, content)`` of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), "length", "content")


def csv_scan(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None,
             keep_bad_rows: bool = True, multi_line: bool = False) -> DataFrame:
    """A CSV table with a header line.

    Large files are split over many tasks; no value may hold a line break then.
    ``multi_line`` reads line breaks inside quotes, at one task per file.

    With a ``schema`` the file is read once; rows that do not fit it keep their
    text in ``_corrupt_record``. Without one the types are inferred, which reads
    the data twice.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if keep_bad_rows and "_corrupt_record" not in schema.names:
        schema = StructType(list(schema.fields)).add("_corrupt_record", "string")
    return reader.schema(schema).option("mode", "PERMISSIVE").csv(path)


def with_row_index(df: DataFrame, name: str = "row_no") -> DataFrame:
    """A file scan with the number of each row, from 0, in the order of files and of rows in them.

    Rows are counted per piece of a file, in the task that reads it; only the pieces' sizes are added up.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__from")).withColumn(
        "__n", F.monotonically_increasing_id())
    rows = stored(placed, "indexed")  # the counting below has to see the numbers as they were given
    pieces = rows.groupBy("__file", "__from").agg(F.min("__n").alias("__first"), F.count(F.lit(1)).alias("__size"))
    before = W.partitionBy().orderBy("__file", "__from").rowsBetween(W.unboundedPreceding, -1)  # a row per piece of a file
    starts = pieces.select("__file", "__from", "__first", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    return rows.join(starts, ["__file", "__from"]).select(
        (F.col("__n") - F.col("__first") + F.col("__start")).alias(name), *df.columns)


def csv_export(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header, no index, quotes only where needed, NULL as an empty field, blanks kept. UTF-8 without a byte order mark."""
    (
        df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def captured_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, html)``: pages captured beforehand take the place of a live fetch."""
    return spark.read.schema(schemas.PAGES).parquet(path)


def write_keyed_texts(texts: DataFrame, path: str, mode: str = "overwrite", shelf_digits: int = 0) -> None:
    """Store ``(file_name, ..., text)`` as Parquet, as it comes: no further shuffle.

    ``shelf_digits`` sorts the texts into folders by the first digits of their
    name, for stores that are read by name; each task then writes its own file per folder.
    """
    if shelf_digits:
        shelved = texts.withColumn("shelf", F.left("file_name", F.lit(shelf_digits)))
        shelved.write.mode(mode).partitionBy("shelf").parquet(path)
    else:
        texts.write.mode(mode).parquet(path)


def text_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the runs that a store of keyed texts holds."""
    return sorted(int(name.removeprefix("version=")) for name in folders_in(spark, path) if name.startswith("version="))


def append_keyed_texts(texts: DataFrame, path: str, version: int | None = None) -> int:
    """Add a run's ``(file_name, ..., text)`` to a store and leave what other runs wrote; gives the run's number.

    A run is a folder of its own, by default the one after the last. Nothing is
    read or rewritten. Of two runs that take the same number at the same time the
    second fails and can be started again; a run that failed on its way has left
    nothing, as its folder is filled when it is done.
    """
    if version is None:
        version = (text_versions(texts.sparkSession, path) or [0])[-1] + 1
    texts.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={version}")
    return version


def latest_keyed_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(file_name, ..., text, version)``: of every name what the last run that had it wrote.

    Which texts a later run has replaced is told by the names of all runs but the
    first, most often few; Spark sends them to the texts if they are small, and
    sorts both sides if not. The texts themselves are neither ranked nor grouped.
    """
    versions = text_versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no texts in {path}")
    rows = spark.read.option("basePath", path).parquet(*[f"{path.rstrip('/')}/version={v}" for v in versions])
    rows = rows.withColumn("version", F.col("version").cast("long"))
    if len(versions) == 1:
        return rows
    later = stored(rows.where(F.col("version") > versions[0]).groupBy("file_name").agg(F.max("version").alias("last")), "latest-texts")
    return rows.join(later, "file_name", "left").where(F.coalesce(F.col("version") == F.col("last"), F.lit(True))).drop("last")


def compact_keyed_texts(spark: SparkSession, path: str) -> int:
    """Write the latest texts as one run, then remove the runs before it; gives its number.

    A store is whole at any time: a run holds all names before any other goes. What
    was begun to be read before goes on only until then.
    """
    versions = text_versions(spark, path)
    if len(versions) < 2:
        return (versions or [0])[-1]
    version = append_keyed_texts(latest_keyed_texts(spark, path).drop("version"), path, versions[-1] + 1)
    remove_paths(spark, [f"{path.rstrip('/')}/version={v}" for v in versions])
    return version


def write_text_lines(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    """Plain text, one value per line."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)
