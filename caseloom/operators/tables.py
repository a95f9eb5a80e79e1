"""Tables in text and cell form: parse, build, map, preview, write as Markdown lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from caseloom.functions import tabletext as TT
from caseloom.plans.store import stored


def detect_delimiter(table_texts: DataFrame) -> DataFrame:
    """``(table_id, delimiter)``."""
    return table_texts.select("table_id", TT.delimiter_of(F.col("text")).alias("delimiter"))


def parse_table_rows(table_texts: DataFrame, keep_empty: bool = False, drop_separator: bool = False) -> DataFrame:
    """``(table_id, row_no, header, cells)``: one row per non-blank line, row 0 being the header line.

    The delimiter is found once per text and the header is cut once per text,
    before the lines are taken apart; both travel with the lines, so a table is
    built without a join or a shuffle. ``drop_separator`` leaves out Markdown
    delimiter lines, which are rows like any other otherwise.
    """
    texts = table_texts.select(
        "table_id", TT.delimiter_of(F.col("text")).alias("__delimiter"), TT.lines_of(F.col("text"), drop_separator).alias("__lines")
    )
    headed = texts.select(
        "table_id", "__delimiter", "__lines",
        TT.cells_of(F.get("__lines", F.lit(0)), F.col("__delimiter"), keep_empty).alias("header"),
    )
    lines = headed.select("table_id", "__delimiter", "header", F.posexplode("__lines").alias("row_no", "__line"))
    return lines.select(
        "table_id", "row_no", "header", TT.cells_of(F.col("__line"), F.col("__delimiter"), keep_empty).alias("cells")
    )


def parse_table_text(table_texts: DataFrame, keep_empty: bool = False) -> DataFrame:
    """``(table_id, row_no, col_no, value)``: the cells, counted from 0. No shuffle."""
    rows = parse_table_rows(table_texts, keep_empty)
    return rows.select("table_id", "row_no", F.posexplode("cells").alias("col_no", "value"))


def _body_rows(parsed: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """``(table_id, row_no, header, cells)`` below the header. Row 0 is taken off even where columns are given."""
    header = F.array(*[F.lit(c) for c in columns]) if columns else F.col("header")
    return parsed.filter(F.col("row_no") > 0).select(
        "table_id", (F.col("row_no") - 1).alias("row_no"), header.alias("header"), "cells"
    )


def construct_table(parsed: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(table_id, row_no, col_no, col_name, value)`` from :func:`parse_table_rows`.

    Short rows are filled up with NULL; rows longer than the header are left to :func:`overlong_rows`.
    """
    body = _body_rows(parsed, columns).filter(F.size("cells") <= F.size("header"))
    named = body.select("table_id", "row_no", "cells", F.posexplode("header").alias("col_no", "col_name"))
    return named.select("table_id", "row_no", "col_no", "col_name", F.get("cells", F.col("col_no")).alias("value"))


def overlong_rows(parsed: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(table_id, row_no, cells, error)``: rows with more cells than the header."""
    body = _body_rows(parsed, columns)
    width, wanted = F.size("cells"), F.size("header")
    return body.filter(width > wanted).select(
        "table_id", "row_no", "cells",
        F.concat(F.lit("row has "), width.cast("string"), F.lit(" cells, header has "), wanted.cast("string")).alias("error"),
    )


def wide_table(parsed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(table_id, row_no, *columns)``: the columns are known, so this is a projection and not a pivot."""
    body = _body_rows(parsed, columns).filter(F.size("cells") <= len(columns))
    return body.select("table_id", "row_no", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def preview(table: DataFrame, n: int = 5, order: Sequence[str] = ("row_no",)) -> DataFrame:
    """The first ``n`` rows of one table: a top-n per task and one small merge, not a sort."""
    return table.orderBy(*order).limit(n)


def preview_each(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows of every table; ``row_no`` counts from 0, so this is a filter."""
    return rows.filter(F.col("row_no") < n)


def render_table_rows(tables: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, text)`` from ``cells array<array<string>>``: rows in pipes, one per line."""
    return tables.select(*keys, TT.rendered_rows(F.col("cells")).alias("text"))


def map_string_columns(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """``fn`` on every string column, the others untouched, in one projection. ``fn`` may be a pandas UDF."""
    return df.select(*[
        (fn(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`"))
        for f in df.schema.fields
    ])


def widest_row(rows: DataFrame, cells: str = "cells") -> int:
    """Number of columns the ragged rows need: one number, found by an aggregate."""
    return rows.agg(F.max(F.size(cells))).first()[0] or 0


def padded_columns(rows: DataFrame, keys: Sequence[str], cells: str = "cells", width: int | None = None) -> DataFrame:
    """``(*keys, 0, 1, ...)``: ragged rows as columns named by number, missing cells NULL."""
    width = widest_row(rows, cells) if width is None else width
    return rows.select(*keys, *[F.get(cells, F.lit(i)).alias(str(i)) for i in range(width)])


def table_to_markdown(df: DataFrame, index: str, index_name: str = "", padded: bool = True) -> DataFrame:
    """``(line_no, line)``: a pipe table as lines, the ``index`` column first.

    Line 0 is the header, line 1 the delimiter line, then one line per row at
    ``index + 2``; the table is the lines in that order, which stays a column
    instead of a global sort. Padding needs the widest cell per column: one row
    of numbers, brought in as a scalar subquery. Numbers are set to the right.
    """
    fields = [f for f in df.schema.fields if f.name != index]
    names = [index_name, *[f.name for f in fields]]
    numeric = [True, *[isinstance(f.dataType, T.NumericType) for f in fields]]
    shown = [F.col(f"`{index}`").cast("string"),
             *[F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("")) for f in fields]]
    cells = [f"c{i}" for i in range(len(shown))]
    body = df.select((F.col(f"`{index}`").cast("long") + 2).alias("line_no"), *[c.alias(n) for c, n in zip(shown, cells)])

    # Fixed value: a header claims two characters more than its name.
    if padded:
        widths = body.agg(F.array(*[
            F.greatest(F.lit(len(name) + 2), F.coalesce(F.max(F.length(c)), F.lit(0))) for c, name in zip(cells, names)
        ])).scalar()
        width = [F.get(widths, F.lit(i)) for i in range(len(cells))]

    def cell(value: Column, i: int) -> Column:
        if not padded:
            return value
        return F.lpad(value, width[i], F.lit(" ")) if numeric[i] else F.rpad(value, width[i], F.lit(" "))

    def line(values: Sequence[Column]) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(v, i) for i, v in enumerate(values)]), F.lit(" |"))

    def dashes(i: int) -> Column:
        run = F.repeat(F.lit("-"), width[i] + 1) if padded else F.lit("---")
        return F.concat(run, F.lit(":")) if numeric[i] else F.concat(F.lit(":"), run)

    spark = df.sparkSession
    delimiter = F.concat(F.lit("|"), F.concat_ws("|", *[dashes(i) for i in range(len(cells))]), F.lit("|"))
    top = spark.range(1).select(
        F.inline(F.array(
            F.struct(F.lit(0).cast("long").alias("line_no"), line([F.lit(n) for n in names]).alias("line")),
            F.struct(F.lit(1).cast("long").alias("line_no"), delimiter.alias("line")),
        ))
    )
    return top.unionByName(body.select("line_no", line([F.col(c) for c in cells]).alias("line")))


def tables_to_markdown(parsed: DataFrame) -> DataFrame:
    """``(table_id, line_no, line)``: many tables as pipe tables, each as wide as its own cells, the row number first.

    From :func:`parse_table_rows`; lines are numbered as in :func:`table_to_markdown`.
    Widths are the longest cells of a table, combined before the shuffle: a few
    numbers per table, however many its rows. Cells are texts and stand left.
    Short rows are filled up; longer ones are left to :func:`overlong_rows`.
    """
    body = _body_rows(parsed, None).filter(F.size("cells") <= F.size("header"))
    names = parsed.filter(F.col("row_no") == 0).select("table_id", F.lit(-1).alias("row_no"), F.posexplode("cells").alias("col_no", "value")).withColumn(
        "n", F.length("value") + 2)     # a header claims two characters more than its name
    cells = body.select("table_id", "row_no", F.posexplode("cells").alias("col_no", "value")).withColumn("n", F.length("value"))
    widest = names.unionByName(cells).groupBy("table_id", "col_no").agg(F.max("n").alias("n"), F.max("row_no").alias("last"), F.max(F.when(F.col("row_no") < 0, F.col("value"))).alias("name"))
    per_table = stored(widest.groupBy("table_id").agg(
        F.sort_array(F.collect_list(F.struct("col_no", "n", "name"))).alias("columns"), F.max("last").alias("last")), "widths").select(
        "table_id", F.transform("columns", lambda c: c["n"]).alias("widths"), F.transform("columns", lambda c: c["name"]).alias("names"),
        F.greatest(F.lit(2), F.length(F.col("last").cast("string"))).alias("first"))

    def line(index: Column, values: Column) -> Column:
        shown = F.zip_with(values, F.col("widths"), lambda v, w: F.rpad(F.coalesce(v, F.lit("")), w, F.lit(" ")))
        return F.concat(F.lit("| "), F.lpad(index, F.col("first"), F.lit(" ")), F.lit(" | "), F.array_join(shown, " | "), F.lit(" |"))

    dashes = F.array_join(F.transform("widths", lambda w: F.concat(F.lit(":"), F.repeat(F.lit("-"), w + 1))), "|")
    delimiter = F.concat(F.lit("|"), F.repeat(F.lit("-"), F.col("first") + 1), F.lit(":|"), dashes, F.lit("|"))
    tops = per_table.select("table_id", F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("line_no"), line(F.lit(""), F.col("names")).alias("line")),
        F.struct(F.lit(1).cast("long").alias("line_no"), delimiter.alias("line")))))
    rows = body.select("table_id", "row_no", "cells").join(per_table, "table_id").select(
        "table_id", (F.col("row_no").cast("long") + 2).alias("line_no"), line(F.col("row_no").cast("string"), F.col("cells")).alias("line"))
    return tops.unionByName(rows)


def column_names(header: Column) -> Column:
    """Names by which the columns of a table can be told apart: ``name``, ``name.1``, ``name.2`` where one repeats,
    ``column_3`` (counted from 0) where there is none."""
    named = F.transform(header, lambda name, i: F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit("column_"), i.cast("string"))).otherwise(name))

    def told_apart(names: Column) -> Column:
        def one(name: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(names, F.lit(1), i), lambda n: n == name))
            return F.when(before == 0, name).otherwise(F.concat(name, F.lit("."), before.cast("string")))

        return F.transform(names, one)

    # A suffixed name may be that of another column; such a one takes its place among the columns as a name.
    def unique(names: Column) -> Column:
        return F.transform(names, lambda name, i: F.when(
            F.array_position(names, name) == i + 1, name).otherwise(F.concat(name, F.lit("#"), i.cast("string"))))

    once = F.get(F.transform(F.array(named), told_apart), F.lit(0))
    return F.get(F.transform(F.array(once), unique), F.lit(0))


def table_schemas(parsed: DataFrame) -> DataFrame:
    """``(table_id, col_no, col_name, header)``: the columns of every table, in order, under the names that its records use."""
    heads = parsed.filter(F.col("row_no") == 0).select("table_id", "header", column_names(F.col("header")).alias("names"))
    return heads.select("table_id", F.posexplode(F.arrays_zip("names", "header")).alias("col_no", "c")).select(
        "table_id", "col_no", F.col("c.names").alias("col_name"), F.col("c.header").alias("header"))


def table_records(parsed: DataFrame) -> DataFrame:
    """``(table_id, row_no, record)``: tables of any headers in one relation; ``record`` maps names to cells, in the table's order.

    Names are those of :func:`table_schemas`. A row too short has NULL for the rest;
    one too long is left to :func:`overlong_rows`. Nothing has to be known of the
    headers when the query is planned.
    """
    body = _body_rows(parsed, None).filter(F.size("cells") <= F.size("header"))
    filled = F.transform("header", lambda _, i: F.get("cells", i))
    return body.select("table_id", "row_no", F.map_from_arrays(column_names(F.col("header")), filled).alias("record"))


def typed_columns(records: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``(table_id, row_no, *columns)``: some names of the records as columns of the given types; NULL where a table or a cell has no such value."""
    return records.select("table_id", "row_no", *[
        F.try_element_at("record", F.lit(name)).try_cast(kind).alias(name) for name, kind in columns.items()])
