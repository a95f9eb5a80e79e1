"""Page layout: choosing pages, reading order, page and document text, rows of tables.

Elements are ``T`` (text), ``R`` (rectangle) or another kind; ``y1`` is the
upper and ``y0`` the lower edge, measured from the foot of the page, y0 <= y1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.functions.tabletext import rendered_rows
from caseloom.functions.text import squeeze
from caseloom.plans.parts import ordered_texts
from caseloom.plans.ranks import ranked, text_pieces
from caseloom.plans.store import stored

PAGE = ["doc_id", "page_no"]
CHUNK = 1 << 16
NO_BOX = "no page box"


def select_pages(df: DataFrame, page_ids: Sequence[int] | None = None, start: int | None = None,
                 end: int | None = None) -> DataFrame:
    """Rows of chosen pages: ``page_ids`` counts from 0 (None: all); ``start..end`` counts from 1 and is inclusive."""
    if page_ids is not None:
        df = df.filter(F.col("page_no").isin([i + 1 for i in page_ids]))
    if start is not None:
        df = df.filter(F.col("page_no") >= start)
    if end is not None:
        df = df.filter(F.col("page_no") <= end)
    return df


def normalize_line_text(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """``(*keys, text)``: lines joined by a blank, whitespace runs as one blank, none at the edges."""
    return df.select(*keys, squeeze(F.col(text)).alias("text"))


def _top_down() -> list[Column]:
    """The one order of a page: by upper edge, NULL ones last, then by number."""
    return [F.desc_nulls_last("y1"), F.asc("elem_no")]


def page_reading_order(elements: DataFrame, spread: bool = False) -> DataFrame:
    """The elements with ``reading_order`` from 1: top to bottom by ``y1``, NULL last, ties by ``elem_no``.

    A page is ranked in one streaming sort. ``spread`` is for pages too long for a
    task: elements are dealt out by ranges of the whole order, so that one page, or
    one height, may lie in many of them, and ranks are counted on from range to range.
    """
    if not spread:
        rank = F.row_number().over(W.partitionBy(*PAGE).orderBy(*_top_down()))
        return elements.withColumn("reading_order", rank.cast("long"))
    # Written, for the borders of the ranges come from a sample.
    dealt = stored(elements.repartitionByRange(*PAGE, *_top_down()).withColumn("__range", F.spark_partition_id()), "reading-order")
    sizes = dealt.groupBy(*PAGE, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*PAGE).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    above = sizes.select(*PAGE, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__above"))
    inner = F.row_number().over(W.partitionBy(*PAGE, "__range").orderBy(*_top_down()))
    return dealt.withColumn("__rank", inner).join(above, [*PAGE, "__range"]).select(
        *elements.columns, (F.col("__rank") + F.col("__above")).alias("reading_order"))


# The walk over a page. Text never changes its state, so it goes over rectangles only: a table is entered at the first
# rectangle met outside, and left at the last rectangle of a run that lies below the table's lower edge. The state is
# the table number t and whether the walk is inside it. The lambdas are SQL text: built from Column objects they would
# cost thousands of calls to the JVM. ``given`` are a range's rectangles in order, and the first one behind the range.
_RECTS = """
filter(transform(given, (r, i) -> named_struct('pos', r.pos, 'y0', r.y0, 'behind', r.behind,
                                               'run_end', coalesce(get(given, i + 1).pos <> r.pos + 1, true))), r -> not r.behind)
"""
_LEAVES = "coalesce(r.run_end and {t} < size(floors) and r.y0 < get(floors, {t}), false)"
# What comes out of a range are the positions at which tables are entered and left. They are gathered by blocks, so that
# what was found before is not copied with every table.
_EVENTS = f"""
flatten(aggregate(
  sequence(1, size(rects), 256),
  named_struct('t', first_t, 'inside', first_inside, 'found', cast(array() as array<array<struct<t: int, lo: bigint, hi: bigint>>>)),
  (s, at) -> get(transform(array(aggregate(
    slice(rects, at, 256),
    named_struct('t', s.t, 'inside', s.inside, 'found', cast(array() as array<struct<t: int, lo: bigint, hi: bigint>>)),
    (s, r) -> get(transform(
      array(named_struct('enters', not s.inside and s.t < size(floors), 'leaves', {_LEAVES.format(t="s.t")})),
      n -> named_struct(
        't', if(n.leaves, s.t + 1, s.t),
        'inside', s.t < size(floors) and not n.leaves,
        'found', if(n.enters or n.leaves, concat(s.found, array(named_struct(
          't', s.t, 'lo', if(n.enters, r.pos, null), 'hi', if(n.leaves, r.pos, null)))), s.found))), 0))),
    b -> named_struct('t', b.t, 'inside', b.inside, 'found', concat(s.found, array(b.found)))), 0),
  s -> s.found))
"""
# What a range does to the walk, whatever state it comes in: for each t the state behind the range, as 2 t, and one more
# inside of a table. Whether the walk comes in inside plays no part. Worked out from the last rectangle backwards.
_PASSAGE = f"""
aggregate(
  reverse(filter(slice(rects, 1, size(rects) - 1), r -> r.run_end)),
  transform(sequence(0, size(floors)), t -> get(transform(slice(rects, -1, 1), r -> if({_LEAVES.format(t="t")}, 2 * t + 2, 2 * t + int(t < size(floors)))), 0)),
  (g, r) -> transform(g, (same, t) -> if({_LEAVES.format(t="t")}, get(g, t + 1), same)))
"""
GROUP = 256     # ranges of a page whose passages are combined in one row


def _handed(passages: str, name: str) -> str:
    """SQL: ``(name, start)`` of each of a row of passages, the walk coming to the first one in the state ``start``."""
    return f"""get(transform(array(
        aggregate({passages}.passage, array(start), (s, p) -> concat(s, array(get(p, element_at(s, -1) div 2))))),
      came -> transform({passages}, (x, i) -> named_struct('{name}', x.{name}, 'start', cast(get(came, i) as int)))), 0)"""


def _range_starts(ranges: DataFrame) -> DataFrame:
    """``(doc_id, page_no, range, first_t, first_inside)`` of the ranges of pages that lie in several.

    Ranges come down to their passages; those of ``GROUP`` ranges are combined to one,
    these are walked page by page, and the states found are handed down again.
    """
    passages = ranges.select(*PAGE, "range", F.expr(_PASSAGE).alias("passage"))
    groups = stored(passages.groupBy(*PAGE, F.expr(f"range div {GROUP}").alias("group")).agg(
        F.sort_array(F.collect_list(F.struct("range", "passage"))).alias("inner")), "walk-groups")
    combined = groups.select(*PAGE, "group", F.expr("""
        aggregate(slice(inner, 2, size(inner)), get(inner, 0).passage, (g, x) -> transform(g, s -> get(x.passage, s div 2)))""").alias("passage"))
    tops = combined.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("group", "passage"))).alias("groups"))
    group_starts = tops.withColumn("start", F.lit(0)).select(*PAGE, F.inline(F.expr(_handed("groups", "group"))))
    starts = groups.join(group_starts, [*PAGE, "group"]).select(*PAGE, F.inline(F.expr(_handed("inner", "range"))))
    return starts.select(*PAGE, "range", F.expr("cast(start div 2 as int)").alias("first_t"), F.expr("start % 2 = 1").alias("first_inside"))


def _table_spans(ordered: DataFrame, page_tables: DataFrame, page_boxes: DataFrame, spread: bool, chunk: int) -> DataFrame:
    """``(doc_id, page_no, lo, hi, t)``: positions taken up by the page's table number ``t``, counted from 0; ends included.

    A table that is not left goes on to the end of the page. Of an element its
    position and lower edge are gathered, and of rectangles only; of a table its
    lower edge. With ``spread`` a page is walked in ranges of ``chunk`` positions.
    """
    floors = page_tables.join(page_boxes, PAGE).groupBy(*PAGE).agg(
        F.sort_array(F.collect_list(F.struct("table_no", (F.col("page_h") - F.col("bbox_bottom")).alias("floor")))).alias("t"))
    lows = floors.select(*PAGE, F.transform("t", lambda t: t["floor"]).alias("floors"))
    pos = F.col("reading_order")
    if not spread:
        given = F.sort_array(F.collect_list(F.when(F.col("elem_type") == "R", F.struct(pos.alias("pos"), "y0", F.lit(False).alias("behind")))))
        pages = ordered.groupBy(*PAGE).agg(given.alias("given"), F.max("reading_order").alias("last_pos"))
        walked = pages.join(lows, PAGE).select(*PAGE, "last_pos", "floors", F.lit(0).alias("first_t"), F.lit(False).alias("first_inside"), F.expr(_RECTS).alias("rects"))
        found = walked.where("size(rects) > 0").select(*PAGE, "last_pos", F.inline(F.expr(_EVENTS)))
        return found.groupBy(*PAGE, "t").agg(F.max("lo").alias("lo"), F.coalesce(F.max("hi"), F.max("last_pos")).alias("hi"))
    # The first position of a range is told to the range before as well: it may end a run of rectangles there.
    rects = ordered.filter(F.col("elem_type") == "R").select(*PAGE, F.explode(F.expr(f"""filter(array(
        named_struct('range', reading_order div {chunk}, 'pos', reading_order, 'y0', y0, 'behind', false),
        if(reading_order % {chunk} = 0, named_struct('range', reading_order div {chunk} - 1, 'pos', reading_order, 'y0', y0, 'behind', true), null)),
        x -> x is not null)""")).alias("r")).select(*PAGE, "r.*")
    ranges = stored(
        rects.groupBy(*PAGE, "range").agg(F.sort_array(F.collect_list(F.struct("pos", "y0", "behind"))).alias("given"))
        .join(lows, PAGE).select(*PAGE, "range", "floors", F.expr(_RECTS).alias("rects")).where("size(rects) > 0"), "walk-ranges")
    found = ranges.join(_range_starts(ranges), [*PAGE, "range"]).select(*PAGE, F.inline(F.expr(_EVENTS)))
    ends = ordered.groupBy(*PAGE).agg(F.max("reading_order").alias("last_pos"))
    spans = found.groupBy(*PAGE, "t").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    return spans.join(ends, PAGE).select(*PAGE, "lo", F.coalesce("hi", "last_pos").alias("hi"), "t")


def page_pieces(elements: DataFrame, page_tables: DataFrame, page_boxes: DataFrame, text: bool = True, table: bool = True,
                spread: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, page_no, pos, piece)``: texts and rendered tables of the pages, as rows in the order of ``pos``.

    Elements are walked top to bottom. At the first rectangle of a table the
    rendered table comes, and text is left out up to the table's last rectangle.
    ``text`` and ``table`` switch either kind off. A page without a box has no
    tables. Texts are held against the tables in chunks of positions, so that no
    task gets a long page whole. ``spread`` is that of :func:`page_reading_order`,
    and has the walk go over the chunks of a page at the same time.
    """
    ordered = page_reading_order(elements, spread)
    texts = ordered.filter(F.col("elem_type") == "T").select(
        *PAGE, F.col("reading_order").alias("pos"), squeeze(F.col("text")).alias("piece"))
    if not table:
        return texts if text else texts.limit(0)
    spans = stored(_table_spans(ordered, page_tables, page_boxes, spread, chunk), "table-spans")  # used twice
    numbered = page_tables.withColumn("t", F.row_number().over(W.partitionBy(*PAGE).orderBy("table_no")) - 1)
    shown = spans.select(*PAGE, F.col("lo").alias("pos"), "t").join(
        numbered.select(*PAGE, "t", rendered_rows(F.col("cells")).alias("piece")), [*PAGE, "t"]).select(*PAGE, "pos", "piece")
    if not text:
        return shown
    # A span is cut at the borders of the chunks; in each, its beginning counts up before and its end down after the texts.
    cut = spans.select(*PAGE, "lo", "hi", F.explode(F.expr(f"sequence(lo div {chunk}, hi div {chunk})")).alias("chunk"))
    ends = cut.select(*PAGE, "chunk", F.inline(F.array(
        F.struct(F.greatest("lo", F.col("chunk") * chunk).alias("pos"), F.lit(0).alias("k"), F.lit(1).alias("d")),
        F.struct(F.least("hi", (F.col("chunk") + 1) * chunk - 1).alias("pos"), F.lit(2).alias("k"), F.lit(-1).alias("d")))))
    marked = texts.select(*PAGE, F.expr(f"pos div {chunk}").alias("chunk"), "pos", F.lit(1).alias("k"), F.lit(0).alias("d"), "piece").unionByName(
        ends, allowMissingColumns=True)
    inside = F.sum("d").over(W.partitionBy(*PAGE, "chunk").orderBy("pos", "k").rowsBetween(W.unboundedPreceding, 0))
    outside = marked.withColumn("__inside", inside).filter("k = 1 and __inside = 0").select(*PAGE, "pos", "piece")
    return outside.unionByName(shown)


def assemble_page(elements: DataFrame, page_tables: DataFrame, page_boxes: DataFrame, text: bool = True,
                  table: bool = True, spread: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, page_no, content, error)``: text of each page with its tables in place, one row per page.

    Pages are those of ``page_boxes`` and of ``elements``; one without a box is assembled without tables and has an
    ``error``. Runs of line breaks become one. For pages too long for a row there is :func:`page_pieces`.
    """
    pieces = page_pieces(elements, page_tables, page_boxes, text, table, spread, chunk)
    pages = page_boxes.select(*PAGE, F.lit(1).alias("box")).unionByName(elements.select(*PAGE, F.lit(0).alias("box")))
    rows = pages.select(*PAGE, "box", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("piece")).distinct().unionByName(
        pieces.select(*PAGE, F.lit(0).alias("box"), "pos", "piece"))
    joined = rows.groupBy(*PAGE).agg(F.array_join(ordered_texts(["pos"], "piece"), "").alias("content"), F.max("box").alias("box"))
    return joined.select(*PAGE, F.regexp_replace("content", r"\n+", "\n").alias("content"), F.when(F.col("box") == 0, NO_BOX).alias("error"))


def assemble_document(page_content: DataFrame, sep: str = "\n") -> DataFrame:
    """``(doc_id, n_pages, text)``: page contents in page order, joined by ``sep``, one row per document."""
    return page_content.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.array_join(ordered_texts(["page_no"], "content"), sep).alias("text"))


def document_pieces(page_content: DataFrame, sep: str = "\n") -> DataFrame:
    """``(doc_id, start, text)``: the documents of :func:`assemble_document` as pieces, a page each with what stands before it, and their places."""
    pages = ranked(page_content.select("doc_id", "page_no", "content"), ["doc_id"], [F.asc("page_no"), F.asc("content")], "n")
    led = F.concat(F.when(F.col("n") > 0, sep).otherwise(""), F.coalesce("content", F.lit("")))
    return text_pieces(pages.select("doc_id", "n", led.alias("__text")), ["doc_id"], [F.asc("n")], "__text")


def collect_tables(page_tables: DataFrame, start: int, end: int) -> DataFrame:
    """``(doc_id, page_no, table_no, row_no, cells)``: all rows of all tables of a page range.

    ``(page_no, table_no, row_no)`` is the order of the flat list; it stays a key instead of a global sort.
    """
    return select_pages(page_tables, start=start, end=end).select(
        *PAGE, "table_no", F.posexplode("cells").alias("row_no", "cells")
    )
