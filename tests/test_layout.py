import itertools
import random
import re

import pytest

from caseloom import schemas
from caseloom.operators import layout as L

HEIGHT = 1000.0


def expected_page(elements, tables, text=True, table=True):
    """The page walk told over runs of like elements."""
    pieces, number, inside = [], 0, False
    ordered = sorted(elements, key=lambda e: (-e["y1"], e["elem_no"]))
    for kind, run in itertools.groupby(ordered, key=lambda e: e["elem_type"]):
        run = list(run)
        if kind == "R" and table and tables:
            if not inside and number < len(tables):
                pieces.append(f"|t{number}|None|\n|a b|")  # what the cells of random_page look like
                inside = True
            if inside and run[-1]["y0"] < HEIGHT - tables[number]["bbox_bottom"]:
                number, inside = number + 1, False
        elif kind == "T" and text and not inside:
            pieces += [" ".join(e["text"].split()) for e in run]
    return re.sub("\n+", "\n", "".join(pieces))


def random_page(rng, page_no, size):
    elements = []
    for i in range(size):
        y1 = float(rng.randrange(0, 1000, rng.choice([1, 50])))
        kind = rng.choice("TTTRRX")
        elements.append({"doc_id": 1, "page_no": page_no, "elem_no": i, "elem_type": kind,
                         "y0": y1 - rng.randrange(0, 120), "y1": y1, "text": f" {kind}{i}\n x "})
    bottoms = sorted(rng.sample(range(50, 1000), rng.randrange(0, 6)))
    if rng.random() < 0.3:
        rng.shuffle(bottoms)
    tables = [{"doc_id": 1, "page_no": page_no, "table_no": n, "bbox_bottom": float(b), "cells": [[f"t{n}", None], ["a\nb"]]}
              for n, b in enumerate(bottoms)]
    return elements, tables


def frames(spark, pages):
    elements = [e for els, _ in pages for e in els]
    tables = [t for _, tabs in pages for t in tabs]
    order = ["doc_id", "page_no", "elem_no", "elem_type", "y0", "y1", "text"]
    return (
        spark.createDataFrame([tuple(e[c] for c in order) for e in elements], schemas.ELEMENTS),
        spark.createDataFrame([(t["doc_id"], t["page_no"], t["table_no"], t["bbox_bottom"], t["cells"]) for t in tables],
                              schemas.PAGE_TABLES),
        spark.createDataFrame([(1, p, HEIGHT) for p in range(len(pages))], schemas.PAGE_BOXES),
    )


@pytest.fixture(scope="module")
def random_pages():
    rng = random.Random(11)
    return [random_page(rng, p, rng.choice([0, 1, 3, 8, 20, 60])) for p in range(150)]


@pytest.mark.parametrize("text,table", [(True, True), (False, True), (True, False)])
@pytest.mark.parametrize("spread,chunk", [(False, 1 << 16), (True, 7)])
def test_page_walk(spark, random_pages, text, table, spread, chunk):
    """Also with elements spread by ranges, and texts held against the tables in chunks of seven."""
    result = L.assemble_page(*frames(spark, random_pages), text=text, table=table, spread=spread, chunk=chunk)
    got = {r.page_no: r.content for r in result.collect()}
    assert len(got) == len(random_pages)
    for p, (els, tabs) in enumerate(random_pages):
        assert got[p] == expected_page(els, tabs, text, table), p


def test_pieces_in_order_are_the_page(spark, random_pages):
    pieces = {}
    for r in L.page_pieces(*frames(spark, random_pages), chunk=5).orderBy("page_no", "pos").collect():
        pieces.setdefault(r.page_no, []).append(r.piece)
    for p, (els, tabs) in enumerate(random_pages):
        assert re.sub("\n+", "\n", "".join(pieces.get(p, []))) == expected_page(els, tabs), p


@pytest.mark.parametrize("spread", [False, True])
def test_reading_order(spark, random_pages, spread):
    elements, _, _ = frames(spark, random_pages)
    got = {}
    for r in L.page_reading_order(elements, spread).collect():
        got[r.page_no, r.elem_no] = r.reading_order
    for p, (els, _) in enumerate(random_pages):
        for rank, e in enumerate(sorted(els, key=lambda e: (-e["y1"], e["elem_no"])), 1):
            assert got[p, e["elem_no"]] == rank


def test_a_hot_page_of_equal_heights_is_spread(spark):
    """Two thirds of the rows are one page, all at one height but for an outlier and a few without height."""
    elements = spark.range(9000).selectExpr(
        "1L as doc_id", "cast(case when id % 3 < 2 then 0 else id end as int) as page_no", "id as elem_no", "'T' as elem_type",
        "0.0D as y0", "case when id = 0 then 1e9D when id % 1000 = 1 then null else 5.0D end as y1", "'x' as text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ordered = L.page_reading_order(elements, spread=True).filter("page_no = 0").collect()
    ranges = elements.repartitionByRange(*L.PAGE, *L._top_down()).filter("page_no = 0").selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(r["count"] for r in ranges) < 2000
    ids = [i for i in range(9000) if i % 3 < 2]
    want = [0] + [i for i in ids if i and i % 1000 != 1] + [i for i in ids if i % 1000 == 1]
    assert [r.elem_no for r in sorted(ordered, key=lambda r: r.reading_order)] == want
    assert sorted(r.reading_order for r in ordered) == list(range(1, 6001))


def test_missing_boxes_and_elements(spark):
    elements = spark.createDataFrame([(1, 1, 0, "T", 0.0, 9.0, "nine"), (1, 1, 1, "T", 0.0, None, "none"), (1, 1, 2, "T", 0.0, 5.0, "five"),
                                      (1, 2, 3, "T", 0.0, 1.0, "lost?")], schemas.ELEMENTS)
    boxes = spark.createDataFrame([(1, 1, HEIGHT), (1, 3, HEIGHT)], schemas.PAGE_BOXES)
    got = {r.page_no: (r.content, r.error) for r in L.assemble_page(elements, spark.createDataFrame([], schemas.PAGE_TABLES), boxes).collect()}
    assert got == {1: ("ninefivenone", None), 2: ("lost?", L.NO_BOX), 3: ("", None)}


def test_select_pages(spark, rows):
    df = spark.createDataFrame([(1, p) for p in range(1, 7)], "doc_id long, page_no int")
    assert rows(L.select_pages(df), "page_no") == [(p,) for p in range(1, 7)]
    assert rows(L.select_pages(df, page_ids=[0, 3]), "page_no") == [(1,), (4,)]
    assert rows(L.select_pages(df, page_ids=[]), "page_no") == []
    assert rows(L.select_pages(df, start=2, end=4), "page_no") == [(2,), (3,), (4,)]


def test_page_choice_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "elements")
    spark.range(10).selectExpr("id as doc_id", "cast(id as int) as page_no", "'x' as text", "'y' as unused").write.parquet(path)
    plan = L.select_pages(spark.read.parquet(path), start=2, end=4).select("doc_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(page_no,2)" in text and "LessThanOrEqual(page_no,4)" in text
    assert "unused" not in text.split("ReadSchema")[1]


def test_line_text(spark):
    df = spark.createDataFrame([("  a\n b\t c \n",), ("",)], "text string")
    assert [r.text for r in L.normalize_line_text(df).collect()] == ["a b c", ""]


def test_document_is_one_row(spark):
    df = spark.createDataFrame([(1, p, f"p{p}") for p in range(1, 601)] + [(2, 3, "only")], "doc_id long, page_no int, content string")
    got = {r.doc_id: (r.n_pages, r.text) for r in L.assemble_document(df).collect()}
    assert got == {1: (600, "\n".join(f"p{p}" for p in range(1, 601))), 2: (1, "only")}
    assert L.assemble_document(df.filter("doc_id = 1"), sep="\n\n").first().text.startswith("p1\n\np2")


def test_collect_tables(spark, rows):
    df = spark.createDataFrame([(1, 1, 0, 5.0, [["a"], ["b", None]]), (1, 2, 0, 5.0, [["c"]]), (1, 5, 0, 5.0, [["d"]])],
                               schemas.PAGE_TABLES)
    got = rows(L.collect_tables(df, 1, 4))
    assert got == [(1, 1, 0, 0, ["a"]), (1, 1, 0, 1, ["b", None]), (1, 2, 0, 0, ["c"])]


def test_passages_of_many_ranges_are_combined(spark, rows, monkeypatch):
    """A page of 60 tables walked in ranges of 3 positions and groups of 2 ranges."""
    monkeypatch.setattr(L, "GROUP", 2)
    n = 480
    elements = spark.range(n).selectExpr(
        "1L as doc_id", "1 as page_no", "id as elem_no", "if(id % 8 in (2, 3, 5), 'R', 'T') as elem_type",
        "5000D - id * 10 - 5 as y0", "5000D - id * 10 as y1", "'t' || id || ';' as text")
    tables = spark.range(60).selectExpr(
        "1L as doc_id", "1 as page_no", "cast(id as int) as table_no", "id * 80D + if(id % 5 = 4, 400D, 5D) as bbox_bottom", "array(array('table' || id)) as cells")
    boxes = spark.createDataFrame([(1, 1, 5000.0)], "doc_id long, page_no int, page_h double")
    whole = rows(L.page_pieces(elements, tables, boxes))
    assert rows(L.page_pieces(elements, tables, boxes, spread=True, chunk=3)) == whole
    assert sum(r[3].startswith("|table") for r in whole) > 20
