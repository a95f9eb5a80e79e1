import io
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.operators import tables as T
from caseloom.sources import files

GOLDEN = ("|Product Name|Q1 Revenue|\n|--------------|-------------|\n|Product A|$1,000,000|\n|Product B|$850,000|\n"
          "|Product C|$750,000|\n|Product D||\n")


def texts(spark, *values):
    return spark.createDataFrame([(f"t{i}", v) for i, v in enumerate(values)], schemas.TABLE_TEXTS)


CASES = [GOLDEN, "a,b\n1,2\n", "a\tb\n1\t\t2", "plain\n\ntext", "", "a,b|c,d|", "x|y\n|\n 1 | 2 ", "\u2003x\x1f,\xa0y\n\x85\n1,\u30002", " a , b \n\r\n c,d"]

ROWS = [
    [["Product Name", "Q1 Revenue"], ["--------------", "-------------"], ["Product A", "$1,000,000"], ["Product B", "$850,000"],
     ["Product C", "$750,000"], ["Product D"]],
    [["a", "b"], ["1", "2"]],
    [["a", "b"], ["1", "2"]],
    [["plain"], ["text"]],
    [],
    [["a,b", "c,d"]],
    [["x", "y"], [], ["1", "2"]],
    [["x", "y"], ["1", "2"]],
    [["a", "b"], ["c", "d"]],
]


def test_parse(spark):
    got = {}
    for r in T.parse_table_rows(texts(spark, *CASES)).orderBy("row_no").collect():
        got.setdefault(r.table_id, []).append(r.cells)
        assert r.header == got[r.table_id][0]
    for i, text in enumerate(CASES):
        assert got.get(f"t{i}", []) == ROWS[i], text
    kept = T.parse_table_rows(texts(spark, "a,,b"), keep_empty=True).first().cells
    assert kept == ["a", "", "b"]
    assert [r.delimiter for r in T.detect_delimiter(texts(spark, *CASES)).orderBy("table_id").collect()] == \
        ["|", ",", "\t", "|", "|", "|", "|", ",", ","]


def test_construct(spark, rows):
    parsed = T.parse_table_rows(texts(spark, GOLDEN, "", "a,b\n1\n1,2,3\n4,5"))
    golden = rows(T.construct_table(parsed).filter("table_id = 't0'"))
    assert golden[0] == ("t0", 0, 0, "Product Name", "--------------")
    assert ("t0", 4, 1, "Q1 Revenue", None) in golden
    assert rows(T.construct_table(parsed).filter("table_id = 't1'")) == []
    short = rows(T.construct_table(parsed).filter("table_id = 't2'"), "row_no", "col_name", "value")
    assert short == [(0, "a", "1"), (0, "b", None), (2, "a", "4"), (2, "b", "5")]
    assert rows(T.overlong_rows(parsed)) == [("t2", 1, ["1", "2", "3"], "row has 3 cells, header has 2")]
    lean = T.parse_table_rows(texts(spark, GOLDEN), drop_separator=True)
    named = T.construct_table(lean, columns=["x", "y"])
    assert rows(named)[0] == ("t0", 0, 0, "x", "Product A")
    wide = T.wide_table(parsed, ["x", "y"]).filter("table_id = 't2'")
    assert rows(wide, "x", "y") == [("1", None), ("4", "5")]
    assert [r.x for r in T.preview(T.wide_table(parsed, ["x", "y"]).filter("table_id = 't0'"), 2).collect()] == \
        ["--------------", "Product A"]
    assert T.preview_each(T.wide_table(parsed, ["x", "y"]), 1).count() == 2


def test_map_string_columns(spark):
    df = spark.createDataFrame([(1, "a", None, 2.5)], "n int, s string, t string, d double")
    got = T.map_string_columns(df, F.upper).first()
    assert tuple(got) == (1, "A", None, 2.5)
    ragged = spark.createDataFrame([(0, ["a"]), (1, ["b", None, "c"])], "row_no int, cells array<string>")
    wide = T.padded_columns(ragged, ["row_no"])
    assert wide.columns == ["row_no", "0", "1", "2"]
    assert [tuple(r) for r in wide.orderBy("row_no").collect()] == [(0, "a", None, None), (1, "b", None, "c")]


def test_markdown(spark):
    df = spark.createDataFrame([(0, "elk", 5), (1, "pig", 12345678), (2, None, 7)], "i long, animal_1 string, n int")
    got = [r.line for r in T.table_to_markdown(df, index="i").orderBy("line_no").collect()]
    assert got == [
        "|    | animal_1   |        n |",
        "|---:|:-----------|---------:|",
        "|  0 | elk        |        5 |",
        "|  1 | pig        | 12345678 |",
        "|  2 |            |        7 |",
    ]
    bare = [r.line for r in T.table_to_markdown(df, index="i", padded=False).orderBy("line_no").collect()]
    assert bare[:3] == ["|  | animal_1 | n |", "|---:|:---|---:|", "| 0 | elk | 5 |"]


def test_rendered_rows(spark):
    df = spark.createDataFrame([(1, [["a", None], ["b\nc"]]), (2, [])], "id int, cells array<array<string>>")
    got = {r.id: r.text for r in T.render_table_rows(df, "id").collect()}
    assert got == {1: "|a|None|\n|b c|", 2: ""}


VALUES = [("plain", 1), ("comma, inside", 2), ('quote " inside', 3), ("line\nbreak", 4), (" blanks ", 5), (None, None), ("é", 7)]


def test_csv_is_what_pandas_writes(spark, tmp_path):
    path = str(tmp_path / "out")
    files.csv_export(spark.createDataFrame(VALUES, "s string, n int").coalesce(1), path)
    part = [f for f in os.listdir(path) if f.startswith("part-")]
    written = open(os.path.join(path, part[0]), encoding="utf-8", newline="").read()
    buffer = io.StringIO()
    pd.DataFrame(VALUES, columns=["s", "n"]).astype({"n": "Int64"}).to_csv(buffer, index=False)
    assert written == buffer.getvalue()
    back = files.csv_scan(spark, path, "s string, n int", multi_line=True).select("s", "n").collect()
    assert sorted(map(tuple, back), key=str) == sorted(VALUES, key=str)


def test_row_index_is_that_of_the_file(spark, tmp_path):
    path = str(tmp_path / "rows.csv")
    with open(path, "w") as f:
        f.write("n,t\n" + "".join(f"{i},{'x' * 50}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30k")
    try:
        scanned = files.csv_scan(spark, path, "n int, t string", keep_bad_rows=False)
        assert scanned.rdd.getNumPartitions() > 5
        got = files.with_row_index(scanned).select("row_no", "n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 5000 and all(r.row_no == r.n for r in got)


def test_csv_scan(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    open(path, "w", encoding="utf-8").write("a,b\n1,x\nbad,y\n")
    inferred = files.csv_scan(spark, path)
    assert dict(inferred.dtypes) == {"a": "string", "b": "string"}
    typed = files.csv_scan(spark, path, "a int, b string").collect()
    assert [(r.a, r.b, r._corrupt_record) for r in typed] == [(1, "x", None), (None, "y", "bad,y")]


def test_keyed_store_shelves(spark, tmp_path, rows):
    df = spark.createDataFrame([("ab1.txt", "one"), ("cd2.txt", "two")], "file_name string, text string")
    files.write_keyed_texts(df, str(tmp_path / "flat"))
    files.write_keyed_texts(df, str(tmp_path / "shelves"), shelf_digits=2)
    assert rows(spark.read.parquet(str(tmp_path / "flat"))) == rows(df)
    assert rows(spark.read.parquet(str(tmp_path / "shelves")), "file_name", "text") == rows(df)
    assert sorted(os.listdir(tmp_path / "shelves"))[-2:] == ["shelf=ab", "shelf=cd"]


@pytest.mark.parametrize("column", ["text"])
def test_text_sink(spark, tmp_path, column):
    files.write_text_lines(spark.createDataFrame([("x",)], f"{column} string"), column, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first().value == "x"


def test_many_tables_each_as_wide_as_its_cells(spark):
    texts = spark.createDataFrame([("a", "x,y\n1,long cell\n22\n1,2,3"), ("b", "name|n\nq|1"), ("c", "only,head"), ("d", ""), ("e", None)], "table_id string, text string")
    got = {}
    for r in T.tables_to_markdown(T.parse_table_rows(texts)).orderBy("table_id", "line_no").collect():
        got.setdefault(r.table_id, []).append(r.line)
    assert got == {
        "a": ["|    | x   | y         |", "|---:|:----|:----------|", "|  0 | 1   | long cell |", "|  1 | 22  |           |"],
        "b": ["|    | name   | n   |", "|---:|:-------|:----|", "|  0 | q      | 1   |"],
        "c": ["|    | only   | head   |", "|---:|:-------|:-------|"]}


def test_names_are_told_apart(spark):
    texts = spark.createDataFrame([("a", "x|x|x.1||x\n1|2|3|4|5\n6"), ("b", "p|q\n1|2|3")], "table_id string, text string")
    parsed = T.parse_table_rows(texts, keep_empty=True)
    names = [(r.table_id, r.col_no, r.col_name, r.header) for r in T.table_schemas(parsed).orderBy("table_id", "col_no").collect()]
    assert names == [("a", 0, "x", "x"), ("a", 1, "x.1", "x"), ("a", 2, "x.1#2", "x.1"), ("a", 3, "column_3", ""), ("a", 4, "x.2", "x"), ("b", 0, "p", "p"), ("b", 1, "q", "q")]
    records = T.table_records(parsed)
    assert {(r.table_id, r.row_no): r.record for r in records.collect()} == {
        ("a", 0): {"x": "1", "x.1": "2", "x.1#2": "3", "column_3": "4", "x.2": "5"},
        ("a", 1): {"x": "6", "x.1": None, "x.1#2": None, "column_3": None, "x.2": None}}
    typed = T.typed_columns(records, {"x": "int", "q": "int"}).orderBy("row_no").collect()
    assert [(r.x, r.q) for r in typed] == [(1, None), (6, None)]
