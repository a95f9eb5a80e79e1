"""Every query against its SQL twin, and its independence of the partitioning."""

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def canonical(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in data]
    return sorted(columns), sorted(cells, key=lambda r: tuple((v is None, str(v)) for v in r))


def spark_result(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    return canonical(df.columns, [tuple(r) for r in df.collect()])


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_against_sql(spark, duck, name):
    cursor = duck.execute(entry.oracle_sql()[name])
    want = canonical([c[0] for c in cursor.description], cursor.fetchall())
    assert spark_result(spark, name) == want
    assert want[1]


def test_no_oracle_without_query():
    assert set(entry.ORACLES) == set(entry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["assemble_page", "report_context", "conversation_context", "band_summary", "page_pieces", "history_pieces", "document_pieces"])
def test_partitioning_does_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(spark_result(spark, name))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_no_python_in_the_plans(spark):
    for name in ("assemble_page", "report_context", "build_prompt", "parse_report_json", "page_pieces", "case_history", "construct_table",
                 "main_text_by_blocks", "export_transcript_rich", "history_pieces", "context_pieces", "upload_texts", "tables_to_markdown", "table_records"):
        plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name


def test_entry(spark):
    assert entry.entry(spark).columns == ["page_id", "num_urls", "context"]
