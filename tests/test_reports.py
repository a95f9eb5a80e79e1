import json

import pytest

from caseloom import schemas
from caseloom.operators import reports as R

FULL = json.dumps({
    "sujets_principaux": ["visa", "travail"],
    "thèmes_clés": [{"thème": "T", "description": "D", "sujets_connexes": ["a", "b"]}],
    "points_de_données_significatifs": [{"point_de_donnée": "P", "contexte": "C", "source": "S"}],
    "insights": [{"insight": "I", "explication": "E"}],
}, ensure_ascii=False)


def responses(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), schemas.RESPONSES)


JSON_TEXTS = [
    FULL, "[1, 2]", "null", '"text"', "NaN", "{}{}", "{},{}", '{"a":1,}', '{"a":1} fin', "{'a':1}", '{"a":1/*c*/}', "01",
    '"a\nb"', '{"a":"]["}', "", '{"a":', '{"a":1}}', '{"a":1}\n', "1],[2", '1},{"v":2', '1,"w":2', "true", "-1.5e3", '[{"a":[]}]',
]


VALID = {FULL, "[1, 2]", "null", '"text"', "NaN", '{"a":"]["}', '{"a":1}\n', "true", "-1.5e3", '[{"a":[]}]'}


def test_strict_json(spark):
    got = {r.doc_id: r.ok for r in R.parse_report_json(responses(spark, *["s```json" + t for t in JSON_TEXTS])).collect()}
    assert {text for i, text in enumerate(JSON_TEXTS) if got[i]} == VALID


def test_split(spark):
    df = responses(spark, " résumé \n```json\n{}\n```", "no fence ", "a```json{}``` fin", "a```json{}```json{}")
    got = [(r.summary, r.json_part) for r in R.split_report(df).orderBy("doc_id").collect()]
    assert got == [("résumé", "{}\n"), ("no fence ", None), ("a", "{}``` fin"), ("a", "{}```json{}")]


def test_good_and_quarantined(spark):
    parsed = R.parse_report_json(responses(spark, f"x```json{FULL}```", "y```json{oops```", "z", "w```json[1]```"))
    assert [r.doc_id for r in R.good_reports(parsed).orderBy("doc_id").collect()] == [0, 3]
    bad = R.quarantined_reports(parsed).collect()
    assert [(r.doc_id, r.raw, r.error) for r in bad] == [(1, "{oops```", R.PARSE_ERROR)]
    other_shape = R.good_reports(parsed).filter("doc_id = 3").first().report
    assert other_shape is None or all(v is None for v in other_shape)


def test_facts(spark, rows):
    parsed = R.parse_report_json(responses(spark, f"x```json{FULL}```", "z", "w```json{}```"))
    assert rows(R.report_facts(parsed)) == [
        (0, "data_point", 0, "P", "C", "S"), (0, "insight", 0, "I", "E", None), (0, "theme", 0, "T", "D", None),
        (0, "topic", 0, "visa", None, None), (0, "topic", 1, "travail", None, None)]
    assert rows(R.theme_related_topics(parsed)) == [(0, 0, "T", 0, "a"), (0, 0, "T", 1, "b")]
    assert rows(R.report_topics(parsed)) == [(0, 0, "visa"), (0, 1, "travail")]
    assert rows(R.report_data_points(parsed)) == [(0, 0, "P", "C", "S")]
    assert rows(R.report_insights(parsed)) == [(0, 0, "I", "E")]
    assert rows(R.topic_counts(parsed)) == [("travail", 1), ("visa", 1)]


@pytest.mark.parametrize("part,trimmed", [("{}", "{}"), ("{}```", "{}"), (" {} \n", "{}")])
def test_json_part_edges(spark, part, trimmed):
    assert R.split_report(responses(spark, "s```json" + part)).first().json_part == trimmed
