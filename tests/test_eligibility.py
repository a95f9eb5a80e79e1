import pytest
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.operators import eligibility as E


# age, diploma, mark, years -> score, added up by hand
SCORES = [
    (25, "Secondaire", 0.0, 0, 0.37), (25, "Baccalauréat", 0.0, 0, 0.40), (25, "Master", 0.0, 0, 0.46), (25, "Doctorat", 0.0, 0, 0.55),
    (60, "Secondaire", 0.0, 0, 0.12), (60, "Secondaire", 4.5, 0, 0.27), (60, "Secondaire", 9.0, 0, 0.42), (60, "Secondaire", 10.0, 0, 0.42),
    (60, "Secondaire", 0.0, 3, 0.245), (60, "Secondaire", 0.0, 6, 0.37), (60, "Secondaire", 0.0, 15, 0.37), (10, "Master", 9.0, 3, 0.635),
    (40, "Master", 4.5, 3, 0.6725), (36, "Doctorat", 9.0, 0, 0.8375), (47, "Baccalauréat", 3.0, 2, 0.25 + 0.1 + 0.25 / 3), (18, "Master", 9.0, 0, 0.76),
    (35, "Doctorat", 4.5, 6, 0.95), (30, "Doctorat", 9.0, 6, 1.0), (30, "Master", 9.0, 6, 1.0), (16, "Doctorat", 9.0, 6, 0.85),
]


def test_scores_of_a_table(spark):
    df = spark.createDataFrame([(i, *row[:4]) for i, row in enumerate(SCORES)], schemas.APPLICANTS)
    got = {r.applicant_id: r.score for r in E.eligibility_score(df).collect()}
    for i, row in enumerate(SCORES):
        assert got[i] == pytest.approx(row[4], abs=1e-12), row


@pytest.mark.parametrize("age,share", [(17, 0), (18, 1), (35, 1), (36, 0.95), (47, 0.4), (48, 0)])
def test_age_edges(spark, age, share):
    df = spark.createDataFrame([(1, age, "Secondaire", 0.0, 0)], schemas.APPLICANTS)
    assert E.eligibility_score(df).first().score == pytest.approx(0.25 * share + 0.12)


def test_unknown_diploma_and_missing_values(spark):
    df = spark.createDataFrame([(1, 30, "Licence", 9.0, 6), (2, 30, "Master", None, 6), (3, 30, None, 9.0, 6)], schemas.APPLICANTS)
    got = {r.applicant_id: r for r in E.eligibility_score(df).collect()}
    assert got[1].score is None and got[1].error == "unknown education: Licence"
    assert got[2].score is None
    assert got[3].score is None and got[3].error is not None


def test_strong_profile_is_clamped(spark):
    df = spark.createDataFrame([(1, 30, "Doctorat", 9.0, 6)], schemas.APPLICANTS)
    assert E.eligibility_score(df).first().score == 1.0


def test_jitter_is_small_and_stable(spark):
    df = spark.range(200).selectExpr("id as applicant_id", "30 as age", "'Master' as education",
                                     "3.0D as language_score", "2 as work_experience")
    plain = E.eligibility_score(df).first().score
    one = {r[0]: r[1] for r in E.eligibility_score(df, 7).select("applicant_id", "score").collect()}
    two = {r[0]: r[1] for r in E.eligibility_score(df.repartition(7), 7).select("applicant_id", "score").collect()}
    assert one == two
    assert all(abs(v - plain) <= 0.05 + 1e-12 for v in one.values())
    assert max(one.values()) - min(one.values()) > 0.05


def test_bands(spark):
    scores = spark.createDataFrame([(1, 0.2999), (2, 0.3), (3, 0.6), (4, 0.8), (5, 1.0), (6, 0.12345), (7, None)],
                                   "applicant_id long, score double")
    got = {r.applicant_id: (r.band, r.percent) for r in E.eligibility_band(scores).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["limited", "medium", "good", "top", "top"]
    assert got[6][1] == "12.35%"
    assert got[7] == (None, None)


def test_missing_documents(spark, rows):
    people = spark.createDataFrame([(1,), (2,), (3,)], "applicant_id long")
    everything = [(2, d) for d in E.REQUIRED_DOCS]
    given = spark.createDataFrame([(1, "photos"), (1, "photos"), (1, "permis"), *everything], schemas.SUBMITTED)
    missing = rows(E.missing_documents(people, given))
    assert [d for a, d in missing if a == 1] == sorted(set(E.REQUIRED_DOCS) - {"photos"})
    assert [d for a, d in missing if a == 2] == []
    assert [d for a, d in missing if a == 3] == sorted(E.REQUIRED_DOCS)
    report = {r.applicant_id: r for r in E.completeness_report(people, given).collect()}
    assert report[2].message == E.ALL_PRESENT and report[2].n_missing == 0
    assert report[1].message.endswith("lettre_invitation, passeport, preuve_linguistique, relevé_bancaire")


def test_one_applicant_with_most_papers_is_combined_before_the_shuffle(spark):
    people = spark.range(50).withColumnRenamed("id", "applicant_id")
    given = spark.range(20000).selectExpr("case when id % 3 = 0 then 7 else id % 50 end as applicant_id", "'photos' as doc")
    plan = E.missing_documents(people, given)
    assert plan.filter("doc = 'photos'").count() == 0
    text = plan._jdf.queryExecution().toString()
    assert "partial_collect_set" in text and "CartesianProduct" not in text


def test_missing_in_array(spark):
    df = spark.createDataFrame([(["photos", "x"],)], "docs array<string>")
    got = df.select(E.missing_in_array(F.col("docs")).alias("m")).first().m
    assert got == sorted(set(E.REQUIRED_DOCS) - {"photos"})


def test_missing_values_are_named(spark):
    people = spark.createDataFrame([(1, None, "Master", 5.0, 2), (2, 20, "Master", None, None), (3, 20, None, 5.0, 2), (4, 20, "Master", 5.0, 2)], schemas.APPLICANTS)
    got = {r.applicant_id: (r.score is None, r.error) for r in E.eligibility_score(people).collect()}
    assert got == {1: (True, "missing: age"), 2: (True, "missing: language_score, work_experience"), 3: (True, "unknown education: NULL"), 4: (False, None)}


def test_any_number_of_required_papers(spark):
    names = [f"p{i:03}" for i in range(150)]
    people = spark.createDataFrame([(1, 20, "Master", 5.0, 2)], schemas.APPLICANTS)
    given = spark.createDataFrame([(1, n) for n in names[:100]], schemas.SUBMITTED)
    assert [r.doc for r in E.missing_documents(people, given, names).orderBy("doc").collect()] == names[100:]
