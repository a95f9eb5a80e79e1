import hashlib

import pytest
from pyspark.sql import functions as F

from caseloom.llm import exact


def test_batches_against_the_index(spark, documents):
    index = exact.new_index(spark, buckets=4)
    first = exact.exact_duplicates(documents(["a b", "ab", "c", None, ""]), index, batch="one").collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in first) == [
        (0, 0, 2, True), (1, 0, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 3, 2, False)]
    assert {r.text_sha256 for r in first if r.doc_id < 2} == {hashlib.sha256(b"ab").hexdigest()}
    second = documents([(10, "c  "), (11, "d"), (12, "a  b"), (13, "d\t")])
    for _ in range(2):  # a batch that is run again comes out the same and adds nothing
        got = exact.exact_duplicates(second, index, batch="two").collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [
            (10, 2, 1, False), (11, 13, 2, False), (12, 0, 1, False), (13, 13, 2, True)]
    again = exact.DigestIndex(spark, index.path, 4).read()
    assert again.count() == again.select("digest").distinct().count() == 4


def test_anti_join_does_not_shuffle_the_index(spark, documents):
    index = exact.new_index(spark, buckets=4)
    exact.exact_duplicates(documents(["a", "b"]), index)
    new = documents(["a", "c"]).select(exact.text_digest(F.col("text")).alias("digest"))
    plan = new.join(index.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan


def test_odd_rows(spark, odd_documents):
    got = exact.exact_duplicates(odd_documents, exact.new_index(spark)).collect()
    assert len(got) == 10
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got}) == 5
    empty = [r for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {(r.keep_id, r.group_size) for r in empty} == {(5, 4)}
    same = [r for r in got if r.group_size == 3]
    assert {r.keep_id for r in same} == {3} and [r.doc_id for r in same if r.kept] == [3]
    assert exact.exact_duplicates(odd_documents.limit(0), exact.new_index(spark)).count() == 0


def test_an_index_keeps_its_buckets_in_a_later_session(spark, documents):
    texts = [f"text {i}" for i in range(200)]
    index = exact.new_index(spark, buckets=8)
    exact.exact_duplicates(documents(texts), index, batch="one").collect()
    spark.sql(f"drop table {index.name}")       # the definition goes with a session, the folder stays
    for buckets in (2, 32):
        with pytest.raises(ValueError):
            exact.DigestIndex(spark, index.path, buckets)
    again = exact.DigestIndex(spark, index.path)
    assert again.buckets == 8
    assert [r for r in exact.exact_duplicates(documents(texts), again, batch="two").collect() if r.kept] == []
    wider = again.rewritten(index.path + "-wider", 16)
    later = exact.exact_duplicates(documents([*texts, "new"]), wider, batch="three").collect()
    assert [r.doc_id for r in later if r.kept] == [200] and wider.read().count() == 201
