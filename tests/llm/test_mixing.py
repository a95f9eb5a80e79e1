import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from caseloom.llm import mixing
from caseloom.llm.tables import read

SF = "/root/testdata/sf0.001"


def plain_targets(sizes):
    """Source -> target by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, full, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            full.add(s)


def checked(rows, texts):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size
    target = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6


def test_targets_are_met(spark):
    docs = read(spark, SF, "documents")
    got = mixing.mixed_documents(docs)
    rows = got.join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
    checked(rows, docs)
    again = mixing.mixed_documents(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got.collect()))


def test_small_and_null_sources(spark, documents):
    rows = [(i, "w " * n, "en", s) for i, (n, s) in enumerate([(1, "a"), (0, "b"), (700, "c"), (3, None), (255, "d"), (256, "d"), (1, "d"), (5000, "é")])]
    docs = documents([*rows, (8, None, "en", "z"), (None, "x y", None, None)])
    got = mixing.mixed_documents(docs)
    joined = got.join(docs.select(F.col("doc_id").alias("d"), "source"), F.col("doc_id").eqNullSafe(F.col("d"))).collect()
    assert len(joined) == 10
    checked(joined, docs)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mixed_documents(documents(["", None])).collect()] == [0, 0]


@pytest.mark.parametrize("size", [1, 2, 3, 10, 255, 1000])
def test_permutation(spark, size):
    frame = spark.range(size).select(F.expr(mixing.permuted("id", f"{size}L", "7L", "1")).alias("p"), "id")
    got = [r.p for r in frame.collect()]
    assert sorted(got) == list(range(size))
    assert size < 100 or sum(a == b for a, b in enumerate(got)) < size / 10


def test_slots_follow_the_draw(spark):
    sources = spark.createDataFrame([(1, 30_000), (2, 0), (3, 5_000), (4, 1)], "sno int, slots long")
    draws = mixing.shard_draws(sources, 1, shard_slots=1000).collect()
    per_source, per_shard = Counter(), Counter()
    for r in draws:
        per_source[r.sno] += r.n
        per_shard[r.shard] += r.n
    assert per_source == {1: 30_000, 3: 5_000, 4: 1}
    assert [per_shard[i] for i in range(36)] == [1000] * 35 + [1]
    for sno in (1, 3):
        spans = sorted((r.first, r.n) for r in draws if r.sno == sno)
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    inner = [r.n for r in draws if r.sno == 3 and r.shard < 30]
    assert 90 < sum(inner) / len(inner) < 200 and len(set(inner)) > 5


def test_texts_hold_the_words_taken(spark, documents):
    docs = documents([(i, " ".join(f"w{i}_{j}" for j in range(n)), "en", s) for i, (n, s) in enumerate([(900, "a"), (300, "b"), (2000, "c"), (10, "c")])])
    docs = docs.withColumn("size", F.lit(1)).withColumn("taken", F.lit(1))
    want = {r.doc_id: r.taken for r in mixing.mixed_documents(docs).collect()}
    rows = mixing.mixed_texts(docs).collect()
    got = Counter()
    for r in rows:
        words = r.text.split()
        assert len(words) == len(set(words)) and all(w.startswith(f"w{r.doc_id}_") for w in words) and r.n_chars == len(r.text)
        got[r.doc_id] += len(words)
    assert got == want and rows[0].__fields__ == docs.columns


def test_odd_rows(spark, odd_documents):
    got = mixing.mixed_documents(odd_documents).collect()
    assert len(got) == 10 and sum(r.taken for r in got) > 30000
    assert mixing.mixed_texts(odd_documents).columns == odd_documents.columns
    assert mixing.mixed_texts(odd_documents.limit(0)).count() == 0


def test_native(spark):
    plan = mixing.mixed_documents(read(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
