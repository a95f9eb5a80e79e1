import hashlib
import random
import re

import pytest

from caseloom.llm import decontaminate
from caseloom.llm.tables import read

SF = "/root/testdata/sf0.001"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def expected(doc, items):
    own, hit, found = words(doc), set(), set()
    for item_id, text in items:
        w = words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for j in range(len(own) - size + 1):
                if own[j] == w[i] and own[j:j + size] == w[i:i + size]:
                    hit.update(range(j, j + size))
                    found.add(str(item_id))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)


def outcome(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def test_against_every_window(spark):
    docs, items = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    bench = [(r.item_id, r.text) for r in items.collect()]
    want = sorted((d.doc_id, *expected(d.text, bench)) for d in docs.collect())
    assert any(w[2] for w in want)
    assert outcome(decontaminate.benchmark_overlap(docs, items)) == want


@pytest.mark.parametrize("seed", range(3))
def test_small_vocabulary(spark, documents, seed):
    """Few different words, so that grams repeat, overlap and tie; items of every length from 0 to 30."""
    rng = random.Random(seed)
    vocabulary = ["a", "B", "é", "1", "zz"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 7, 12, 13, 14, 30])))) for i in range(25)]
    texts = []
    for _ in range(30):
        parts = [rng.choice(items)[1] if rng.random() < 0.3 else "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "\n", ""]) for _ in range(rng.randrange(30)))
                 for _ in range(rng.randrange(4))]
        texts.append(" x, ".join(parts))
    texts += [None, "", "?!"]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *expected(t, items)) for i, t in enumerate(texts))
    assert outcome(decontaminate.benchmark_overlap(documents(texts), frame)) == want


def test_odd_rows(spark, odd_documents):
    items = spark.createDataFrame([(1, "some words here"), (None, "words"), (2, None), (1, "some words here")], "item_id long, text string")
    got = decontaminate.benchmark_overlap(odd_documents, items).collect()
    assert len(got) == 10
    assert sorted((r.n_words, r.n_hit, r.n_items) for r in got)[-6:] == [(1, 0, 0), (2, 1, 0), (3, 3, 1), (3, 3, 1), (3, 3, 1), (30000, 0, 0)]
    kept = decontaminate.keep_clean(odd_documents, items)
    assert kept.columns == odd_documents.columns and kept.count() == 6
    assert decontaminate.keep_clean(odd_documents, items.limit(0)).count() == 10
    assert decontaminate.benchmark_overlap(odd_documents.limit(0), items).count() == 0
