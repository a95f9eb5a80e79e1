import zlib

import numpy as np

from caseloom.llm import language
from caseloom.llm.tables import read

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = read(spark, SF, "documents")
    got = language.predicted_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in test) >= 0.98 * len(test)


def test_trigrams_against_a_plain_count():
    import pyarrow as pa

    texts = ["Ab c", "", "é1é", "  ", "x", "Straße,YZ"]
    keys, bounds = language.trigrams(pa.array([t.encode() for t in texts], pa.large_binary()))
    for i, text in enumerate(texts):
        line = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + " "
        want = [line[j - 1:j + 2] for j in range(1, len(line) - 1) if line[j] != " "]
        got = ["".join(chr(int(k) >> s & 0x1FFFFF) for s in (42, 21, 0)) for k in keys[bounds[i]:bounds[i + 1]]]
        assert got == want


def test_filters_answer_for_all_languages_and_correct_false_positives():
    rng = np.random.default_rng(1)
    languages = [f"l{i:02}" for i in range(70)]  # more than one word of bits
    keys = rng.integers(0, 1 << 62, 70 * 2000).astype(np.uint64)
    places = np.repeat(np.arange(70), 2000)
    filters = language.LanguageFilters.build(languages, "l00", keys, places)
    own = filters.counts(keys, np.arange(0, len(keys) + 1, 2000))
    assert (own.argmax(axis=1) == np.arange(70)).all() and np.allclose(own.diagonal(), 2000)
    foreign = filters.counts(rng.integers(0, 1 << 62, 50000).astype(np.uint64), np.array([0, 50000]))
    assert foreign.max() < 50


def test_odd_rows(spark, odd_documents):
    got = language.predicted_languages(odd_documents).collect()
    assert len(got) == 10
    assert sorted((r.lang_pred, r.score) for r in got if r.lang_pred == "und") == [("und", 0.0)] * 4
    assert {r.lang_pred for r in got} <= {"und", "en", "fr"}
    kept = language.keep_identified(odd_documents.withColumnsRenamed({"key": "lang_pred", "fp": "score"}))
    assert "lang_pred" in kept.columns and kept.filter("text is null or trim(text) = ''").count() == 0
    assert language.predicted_languages(odd_documents.limit(0)).count() == 0
