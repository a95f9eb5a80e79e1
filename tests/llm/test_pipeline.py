"""Every stage against a plain version of what it has to do to its own input."""

import zlib
from collections import Counter, defaultdict

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from caseloom.llm import mixing
from caseloom.llm.tables import read
from caseloom.plans.store import stored
from test_decontaminate import expected
from test_mixing import plain_targets
from test_simhash import slow_components, slow_print
from test_token_files import PLAIN

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = read(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]

    kept = stored(stages["language_id"](spark, docs, SF), "t")
    assert kept.columns == COLUMNS
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text)}

    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    single = stored(stages["simhash_near_dedup"](spark, kept, SF), "t")
    first = slow_components([slow_print(r.text) for r in rows])
    assert sorted(r.doc_id for r in single.collect()) == [rows[i].doc_id for i in sorted(set(first))]
    assert single.columns == COLUMNS

    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    clean = stored(stages["benchmark_decontamination"](spark, single, SF), "t")
    assert clean.columns == COLUMNS
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in single.collect() if not expected(r.text, items)[4])

    mixed = stored(stages["source_mixing"](spark, clean, SF), "t")
    assert mixed.columns == COLUMNS
    sizes, taken, before = defaultdict(int), defaultdict(int), {}
    for r in clean.collect():
        sizes[r.source] += len(r.text.encode().split())
        before[r.doc_id] = Counter(r.text.encode().split())
    copies = Counter()
    for r in mixed.collect():
        own = Counter(r.text.encode().split())
        assert own <= before[r.doc_id] and len(r.text) == r.n_chars
        taken[r.source] += sum(own.values())
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 2
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= 0.5 + 1e-6

    got = stages["token_output"](spark, mixed, SF).orderBy("start").collect()
    want = Counter()
    for r in mixed.collect():
        ids = [*PLAIN.encode(r.text, add_special_tokens=False).ids, 0]
        want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)


def test_run_agrees_with_itself_and_is_registered(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    first = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert first and first == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_odd_rows_pass_every_stage(spark, odd_documents):
    for rows in (odd_documents, odd_documents.limit(0)):
        docs = stored(rows, "t")
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), "t")
            if name != "token_output":
                assert docs.columns == odd_documents.columns, name
    assert docs.count() == 0


def test_mix_takes_a_document_at_most_twice(spark):
    docs = read(spark, SF, "documents")
    assert all(r.taken <= 2 * r["size"] for r in mixing.mixed_documents(docs).collect())


def test_results_of_two_runs_can_be_open(spark):
    one = corpus_pipeline.run(spark, SF)
    two = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
