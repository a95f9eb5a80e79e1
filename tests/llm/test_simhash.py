import random

import numpy as np
import pytest
import xxhash

from caseloom.llm import simhash
from caseloom.llm.tables import read

SF = "/root/testdata/sf0.001"


def slow_print(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Every pair compared; doc index -> smallest index reachable."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_against_all_pairs(spark):
    docs = read(spark, SF, "documents").orderBy("doc_id").collect()
    prints = [slow_print(d.text) for d in docs]
    want = {d.doc_id: (f"{p:016x}", docs[r].doc_id) for d, p, r in zip(docs, prints, slow_components(prints))}
    got = simhash.simhash_near_duplicates(read(spark, SF, "documents")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    assert len(got) == len(docs)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_kernel_connects_what_is_linked(radius):
    rng = random.Random(radius)
    prints, groups = [], []
    for g in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 70, 150])):
            prints.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))))
            groups.append(g)
    order = sorted(range(len(prints)), key=lambda i: (groups[i], prints[i]))
    prints, groups = [prints[i] for i in order], [groups[i] for i in order]
    a, b = simhash.connecting_links(np.array(groups), np.array(prints, np.uint64), radius)
    assert all(groups[i] == groups[j] and (prints[i] ^ prints[j]).bit_count() <= radius for i, j in zip(a, b))

    def classes(links):
        parent = list(range(len(prints)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in links:
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
        return [root(i) for i in range(len(prints))]

    every = [(i, j) for i in range(len(prints)) for j in range(i)
             if groups[i] == groups[j] and (prints[i] ^ prints[j]).bit_count() <= radius]
    assert classes(zip(a.tolist(), b.tolist())) == classes(every)
    assert len(a) <= len(prints)


def test_chunks_of_a_long_file_miss_nothing(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(120)} | {rng.getrandbits(64) for _ in range(40)}
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    frame = spark.createDataFrame(signed, "fp long")
    from caseloom.llm.components import connected_components

    def sizes(chunk):
        roots = connected_components(simhash.similar_fingerprints(frame, 3, chunk)).groupBy("root").count()
        return sorted(r["count"] for r in roots.collect())

    assert sizes(7) == sizes(2048)


def test_odd_rows(odd_documents, spark):
    got = simhash.simhash_near_duplicates(odd_documents).collect()
    assert len(got) == 10
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in zero) == [(False, 1), (False, 2), (False, 5), (True, 0)]
    assert {r.component_id for r in zero} == {1}
    kept = simhash.keep_one_per_group(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 3, 4, 6]
    assert simhash.simhash_near_duplicates(odd_documents.limit(0)).count() == 0
    assert simhash.keep_one_per_group(odd_documents.limit(0)).count() == 0
