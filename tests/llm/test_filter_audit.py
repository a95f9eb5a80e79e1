from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from caseloom.llm.filter_audit import FILTERS, filter_interactions, removal_intervals


def failed(rows, i):
    """Letters of the filters that row i fails, by the plain rules."""
    doc_id, text, *_ = rows[i]
    text = text or ""
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    out = "A" if len(words) < 200 else ""
    out += "B" if 2 * len(set(words)) < len(words) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else ""
    out += "D" if any(c in "#$%&*|" for c in text) else ""
    smaller = [r for r in rows if r[0] is not None and doc_id is not None and r[0] < doc_id and (r[1] or "") == text]
    return out + ("E" if smaller else "")


def plain(rows, good, toxic):
    """Every order applied to every document, one by one."""
    fails = [failed(rows, i) for i in range(len(rows))]
    out = {}
    for part in {r[3] or "" for r in rows}:
        mine = [i for i, r in enumerate(rows) if (r[3] or "") == part]
        shapley = Counter()
        for order in permutations(FILTERS):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in fails[i]]
                earlier = [i for i in mine if i not in left and f in fails[i]]
                left = [i for i in left if i not in gone]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(earlier), sum(fails[i] == f for i in mine),
                    sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, LONG, "en", "a"), (2, LONG, "en", "a"), (2, LONG, "en", "b"), (None, LONG, "en", "b"), (3, None, None, None), (4, "", "en", "a"),
    (5, "word " * 30000, "en", "a"), (6, "Word\tword\n" * 150, "en", "b"), (7, "A few # Words", "en", "b"), (8, LONG + " |", "en", None),
    (9, "É é $" * 100, "fr", "b"), (10, LONG.upper(), "en", "a"), (11, LONG.upper() + "*", "en", "a"), (None, None, None, None), (12, LONG, "en", "c"),
]


def answer(df):
    return {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in df.collect()}


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, None, 1), (7, 1, 1), (9, 0, 0), (10, 1, 0), (None, 1, 1), (99, 1, 1)],
        "doc_id long, quality long, toxic long")


def test_as_every_order_applied_to_every_document(documents, labels):
    want = plain(ROWS, good={1, 2, 7, 10}, toxic={2, 5, 7})
    got = answer(filter_interactions(documents(ROWS), labels))
    assert len(got) == 4 * 600 and got == want


def test_odd_documents_and_clashing_names(odd_documents, labels):
    clashing = odd_documents.withColumns({c: F.lit("x") for c in ("mask", "part", "good", "toxic", "quality", "digest", "first", "rank", "step")})
    got = answer(filter_interactions(clashing, labels))
    assert {k[0] for k in got} == {"", "a", "b"}
    # the two empty rows, three short ones, a repeated word and a blank text, in the order of the letters
    assert got["a", "ABCDE", 1][:2] == [1, 4] and got["a", "ABCDE", 2][:2] == [0, 1]


def test_empty_tables(documents, labels):
    assert filter_interactions(documents([]), labels).collect() == []
    assert len(answer(filter_interactions(documents(ROWS), labels.limit(0)))) == 2400


def test_each_order_is_covered_once_by_the_intervals_of_a_mask():
    for mask in range(1, 32):
        ranks = [r for m, _, first, behind in removal_intervals() if m == mask for r in range(first, behind)]
        assert sorted(ranks) == list(range(120))
