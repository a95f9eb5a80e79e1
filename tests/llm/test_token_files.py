import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from caseloom.llm import token_files
from caseloom.llm.tables import read
from caseloom.plans.store import fresh_path

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(FILE)
PLAIN.encode_special_tokens = True
UNITS = token_files.UnitEncoder(open(FILE, encoding="utf-8").read())


def expected(rows):
    """Rows (doc_id, text) in order; what the files must tell."""
    at, out = 0, []
    for doc_id, text in rows:
        ids = [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "Bé", "'s", "n't", "12", " ", " ", "\x1c", "\x85", "。", "語", "<|endoftext|>", "-", "🙂", "́", "word", "Ab.", "x%%%", "²", "\0", "é!'s"]), max_size=14).map("".join))
def test_units_give_the_ids_of_the_text(text):
    assert np.frombuffer(UNITS.encode([text.encode()])[0], "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_encoder_that_forgets(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 50)
    units = token_files.UnitEncoder(open(FILE, encoding="utf-8").read())
    for i in range(40):
        texts = [" ".join(f"word{'abcdefgh'[j % 8] * (j % 5)}{i * j}, and" for j in range(30)), "again and again"]
        assert [np.frombuffer(x, "<u4").tolist() for x in units.encode([t.encode() for t in texts])] == [
            PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("count", [0, 1, 3, 4, 5, 1000])
def test_code_round_trip(count):
    rng = random.Random(count)
    ranks = np.array([rng.choice([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]) for _ in range(count)], "<u4")
    control, data = token_files.encode_ranks(ranks)
    assert (token_files.decode_ranks(control, data, count) == ranks).all()
    assert len(control) == (count + 3) // 4
    if count:
        with pytest.raises(ValueError):
            token_files.decode_ranks(control, data + b"x", count)


def test_files_tell_the_corpus(spark):
    docs = read(spark, SF, "documents")
    want = expected([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
    for segment in (token_files.SEGMENT, 700):
        got = token_files.token_output(docs.repartition(5), FILE, segment=segment).orderBy("start").collect()
        assert [tuple(r) for r in got] == want


def test_frequent_ids_take_one_byte(spark):
    path = fresh_path(spark, "files")
    token_files.write_token_files(read(spark, SF, "documents"), path, FILE)
    rows = spark.read.parquet(f"{path}/segments").collect()
    total = sum(sum(r.lengths) for r in rows)
    assert sum(len(r.data) + len(r.control) for r in rows) < 2 * total


def test_odd_rows(spark, odd_documents):
    got = token_files.token_output(odd_documents, FILE).orderBy("start").collect()
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert len(got) == len(rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.ids_crc32) for r in got) == sorted(
        ((d is None, d or 0), n, c) for d, _, n, c in expected(rows))
    assert [r.doc_id for r in got] == [None, None, 1, 2, 3, 3, 3, 4, 5, 6]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0
    assert token_files.token_output(odd_documents.limit(0), FILE).count() == 0


def test_added_tokens_as_the_library_has_them(spark, documents):
    """Against an unchanged tokenizer: the string of a special token in a text is that token."""
    library = Tokenizer.from_file(FILE)
    texts = ["a <|endoftext|> b", "plain words, here", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny", "<|endoftext| >", "", "again plain words,", "<|endoftext|>."]
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    units = token_files.UnitEncoder(open(FILE, encoding="utf-8").read(), added=True)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in units.encode([t.encode() for t in texts])] == want
    at, rows = 0, []
    for i, ids in enumerate(want):
        ids = [*ids, 0]
        rows.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in token_files.token_output(documents(texts), FILE).orderBy("start").collect()] == rows


def test_units_of_a_slice(monkeypatch):
    """Punctuation is cut off words, also behind letters of two bytes and in texts with runs of white space; the tokenizer sees a unit once."""
    texts = ["Élan vital!  Größe, Größe.\tdon't\n\nMüller (x)", "", "a\nb", "Größe, vital!"]
    units, bounds = token_files.UnitEncoder.units([t.encode() for t in texts])
    assert [x.decode() for x in units.to_pylist()] == [
        "Élan", " vital", "! ", " Größe", ",", " Größe", ".\tdon't", "\n\nMüller", " (x", ")", "a", "\n", "b", "Größe", ",", " vital", "!"]
    assert bounds.tolist() == [0, 10, 10, 13, 17]
    encoder, seen = token_files.UnitEncoder(open(FILE, encoding="utf-8").read()), []

    class Counting:
        def encode_batch_fast(self, part, **more):
            seen.extend(part)
            return PLAIN.encode_batch_fast(part, **more)

    encoder.tokenizer = Counting()
    for _ in range(2):
        encoder.encode([t.encode() for t in texts])
    assert len(seen) == len(set(seen)) == len(set(units.to_pylist()))


@pytest.mark.parametrize("seed", range(4))
def test_texts_of_a_slice_do_not_touch(seed):
    """Texts begin and end anywhere, also within what would be a character or a run of white space with their neighbour."""
    rng = random.Random(seed)
    parts = [b" ", b"\n", b"a", b"Word", b"!", b",", b"\xc3\xa9", b"\xc3", b"\xa9", b"\xc2", b"\xa0", b"\xe2\x80\x89", b"\xc3\x97", b"\xd0\xb6", b"\xe8\xaa\x9e", b"'s", b"1", b"\t", b"\xe3\x80"]
    texts = [b"".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(1500)]
    got = [np.frombuffer(x, "<u4").tolist() for x in UNITS.encode(texts)]
    assert got == [PLAIN.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts]
