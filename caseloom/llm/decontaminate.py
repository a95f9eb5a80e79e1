"""Benchmark passages in documents, found by winnowing.

Texts are sequences of words. Of every 13 words in a row the least of the nine
5-word hashes is a fingerprint, so any 13 words that a document and an item share
give both the same fingerprint at the same place. Fingerprints are joined, and
each hit is extended over the words around it, which are compared as words: a
hash alone never decides. Items of fewer words are one fingerprint as a whole,
looked for at every place.

Before the join, document fingerprints pass a bit table of the items'
fingerprints. Its size is fixed, whatever the number of items; it lets all true
hits pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from caseloom.llm.simhash import mixed
from caseloom.llm.tables import ROW, map_texts, stored_with_row
from caseloom.plans.store import stored

WINDOW = 13
GRAM = 5
FILTER_BITS = 24

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)

HIT = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("pos", T.LongType()),
    T.StructField("before", T.ArrayType(T.StringType())), T.StructField("after", T.ArrayType(T.StringType())),
])
SCAN = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(HIT))])
_HITS = pa.list_(pa.struct([("kind", pa.int32()), ("hash", pa.int64()), ("pos", pa.int64()),
                            ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]))


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, first and past-the-last byte of each word, and each text's first word."""
    low = _LOWER[data]
    inside = _IN_WORD[low]
    edge = np.zeros(len(data) + 1, bool)  # a text begins here
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    powers = np.cumprod(np.full(int(sizes.max()), _ODD, np.uint64))
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    place = np.arange(total) - np.repeat(first, sizes)
    octets = low[np.repeat(starts, sizes) + place].astype(np.uint64) + np.uint64(1)
    return mixed(np.add.reduceat(octets * powers[place], first) + sizes.astype(np.uint64) * _ODD)


def gram_hashes(words: np.ndarray, size: int, kind: int) -> np.ndarray:
    """Hash of every ``size`` words in a row, over text ends as well."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = np.cumprod(np.full(size, _ODD, np.uint64))
    out = np.full(n, kind, np.uint64)
    for i in range(size):
        out += words[i:i + n] * factors[i]
    return mixed(out)


def winnow(grams: np.ndarray, owner: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Places of the least gram of every ``window`` words of one text; all places where it is reached count."""
    span = window - gram + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = grams[:n].copy()
    for i in range(1, span):
        np.minimum(least, grams[i:i + n], out=least)
    whole = owner[:n] == owner[window - 1:window - 1 + n]
    chosen = np.zeros(len(grams), bool)
    for i in range(span):
        chosen[i:i + n] |= whole & (grams[i:i + n] == least)
    return np.flatnonzero(chosen)


def _scan(texts: pa.BinaryArray, window: int, gram: int, short: tuple[int, ...], items: bool, bits: np.ndarray | None) -> list[pa.Array]:
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    offsets, base = offsets - offsets[0], offsets[0]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[base:base + offsets[-1]]
    low, starts, ends, first = word_places(data, offsets)
    sizes = np.diff(first)
    owner = np.repeat(np.arange(n), sizes)
    words = word_hashes(low, starts, ends)
    found: list[tuple[np.ndarray, np.ndarray, int]] = []

    def passing(places, hashes, kind):
        if bits is not None and len(places):
            at = (hashes[places] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            places = places[bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1]
        found.append((places, hashes, kind))

    grams = gram_hashes(words, gram, window)
    passing(winnow(grams, owner, window, gram), grams, window)
    for kind in (np.unique(sizes[(sizes > 0) & (sizes < window)]).tolist() if items else short):
        whole = gram_hashes(words, kind, kind)
        places = np.flatnonzero(owner[:len(whole)] == owner[kind - 1:kind - 1 + len(whole)])
        if items:
            places = places[sizes[owner[places]] == kind]
        passing(places, whole, kind)
    line = low.tobytes()

    def told(a, b, step):
        return [line[starts[i]:ends[i]].decode("utf-8", "replace") for i in range(a, b, step)]

    hits: list[list[dict]] = [[] for _ in range(n)]
    reach = window - gram
    for places, hashes, kind in found:
        long = kind == window
        for p, h in zip(places.tolist(), hashes[places].view(np.int64).tolist()):
            own = int(owner[p])
            before = told(p - 1, max(int(first[own]), p - reach) - 1, -1) if long else []
            after = told(p, min(int(first[own + 1]), p + (window if long else kind)), 1)
            hits[own].append({"kind": kind, "hash": h, "pos": p - int(first[own]), "before": before, "after": after})
    return [pa.array(sizes.astype(np.int64)), pa.array(hits, _HITS)]


def _same(a: str, b: str) -> Column:
    """How many words two lists have in common from their beginning on."""
    return F.expr(f"array_position(transform(sequence(1, 1 + least(size({a}), size({b}))), "
                  f"i -> get({a}, i - 1) <=> get({b}, i - 1) and i <= least(size({a}), size({b}))), false) - 1")


def item_fingerprints(items: DataFrame, text: str = "text", id_col: str = "item_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(item, kind, hash, before, after)``: what is looked for. ``kind`` is the window, or the length of a shorter item."""
    narrow = items.select(F.col(id_col).cast("string").alias("item"), F.col(text).alias("t"))
    scanned = map_texts(narrow, "t", ["item"], SCAN, lambda texts: _scan(texts, window, gram, (), True, None))
    found = scanned.select("item", F.explode("hits").alias("h")).select("item", "h.kind", "h.hash", "h.before", "h.after")
    return stored(found.distinct(), "item-prints")


def _bit_table(prints: DataFrame) -> np.ndarray:
    """The fixed-size bit table: Spark makes 4 KB pieces of it, at most 512 of which come here."""
    at = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    pieces = prints.select((at / 32768).cast("long").alias("piece"), (at % 32768).alias("bit")).groupBy("piece").agg(
        F.bitmap_construct_agg("bit").alias("bits")).collect()
    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in pieces:
        table[r["piece"] * 4096:(r["piece"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return table


def scan_documents(docs: DataFrame, prints: DataFrame, text: str, carry: list[str], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``carry``, ``n_words`` and ``hits`` (possible ones, to be joined) of every document, written with a row number."""
    bits = docs.sparkSession.sparkContext.broadcast(_bit_table(prints))
    short = tuple(sorted(r["kind"] for r in prints.filter(F.col("kind") < window).select("kind").distinct().collect()))
    scanned = map_texts(docs, text, carry, SCAN, lambda texts: _scan(texts, window, gram, short, False, bits.value))
    return stored_with_row(scanned, "scanned")


def contamination(scanned: DataFrame, prints: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(row, n_hit, n_items, items_sha256)`` of the scanned documents with hits."""
    hits = scanned.select(ROW, F.explode("hits").alias("h")).select(ROW, "h.kind", "h.hash", "h.pos", "h.before", "h.after")
    prints = prints.withColumnsRenamed({"before": "b2", "after": "a2"})
    joined = (
        hits.join(prints, ["kind", "hash"])
        .withColumn("left", _same("before", "b2")).withColumn("right", _same("after", "a2"))
        .filter(F.col("left") + F.col("right") >= F.col("kind"))
        .select(ROW, "item", (F.col("pos") - F.col("left")).alias("lo"), (F.col("pos") + F.col("right")).alias("hi"))
    )
    found = stored(joined.distinct(), "hits")
    union = F.expr("""aggregate(array_sort(spans), named_struct('n', 0L, 'to', 0L),
        (s, x) -> named_struct('n', s.n + greatest(0L, x.hi - greatest(x.lo, s.to)), 'to', greatest(s.to, x.hi)), s -> s.n)""")
    words = (found.select(ROW, "lo", "hi").distinct().groupBy(ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
             .select(ROW, union.alias("n_hit")))
    items = (found.select(ROW, "item").distinct().groupBy(ROW).agg(F.array_sort(F.collect_list("item")).alias("items"))
             .select(ROW, F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")))
    return words.join(items, ROW)


def benchmark_overlap(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text",
                      item_id: str = "item_id", window: int = WINDOW, gram: int = GRAM, rate: int = 20) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if it stands in an occurrence of any 13 words of an item, or of
    a whole item that has fewer. Contaminated: at least one word in ``rate`` is
    hit. NULL and empty texts have no words, items without words no windows; an
    item without id marks words but is not listed. Repeated rows each get a row,
    repeated items count once by id; empty tables give no rows or no hits.
    """
    prints = item_fingerprints(items, item_text, item_id, window, gram)
    scanned = scan_documents(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")), prints, "t", ["id"], window, gram)
    found = contamination(scanned, prints, window)
    hit = F.coalesce("n_hit", F.lit(0))
    return scanned.select(ROW, "id", "n_words").join(found, ROW, "left").select(
        F.col("id").alias("doc_id"), "n_words", hit.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((hit > 0) & (rate * hit >= F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id",
               window: int = WINDOW, gram: int = GRAM, rate: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    prints = item_fingerprints(items, item_text, item_id, window, gram)
    wide = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("t"))
    scanned = scan_documents(wide, prints, "t", ["doc"], window, gram)
    found = contamination(scanned, prints, window).join(scanned.select(ROW, "n_words"), ROW)
    dirty = found.filter((F.col("n_hit") > 0) & (rate * F.col("n_hit") >= F.col("n_words"))).select(ROW)
    return scanned.join(dirty, ROW, "left_anti").select("doc.*")
