"""Language of a text by n-gram filters that answer for all languages at once.

Each language has a Bloom filter of the character trigrams that are typical of
it. The filters are bit-sliced: a slot holds one bit per language, so the AND of
a trigram's slots is the set of languages that may have it. A text's trigrams
are counted per language, the count is corrected for the share of false
positives that the filter's filling gives, and the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from caseloom.llm.tables import map_texts, ship
from caseloom.plans.store import stored

MAX_DOCS = 4000      # labelled documents per language that are learned from
MAX_GRAMS = 40000    # trigrams per language in the filters
SLOT_BITS = 18
PROBES = 3
SALTS = 64
UNKNOWN = "und"
_FOLDED = 0x20000


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and their lower-case forms (where that is one code point)."""
    letter = np.zeros(0x110000, bool)
    low = np.arange(0x110000, dtype=np.uint32)
    for c in range(_FOLDED):
        char = chr(c)
        if char.isalpha():
            letter[c] = True
            folded = char.lower()
            if len(folded) == 1:
                low[c] = ord(folded)
    letter[_FOLDED:0x40000] = True
    return letter, low


def trigrams(texts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all trigrams around a letter, and the bounds of each text's keys.

    Letters are lower-cased; whatever is no letter, the ends included, stands as a space.
    """
    letter, low = _letters()
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets - offsets[0]]
    is_letter = letter[points]
    chars = np.full(len(points) + 2, 32, np.uint64)
    chars[1:-1] = np.where(is_letter, low[points], 32)
    before, after = chars[:-2].copy(), chars[2:].copy()
    inner = heads[(heads > 0) & (heads < len(points))]
    before[inner] = 32
    after[inner - 1] = 32
    at = np.flatnonzero(is_letter)
    keys = before[at] << np.uint64(42) | chars[1:-1][at] << np.uint64(21) | after[at]
    return keys, np.searchsorted(at, heads)


def _slots(keys: np.ndarray) -> list[np.ndarray]:
    mixed = keys * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return [(mixed >> np.uint64(64 - SLOT_BITS * (i + 1))) & mask for i in range(PROBES)]


@dataclass
class LanguageFilters:
    languages: list[str]         # sorted; the place is the bit
    common: str                  # the language with most learned documents
    slots: np.ndarray            # (2 ** SLOT_BITS, words): one bit per language
    false_rate: np.ndarray       # per language: chance that a foreign trigram seems to be in the filter

    @classmethod
    def build(cls, languages: list[str], common: str, keys: np.ndarray, places: np.ndarray) -> LanguageFilters:
        slots = np.zeros((1 << SLOT_BITS, (len(languages) + 63) // 64), np.uint64)
        for probe in _slots(keys):
            np.bitwise_or.at(slots, (probe.astype(np.int64), places // 64), np.uint64(1) << (places % 64).astype(np.uint64))
        fill = np.array([((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        return cls(languages, common, slots, fill ** PROBES)

    def counts(self, keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Trigrams of each text that each language has, corrected for false positives."""
        probes = _slots(keys)
        masks = self.slots[probes[0]]
        for probe in probes[1:]:
            masks &= self.slots[probe]
        sizes = np.diff(bounds)
        full = np.flatnonzero(sizes)
        out = np.zeros((len(sizes), len(self.languages)))
        for i, rate in enumerate(self.false_rate):
            bits = ((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64)
            if len(full):
                seen = np.add.reduceat(bits, bounds[:-1][full])
                out[full, i] = (seen - sizes[full] * rate) / (1 - rate) if rate < 1 else 0
        return np.maximum(out, 0)

    def decide(self, texts: pa.BinaryArray) -> tuple[list[str], np.ndarray]:
        keys, bounds = trigrams(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        counts = self.counts(keys, bounds)
        best, total = counts.argmax(axis=1), counts.sum(axis=1)
        score = np.divide(counts.max(axis=1), total, out=np.zeros(len(texts)), where=total > 0)
        letters = np.diff(bounds) > 0
        named = [self.languages[b] if s > 0 else self.common for b, s in zip(best.tolist(), score.tolist())]
        return [name if has else UNKNOWN for name, has in zip(named, letters.tolist())], np.where(letters, score, 0.0)


def is_held_out(id_col: Column) -> Column:
    """A fifth of the documents by their id; a row without id is never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _count_grams(place: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                keys, bounds = trigrams(part.column(1).cast(pa.large_binary()).fill_null(b""))
                owners = np.repeat(np.array([place[x] for x in part.column(0).to_pylist()]), np.diff(bounds))
                for owner in np.unique(owners):
                    found, times = np.unique(keys[owners == owner], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), owner, np.int32)), pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))],
                        names=["place", "gram", "n"])

    return run


def learn_languages(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
                    max_docs: int = MAX_DOCS, max_grams: int = MAX_GRAMS, share: float = 0.25) -> LanguageFilters:
    """Filters from the labelled documents outside the held-out fifth.

    Of each language at most ``max_docs`` documents count, those with the lowest
    hash of their id in each of ``SALTS`` parts, with their whole texts. A trigram belongs to a language if
    it is at least ``share`` as frequent there as in the language that has it
    most, and among the language's ``max_grams`` most frequent ones. What reaches
    the driver is bounded by the number of languages times ``max_grams``.
    """
    ship(docs.sparkSession)
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~is_held_out(F.col(id_col))).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(id_col)).alias("h"))
    # Ranked in salted parts, so that a language that most documents are in is no task of its own.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int"))
    low = rows.select("lang", "salt", "h").withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h")))
    cuts = low.filter(F.col("r") <= max(1, max_docs // SALTS)).groupBy("lang", "salt").agg(F.max("h").alias("cut"), F.count(F.lit(1)).alias("n"))
    cuts = stored(cuts, "language-cuts")  # SALTS rows a language
    found = cuts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()
    languages = [r["lang"] for r in found]
    if not languages:
        return LanguageFilters([], UNKNOWN, np.zeros((1 << SLOT_BITS, 0), np.uint64), np.zeros(0))
    chosen = rows.join(F.broadcast(cuts.drop("n")), ["lang", "salt"]).filter(F.col("h") <= F.col("cut"))
    counts = (
        chosen.select("lang", "text")
        .mapInArrow(_count_grams({name: i for i, name in enumerate(languages)}), "place int, gram long, n long")
        .groupBy("place", "gram").agg(F.sum("n").alias("n"))
    )
    totals = Window.partitionBy("place")
    rates = counts.withColumn("rate", F.col("n") / F.sum("n").over(totals))
    typical = (
        rates.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).filter(F.col("rate") >= share * F.col("most"))
        .withColumn("r", F.row_number().over(Window.partitionBy("place").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= max_grams)
    )
    table = typical.select("place", "gram").toPandas()
    common = max(found, key=lambda r: (r["n"], r["lang"]))["lang"]
    return LanguageFilters.build(languages, common, table["gram"].to_numpy(np.int64).view(np.uint64), table["place"].to_numpy(np.int64))


def identify_language(docs: DataFrame, filters: LanguageFilters, text: str = "text", carry: list[str] | None = None,
                      names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``carry`` (all columns by default) with ``lang_pred`` and ``score``, or columns of other ``names``.

    ``score`` is the decided language's part of all corrected counts. A text that
    is NULL or has no letters is ``und`` with score 0; one whose trigrams are
    unknown to all languages gets the most common language with score 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def work(texts):
        named, score = sent.value.decide(texts)
        return [pa.array(named, pa.string()), pa.array(score)]

    result = T.StructType([T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return map_texts(docs, text, docs.columns if carry is None else carry, result, work)


def predicted_languages(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Learn from ``docs`` and predict all of it: ``doc_id, held_out, lang_pred, score``, one row per document.

    NULL labels are not learned from, a NULL id counts as held out, repeated rows
    each get a row, an empty table gives an empty one.
    """
    filters = learn_languages(docs, text, lang, id_col)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    return identify_language(narrow, filters, "t", ["id"]).select(
        F.col("id").alias("doc_id"), is_held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without texts that have no letters or no trigram of any learned language."""
    filters = learn_languages(docs, text, lang, id_col)
    marked = identify_language(docs, filters, text, names=("__lang", "__score"))
    return marked.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") > 0)).select(*docs.columns)
