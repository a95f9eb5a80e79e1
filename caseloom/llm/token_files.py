"""Token ids in files: frequency ranks in byte-aligned variable-length code.

Ids are replaced by their rank in the corpus, so that frequent ids are small. A
rank takes one to four bytes; its length stands in two bits of a control byte
for four ranks, and control and data bytes are kept apart. Decoding looks a
control byte up in two tables: how many data bytes its ranks have, and where
these go in sixteen bytes of output; it is numpy all through.

A file is a Parquet file of segments, so that it can lie wherever Spark can
write and a failed task leaves nothing behind. A segment holds whole documents
in order: ``part, segment`` (their order is the order of ids in the corpus),
``ids`` and ``lengths`` of its documents, ``control`` and ``data``. The rank table
is written next to the segments.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from caseloom.llm.tables import map_texts, ship
from caseloom.plans.store import fresh_path, stored

END = 0
SEGMENT = 1 << 20      # ids after which a segment ends
CACHE = 1_000_000      # units whose ids a worker remembers at a time
SLICE = 8 << 20        # bytes of text that are encoded at a time

# What a byte of UTF-8 tells about the places next to it, in bits.
_BLANK, _LINE, _LETTER, _LEAD, _MARK, _TEXT_BEGINS, _TEXT_ENDS = (1 << i for i in range(7))


def _kinds() -> np.ndarray:
    """Of every byte. One that a character of white space may begin or end with does not count as text there.

    All characters of two bytes that begin with a ``_LEAD`` are letters, but for two that end in 0x97 and 0xB7.
    """
    kinds = np.zeros(256, np.uint8)
    for bit, octets in ((_BLANK, b" "), (_LINE, b"\n"), (_LETTER, string.ascii_letters.encode()),
                        (_LEAD, b"\xc3\xc4\xc5\xd0\xd1"), (_MARK, string.punctuation.replace("'", "").encode())):
        kinds[list(octets)] |= bit
    kinds[0x21:] |= _TEXT_BEGINS | _TEXT_ENDS
    kinds[[0xC2, 0xE1, 0xE2, 0xE3]] &= 255 - _TEXT_BEGINS
    kinds[[*range(0x80, 0x90), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] &= 255 - _TEXT_ENDS
    return kinds


_KINDS = _kinds()
_ENCODERS: dict[int, UnitEncoder] = {}


# --- encoding -------------------------------------------------------------------------------------------------------

class UnitEncoder:
    """Ids of whole texts by a byte-level tokenizer, unit by unit.

    Its pre-tokenizer always begins a piece at a blank that something other than
    white space follows, around a single line feed, and where letters end and
    punctuation begins; merges never go over pieces. So a text's ids are those of its
    units one after the other, and units, mostly words, come again and again: the
    texts of a slice are cut in numpy, and only its distinct units are looked up.

    With ``added``, as the library has it by default, the strings of added tokens in a
    text are these tokens, and a text that has one is encoded whole. Without it, those
    of special tokens are ordinary text.
    """

    def __init__(self, definition: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = not added
        kinds = self.tokenizer.get_added_tokens_decoder().values() if added else []
        self.added = [t.content.encode() for t in kinds if t.content]
        #: Such tokens are looked for in the normalised text, which need not have the same characters.
        self.whole = self.tokenizer.normalizer is not None and any(t.normalized for t in kinds)
        self.known = self.ids = pa.array([], pa.large_binary())  # units and their ids; Arrow holds many in little memory

    @staticmethod
    def units(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """Units of all texts, one text after the other, and before how many of them each text begins and the last one ends."""
        joined = b"".join(texts)
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        data = np.frombuffer(joined, np.uint8)
        kinds = _KINDS[data]
        cut = np.zeros(len(kinds) + 1, bool)
        if len(kinds):
            after = np.append(kinds[1:], 0) & _TEXT_BEGINS != 0
            after[bounds[bounds > 0] - 1] = False
            cut[:-1] = (kinds & _BLANK != 0) & after
            line = np.flatnonzero(kinds & _LINE)
            line = line[kinds[line - 1] & _TEXT_ENDS != 0]
            cut[line] = True
            cut[line[after[line]] + 1] = True
            kinds[bounds[bounds > 0] - 1] &= 255 - _LEAD
            mark = np.flatnonzero(kinds[2:] & _MARK) + 2
            last = data[mark - 1]
            letter = (kinds[mark - 2] & _LEAD != 0) & (last >= 0x80) & (last <= 0xBF) & (last != 0x97) & (last != 0xB7)
            cut[mark[letter | (kinds[mark - 1] & _LETTER != 0)]] = True
        cut[bounds] = True
        offsets = np.flatnonzero(cut)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(joined)])
        return units, np.searchsorted(offsets, bounds)

    def ids_of(self, units: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """Ids of distinct units."""
        if len(self.known) > CACHE:
            self.known = self.ids = self.known[:0]
        place = pc.index_in(units, value_set=self.known)
        if not place.null_count:
            return self.ids.take(place)
        fresh = units.filter(place.is_null())
        made: list[list[int]] = []
        for at in range(0, len(fresh), 4096):  # what the library returns takes far more memory than the ids
            part = [u.decode("utf-8", "replace") for u in fresh[at:at + 4096].to_pylist()]
            made += [one.ids for one in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))))
        flat = np.fromiter(chain.from_iterable(made), "<u4", ends[-1])
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(made), [None, pa.py_buffer(4 * ends), pa.py_buffer(flat)])
        at = place.fill_null(0).to_numpy().astype(np.int64)
        new = place.is_null().to_numpy(zero_copy_only=False)
        at[new] = len(self.known) + np.arange(len(fresh))
        self.known, self.ids = pa.concat_arrays([self.known, fresh]), pa.concat_arrays([self.ids, ids])
        return self.ids.take(pa.array(at))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        odd = [i for i, t in enumerate(texts) if self.whole or any(a in t for a in self.added)]
        if odd:
            plain = list(texts)
            for i in odd:
                plain[i] = b""
            out = self._by_units(plain)
            for i in odd:
                ids = self.tokenizer.encode(texts[i].decode("utf-8", "replace"), add_special_tokens=False).ids
                out[i] = np.array(ids, "<u4").tobytes()
            return out
        return self._by_units(texts)

    def _by_units(self, texts: list[bytes]) -> list[bytes]:
        units, bounds = self.units(texts)
        coded = units.dictionary_encode()
        made = self.ids_of(coded.dictionary).take(coded.indices)
        ends = np.frombuffer(made.buffers()[1], np.int64)[made.offset + bounds].tolist()
        octets = memoryview(made.buffers()[2] or b"")
        return [bytes(octets[a:b]) for a, b in zip(ends, ends[1:])]


def _encoder(definition: str) -> UnitEncoder:
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = UnitEncoder(definition, added=True)
    return _ENCODERS[key]


def encoded(docs: DataFrame, tokenizer_file: str, text: str, carry: list[str], end: int = END) -> DataFrame:
    """``carry``, ``n_tokens`` and ``packed``: the ids of each text and the end id, 16 or 32 bits each, compressed."""
    with open(tokenizer_file, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def work(texts):
        pack = zstandard.ZstdCompressor(level=1).compress
        last = np.array([end], "<u4").tobytes()
        n, packed = [], []
        for ids in _encoder(sent.value).encode(texts.to_pylist()):
            ids = np.frombuffer(ids + last, "<u4")
            n.append(len(ids))
            packed.append(pack(_narrow(ids)))
        return [pa.array(n, pa.int64()), pa.array(packed, pa.binary())]

    return map_texts(docs, text, carry, T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("packed", T.BinaryType())]), work, SLICE)


def _narrow(ids: np.ndarray) -> bytes:
    return b"\2" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def _ids(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1)


# --- the code -------------------------------------------------------------------------------------------------------

_SHIFTS = np.arange(4) * 2
_CLASSES = (np.arange(256)[:, None] >> _SHIFTS) & 3                       # of the four ranks of a control byte
DATA_BYTES = (_CLASSES + 1).sum(axis=1)                                   # control byte -> its number of data bytes
FILLED = (np.arange(4) <= _CLASSES[:, :, None]).reshape(256, 16)          # control byte -> output bytes that they fill


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes. The last control byte is filled up with ranks of 0."""
    full = np.zeros((len(ranks) + 3) // 4 * 4, "<u4")
    full[:len(ranks)] = ranks
    classes = ((full >> 8 > 0).astype(np.uint8) + (full >> 16 > 0) + (full >> 24 > 0)).reshape(-1, 4)
    control = (classes << _SHIFTS).sum(axis=1).astype(np.uint8)
    return control.tobytes(), full.view(np.uint8)[FILLED[control].reshape(-1)].tobytes()


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    keys = np.frombuffer(control, np.uint8)
    if DATA_BYTES[keys].sum() != len(data) or len(keys) != (count + 3) // 4:
        raise ValueError("damaged segment: its control and data bytes do not go together")
    out = np.zeros(len(keys) * 16, np.uint8)
    out[FILLED[keys].reshape(-1)] = np.frombuffer(data, np.uint8)
    return out.view("<u4")[:count]


# --- files ----------------------------------------------------------------------------------------------------------

def id_ranks(tokens: DataFrame) -> np.ndarray:
    """Ids by falling frequency, ties by id. As many as the vocabulary has reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                found = np.bincount(_ids(packed))
                if len(found) > len(total):
                    total = np.concatenate((total, np.zeros(len(found) - len(total), np.int64)))
                total[:len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    ship(tokens.sparkSession)
    counts = tokens.select("packed").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)


SEGMENTS = "part int, segment int, ids array<bigint>, lengths array<bigint>, control binary, data binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, text: str = "text", id_col: str = "doc_id",
                      segment: int = SEGMENT, end: int = END) -> None:
    """Write the ids of all texts, in ascending order of document id (NULL first), to ``path``."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("t"))
    tokens = stored(encoded(narrow, tokenizer_file, "t", ["id", "mark"], end).drop("n_tokens"), "tokens")
    by_rank = id_ranks(tokens)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, "<u4")
    rank[by_rank] = np.arange(len(by_rank))
    sent = spark.sparkContext.broadcast(rank)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, found, size = [], [], 0

        def row():
            control, data = encode_ranks(sent.value[np.concatenate(found)])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([[len(x) for x in found]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=["part", "segment", "ids", "lengths", "control", "data"])

        for batch in batches:
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = _ids(packed)
                if found and size + len(tokens) > segment:
                    yield row()
                    ids, found, size, number = [], [], 0, number + 1
                ids.append(doc)
                found.append(tokens)
                size += len(tokens)
        if found:
            yield row()

    in_order = tokens.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark").select("id", "packed")
    in_order.mapInArrow(segments, SEGMENTS).write.option("compression", "zstd").parquet(f"{path}/segments")


def read_token_files(spark, path: str, result: str, work) -> DataFrame:
    """``part, segment`` and what ``work`` makes of each segment: of its document ids, lengths and decoded token ids."""
    ship(spark)
    by_rank = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy("<u4")
    sent = spark.sparkContext.broadcast(by_rank)
    schema = T._parse_datatype_string(f"part int, segment int, {result}")
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, segment, ids, lengths, control, data = (c[i].as_py() for c in batch.columns)
                tokens = sent.value[decode_ranks(control, data, sum(lengths))]
                made = work(ids, lengths, tokens)
                n = len(made[0])
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([segment] * n, pa.int32()), *made], names=names)

    return spark.read.schema(SEGMENTS).parquet(f"{path}/segments").mapInArrow(run, schema)


def segment_starts(spark, path: str) -> DataFrame:
    """``(part, segment, start)``: ids before each segment. Parts are added up first, then the segments of each."""
    sizes = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").select(
        "part", "segment", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n"))
    before = F.sum("n")
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(before.over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p"))
    inner = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("s", F.coalesce(before.over(inner), F.lit(0))).join(parts, "part").select("part", "segment", (F.col("p") + F.col("s")).alias("start"))


def token_documents(spark, path: str) -> DataFrame:
    """Of each document in the files: ``doc_id, start, n_tokens, ids_crc32``."""

    def work(ids, lengths, tokens):
        octets = memoryview(tokens.astype("<u4").tobytes())
        ends = np.cumsum(lengths) if lengths else np.zeros(0, np.int64)
        starts = ends - np.array(lengths, np.int64)
        crcs = [zlib.crc32(octets[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
        return [pa.array(ids, pa.int64()), pa.array(starts.astype(np.int64)), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]

    rows = read_token_files(spark, path, "doc_id long, inner long, n_tokens long, ids_crc32 long", work)
    return rows.join(segment_starts(spark, path), ["part", "segment"]).select(
        "doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_file: str, text: str = "text", id_col: str = "doc_id", segment: int = SEGMENT) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and tell, from the files, ``doc_id, start, n_tokens, ids_crc32``.

    Ids are those of ``Tokenizer.from_file(tokenizer_file).encode(text, add_special_tokens=False)``,
    so that the string of an added token in a text is that token. A NULL or empty
    text has the end id alone. NULL ids come first, equal ids in
    an order that their texts decide; each row is a document. An empty table gives
    files without segments and no rows.
    """
    path = fresh_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_file, text, id_col, segment)
    return token_documents(docs.sparkSession, path)
