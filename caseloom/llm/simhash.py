"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint is cut into five pieces. Two fingerprints that differ in at most
three bits agree in at least two whole pieces, so each is filed under its ten
pairs of pieces and only fingerprints filed together are compared. Equal
fingerprints are one node from the start. A file that is too long is dealt out
to pairs of chunks, each a group of its own.

Within a group the bits stand in vertical planes, 64 fingerprints to a machine
word. For a shift s, the planes are compared with themselves s places on; a
carry-save counter per lane counts the differing bits, and words in which every
lane has passed the radius are abandoned. Groups that are connected already
take no part in further shifts, and only links that connect something new go
on, so that a dense group of m nodes gives m - 1 links, not m * m.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from caseloom.llm.components import connected_components
from caseloom.llm.tables import ROW, map_texts, stored_with_row
from caseloom.plans.store import stored

PIECES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
RADIUS = 3
CHUNK = 2048
SEED = 42


#: Byte -> its bits, one to a byte.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes with every bit depending on all of ``x``."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bits set in over half the hashes of each run of ``sizes`` hashes, none of them empty.

    Bits are counted 8 to a machine word, in stretches that a byte can count.
    """
    stretches = (sizes + 254) // 255
    first = np.cumsum(stretches) - stretches
    starts = np.repeat(np.cumsum(sizes) - sizes, stretches) + 255 * (np.arange(stretches.sum()) - np.repeat(first, stretches))
    sums = np.add.reduceat(_SPREAD[hashes.view(np.uint8)].reshape(-1, 8), starts, axis=0)
    ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64).astype(np.int32), first, axis=0)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of every shingle of ``shingle`` words; 0 for a text without words."""
    words = text.lower().split()  # bytes: A-Z only, split at 0x20 and 0x09-0x0D
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    total = len(starts)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        part = [digest(line[a:b], SEED) for a, b in zip(starts[at:at + (1 << 16)], ends[at:at + (1 << 16)])]
        octets = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", carry: list[str] | None = None, shingle: int = 3) -> DataFrame:
    """``carry`` (all columns by default) and ``__fp``, the fingerprint as a signed long."""

    def work(texts):
        made = np.fromiter((fingerprint(t, shingle) for t in texts.to_pylist()), np.uint64, len(texts))
        return [pa.array(made.view(np.int64))]

    carry = docs.columns if carry is None else carry
    return map_texts(docs, text, carry, T.StructType([T.StructField("__fp", T.LongType())]), work)


# --- bit-sliced comparison ------------------------------------------------------------------------------------------

def bit_planes(prints: np.ndarray) -> np.ndarray:
    """64 rows of machine words: bit i of row b is bit b of fingerprint i. One empty word stands at the end."""
    n = len(prints)
    bits = np.unpackbits(prints.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    out = np.zeros((64, (n + 63) // 64 + 1), np.uint64)
    out.view(np.uint8)[:, :packed.shape[1]] = packed
    return out


def lanes_within(planes: np.ndarray, shift: int, open_lanes: np.ndarray, radius: int) -> np.ndarray:
    """Lanes i, among the open ones, whose fingerprints i and i + shift differ in at most ``radius`` bits."""
    n = len(open_lanes)
    lanes = np.zeros(planes.shape[1] * 64, bool)
    lanes[:n] = open_lanes
    over = ~np.packbits(lanes, bitorder="little").view(np.uint64)
    active = np.flatnonzero(over != np.uint64(0xFFFFFFFFFFFFFFFF))
    over = over[active]
    whole, part = divmod(shift, 64)
    last = planes.shape[1] - 1
    low, high = np.minimum(active + whole, last), np.minimum(active + whole + 1, last)
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius  # so that the counter runs over at radius + 1
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    counter = [np.full(len(active), full if start >> k & 1 else 0, np.uint64) for k in range(width)]
    for b in range(64):
        if not len(active):
            break
        plane = planes[b]
        moved = plane[low] >> np.uint64(part)
        if part:
            moved |= plane[high] << np.uint64(64 - part)
        carry = plane[active] ^ moved
        for k in range(width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if b % 8 == 7:  # abandon words with no lane left
            left = over != full
            if not left.all():
                active, low, high, over = active[left], low[left], high[left], over[left]
                counter = [c[left] for c in counter]
    found = np.zeros(planes.shape[1], np.uint64)
    found[active] = ~over
    return np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")[:n])


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def connecting_links(groups: np.ndarray, prints: np.ndarray, radius: int = RADIUS,
                     agreed: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of links within ``radius`` inside equal ``groups`` (sorted), enough to connect all that are linked.

    A pair counts as a link if ``agreed``, when given, says so as well; it is asked
    for every pair within the radius that is not connected yet.
    """
    n = len(prints)
    parent = np.arange(n)
    rows = np.arange(n)  # rows that still take part
    out: list[tuple[int, int]] = []
    shift, narrowed = 1, 0
    while True:
        if shift >= 2 * narrowed or narrowed == 0:
            label = parent
            while True:  # every row names its root
                up = label[label]
                if (up == label).all():
                    break
                label = up
            parent = label.copy()
            heads = np.flatnonzero(np.concatenate(([True], groups[rows][1:] != groups[rows][:-1]))) if len(rows) else np.zeros(0, int)
            sizes = np.diff(np.append(heads, len(rows)))
            names = label[rows]
            joined = (np.minimum.reduceat(names, heads) == np.maximum.reduceat(names, heads)) if len(rows) else np.zeros(0, bool)
            rows = rows[np.repeat((sizes > shift) & ~joined, sizes)]
            if not len(rows):
                break
            planes, kinds, narrowed = bit_planes(prints[rows]), groups[rows], shift
        if shift >= len(rows):
            break
        open_lanes = np.zeros(len(rows), bool)
        open_lanes[:-shift] = kinds[:-shift] == kinds[shift:]
        if not open_lanes.any():
            break
        hit = lanes_within(planes, shift, open_lanes, radius)
        left, right = rows[hit], rows[hit + shift]
        new = parent[left] != parent[right]
        for i, j in zip(left[new].tolist(), right[new].tolist()):
            a, b = _root(parent, i), _root(parent, j)
            if a != b and (agreed is None or agreed(i, j)):
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
        shift += 1
    made = np.array(out, np.int64).reshape(-1, 2)
    return made[:, 0], made[:, 1]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(table: np.ndarray) -> pa.RecordBatch:
            groups = np.cumsum(np.concatenate(([0], np.any(table[:-1, :3] != table[1:, :3], axis=1)))) if len(table) else table[:, 0]
            prints = np.ascontiguousarray(table[:, 3]).view(np.uint64)
            i, j = connecting_links(groups, prints, radius)
            return pa.RecordBatch.from_arrays([pa.array(table[i, 3]), pa.array(table[j, 3])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            held.append(table)
            if np.array_equal(held[0][0, :3], table[-1, :3]):
                continue  # one group so far, at most two chunks long
            table = np.concatenate(held)
            cut = len(table) - int(np.argmin(np.all(table[::-1, :3] == table[-1, :3], axis=1)))
            held = [table[cut:]]
            yield links(table[:cut])
        if held:
            yield links(np.concatenate(held))

    return run


def filed(prints: DataFrame, chunk: int = CHUNK, more: Sequence[str] = ()) -> DataFrame:
    """``(key, lo, hi, fp, more)``: distinct rows under their fingerprint's pairs of pieces, files of one left out.

    Files of more than ``chunk`` go out as all pairs of their chunks, so that no
    group exceeds about twice the chunk and no pair of fingerprints is missed.
    """
    pairs = [(i, j) for i in range(len(PIECES)) for j in range(i + 1, len(PIECES))]

    def piece(i):
        at, bits = PIECES[i]
        return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1))

    keys = [F.lit(n << 26).bitwiseOR(F.shiftleft(piece(i), 13).bitwiseOR(piece(j))) for n, (i, j) in enumerate(pairs)]
    return dealt_files(prints.select("fp", *more, F.explode(F.array(*keys)).alias("key")), chunk, more)


def dealt_files(rows: DataFrame, chunk: int = CHUNK, more: Sequence[str] = ()) -> DataFrame:
    """``(key, lo, hi, fp, more)`` of ``rows(key, fp, more)``: files of one left out, long ones as all pairs of their chunks."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = (
        rows.join(sizes, "key")
        .withColumn("chunks", F.expr(f"cast(ceil(n / {chunk}) as int)"))
        .withColumn("own", F.expr(f"cast(pmod(xxhash64({', '.join(['fp', *more])}), chunks) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    )
    return dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", *more)


def similar_fingerprints(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` between the distinct ``fp`` that connect all within ``radius`` (at most 3) bits."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"five pieces guarantee a radius of at most {RADIUS}")
    groups = filed(prints, chunk).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")
    return groups.mapInArrow(_compare(radius), "a long, b long")


def simhash_groups(prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``(fp, root, component_id)`` of every distinct ``__fp`` of a stored table.

    ``component_id`` is the smallest id of all rows in the component, NULL if
    they have none. Rows with equal fingerprints are in one component.
    """
    nodes = stored(prints.groupBy(F.col("__fp").alias("fp")).agg(F.min(id_col).alias("first_id")), "fingerprints")
    roots = connected_components(similar_fingerprints(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def simhash_near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS,
                            shingle: int = 3) -> DataFrame:
    """One row per document: ``id_col``, ``fingerprint`` (16 hex digits) and ``component_id``.

    NULL and empty texts have fingerprint zero and are linked like any other.
    Repeated rows each keep their row. An empty table gives an empty one. Other
    columns of ``docs``, whatever their names, play no part.
    """
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__t"))
    prints = stored(with_fingerprint(narrow, "__t", ["__id"], shingle), "prints")
    groups = simhash_groups(prints, "__id", radius)
    joined = prints.join(groups, prints["__fp"] == groups["fp"])
    return joined.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
                         "component_id")


def keep_one_per_group(docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS,
                       shingle: int = 3) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays, a NULL id last.

    Of several rows with that id one stays. All columns are kept.
    """
    prints = stored_with_row(with_fingerprint(docs, text, None, shingle), "prints")
    groups = simhash_groups(prints.select(id_col, "__fp"), id_col, radius).select("fp", "root")
    narrow = prints.select("__fp", F.col(id_col).alias("id"), ROW)
    first = (
        narrow.join(groups, narrow["__fp"] == groups["fp"])
        .groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", ROW)).alias("first"))
        .select(F.col(f"first.{ROW}").alias(ROW))
    )
    return prints.join(first, ROW, "left_semi").select(*docs.columns)
