"""Conversations brought into a legal order of roles by the cheapest edits, in one sorted stream.

The turns are dealt out by conversation and sorted by turn; ``mapInPandas`` goes
through them and carries the costs of an automaton from turn to turn and from batch
to batch. What it keeps of a turn is one small number: from where, and by which
edit, each state was reached at least cost. A conversation that ends within a block
is traced back at once. A giant one leaves its blocks behind as rows, with those
numbers, in the shared folder; they are traced back by a second stream, last block
first. No step holds more than a block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm.tables import ship
from caseloom.plans.store import stored

BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 22

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3      # costs; to keep a turn costs nothing
START, SYSTEM, USER, ASSISTANT = range(4)
ENDING = {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}    # empty turns to a legal end
NAMES = {"u": "user", "a": "assistant"}
_FAR = 1 << 40
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}    # whom an inserted or relabelled turn can be

_VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
_PAIRS = {"su", "ua", "au"}


# --- one conversation -----------------------------------------------------------------------------------------------

def fault(text: str, seen: bool) -> str:
    """b(lank), d(uplicate), t(runcated) or nothing."""
    if not _VISIBLE.search(text):
        return "b"
    if seen:
        return "d"
    # the last visible character, looked for from the end
    last = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1]
    return "" if last in ".!?" else "t"


def _ways(state: int, initial: str, kind: str) -> list[tuple[int, int, str]]:
    """``(cost, next state, edits)`` of all ways to take a turn in a state."""
    out = [(DELETE, state, "D")]
    if kind in ("b", "d"):
        return out
    extra = TRUNCATED if kind == "t" else 0
    for insert, at in (("", state), ("I", _AFTER[_NEXT[state]])):
        cost = extra + INSERT * len(insert)
        if initial == _NEXT[at] or (initial == "s" and at == START):
            out.append((cost, _AFTER[initial], insert + "K"))
        out.append((cost + REROLE, _AFTER[_NEXT[at]], insert + "R"))
    return out


EDITS = ("D", "IK", "IR", "K", "R")


@lru_cache(maxsize=20_000)
def step(costs: tuple[int, ...], ranks: tuple[int, ...], initial: str, kind: str):
    """One turn: ``(costs less the least, ranks, the least, the way back)``.

    ``ranks`` order the edits that led to the states as texts. As all of them end
    in an edit of the same turn, none is the beginning of another, so that longer
    texts are ordered by their beginnings' ranks. The way back has five bits a
    state: the state before and the number of the edit.
    A state from which another one is reached for less than its own cost can't lie
    on a cheapest path and is given up, which bounds the differences of the costs.
    """
    best: dict[int, tuple] = {}
    for state in range(4):
        if costs[state] < _FAR:
            for cost, after, edits in _ways(state, initial, kind):
                way = (costs[state] + cost, ranks[state], edits, state)
                if after not in best or way < best[after]:
                    best[after] = way
    total = [best[s][0] if s in best else _FAR for s in range(4)]
    limits = {START: total[ASSISTANT] + DELETE, SYSTEM: total[ASSISTANT], USER: total[ASSISTANT] + INSERT,
              ASSISTANT: total[USER] + INSERT}
    alive = [s for s in sorted(best) if total[s] <= limits[s]]
    least = min(total[s] for s in alive)
    order = sorted(alive, key=lambda s: best[s][1:3])
    back = 0
    for s in alive:
        back |= (best[s][3] | EDITS.index(best[s][2]) << 2) << 5 * s
    return (tuple(total[s] - least if s in alive else _FAR for s in range(4)),
            tuple(order.index(s) if s in alive else 9 for s in range(4)), least, back)


def ending(costs: tuple[int, ...], ranks: tuple[int, ...]) -> tuple[int, int]:
    """``(cost beside the least, state)`` of the cheapest end."""
    cost, _, state = min((costs[s] + INSERT * len(ENDING[s]), ranks[s], s) for s in range(4) if costs[s] < _FAR)
    return cost, state


def traced(back: list[int], state: int) -> tuple[list[str], list[int]]:
    """The edits of a block's turns, and the states before them, from the state behind the last one."""
    edits, states = [], []
    for b in reversed(back):
        b = b >> 5 * state & 31
        state = b & 3
        edits.append(EDITS[b >> 2])
        states.append(state)
    return edits[::-1], states[::-1]


def acts(edits: list[str], states: list[int]) -> list[dict]:
    """What to do at each turn: ``ins`` is the role of an empty turn put before it, ``role`` its new one."""
    out = []
    for edit, state in zip(edits, states):
        ins = None
        if len(edit) == 2:
            ins, state = NAMES[_NEXT[state]], _AFTER[_NEXT[state]]
        out.append({"ins": ins, "edit": edit[-1], "role": NAMES[_NEXT[state]] if edit[-1] == "R" else None})
    return out


def _solved(back: list[int], state: int, ended: bool) -> tuple[list[dict], list[str], str, int]:
    """``(acts, roles of the empty turns at the end, audit, state before)`` of a block."""
    edits, states = traced(back, state)
    tail = [NAMES[c] for c in ENDING[state]] if ended else []
    return acts(edits, states), tail, "".join(edits) + "I" * len(tail), states[0]


# --- over tables ----------------------------------------------------------------------------------------------------

_ACTS = "acts array<struct<ins: string, edit: string, role: string>>, tail array<string>, audit string"
_BLOCKS = ("key string, block bigint, ended boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, "
           "low string, high string, cost bigint, goal int, back array<int>, "
           f"rows array<struct<turn: string, role: string, text: string>>, {_ACTS}")


class _Walk:
    """The state of the stream: what is known of the conversation it is in, and of its open block."""

    def __init__(self, block_rows: int, block_chars: int):
        self.limits = block_rows, block_chars
        self.key = None

    def open(self, key: str) -> None:
        self.key, self.block = key, 0
        self.costs, self.ranks, self.cost = (0, _FAR, _FAR, _FAR), (0, 9, 9, 9), 0
        self.before = self.last_turn = None
        self.empty()

    def empty(self) -> None:
        self.rows, self.back, self.chars, self.low, self.high = [], [], 0, None, None
        self.counts = {"b": 0, "d": 0, "t": 0, "": 0}
        self.illegal = self.turns = 0

    def add(self, turn: str | None, role: str, text: str, later: bool) -> None:
        same = self.before == (turn, role, text)
        kind = fault(text, later or same)
        self.counts[kind] += 1
        if self.before is not None:
            self.illegal += self.before[1][:1] + role[:1] not in _PAIRS
        if turn is not None:
            if turn != self.last_turn:
                self.turns += 1
            self.low, self.high = self.low or turn, turn
            self.last_turn = turn
        self.before = (turn, role, text)
        self.costs, self.ranks, least, back = step(self.costs, self.ranks, role[:1] if role[:1] in "sua" else "", kind)
        self.cost += least
        self.back.append(back)
        self.rows.append({"turn": turn, "role": role, "text": text})
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.rows) >= self.limits[0] or self.chars >= self.limits[1]

    def close(self, ended: bool) -> tuple:
        """The open block as a row; of a conversation that ends in its first one, with the way back already taken."""
        cost, goal = ending(self.costs, self.ranks) if ended else (0, None)
        alone = ended and self.block == 0
        made = _solved(self.back, goal, True)[:3] if alone else (None, None, None)
        row = (self.key, self.block, ended, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, self.turns, self.low,
               self.high, self.cost + cost if ended else None, goal, None if alone else self.back, self.rows, *made)
        self.block += 1
        self.empty()
        return row


_BLOCK_NAMES = re.findall(r"(\w+) (?:string|bigint|boolean|int|array<)", re.sub(r"struct<[^>]*>", "x", _BLOCKS))


def _forward(block_rows: int, block_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = _Walk(block_rows, block_chars)
        for batch in batches:
            out = []
            columns = [batch[c].tolist() for c in ("key", "turn", "role", "text", "later")]
            for key, turn, role, text, later in zip(*columns):
                if key != walk.key:
                    if walk.key is not None:
                        out.append(walk.close(True))
                    walk.open(key)
                elif walk.full():       # a full block waits for the next turn, so that the last block is never empty
                    out.append(walk.close(False))
                walk.add(turn if isinstance(turn, str) else None, role, text, later)
            yield pd.DataFrame(out, columns=_BLOCK_NAMES, dtype=object)
        if walk.key is not None:
            yield pd.DataFrame([walk.close(True)], columns=_BLOCK_NAMES, dtype=object)

    return run


def _backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state = None
    for batch in batches:
        out = []
        for key, block, ended, goal, back in zip(*[batch[c].tolist() for c in ("key", "block", "ended", "goal", "back")]):
            made = _solved([int(b) for b in back], int(goal) if ended else state, ended)
            state = made[3]
            out.append((key, block, *made[:3]))
        yield pd.DataFrame(out, columns=["key", "block", "acts", "tail", "audit"], dtype=object)


def key_of(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def solved_blocks(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of consecutive turns with what to do at each: ``key, block, ended``, counts, ``cost, rows, acts, tail, audit``.

    A turn is a duplicate if its role and text come earlier in the conversation.
    Which texts come at more than one turn is counted before the stream, by digest,
    so that the stream needs to know the row before only.
    """
    ship(turns.sparkSession)
    every = turns.select(
        key_of(F.col(conv)).alias("key"), F.col(turn).alias("at"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text")).withColumn(
        "place", F.struct(F.col("at").isNotNull().alias("given"), "at")).withColumn(
        "digest", F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)))
    firsts = stored(every.groupBy("key", "digest").agg(F.min("place").alias("first"), F.max("place").alias("last"))
                    .where("first < last").select("key", "digest", "first"), "repeated_turns")
    marked = every.join(firsts, ["key", "digest"], "left").select(
        "key", "at", F.col("at").cast("string").alias("turn"), "role", "text",
        F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("later"))
    dealt = marked.repartition("key").sortWithinPartitions("key", "at", "role", "text").drop("at")
    blocks = stored(dealt.mapInPandas(_forward(block_rows, block_chars), _BLOCKS), "turn_blocks")
    giants = blocks.where("audit is null")
    back = giants.select("key", "block", "ended", "goal", "back").repartition("key").sortWithinPartitions("key", F.desc("block"))
    traced_back = stored(back.mapInPandas(_backward, f"key string, block bigint, {_ACTS}"), "traced_blocks")
    names = [c for c in blocks.columns if c not in ("goal", "back", "acts", "tail", "audit")]
    return blocks.where("audit is not null").select(*names, "acts", "tail", "audit").unionByName(
        giants.select(*names).join(traced_back, ["key", "block"]))


_REPAIRED = """
    flatten(transform(arrays_zip(rows, acts), z -> filter(array(
        if(z.acts.ins is null, null, named_struct('edit', 'I', 'turn', cast(null as string), 'role', z.acts.ins, 'text', '')),
        if(z.acts.edit = 'D', null, named_struct('edit', z.acts.edit, 'turn', z.rows.turn, 'role', coalesce(z.acts.role, z.rows.role), 'text', z.rows.text))),
      x -> x is not null)))
    || transform(tail, r -> named_struct('edit', 'I', 'turn', cast(null as string), 'role', r, 'text', ''))"""


def repaired_turns(blocks: DataFrame) -> DataFrame:
    """``key, block, piece, edit, turn, role, text``: the repaired conversations turn by turn, in the order of (block, piece).

    From :func:`solved_blocks`. An inserted turn (edit I) has an empty text and no
    turn number; of the others the edit is K (kept) or R (relabelled).
    """
    return blocks.select("key", "block", F.posexplode(F.expr(_REPAIRED)).alias("piece", "r")).select("key", "block", "piece", "r.*")


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, sha, begun = None, None, False
    for batch in batches:
        out = []
        for k, piece in zip(batch["key"].tolist(), batch["piece"].tolist()):
            if k != key:
                if key is not None:
                    out.append((key, sha.hexdigest()))
                key, sha, begun = k, hashlib.sha256(), False
            if isinstance(piece, str):      # a block of which nothing stays adds no line
                sha.update((("\n" if begun else "") + piece).encode())
                begun = True
        yield pd.DataFrame(out, columns=["key", "repaired_sha256"], dtype=object)
    if key is not None:
        yield pd.DataFrame([(key, sha.hexdigest())], columns=["key", "repaired_sha256"], dtype=object)


def conversation_audit(original: DataFrame, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                       text: str = "text", **limits) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every id of ``original``.

    ``turns`` are the rows to repair. They are taken by turn (NULL first), then role
    and text. The first fault of a row counts: blank, duplicate, truncated. Blank
    and duplicate rows are deleted. The edits are the cheapest that leave role
    initials ``(s?(ua)+)?``; of equals the least ``audit`` in ASCII. A role of
    another initial, or none, can't be kept.

    A NULL role or text is one space. Rows without id are a conversation of their
    own. A conversation without rows has zeros and an empty audit. Repeated rows
    are duplicates of each other. An empty table gives no rows. Other columns play no part.
    """
    blocks = stored(solved_blocks(turns, conv, turn, role, text, **limits), "solved_blocks")
    by_key = blocks.groupBy("key").agg(
        F.expr("coalesce(max(cast(high as bigint)) - min(cast(low as bigint)) + 1 - sum(turns), 0)").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.expr("array_join(transform(array_sort(collect_list(struct(block, audit))), x -> x.audit), '')").alias("audit"))
    piece = F.expr("nullif(array_join(transform(repaired, r -> concat(r.role, ':', r.text)), '\n'), '')")
    pieces = blocks.select("key", "block", "ended", F.expr(_REPAIRED).alias("repaired")).select("key", "block", "ended", piece.alias("piece"))
    alone = pieces.where("ended and block = 0").select("key", F.sha2(F.coalesce("piece", F.lit("")), 256).alias("repaired_sha256"))
    many = pieces.where("not (ended and block = 0)").repartition("key").sortWithinPartitions("key", "block")
    digests = alone.unionByName(many.mapInPandas(_hashed, "key string, repaired_sha256 string"))
    ids = original.groupBy(key_of(F.col(conv)).alias("key")).agg(F.first(conv).alias("conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return ids.join(by_key, "key", "left").join(digests, "key", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def damaged_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows damaged by a hash of conversation and turn: some dropped, emptied, without final marks, repeated or of role user.

    NULLs count as one space, in the hash too; ids and turn numbers stay as they are.
    """
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)}
    mark = F.crc32(F.concat(spaced[conv], F.lit(":"), spaced[turn]).cast("binary")) % 20
    marked = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), spaced[role].alias("role"), spaced[text].alias("text"), mark.alias("mark"))
    times = F.when(F.col("mark") == 0, 0).when(F.col("mark") == 3, 2).otherwise(1)
    return marked.select(
        "conv_id", "turn", F.when(F.col("mark") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")
