"""Chat logs repaired to a legal order of roles at the least cost, then rendered.

Legal is: at most one system turn, at the beginning, then user and assistant in
turns, the assistant last. Every turn of the log may be kept, merged into the turn
before, relabelled, or preceded by empty turns; a path through the automaton of
legal turns with the least total cost is found by dynamic programming.

A conversation may be of any length. It is cut into segments; a segment comes down
to the least costs from every state to every state, such tables are combined over
blocks of segments and then over a conversation, and the states chosen on top
are handed down again. No step holds more than a segment's turns or a block's
tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.llm.tables import ROW, ship, stored_with_row
from caseloom.plans.store import stored

MERGE, INSERT, RELABEL = 1, 2, 3
SEGMENT = 512       # turns
BLOCK = 4096        # segments

# Names under which logs know the three roles, and the marks of the rendered form.
ROLE_NAMES = {"system": "s", "developer": "s", "user": "u", "human": "u", "prompter": "u",
              "assistant": "a", "model": "a", "bot": "a", "gpt": "a", "ai": "a"}
ROLES = {"s": "system", "u": "user", "a": "assistant"}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LEGAL = {(START, "s"), (START, "u"), (SYSTEM, "u"), (USER, "a"), (ASSISTANT, "u")}
#: Empty turns that lead from a state to the end of a conversation.
_ENDING = {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}
_FAR = 1 << 40


def _steps(state: int, code: str) -> list[tuple[int, int, str, str, bool]]:
    """``(cost, next state, empty turns, role, merged)`` of all ways to take a turn, the preferred one of equals first."""
    out = []
    for role in sorted("sua", key=lambda r: (r != code, r)):
        changed = 0 if role == code else RELABEL
        if (state, role) in _LEGAL:
            out.append((changed, _AFTER[role], "", role, False))
        if state != START and _AFTER[role] == state:
            out.append((changed + MERGE, state, "", role, True))
        for empty in ("u", "a"):
            if (state, empty) in _LEGAL and (_AFTER[empty], role) in _LEGAL:
                out.append((changed + INSERT, _AFTER[role], empty, role, False))
    return out


_STEPS = {(state, code): _steps(state, code) for state in range(4) for code in "sua?"}


@lru_cache(maxsize=100_000)
def segment_costs(codes: str) -> tuple[int, ...]:
    """Least cost of ``codes`` from state i to state j, at 4 * i + j."""
    out: list[int] = []
    for first in range(4):
        costs = [_FAR] * 4
        costs[first] = 0
        for code in codes:
            after = [_FAR] * 4
            for state, cost in enumerate(costs):
                if cost < _FAR:
                    for step in _STEPS[state, code]:
                        after[step[1]] = min(after[step[1]], cost + step[0])
            costs = after
        out += costs
    return tuple(out)


def combined(tables: list) -> list[int]:
    """One table for a row of tables."""
    total = [0 if i == j else _FAR for i in range(4) for j in range(4)]
    for t in tables:
        total = [min(min(total[4 * i + k] + t[4 * k + j] for k in range(4)), _FAR) for i in range(4) for j in range(4)]
    return total


def states_between(tables: list, first: int, last: int | None) -> list[int]:
    """States before, between and after the tables on a least path from ``first`` to ``last``, or to the best end."""
    costs = [[0 if s == first else _FAR for s in range(4)]]
    for t in tables:
        costs.append([min(min(costs[-1][k] + t[4 * k + j] for k in range(4)), _FAR) for j in range(4)])
    if last is None:
        last = min(range(4), key=lambda s: costs[-1][s] + INSERT * len(_ENDING[s]))
    states = [last]
    for n in range(len(tables) - 1, -1, -1):
        states.append(min(range(4), key=lambda k: costs[n][k] + tables[n][4 * k + states[-1]]))
    return states[::-1]


@lru_cache(maxsize=100_000)
def repair(codes: str, first: int, last: int) -> tuple[tuple[str, str, bool], ...]:
    """``(empty turns before, role, merged)`` of every turn on a least path between two states."""
    costs = [[0 if s == first else _FAR for s in range(4)]]
    back: list[list] = []
    for code in codes:
        after, chosen = [_FAR] * 4, [None] * 4
        for state, cost in enumerate(costs[-1]):
            if cost < _FAR:
                for step in _STEPS[state, code]:
                    if cost + step[0] < after[step[1]]:
                        after[step[1]], chosen[step[1]] = cost + step[0], (state, step[2], step[3], step[4])
        costs.append(after)
        back.append(chosen)
    out, state = [], last
    for chosen in reversed(back):
        state, empty, role, merged = chosen[state]
        out.append((empty, role, merged))
    return tuple(reversed(out))


# --- over tables ----------------------------------------------------------------------------------------------------

def _rows(df: DataFrame, keep: list[str], result: str, work) -> DataFrame:
    """``keep`` and the columns that ``work`` makes of each row's remaining columns."""
    ship(df.sparkSession)
    given = [c for c in df.columns if c not in keep]
    schema = ", ".join([*[f"{c} {df.schema[c].dataType.simpleString()}" for c in keep], result])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024).to_pydict()
                rows = [work(*values) for values in zip(*[part[c] for c in given])]
                made = [pa.array(part[c], arrow.field(c).type) for c in keep]
                for i, field in enumerate(list(arrow)[len(keep):]):
                    made.append(pa.array([r[i] for r in rows], field.type))
                yield pa.RecordBatch.from_arrays(made, names=arrow.names)

    return df.select(*keep, *given).mapInArrow(run, schema)


def _code(role: Column) -> Column:
    names = F.lower(F.trim(role))
    out = F.when(names.isin([n for n, c in ROLE_NAMES.items() if c == "s"]), "s")
    for code in "ua":
        out = out.when(names.isin([n for n, c in ROLE_NAMES.items() if c == code]), code)
    return out.otherwise("?")


def repaired_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """``conv_id, turn_no, piece_no, role, source_turn, source_role, text, rendered``: the repaired conversations.

    A row is a turn of the log or an inserted empty one (no ``source_turn``).
    Merged turns share ``turn_no``; their pieces are numbered. ``rendered`` in the
    order of ``turn_no, piece_no`` joins up to the conversation's rendered form.

    Turns are ordered by number (NULL last), then by role and text. An unknown or
    NULL role is relabelled; a NULL text is empty; marks of the rendered form in a
    text are broken up. Rows without conversation id are a conversation of their
    own. Repeated rows are turns of their own. An empty table gives no rows. Other
    columns play no part.
    """
    every = stored_with_row(turns.select(
        F.col(conv).alias("conv_id"), F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("key"),
        F.col(turn).alias("turn"), F.col(turn).alias("source_turn"), F.col(role).alias("source_role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), _code(F.col(role)).alias("code")), "turns")
    last_part = (1 << 62) // block * block
    narrow = every.select(
        "key", F.coalesce(F.floor(F.col("turn").cast("double") / segment), F.lit(last_part)).alias("part"), "turn", "source_role",
        F.xxhash64("text").alias("mark"), "text", ROW, "code")
    # Turn numbers spread a conversation over parts; a part that repeats numbers is cut further by rank.
    order = Window.partitionBy("key", "part").orderBy(F.col("turn").asc_nulls_last(), "source_role", "text", ROW)
    placed = narrow.withColumn("rank", F.row_number().over(order)).select(
        "key", "part", F.expr(f"(rank - 1) div {segment}").alias("sub"), "rank", ROW, "code")
    segments = stored(
        placed.groupBy("key", "part", "sub").agg(F.array_sort(F.collect_list(F.struct("rank", ROW, "code"))).alias("t"))
        .select("key", "part", "sub", F.expr(f"transform(t, x -> x.{ROW})").alias("rows"),
                F.expr("array_join(transform(t, x -> x.code), '')").alias("codes")), "segments")

    tables = _rows(segments.select("key", "part", "sub", "codes"), ["key", "part", "sub"], "costs array<bigint>", lambda codes: (segment_costs(codes),))
    gathered = stored(
        tables.groupBy("key", F.expr(f"part div {block}").alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("part", "sub", "costs"))).alias("inner")), "blocks")
    block_tables = _rows(gathered.select("key", "block", F.expr("transform(inner, x -> x.costs)").alias("tables")), ["key", "block"],
                         "costs array<bigint>", lambda t: (combined(t),))
    tops = block_tables.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "costs"))).alias("t")).select(
        "key", F.expr("transform(t, x -> x.block)").alias("blocks"), F.expr("transform(t, x -> x.costs)").alias("tables"))
    steps = "places array<struct<at: int, first: int, last: int>>"

    def handed_down(tables, first, last):
        states = states_between(tables, first, last)
        return ([{"at": i, "first": a, "last": b} for i, (a, b) in enumerate(zip(states, states[1:]))],)

    top = _rows(tops, ["key", "blocks"], steps, lambda t: handed_down(t, START, None)).select(
        "key", "blocks", F.explode("places").alias("p")).select(
        "key", F.expr("blocks[p.at]").alias("block"), "p.first", "p.last", (F.col("p.at") == F.size("blocks") - 1).alias("ends"))
    middle = _rows(
        gathered.join(top, ["key", "block"]).select(
            "key", "ends", F.expr("transform(inner, x -> named_struct('part', x.part, 'sub', x.sub))").alias("names"),
            F.expr("transform(inner, x -> x.costs)").alias("tables"), "first", "last"),
        ["key", "ends", "names"], steps, handed_down)
    places = middle.select("key", "ends", "names", F.explode("places").alias("p")).select(
        "key", F.expr("names[p.at].part").alias("part"), F.expr("names[p.at].sub").alias("sub"), "p.first", "p.last",
        (F.col("ends") & (F.col("p.at") == F.size("names") - 1)).alias("ends"))

    def actions(codes, first, last, ends):
        made = [{"empty": e, "role": r, "merged": m} for e, r, m in repair(codes, first, last)]
        tail = _ENDING[last] if ends else ""
        fresh = sum(len(a["empty"]) + (not a["merged"]) for a in made)
        behind = len(made) - max((i for i, a in enumerate(made) if not a["merged"]), default=-1) - 1
        return made, tail, fresh, behind, fresh > 0

    solved = stored(_rows(
        segments.join(places, ["key", "part", "sub"]).select("key", "part", "sub", "rows", "ends", "codes", "first", "last", F.col("ends").alias("e2")),
        ["key", "part", "sub", "rows", "ends"],
        "actions array<struct<empty: string, role: string, merged: boolean>>, tail string, fresh bigint, behind bigint, opens boolean", actions), "solved")
    before = Window.partitionBy("key").orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    # Pieces of a turn that goes on over segments: those behind its beginning, and all of the segments it fills.
    run = solved.select("key", "part", "sub", "rows", "ends", "actions", "tail", "fresh", "behind", "opens").withColumn(
        "had", F.coalesce(F.sum("fresh").over(before), F.lit(0))).withColumn(
        "runs", F.coalesce(F.sum(F.col("opens").cast("int")).over(before), F.lit(0)))
    within = Window.partitionBy("key", "runs").orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    opened = run.withColumn("own_run", F.col("runs") + F.col("opens").cast("int"))
    lead = opened.groupBy("key", F.col("own_run").alias("runs")).agg(F.max(F.when(F.col("opens"), F.col("behind"))).alias("led"))
    numbered = (
        opened.withColumn("filled", F.coalesce(F.sum(F.when(~F.col("opens"), F.size("rows"))).over(within), F.lit(0)))
        .join(lead, ["key", "runs"], "left").withColumn("piece0", F.coalesce("led", F.lit(0)) + F.col("filled"))
    )
    # turn: its number, counted in the conversation; piece: its place in the turn.
    walked = numbered.select("key", "ends", "tail", "rows", "actions", "had", "piece0", F.expr("""
        aggregate(actions, named_struct('turn', had - 1, 'piece', piece0, 'out', cast(array() as array<struct<turn: bigint, piece: bigint>>)),
          (s, a) -> named_struct(
            'turn', s.turn + length(a.empty) + if(a.merged, 0L, 1L), 'piece', if(a.merged, s.piece + 1, 0L),
            'out', s.out || array(named_struct('turn', s.turn + length(a.empty) + if(a.merged, 0L, 1L), 'piece', if(a.merged, s.piece + 1, 0L)))),
          s -> s.out)""").alias("numbers"))
    taken = walked.select("ends", "tail", F.size("rows").alias("size"), F.posexplode(F.arrays_zip("rows", "actions", "numbers"))).select(
        F.col("col.rows").alias(ROW), F.col("col.actions.empty").alias("empty"), F.col("col.actions.role").alias("role"),
        F.col("col.numbers.turn").alias("turn_no"), F.col("col.numbers.piece").alias("piece_no"),
        F.when(F.col("ends") & (F.col("pos") == F.col("size") - 1), F.col("tail")).alias("tail"))
    joined = every.join(taken, ROW)
    own = F.struct("role", "turn_no", "piece_no", "source_turn", "source_role", "text", F.expr("tail = ''").alias("last"))
    kind = "struct<role: string, turn_no: bigint, piece_no: bigint, source_turn: %s, source_role: string, text: string, last: boolean>" % (
        every.schema["source_turn"].dataType.simpleString())
    inserted = F.expr(f"""transform(filter(split(empty, ''), x -> x <> ''), (x, i) -> cast(named_struct(
        'role', x, 'turn_no', turn_no - length(empty) + i, 'piece_no', 0L, 'source_turn', null, 'source_role', null, 'text', '', 'last', false) as {kind}))""")
    added = F.expr(f"""transform(filter(split(coalesce(tail, ''), ''), x -> x <> ''), (x, i) -> cast(named_struct(
        'role', x, 'turn_no', turn_no + 1 + i, 'piece_no', 0L, 'source_turn', null, 'source_role', null, 'text', '', 'last', i = length(tail) - 1) as {kind}))""")
    rows = joined.select("conv_id", F.explode(F.concat(inserted, F.array(own.cast(kind)), added)).alias("r")).select("conv_id", "r.*")
    named = F.expr("case role " + " ".join(f"when '{c}' then '{n}'" for c, n in ROLES.items()) + " end")
    safe = F.regexp_replace("text", r"<\|(im_start|im_end)\|>", "<| $1 |>")
    opening = F.concat(F.when(F.col("turn_no") > 0, CLOSE + "\n").otherwise(""), F.lit(OPEN), named, F.lit("\n"))
    rendered = F.concat(F.when(F.col("piece_no") == 0, opening).otherwise("\n\n"), safe, F.when(F.col("last"), CLOSE + "\n").otherwise(""))
    return rows.select("conv_id", "turn_no", "piece_no", named.alias("role"), "source_turn", "source_role", "text", rendered.alias("rendered"))
