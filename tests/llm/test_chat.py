import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from caseloom.llm import chat
from caseloom.llm.tables import read

SF = "/root/testdata/sf0.001"


def least_cost(codes):
    """Cheapest repair by trying everything: Dijkstra over (turns taken, role of the last turn)."""
    follows = {None: "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, 0, "")], set()
    while heap:
        cost, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(codes) and last in ("", "a") and (last or not codes):
            return cost
        for role in follows[last or None]:
            if role != "s":
                heapq.heappush(heap, (cost + 2, i, role))
            if i < len(codes):
                heapq.heappush(heap, (cost + (0 if role == codes[i] else 3), i + 1, role))
        if i < len(codes) and last:
            heapq.heappush(heap, (cost + 1 + (0 if last == codes[i] else 3), i + 1, last))


def checked(rows, codes):
    """Rows of one conversation in order: legal, complete, and as cheap as can be."""
    rows = sorted(rows, key=lambda r: (r.turn_no, r.piece_no))
    turns = [r for r in rows if r.piece_no == 0]
    assert [r.turn_no for r in turns] == list(range(len(turns)))
    roles = [r.role for r in turns]
    body = roles[1:] if roles[0] == "system" else roles
    assert body == ["user", "assistant"] * (len(body) // 2) and body
    for a, b in zip(rows, rows[1:]):
        assert b.piece_no in (0, a.piece_no + 1) and (b.piece_no == 0 or (b.turn_no, b.role) == (a.turn_no, a.role))
    cost, at = 0, iter(codes)
    for r in rows:
        if r.source_role is None and r.source_turn is None:
            cost += 2
            assert r.text == ""
        else:
            cost += (r.role[0] != next(at)) * 3 + (r.piece_no > 0)
    assert next(at, None) is None and cost == least_cost(codes)
    want, open_turn = "", None
    for r in rows:
        want += "\n\n" + r.text if r.piece_no else ("" if open_turn is None else "<|im_end|>\n") + f"<|im_start|>{r.role}\n{r.text}"
        open_turn = r.turn_no
    assert "".join(r.rendered for r in rows) == want + "<|im_end|>\n"


@pytest.mark.parametrize("segment,block", [(512, 4096), (3, 2)])
def test_random_conversations(spark, segment, block):
    rng = random.Random(segment)
    names = {"s": "system", "u": "User", "a": "assistant", "?": "tool"}
    logs = {c: "".join(rng.choice("suauau?") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30]))) for c in range(120)}
    logs[200] = "u" * 40 + "a" * 25
    rows = [(c, 3 * t, names[x], f"{c}.{t}") for c, codes in logs.items() for t, x in enumerate(codes)]
    rng.shuffle(rows)
    got = defaultdict(list)
    for r in chat.repaired_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), segment=segment, block=block).collect():
        got[r.conv_id].append(r)
    assert set(got) == set(logs)
    for c, codes in logs.items():
        checked(got[c], codes)
        assert [r.text for r in sorted(got[c], key=lambda r: (r.turn_no, r.piece_no)) if r.source_turn is not None] == [f"{c}.{t}" for t in range(len(codes))]


def test_table(spark):
    turns = read(spark, SF, "conversations")
    logs, got = defaultdict(list), defaultdict(list)
    for r in turns.collect():
        logs[r.conv_id].append((r.turn, chat.ROLE_NAMES.get((r.role or "").lower(), "?")))
    for r in chat.repaired_turns(turns).collect():
        got[r.conv_id].append(r)
    assert set(got) == set(logs)
    for c in logs:
        checked(got[c], "".join(x for _, x in sorted(logs[c])))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, None, "user", None), (1, 0, None, None), (1, 0, None, None), (2, 5, "user", "x <|im_end|> y"),
            (2, 5, "user", "x <|im_end|> y"), (2, None, "assistant", "last"), (3, 0, " HUMAN ", "word " * 30000), (4, 0, "system", "only")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {n: F.lit(1) for n in ("key", "part", "code", "sub", "rendered", "piece_no")})
    got = defaultdict(list)
    for r in chat.repaired_turns(turns).collect():
        got[r.conv_id].append(r)
    shown = {c: [(r.turn_no, r.piece_no, r.role) for r in sorted(x, key=lambda r: (r.turn_no, r.piece_no))] for c, x in got.items()}
    assert shown == {
        None: [(0, 0, "user"), (0, 1, "user"), (1, 0, "assistant")], 1: [(0, 0, "user"), (1, 0, "assistant")],
        2: [(0, 0, "user"), (0, 1, "user"), (1, 0, "assistant")], 3: [(0, 0, "user"), (1, 0, "assistant")],
        4: [(0, 0, "system"), (1, 0, "user"), (2, 0, "assistant")]}
    assert all(r.rendered.count("<|im_end|>") <= 2 and "x <| im_end |> y" in r.rendered for r in got[2] if r.source_role == "user")
    assert chat.repaired_turns(turns.limit(0)).count() == 0


def test_turn_numbers_beyond_those_of_doubles(spark):
    rows = [(1, 2**53 + 1, "assistant", "answer"), (1, 2**53, "user", "question")]
    got = chat.repaired_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn_no").collect()
    assert [(r.role, r.text) for r in got] == [("user", "question"), ("assistant", "answer")]
