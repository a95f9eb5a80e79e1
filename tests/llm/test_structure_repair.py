import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from caseloom.llm import structure_repair as s

LEGAL = re.compile(r"(s?(ua)+)?\Z")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        mark = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if mark == 1:
            text = ""
        elif mark == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif mark == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(mark, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """All edits tried in all states, with the whole audits as texts: {(role initials' end, whether begun)}."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(paths):
        for _ in range(3):
            for state, (cost, audit, lines) in list(paths.items()):
                for c, name in (("u", "user"), ("a", "assistant")):
                    if c in follow[state]:
                        new = (cost + 3, audit + "I", [*lines, f"{name}:"])
                        if c not in paths or new[:2] < paths[c][:2]:
                            paths[c] = new
        return paths

    paths = inserted({"": (0, "", [])})
    for (_, _, role, text), kind in zip(rows, kinds):
        after = {}

        def offer(state, new):
            if state not in after or new[:2] < after[state][:2]:
                after[state] = new

        for state, (cost, audit, lines) in paths.items():
            offer(state, (cost + 4, audit + "D", lines))
            if kind not in "bd" or not kind:
                more = 3 if kind == "t" else 0
                if role[:1] and role[0] in follow[state]:
                    offer(role[0], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if c in follow[state]:
                        offer(c, (cost + more + 3, audit + "R", [*lines, f"{name}:{text}"]))
        paths = inserted(after)
    return min((paths[e] for e in ("", "a") if e in paths), key=lambda p: p[:2])


def plain(rows, damage=True):
    out = {}
    left = damaged(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        kinds = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = cheapest(mine, kinds)
        roles = [r[2][:1] for r in mine]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("b"), kinds.count("d"), kinds.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def answer(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
            for r in df.collect()}


def random_rows(seed, convs, longest):
    rnd = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "user", "assistant", "tool", "", "sys", "User", None]
    texts = ["One.", "Two!", "Three? ", "cut", "", " \t", None, "é.", "Four.\n", "Five .", "a b c."]
    return [(c, rnd.choice([None, t, t, t, t + 2, 5]), rnd.choice(roles), rnd.choice(texts + [f"Text {t} of {c}.", f"Open {t}"] * 4))
            for c in range(convs) for t in range(rnd.randint(1, longest))]


@pytest.mark.parametrize("limits", [{}, {"block_rows": 3}, {"block_chars": 9}])
def test_as_all_edits_tried(spark, limits):
    rows = random_rows(7, 300, 14)
    df = table(spark, rows)
    assert answer(s.conversation_audit(df, s.damaged_turns(df), **limits)) == plain(rows)
    assert answer(s.conversation_audit(df, df, **limits)) == plain(rows, damage=False)


def test_one_giant_conversation_in_many_blocks(spark):
    rows = [(1, t, r, x) for _, t, r, x in random_rows(3, 1, 1)] + [
        (1, i, r, x) for i, (_, _, r, x) in enumerate(random_rows(5, 1, 4000) + random_rows(6, 400, 10))]
    df = table(spark, rows).repartition(7)
    assert answer(s.conversation_audit(df, df, block_rows=64)) == plain(rows, damage=False)


def test_repaired_turns_are_legal_and_say_where_they_come_from(spark):
    rows = random_rows(11, 40, 12)
    got = s.repaired_turns(s.solved_blocks(table(spark, rows), block_rows=4)).orderBy("key", "block", "piece").collect()
    assert got and all((r["edit"] == "I") == (r["turn"] is None and r["text"] == "") for r in got if r["edit"] == "I")
    for key in {r["key"] for r in got}:
        assert LEGAL.match("".join(r["role"][0] for r in got if r["key"] == key))


def test_rows_without_id_or_turn_repeated_rows_clashing_names(spark):
    rows = [(None, None, "user", "Hello."), (None, 2, None, None), (None, 1, "assistant", "Yes."), (3, None, "user", "a."), (3, None, "user", "a."),
            (4, 9007199254740993, "assistant", "No."), (4, 9007199254740992, "user", "Is it?"), (5, 1, "user", "x" * 300_000)]
    df = table(spark, rows).withColumns({c: F.lit("x") for c in ("key", "block", "digest", "first", "at", "place", "mark")})
    assert answer(s.conversation_audit(df, s.damaged_turns(df))) == plain(rows)
    assert answer(s.conversation_audit(df, df)) == plain(rows, damage=False)
    assert answer(s.conversation_audit(df, df))[4][5:7] == (0, "KK")


def test_empty_table_and_conversations_that_lose_all_rows(spark):
    empty = table(spark, [])
    assert s.conversation_audit(empty, s.damaged_turns(empty)).collect() == []
    some = table(spark, [(1, 0, "user", "Hi.")])
    assert answer(s.conversation_audit(some, some.limit(0))) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_least_audit_of_equals(spark):
    rows = [(1, 0, "assistant", "A."), (2, 0, "user", "U."), (3, 0, "system", "S."), (4, 0, "user", "U."), (4, 1, "user", "V.")]
    got = answer(s.conversation_audit(table(spark, rows), table(spark, rows)))
    assert {k: v[5:7] for k, v in got.items()} == {1: (3, "IK"), 2: (3, "KI"), 3: (4, "D"), 4: (3, "KR")}
