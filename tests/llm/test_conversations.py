"""Conversation repair against a row-by-row search that carries whole audits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rationale.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, part string, no int"
SHAPE = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def best(rows):
    """(cost, audit, repaired) of (role, text, must go, truncated) rows: least of (cost, audit) for each state, row by row."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def put(ways, state, way):
        if state not in ways or way < ways[state]:
            ways[state] = way

    def with_inserts(ways):
        out = dict(ways)
        for _ in range(2):
            for s, (c, a, t) in list(out.items()):
                put(out, after[s], (c + 3, a + "I", [*t, name[after[s]] + ":"]))
        return out

    ways = {"": (0, "", [])}
    for role, text, gone, cut in rows:
        new = {}
        for s, (c, a, t) in with_inserts(ways).items():
            put(new, s, (c + 4, a + "D", t))
            if not gone:
                more = 3 if cut else 0
                put(new, after[s], (c + 3 + more, a + "R", [*t, f"{name[after[s]]}:{text}"]))
                if role[:1] == after[s] or (role[:1] == "s" and s == ""):
                    put(new, role[:1], (c + more, a + "K", [*t, f"{role}:{text}"]))
        ways = new
    return min(w for s, w in with_inserts(ways).items() if s in ("", "a"))


def plain(rows, damage=False):
    """The contract's columns for (conv_id, turn, role, text) rows."""
    told = {}
    for conv, turn, role, text, *_ in rows:
        mine = told.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, mine in told.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, n, ready = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in mine:
            end = text.rstrip(BLANK)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            ready.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, kept = best(ready)
        assert SHAPE.fullmatch("".join(x[:1] for x in kept))
        out.append((conv, gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def made():
    """Conversations of all kinds; the last ones are long, with many equal rows and turns."""
    rng = random.Random(3)
    rows = [(None, 1, "user", "a."), (None, None, "user", "b"), (500, None, None, None), (501, 3, "", "x."), (502, 2, "system", "only."), (503, 2, "system", "cut"), (504, None, "user", "q?"), (504, None, "assistant", "é!"), (505, 4, "User", "x." * 3000)]
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn * rng.choice((1, 1, 1, 3)) if rng.random() < 0.9 else None, rng.choice(("user", "assistant", "system", "usr", "tool", "")), rng.choice(("yes.", "no", "", " \n", "why?", f"n{turn}.", f"n{turn}", "é\n!"))))
    for conv, n in ((700, 300), (701, 90), (702, 40)):
        for turn in range(n):
            role = rng.choice(("user", "assistant")) if rng.random() < 0.3 else ("user" if turn % 90 < 60 else "assistant")
            rows.append((conv, turn // 3 if rng.random() < 0.95 else None, role, rng.choice((f"t{turn}.", f"t{turn}", "same.", ""))))
    rows += [(703, 5, "user", "again.")] * 120
    return rows


def key(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in made()], SCHEMA).repartition(4).cache()


@pytest.mark.parametrize("damage", [False, True])
def test_report(talks, damage):
    out = conversations.damaged_report(talks) if damage else conversations.conversation_report(talks)
    assert key(out.collect()) == key(plain(made(), damage))


@pytest.mark.parametrize(("most_rows", "most_bytes"), [(5, 700), (0, 1 << 20), (30, 3000)])
def test_long_conversations(talks, most_rows, most_bytes):
    """In parts of bounded size, with and without damage, as in one."""
    assert key(conversations.conversation_report(talks, most_rows=most_rows, most_bytes=most_bytes).collect()) == key(plain(made()))
    hurt = conversations.damaged(talks)
    assert key(conversations.conversation_report(hurt, copies_col="copies", most_rows=most_rows, most_bytes=most_bytes).collect()) == key(plain(made(), True))


def test_parts_are_bounded(talks):
    """No part of a long conversation holds much more text than asked for, and together they are the repaired rows."""
    _, parts = conversations.repair(talks, most_rows=20, most_bytes=900)
    sizes = parts.where("conv_id = 700").select(F.col("part"), F.size("messages").alias("n")).collect()
    assert len(sizes) > 10 and sorted(r.part for r in sizes) == list(range(len(sizes))) and max(r.n for r in sizes) < 40


def test_all_rows_dropped(spark):
    """A conversation stays in the result, with zeros, whole or in parts."""
    rows = spark.createDataFrame([(1, 1, "user", "a.", 0), (2, 1, "user", "b.", 1)], "conv_id long, turn long, role string, text string, copies int")
    nothing = (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for most in (10, -1):
        out = conversations.conversation_report(rows, copies_col="copies", most_rows=most, most_bytes=1)
        assert nothing in [tuple(r) for r in out.collect()] and out.count() == 2


def test_no_rows(talks):
    assert conversations.damaged_report(talks.limit(0)).isEmpty()


def test_runs_and_powers():
    """Runs passed with powers and unrolled by halves: the same as row by row, on random rows with long runs."""
    rng = random.Random(11)
    for _ in range(200):
        runs = [(rng.randint(0, 8), rng.choice((1, 1, 2, 3, 7, 20))) for _ in range(rng.randint(0, 6))]
        rows = [("suat"[s // 2] if s < 8 else "t", "x", s == 8, s < 8 and s % 2 == 1) for s, n in runs for _ in range(n)]
        cost = conversations.END
        for s, n in reversed(runs):
            cost = conversations.rest_before(s, n, cost)
            assert all(x == y for x, y in zip(conversations._behind(conversations.run_matrix(s, n), conversations.END), conversations.rest_before(s, n, conversations.END), strict=True))
        audit, state = conversations.unrolled(conversations.collapsed(runs), conversations.END, conversations.START)
        assert (cost[0], audit + conversations.closing(state)) == best(rows)[:2]
    audit, state = conversations.unrolled([(2, 1_000_000)], conversations.END, conversations.START)
    assert len(audit) >= 1_000_000 and conversations.rest_before(2, 1_000_000, conversations.END)[0] == 1_500_000
