"""Conversation structure repair by dynamic programming over runs of equal symbols.

A conversation's rows, in the order of turn (nulls first), role and text, should
read ``(s?(ua)+)?`` in the initials of their roles.  A row is kept (K, costs 0), given
the role user or assistant (R, 3) or deleted (D, 4); rows without text may be inserted
anywhere (I, 3).  Blank rows, and rows whose role and text stood earlier, must go;
a truncated row that stays costs 3 more.  Of the cheapest sequences of edits the one
whose initials are least in ASCII is taken.

A row is a symbol: role initial and fault.  Equal consecutive symbols are one run.
Four states tell what the repaired rows so far end with, and a symbol is a min-plus
matrix of costs between them, inserts before the row included.  A run is passed with
the cached binary powers of its matrix, from the conversation's end to its start, so
the cheapest rest is known at each run.  Then the choices are unrolled from the start:
a block of 2**j equal rows is two of half the size, and short blocks are cached by
state and cheapest rests.  From a state each initial leads to one next state, so the
least initial that stays cheapest is right.

Scale.  Conversations of up to ``ROWS`` rows and ``BYTES`` of text are dealt out by id
with one exchange and worked through one after the other.  Longer ones are split:
equal rows are counted, earlier equals looked up by an aggregate, the rest numbered
by sorted ranges and cut into parts of bounded size.  A part becomes its runs, with a
matrix over all of them; passes over one small row for each part carry the cheapest
rests back and the state forward, and the parts are unrolled side by side.  One task
hashes the text of a conversation, as one hash asks for, a part at a time.

Null roles and texts are one space, so such a text is blank; a null id is a
conversation of its own; rows of one turn go by role and text; an empty role, like
any that starts otherwise, has to change or go.  Equal rows are duplicates of the
first; long texts are kept whole; a conversation whose rows are all dropped has zeros
and no repaired rows; further columns play no part, whatever their names.  No rows: no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rationale.functions.order import running

from .session import stored

ROWS, BYTES = 20_000, 16 << 20
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired rows end with
AFTER = (USER, USER, ASSISTANT, USER)  # by an inserted or changed row
ROLES = {USER: "user", ASSISTANT: "assistant"}
GONE = 8  # the symbol of rows that must go; others are 2 * initial + truncated
FAR = 1 << 60
CACHED = 10  # unrolled blocks of up to 2**CACHED rows are kept
BLANKS = " \t\n\x0b\x0c\r"

MESSAGES = "array<struct<role:string,text:string>>"
PART = f"conv_id long, part long, min_turn long, max_turn long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, messages {MESSAGES}"
NAMES = [c.split()[0] for c in PART.split(", ")]


def _keep(symbol: int, state: int) -> int | None:
    """The state behind a kept row, if it may stand there."""
    initial = "sua?"[symbol // 2] if symbol != GONE else "?"
    if initial == "s" and state == START:
        return SYSTEM
    if initial == "u" and state != USER:
        return USER
    return ASSISTANT if initial == "a" and state == USER else None


def _product(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(x + y[j] for x, y in zip(row, b, strict=True)) for j in range(4)) for row in a)


def _behind(matrix: tuple, rest: tuple) -> tuple:
    """The cheapest rests before a step, from those after it."""
    return tuple(min(x + y for x, y in zip(row, rest, strict=True)) for row in matrix)


UNIT = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
_ONE = tuple(tuple(0 if i == j else INSERT if j == AFTER[i] else FAR for j in range(4)) for i in range(4))
INSERTS = _product(_ONE, _ONE)  # two lead anywhere
END = _behind(INSERTS, (0, FAR, FAR, 0))


@lru_cache(maxsize=None)
def power(symbol: int, j: int) -> tuple:
    """The matrix of 2**j rows with one symbol; 9 symbols and as many powers as a number has bits."""
    if j:
        return _product(power(symbol, j - 1), power(symbol, j - 1))
    step = [[FAR] * 4 for _ in range(4)]
    for p in range(4):
        step[p][p] = DELETE
        if symbol != GONE:
            more = TRUNCATED * (symbol % 2)
            step[p][AFTER[p]] = min(step[p][AFTER[p]], REROLE + more)
            if (q := _keep(symbol, p)) is not None:
                step[p][q] = min(step[p][q], more)
    return _product(INSERTS, tuple(map(tuple, step)))


def _bits(n: int) -> list[int]:
    return [j for j in range(n.bit_length()) if n >> j & 1]


def run_matrix(symbol: int, n: int) -> tuple:
    out = UNIT
    for j in _bits(n):
        out = _product(out, power(symbol, j))
    return out


def rest_before(symbol: int, n: int, rest: tuple) -> tuple:
    for j in _bits(n):
        rest = _behind(power(symbol, j), rest)
    return rest


def _one_row(symbol: int, rest: tuple, state: int) -> tuple[str, int]:
    before, edits = _behind(power(symbol, 0), rest), ""
    more = TRUNCATED * (symbol % 2)
    while True:
        left = before[state]
        if left == DELETE + rest[state]:
            return edits + "D", state
        if left == INSERT + before[AFTER[state]]:
            edits, state = edits + "I", AFTER[state]
            continue
        q = _keep(symbol, state)
        if q is not None and left == more + rest[q]:
            return edits + "K", q
        return edits + "R", AFTER[state]


@lru_cache(maxsize=1 << 14)
def _short_block(symbol: int, j: int, rest: tuple, state: int) -> tuple[str, int]:
    return _halves(symbol, j, rest, state) if j else _one_row(symbol, rest, state)


def _halves(symbol: int, j: int, rest: tuple, state: int) -> tuple[str, int]:
    left, middle = _block(symbol, j - 1, _behind(power(symbol, j - 1), rest), state)
    right, state = _block(symbol, j - 1, rest, middle)
    return left + right, state


def _block(symbol: int, j: int, rest: tuple, state: int) -> tuple[str, int]:
    """Edits of 2**j rows and the state behind them; only differences between rests matter."""
    least = min(rest)
    rest = tuple(x - least for x in rest)
    return _short_block(symbol, j, rest, state) if j <= CACHED else _halves(symbol, j, rest, state)


def unrolled(runs: list[tuple[int, int]], rest: tuple, state: int) -> tuple[str, int]:
    """The least of the cheapest edits of all runs, from ``state`` and before ``rest``, and the state behind them."""
    steps = []
    for symbol, n in reversed(runs):
        for j in _bits(n):
            steps.append((symbol, j, rest))
            rest = _behind(power(symbol, j), rest)
    out = []
    for symbol, j, behind in reversed(steps):
        edits, state = _block(symbol, j, behind, state)
        out.append(edits)
    return "".join(out), state


def closing(state: int) -> str:
    """Inserts at the conversation's end."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


def collapsed(symbols: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring runs of one symbol as one."""
    return [(s, sum(n for _, n in run)) for s, run in groupby(symbols, key=lambda x: x[0])]


def symbol_of(role: str, cut: bool) -> int:
    return 2 * ("sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3) + cut


def repaired(rows: Iterator[tuple[str, str]], audit: str, state: int) -> tuple[list[dict], int]:
    """The messages that the edits make of (role, text) rows, and the state behind them."""
    out = []
    for edit in audit:
        if edit in "IR":
            state = AFTER[state]
            out.append({"role": ROLES[state], "text": next(rows)[1] if edit == "R" else ""})
            continue
        role, text = next(rows)
        if edit == "K":
            state = _keep(symbol_of(role, False), state)
            out.append({"role": role, "text": text})
    return out, state


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies_col: str | None) -> DataFrame:
    copies = F.col(copies_col) if copies_col else F.lit(1)
    space = F.lit(" ")
    named = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"), copies.cast("long").alias("copies"))
    solid = F.rtrim("text", F.lit(BLANKS))
    return named.select("*", (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"))


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows that share their first columns, as lists; equal keys come one after the other."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[dict], schema: pa.Schema, weight=lambda r: 1) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(of_messages: bool = True) -> pa.Schema:
    fields = [(n, pa.string() if n == "audit" else pa.int64()) for n in NAMES[:-1]]
    return pa.schema([*fields, ("messages", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))] if of_messages else fields)


def _whole(rows: list[tuple]) -> dict:
    """One conversation: (conv_id, turn, role, text, copies, blank, cut) rows in order."""
    seen: set[tuple[str, str]] = set()
    symbols, counts = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    turns, texts, initials = [], [], []
    for _, turn, role, text, copies, blank, cut in rows:
        for _ in range(copies):
            fault = "blank" if blank else "duplicate" if (role, text) in seen else "truncated" if cut else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            symbols.append((GONE, 1) if fault in ("blank", "duplicate") else (symbol_of(role, cut), 1))
            texts.append((role, text))
            initials.append(role[:1])
            turns.append(turn)
    runs = collapsed(symbols)
    cost = END
    for symbol, n in reversed(runs):
        cost = rest_before(symbol, n, cost)
    audit, state = unrolled(runs, END, START)
    audit += closing(state)
    turns = [t for t in turns if t is not None]
    return {"conv_id": rows[0][0], "part": 0, "min_turn": min(turns, default=None), "max_turn": max(turns, default=None), "turns": len(set(turns)), **counts, "illegal": _illegal(initials), "cost": cost[START], "audit": audit, "messages": repaired(iter(texts), audit, START)[0]}


def _size(part: dict) -> int:
    return 1 + sum(len(m["text"]) for m in part["messages"]) // 1024 + len(part["messages"]) // 16


def _whole_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(map(_whole, _grouped(batches, 1)), _arrow(), _size)


# Long conversations, in parts.


def _runs_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's runs and their matrix, its first and last initial and turn, and illegal pairs inside."""

    def one(rows: list[tuple]) -> dict:
        symbols, illegal, before = [], 0, None
        for _, _, _, _, role, copies, blank, again, cut in rows:
            gone = blank or again
            symbols += [(GONE, copies)] if gone else [(symbol_of(role, cut), 1), (GONE, copies - 1)]
            illegal += copies - 1 + (before is not None and _illegal([before, role[:1]]))
            before = role[:1]
        runs = collapsed([(s, n) for s, n in symbols if n])
        matrix = UNIT
        for symbol, n in runs:
            matrix = _product(matrix, run_matrix(symbol, n))
        turns = [r[3] for r in rows]
        known = [t for t in turns if t is not None]
        return {"conv_id": rows[0][0], "part": rows[0][1], "symbols": [s for s, _ in runs], "counts": [n for _, n in runs], "matrix": [x for row in matrix for x in row], "illegal": illegal, "first": rows[0][4][:1], "last": before, "min_turn": min(known, default=None), "max_turn": max(known, default=None), "turns": len(set(known))}

    whole, text = pa.int64(), pa.string()
    schema = pa.schema([("conv_id", whole), ("part", whole), ("symbols", pa.list_(whole)), ("counts", pa.list_(whole)), ("matrix", pa.list_(whole)), ("illegal", whole), ("first", text), ("last", text), ("min_turn", whole), ("max_turn", whole), ("turns", whole)])
    yield from _batches(map(one, _grouped(batches, 2)), schema)


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest rests behind each part, carried from the last part to the first, one row at a time; its cost from each state."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("rest", pa.list_(pa.int64())), ("before", pa.list_(pa.int64())), ("is_last", pa.bool_())])

    def rows() -> Iterator[dict]:
        at, rest = (), END
        for batch in batches:
            for conv, part, matrix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                is_last = at != (conv,)
                at, rest = (conv,), END if is_last else rest
                before = _behind(tuple(zip(*[iter(matrix)] * 4, strict=True)), rest)
                yield {"conv_id": conv, "part": part, "rest": list(rest), "before": list(before), "is_last": is_last}
                rest = before

    yield from _batches(rows(), schema)


def _unrolled_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and last state of each part from each state that it may start in."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("audits", pa.list_(pa.string())), ("ends", pa.list_(pa.int64()))])
    for batch in batches:
        out = []
        for conv, part, symbols, counts, rest, is_last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = [unrolled(list(zip(symbols, counts, strict=True)), tuple(rest), s) for s in range(4 if part else 1)]
            out.append({"conv_id": conv, "part": part, "audits": [a + (closing(s) if is_last else "") for a, s in found], "ends": [s for _, s in found]})
        yield from _batches(iter(out), schema, lambda r: 1 + sum(map(len, r["audits"])) // 1024)


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each part starts, carried from the first part to the last, one row at a time."""

    def rows() -> Iterator[dict]:
        at, state = (), START
        for batch in batches:
            for conv, part, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, state = (conv,), START if at != (conv,) else state
                yield {"conv_id": conv, "part": part, "state": state}
                state = ends[state]

    yield from _batches(rows(), pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("state", pa.int64())]))


def _messages_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages of each part, whose first row holds its state and edits."""

    def one(rows: list[tuple]) -> dict:
        conv, part, _, _, _, _, state, audit = rows[0]
        texts = ((role, text) for _, _, _, role, text, copies, _, _ in rows[1:] for _ in range(copies))
        return {"conv_id": conv, "part": part, "messages": repaired(texts, audit, state)[0]}

    schema = pa.schema([f for f in _arrow() if f.name in ("conv_id", "part", "messages")])
    yield from _batches(map(one, _grouped(batches, 2)), schema, _size)


def _same(a: DataFrame, b: DataFrame, columns: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Join on columns that may be null; those of ``b`` go."""
    other = b.select(*[F.col(c).alias(f"b_{c}" if c in columns else c) for c in b.columns])
    on = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in columns]
    return a.join(other, on, how).drop(*[f"b_{c}" for c in columns])


def _in_parts(rows: DataFrame, part_bytes: int) -> DataFrame:
    """The parts of long conversations; ``rows`` as of ``_prepared``."""
    # equal rows as one with their number; of equal role and text, all but those of the first turn stood earlier
    counted = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text", "blank", "cut").agg(F.sum("copies").alias("copies")).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    counted = stored(counted.withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), "turn")))
    first = counted.groupBy("conv_id", "role", "key").agg(F.min("place").alias("first_place"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = _same(counted, first, ("conv_id", "role", "key"), "left").withColumn("again", F.coalesce(F.col("place") > F.col("first_place"), F.lit(False)))
    weight = F.octet_length("text").cast("long") + 64
    told = running(told.select("conv_id", "turn", "role", "text", "copies", "blank", "cut", "again", weight.alias("weight")), ["turn", "role", "text"], {"no": F.lit(1).cast("long"), "up_to": F.col("weight")}, ("conv_id",))
    told = stored(told.withColumn("part", F.floor((F.col("up_to") - F.col("weight")) / part_bytes).cast("long")))

    keys = ["conv_id", "part"]
    ordered = told.select(*keys, "no", "turn", "role", "copies", "blank", "again", "cut").repartition(*keys).sortWithinPartitions(*keys, "no")
    runs = ordered.mapInArrow(_runs_of_parts, "conv_id long, part long, symbols array<long>, counts array<long>, matrix array<long>, illegal long, first string, last string, min_turn long, max_turn long, turns long")
    renumbered = Window.partitionBy("conv_id").orderBy("part")  # one row for each part
    runs = stored(runs.withColumns({"no": F.row_number().over(renumbered).cast("long") - 1, "before_initial": F.lag("last").over(renumbered), "before_turn": F.lag("max_turn").over(renumbered)}))
    rests = stored(runs.select("conv_id", "no", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("no")).mapInArrow(_rests, "conv_id long, part long, rest array<long>, before array<long>, is_last boolean"))
    both = _same(runs, rests.withColumnRenamed("part", "no"), ("conv_id", "no"))
    found = stored(both.select("conv_id", "no", "symbols", "counts", "rest", "is_last").mapInArrow(_unrolled_parts, "conv_id long, part long, audits array<string>, ends array<long>"))
    states = found.select("conv_id", "part", "ends").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_states, "conv_id long, part long, state long")
    edits = _same(found, states, ("conv_id", "part")).select("conv_id", F.col("part").alias("no"), "state", F.element_at("audits", (F.col("state") + 1).cast("int")).alias("audit"))
    pair = F.concat("before_initial", "first")
    crossing = (F.col("before_initial").isNotNull() & ~pair.isin("su", "ua", "au")).cast("long")
    shared = F.coalesce((F.col("before_turn") == F.col("min_turn")).cast("long"), F.lit(0))
    edits = stored(_same(_same(runs, edits, ("conv_id", "no")), rests.select("conv_id", F.col("part").alias("no"), "before", "rest"), ("conv_id", "no")).select("conv_id", "no", "part", "state", "audit", "min_turn", "max_turn", (F.col("turns") - shared).alias("turns"), (F.col("illegal") + crossing).alias("illegal"), F.element_at("before", (F.col("state") + 1).cast("int")).alias("cost_from")))

    heads = edits.select("conv_id", "part", F.lit(0).cast("long").alias("no"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), "state", "audit")
    body = told.select("conv_id", "part", "no", "role", "text", "copies", F.lit(None).cast("long").alias("state"), F.lit(None).cast("string").alias("audit"))
    messages = heads.union(body).repartition(*keys).sortWithinPartitions(*keys, "no").mapInArrow(_messages_of_parts, f"conv_id long, part long, messages {MESSAGES}")
    faults = told.groupBy(*keys).agg(F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"), F.sum(F.when(F.col("blank"), 0).when(F.col("again"), F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicate"), F.count_if(~F.col("blank") & ~F.col("again") & F.col("cut")).alias("truncated"))
    after = F.coalesce(F.lead("cost_from").over(Window.partitionBy("conv_id").orderBy("no")), F.lit(0))
    costs = edits.withColumn("cost", F.col("cost_from") - after)
    return _same(_same(costs, faults, ("conv_id", "part")), messages, ("conv_id", "part")).select("conv_id", F.col("no").alias("part"), *NAMES[2:])


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, most_rows: int = ROWS, most_bytes: int = BYTES) -> tuple[DataFrame, DataFrame | None]:
    """Conversations in one part each, and those in several (None without any): statistics, audit and repaired messages of each part.

    ``copies_col`` says how often a row stands; with 0 it is gone, but its conversation still has its row in the result.
    """
    ready = _prepared(rows, conv_col, turn_col, role_col, text_col, copies_col)
    long = ready.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text").cast("long") * F.greatest("copies", F.lit(1))).alias("size")).where((F.col("n") > most_rows) | (F.col("size") > most_bytes)).select("conv_id")
    long = stored(long)
    split = not long.isEmpty()
    short = _same(ready, long, ("conv_id",), "left_anti") if split else ready
    columns = ["conv_id", "turn", "role", "text", "copies", "blank", "cut"]
    whole = short.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_whole_conversations, PART)
    if not split:
        return whole, None
    mine = _same(ready, long, ("conv_id",), "left_semi")
    parts = _in_parts(mine, most_bytes)
    # a long conversation without rows has one empty part
    empty = _same(long, parts.select("conv_id").distinct(), ("conv_id",), "left_anti")
    nothing = {"min_turn": "null", "max_turn": "null", "audit": "''", "messages": f"cast(array() as {MESSAGES})"}
    return whole.union(empty.select("conv_id", *[F.expr(nothing.get(c, "0")).alias(c) for c in NAMES[1:]]).to(whole.schema)), parts


def _hashed_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the messages of each conversation, whose parts come in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def rows() -> Iterator[dict]:
        at, digest, started = (), None, False
        for batch in batches:
            for conv, _, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (conv,):
                    if at:
                        yield {"conv_id": at[0], "repaired_sha256": digest.hexdigest()}
                    at, digest, started = (conv,), hashlib.sha256(), False
                if n:
                    digest.update((b"\n" if started else b"") + text.encode())
                    started = True
        if at:
            yield {"conv_id": at[0], "repaired_sha256": digest.hexdigest()}

    yield from _batches(rows(), schema)


def conversation_report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation."""
    whole, parts = repair(rows, conv_col, turn_col, role_col, text_col, copies_col, most_rows, most_bytes)
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    numbers = ["blank", "duplicate", "truncated", "illegal", "cost"]
    out = whole.select("conv_id", gaps, *numbers, "audit", F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))
    if parts is None:
        return out.withColumnRenamed("conv_id", conv_col)
    parts = stored(parts)
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"]), "").alias("audit")
    sums = parts.groupBy("conv_id").agg(F.min("min_turn").alias("min_turn"), F.max("max_turn").alias("max_turn"), *[F.sum(c).alias(c) for c in ("turns", *numbers)], audit)
    texts = parts.select("conv_id", "part", text.alias("text"), F.size("messages").alias("n"))
    hashed = texts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_hashed_parts, "conv_id long, repaired_sha256 string")
    return out.union(_same(sums, hashed, ("conv_id",)).select("conv_id", gaps, *numbers, "audit", "repaired_sha256")).withColumnRenamed("conv_id", conv_col)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows dropped (copies 0), emptied, stripped of marks, repeated or given to the user, by their key."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def damaged_report(conversations: DataFrame) -> DataFrame:
    """The report on the conversations after damage."""
    return conversation_report(damaged(conversations), copies_col="copies")
