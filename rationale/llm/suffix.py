"""Repeated byte strings, by merging the Burrows-Wheeler transforms of shards.

A window is ``size`` consecutive bytes of one document.  Every byte covered by a
window that also starts earlier (smaller id, or same document and smaller start)
is removed; what stands first stays.

1. The least ``GRAM``-byte gram of a window is its anchor; equal windows have
   equal anchors at equal offsets.  Runs of windows with the same anchor are
   found in each document, and anchors that occur once in the corpus are set
   aside: no window there can repeat.
2. The runs left are cut out as strings and dealt out by anchor.  Equal strings
   are one string; all but its first place are covered.
3. In a bucket the strings form shards.  Each shard is sorted once and kept as
   its Burrows-Wheeler transform over 8-byte symbols.  The transforms are merged
   by refining the interleave: it starts with one shard after the other, and
   each round reorders it, stably, by the symbol that precedes each suffix, so
   that after a round it is sorted 8 bytes deeper.  Rounds end at ``size`` bytes.
   Boundaries carried along mark where neighbours share fewer than ``size``
   bytes, so each interval between two boundaries is one repeated string with
   all its places; no suffix is sorted again.

Scale.  Each slice of text sends an anchor once, however often it holds it, and
an equal string once.  Anchors with a large share of all runs (a list with a
fixed maximum) deal out each window by its own content instead, so a common
passage in ever new surroundings fills no bucket.

Null texts are empty.  Rows with one id but different texts are told apart by
their text; equal rows count as one place.  No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored
from .substring import NO_ID
from .text import _BYTE_CODE, covered, mix, range_hashes, slices, sliding_min

WINDOW = 100
GRAM = 40
RUNS_PER_BUCKET = 300_000
BYTES_PER_BUCKET = 1_500_000
BYTES_PER_GROUP = 8_000_000  # text of a group of documents whose ranges travel together
SHARDS = 4
HOT_ANCHORS = 20_000  # at most so many anchors deal out windows one by one
SYMBOL = 8
END = 0xFF  # in no UTF-8 text


def _runs(data: np.ndarray, offsets: np.ndarray, size: int, wanted: np.ndarray | None = None):
    """Text number, first and last window start, anchor of each run of windows (those wanted) with one anchor."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, np.zeros(0, np.uint64)
    at = np.arange(n - GRAM + 1)
    grams = range_hashes(data, at, at + GRAM, _BYTE_CODE)
    keys = (grams >> np.uint64(32)) << np.uint64(32) | at.astype(np.uint64)
    least = (sliding_min(keys, size - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= size)
    valid[offsets[long]] += 1
    valid[offsets[long + 1] - size + 1] -= 1
    valid = np.cumsum(valid)[: len(least)] > 0
    if wanted is not None:
        valid &= wanted[: len(least)]
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(least[at]) != 0)
    head = np.flatnonzero(new)
    first, last = at[head], at[np.append(head[1:], len(at)) - 1]
    return np.searchsorted(offsets, first, "right") - 1, first, last, grams[least[first]]


def _pack(*arrays) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a, t).tobytes() for a, t in arrays), 1)


def _unpack(blob: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.frombuffer(raw, k, n, at))
        at += n * w
    return out


ANCHOR_KINDS = ("u8", "i8", "i8", "i4", "i4")  # anchor, times, id, first, last - first
PLACE_KINDS = ("u8", "i8", "i4", "i8")  # anchor, id, key, start
SPAN_KINDS = ("i8", "i4", "i8", "i8")  # id, key, start, end


def _parts(bucket: np.ndarray):
    by = np.argsort(bucket, kind="stable")
    return [p for p in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(p)]


def _find_anchors(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, _, data, offsets in slices(batch.column(1)):
                text, first, last, anchor = _runs(data, offsets, size)
                first, last = first - offsets[text], last - offsets[text]
                own = ids[row + text]
                _, head, group, times = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
                again = times[group] > 1
                out_bucket, out_blob = [], []
                if again.any():  # known already: neighbouring runs make one
                    t, a, b = text[again], first[again], last[again]
                    new = np.ones(len(t), bool)
                    new[1:] = (np.diff(t) != 0) | (a[1:] != b[:-1] + 1)
                    h = np.flatnonzero(new)
                    b = b[np.append(h[1:], len(t)) - 1]
                    none = np.zeros(len(h))
                    out_bucket.append(-1 - int(own[0] % buckets))
                    out_blob.append(_pack((none, "u8"), (none, "i8"), (ids[row + t[h]], "i8"), (a[h], "i4"), (b - a[h], "i4")))
                bucket = (anchor[head] % np.uint64(buckets)).astype(np.int64)
                for p in _parts(bucket):
                    h = head[p]
                    out_bucket.append(int(bucket[p[0]]))
                    out_blob.append(_pack((anchor[h], "u8"), (times[p], "i8"), (own[h], "i8"), (first[h], "i4"), ((last - first)[h], "i4")))
                yield pa.record_batch([pa.array(out_bucket, pa.int64()), pa.array(out_blob, pa.binary())], ["bucket", "packed"])

    return run


def _repeated_anchors(hot: int, groups: int):
    def run(table: pa.Table) -> pa.Table:
        anchor, times, ids, first, more = (np.concatenate(x) for x in zip(*[_unpack(b, ANCHOR_KINDS) for b in table.column("packed").to_pylist()], strict=True))
        if table.column("bucket")[0].as_py() < 0:  # known to repeat within their slice
            use, hot_anchor = np.ones(len(anchor), bool), np.zeros(0, np.uint64)
            total = hot_anchor
        else:
            found, group = np.unique(anchor, return_inverse=True)
            total = np.bincount(group, times)
            use = total[group] > 1
            hot_anchor, total = found[total >= hot], total[total >= hot]
        first = first[use].astype(np.int64)
        docs, packed = _by_documents([(ids[use], np.zeros(len(first)), first, first + more[use] + 1)], groups)
        m, k = len(docs), len(hot_anchor)
        return pa.table({
            "docs": pa.array([*docs, *[None] * k], pa.int64()),
            "packed": pa.array([*packed, *[None] * k], pa.binary()),
            "hot": pa.array([*[None] * m, *hot_anchor.view(np.int64).tolist()], pa.int64()),
            "times": pa.array([*[None] * m, *total.astype(np.int64).tolist()], pa.int64()),
        })

    return run


def _merged(ids, keys, starts, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ranges sorted, with those of one text that overlap or touch made one."""
    order = np.lexsort((starts, keys, ids))
    ids, keys, starts, ends = ids[order], keys[order], starts[order], ends[order]
    if not len(ids):
        return ids, keys, starts, ends
    other = np.ones(len(ids), bool)
    other[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    lift = (np.cumsum(other) - 1) * (int(ends.max()) + 2)
    reach = np.maximum.accumulate(ends + lift)
    new = other.copy()
    new[1:] |= (starts + lift)[1:] > reach[:-1]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(ids)) - 1
    return ids[head], keys[head], starts[head], reach[tail] - lift[tail]


def _by_documents(found: list, groups: int) -> tuple[list[int], list[bytes]]:
    """Ranges (id, key, start, end), packed for each group of documents."""
    if not found:
        return [], []
    ids, keys, starts, ends = _merged(*(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)))
    group = (mix(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    parts = _parts(group)
    return [int(group[p[0]]) for p in parts], [_pack((ids[p], "i8"), (keys[p], "i4"), (starts[p], "i8"), (ends[p], "i8")) for p in parts]


def _of_documents(table: pa.Table) -> pa.Table:
    """One row for each id of a group of documents: its ranges, merged."""
    ids, keys, starts, ends = _merged(*(np.concatenate(x).astype(np.int64) for x in zip(*[_unpack(b, SPAN_KINDS) for b in table.column("packed").to_pylist()], strict=True)))
    head = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    ranges = pa.StructArray.from_arrays([pa.array(keys.astype(np.int32)), pa.array(starts), pa.array(ends)], ["r_key", "s", "e"])
    return pa.table({"r_id": ids[head], "r_spans": pa.ListArray.from_arrays(pa.array(np.append(head, len(ids)).astype(np.int32)), ranges)})


def _ranges_of(column: pa.Array, first: int, last: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, key, start and end (both in the slice of texts first..last) of each range."""
    lists = column.slice(first, last - first)
    flat = lists.flatten()
    key, s, e = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
    text = np.repeat(np.arange(last - first), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    start, stop = offsets[text], offsets[text + 1]
    return text, key, np.minimum(start + s, stop), np.minimum(start + e, stop)


def _spans_of(ids, keys, first, last, size: int) -> bytes:
    """Byte ranges under windows first..last, of one document or several."""
    return _pack((ids, "i8"), (keys, "i4"), (first, "i8"), (last + size, "i8"))


def _cut_strings(size: int, buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            ids = batch.column(names.index("r_id")).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column(names.index("r_key")).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, end, data, offsets in slices(batch.column(names.index("r_text"))):
                _, _, s, e = _ranges_of(batch.column(names.index("r_spans")), row, end, offsets)
                wanted = covered(len(data), s, e)
                text, first, last, anchor = _runs(data, offsets, size, wanted)
                if not len(text):
                    continue
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
                    if is_hot.any():
                        n = (last - first + 1)[is_hot]
                        each = np.repeat(first[is_hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        own = range_hashes(data, each, each + size, _BYTE_CODE)
                        text = np.concatenate([text[~is_hot], np.repeat(text[is_hot], n)])
                        first, last = np.concatenate([first[~is_hot], each]), np.concatenate([last[~is_hot], each])
                        anchor = np.concatenate([anchor[~is_hot], own])
                own, key, at = ids[row + text], keys[row + text], first - offsets[text]
                by = np.lexsort((at, key, own))
                raw = data.tobytes()
                seen: dict[bytes, int] = {}
                lead, later = [], []
                for i, a, b in zip(by.tolist(), first[by].tolist(), (last[by] + size).tolist(), strict=True):
                    j = seen.setdefault(raw[a:b], i)
                    if j == i:
                        lead.append(i)
                    elif (own[i], key[i], at[i]) != (own[j], key[j], at[j]):
                        later.append(i)
                lead, later = np.array(lead, np.int64), np.array(later, np.int64)
                out = {"bucket": [], "packed": [], "place": [], "spans": []}
                if len(later):
                    out["bucket"].append(int(own[later[0]] % buckets))
                    out["packed"].append(None)
                    out["place"].append(None)
                    out["spans"].append(_spans_of(own[later], key[later], at[later], (at + last - first)[later], size))
                bucket = (anchor[lead] % np.uint64(buckets)).astype(np.int64)
                for p in _parts(bucket):
                    q = lead[p]
                    out["bucket"].append(int(bucket[p[0]]))
                    out["packed"].append(zstandard.compress(b"".join(raw[a:b] + b"\xff" for a, b in zip(first[q].tolist(), (last[q] + size).tolist(), strict=True)), 1))
                    out["place"].append(_pack((anchor[q], "u8"), (own[q], "i8"), (key[q], "i4"), (at[q], "i8")))
                    out["spans"].append(None)
                yield pa.record_batch([pa.array(out["bucket"], pa.int64()), *[pa.array(out[k], pa.binary()) for k in ("packed", "place", "spans")]], ["bucket", "packed", "place", "spans"])

    return run


def _symbols(text: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes before each position of a cyclic text, as one number."""
    out = np.zeros(len(text), np.uint64)
    for back in range(width, 0, -1):
        out = out << np.uint64(8) | np.roll(text, back).astype(np.uint64)
    return out


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.uint64)


def shard_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a cyclic text in the order of their first ``depth`` bytes or more, by prefix doubling."""
    rank = _dense(np.roll(_symbols(text, SYMBOL), -SYMBOL))
    have = SYMBOL
    while have < depth:
        rank = _dense(rank << np.uint64(32) | np.roll(rank, -have))
        have *= 2
    return np.argsort(rank, kind="stable")


def merge_transforms(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the shards' transforms: shard and position of every suffix, sorted by ``depth`` bytes, and its interval.

    An interval holds the suffixes that have their first ``depth`` bytes in common.
    """
    orders = [shard_order(t, depth) for t in shards]
    position = np.concatenate(orders)
    n = len(position)
    widths = [SYMBOL] * (depth // SYMBOL) + [depth % SYMBOL] * (depth % SYMBOL > 0)
    transform = {w: _dense(np.concatenate([_symbols(t, w)[o] for t, o in zip(shards, orders, strict=True)])) for w in set(widths)}
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(t) for t in shards])
    interval = np.zeros(n, np.int64)
    place = np.arange(n, dtype=np.uint64)
    for w in widths:
        before = np.empty(n, np.uint64)
        before[np.argsort(interleave, kind="stable")] = transform[w]  # each shard's symbols in its own order
        ordered = np.sort(before << np.uint64(32) | place)
        source = (ordered & np.uint64(0xFFFFFFFF)).astype(np.int64)
        symbol = ordered >> np.uint64(32)
        interleave, interval = interleave[source], interval[source]
        step = np.zeros(n, np.int64)
        step[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(step)
    merged = np.empty(n, np.int64)
    merged[np.argsort(interleave, kind="stable")] = position
    return interleave, merged, interval


def _later_windows(size: int, groups: int):
    def run(table: pa.Table) -> pa.Table:
        found = [_unpack(x, SPAN_KINDS) for x in table.column("spans").to_pylist() if x]
        strings: list[bytes] = []
        places = []
        for blob, place in zip(table.column("packed").to_pylist(), table.column("place").to_pylist(), strict=True):
            if blob:
                strings += zstandard.decompress(blob).split(b"\xff")[:-1]
                places.append(_unpack(place, PLACE_KINDS))
        if strings:
            anchor, ids, keys, at = (np.concatenate(x) for x in zip(*places, strict=True))
            by = np.lexsort((at, keys, ids))
            seen: dict[bytes, int] = {}
            lead, later = [], []
            for i in by.tolist():
                j = seen.setdefault(strings[i], i)
                if j == i:
                    lead.append(i)
                elif (ids[i], keys[i], at[i]) != (ids[j], keys[j], at[j]):
                    later.append(i)
            width = np.array([len(s) for s in strings])
            later = np.array(later, np.int64)
            found.append([ids[later], keys[later], at[later], at[later] + width[later]])
            lead = np.array(lead, np.int64)
            _, group, times = np.unique(anchor[lead], return_inverse=True, return_counts=True)
            lead = lead[times[group] > 1]
            if len(lead):
                cuts = np.cumsum(width[lead] + 1)
                share = np.minimum(cuts * SHARDS // (cuts[-1] + 1), SHARDS - 1)
                members = [lead[share == k] for k in range(SHARDS) if (share == k).any()]
                shards = [np.frombuffer(b"".join(strings[i] + b"\xff" for i in m), np.uint8) for m in members]
                shard, position, interval = merge_transforms(shards, size)
                begin = [np.cumsum(width[m] + 1) - width[m] - 1 for m in members]
                string, offset = np.empty(len(shard), np.int64), np.empty(len(shard), np.int64)
                for k, m in enumerate(members):
                    mine = shard == k
                    which = np.searchsorted(begin[k], position[mine], "right") - 1
                    string[mine], offset[mine] = m[which], position[mine] - begin[k][which]
                whole = (offset + size <= width[string]) & (np.bincount(interval)[interval] > 1)
                string, offset, interval = string[whole], offset[whole], interval[whole]
                start = at[string] + offset
                order = np.lexsort((start, keys[string], ids[string], interval))
                string, start, interval = string[order], start[order], interval[order]
                head = np.ones(len(start), bool)
                head[1:] = interval[1:] != interval[:-1]
                lead_at = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
                same = (ids[string] == ids[string[lead_at]]) & (keys[string] == keys[string[lead_at]]) & (start == start[lead_at])
                hit = ~same
                i, k, a = ids[string[hit]], keys[string[hit]], start[hit]
                order = np.lexsort((a, k, i))
                i, k, a = i[order], k[order], a[order]
                new = np.ones(len(a), bool)
                new[1:] = (np.diff(i) != 0) | (np.diff(k) != 0) | (np.diff(a) > 1)
                h = np.flatnonzero(new)
                if len(h):
                    t = np.append(h[1:], len(a)) - 1
                    found.append([i[h], k[h], a[h], a[t] + size])
        docs, packed = _by_documents(found, groups)
        return pa.table({"docs": pa.array(docs, pa.int64()), "packed": pa.array(packed, pa.binary())})

    return run


def _erase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        keys = batch.column(names.index("r_key")).to_numpy(zero_copy_only=False).astype(np.int64)
        for row, end, data, offsets in slices(batch.column(names.index("r_text"))):
            text, key, s, e = _ranges_of(batch.column(names.index("r_spans")), row, end, offsets)
            own = key == keys[row + text]
            gone = covered(len(data), s[own], e[own])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edges = offsets[:-1][offsets[:-1] < len(data)]
            begins[edges] = gone[edges]
            removed, spans = (np.append(0, np.cumsum(x))[offsets] for x in (gone, begins))
            left, at = data[~gone].tobytes(), offsets - removed
            kept = [left[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            rest = {k: batch.column(i).slice(row, end - row) for i, k in enumerate(names) if k not in ("r_spans", "r_text", "r_id", "r_key")}
            digest = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
            yield pa.record_batch({**rest, "n_bytes": np.diff(offsets), "n_removed": np.diff(removed), "n_spans": np.diff(spans), "kept_sha256": digest, **({"kept_bytes": pa.array(kept, pa.binary())} if "r_want" in names else {})})


def repeated_bytes(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """One row for each document: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_bytes."""
    if size < GRAM:
        raise ValueError(f"windows have {GRAM} bytes at least")
    named = docs.select(F.col(id_col).alias("r_0"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("r_id"), F.hash(text_col).alias("r_key"), F.col(text_col).alias("r_text"))
    total = named.agg(F.sum(F.octet_length("r_text"))).first()[0] or 0
    runs = total // ((size - GRAM + 2) // 2)
    anchors = named.select("r_id", "r_text").mapInArrow(_find_anchors(size, max(1, runs // RUNS_PER_BUCKET)), "bucket long, packed binary")
    groups = max(1, total // BYTES_PER_GROUP)
    known = stored(anchors.groupBy("bucket").applyInArrow(_repeated_anchors(max(2000, runs // HOT_ANCHORS), groups), "docs long, packed binary, hot long, times long"))
    hot = np.sort(np.array([r.hot for r in known.where("hot is not null").orderBy(F.desc("times"), "hot").limit(HOT_ANCHORS).select("hot").collect()], np.int64).view(np.uint64))
    of_documents = "r_id long, r_spans array<struct<r_key int, s long, e long>>"
    candidates = known.where("docs is not null").groupBy("docs").applyInArrow(_of_documents, of_documents)
    strings = named.join(candidates, "r_id").mapInArrow(_cut_strings(size, max(1, total // (2 * BYTES_PER_BUCKET)), hot), "bucket long, packed binary, place binary, spans binary")
    spans = strings.groupBy("bucket").applyInArrow(_later_windows(size, groups), "docs long, packed binary")
    # the same exchange of the documents serves both joins
    joined = named.join(spans.groupBy("docs").applyInArrow(_of_documents, of_documents), "r_id", "left")
    if with_bytes:
        joined = joined.withColumn("r_want", F.lit(True))
    kind = joined.schema["r_0"].dataType.simpleString()
    out = joined.mapInArrow(_erase, f"r_0 {kind}, " + "r_want boolean, " * with_bytes + "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_bytes)
    return out.select(F.col("r_0").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_bytes"] * with_bytes)
