"""Substring dedup over words, by super-k-mer partitioning.

A window is ``size`` consecutive words of one document.  Every word covered by
a window whose word sequence also starts anywhere else is removed, all copies
alike.  Neighbouring windows mostly share their minimiser (the least of their
short word grams in a fixed order), so a run of such windows travels as one
packed string to the bucket of that minimiser.  Equal windows have equal
minimisers and meet in one bucket, where sorting finds those that occur twice.

Scale.  Each slice of text (about 2 MB) settles the repeats within itself and
forwards one copy of each of its windows, so a passage in a third of all
documents reaches its bucket once a slice.  Word grams that are frequent over
all documents come last in the order of minimisers, so a common line that stands
in ever new surroundings gathers no bucket; their list has a fixed maximum,
changes only where windows meet, and never what is found.  The number of buckets
follows the number of words.

Null texts have no words; documents without a full window lose nothing; a row
that stands twice is two documents, so its windows repeat.  No rows: no rows.
Columns besides id and text are carried along on request, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, covered, equal_neighbours, release, runs_of, slices, sliding_min

WINDOW = 35
GRAM = 4
BUCKET_WORDS = 500_000
HEAVY_GRAMS = 50_000  # at most so many grams are put last in the order
HEAVY_IN_SLICE = 8
NO_ID = -(1 << 63)


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a, np.int64).tobytes() for a in arrays), 1)


def _unpack(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), np.int64).reshape(n, -1)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams, counts, total = [], [], 0
        for _, _, data, offsets in slices(batch.column(0)):
            words = Words(data, offsets)
            total += len(words)
            found, n = np.unique(words.windows(GRAM)[1], return_counts=True)
            grams.append(found[n >= HEAVY_IN_SLICE].view(np.int64))
            counts.append(n[n >= HEAVY_IN_SLICE])
        gram = np.concatenate([*grams, [0]]).astype(np.int64)
        n = np.concatenate([*counts, [total]]).astype(np.int64)
        is_total = np.zeros(len(n), bool)
        is_total[-1] = True
        yield pa.record_batch({"gram": gram, "n": n, "is_total": is_total})


def _survey(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Words of all documents, and the grams to put last (a sorted list of bounded length)."""
    counts = docs.select("text").mapInArrow(_gram_counts, "gram long, n long, is_total boolean").groupBy("is_total", "gram").agg(F.sum("n").alias("n"))
    total = counts.where("is_total").agg(F.sum("n")).first()[0] or 0
    rows = counts.where(f"not is_total and n >= {max(64, total // (2 * HEAVY_GRAMS))}").orderBy(F.desc("n"), "gram").limit(HEAVY_GRAMS).select("gram").toArrow()
    return total, np.sort(rows.column("gram").to_numpy().view(np.uint64))


def _repeats(words: Words, size: int):
    """Windows of the words; which of them occur twice; which is the first of its kind; the packed text and its word starts."""
    at, codes = words.windows(size)
    packed, begin = words.joined()
    lo, hi = begin[at], begin[at + size] - 1 if len(at) else at
    order, same = equal_neighbours(codes, lambda i: packed[lo[i] : hi[i]])
    later = np.zeros(len(at), bool)
    later[order[same]] = True
    twice = later.copy()
    twice[order[np.flatnonzero(same) - 1]] = True
    return at, twice, ~later, packed, begin


def _scatter(size: int, buckets: int, heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, _, data, offsets in slices(batch.column(2)):
                words = Words(data, offsets)
                at, twice, ahead, packed, begin = _repeats(words, size)
                if not len(at):
                    continue
                flags = np.zeros(len(words), bool)
                flags[at[twice]] = True
                s, e = runs_of(flags)
                text = words.text[s]
                out = {"bucket": [], "packed": [], "place": [], "spans": []}
                if len(s):
                    into = words.first[text]
                    out["bucket"].append(int(ids[first + text[0]] % buckets))
                    out["packed"].append(None)
                    out["place"].append(None)
                    out["spans"].append(_pack(ids[first + text], keys[first + text], s - into, e - 1 + size - into))
                at = at[ahead]
                grams = np.zeros(len(words), np.uint64)
                where, codes = words.windows(GRAM)
                grams[where] = codes
                order = (grams >> np.uint64(33)) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64)
                if len(heavy):
                    near = np.minimum(np.searchsorted(heavy, grams), len(heavy) - 1)
                    order |= (heavy[near] == grams).astype(np.uint64) << np.uint64(63)
                least = (sliding_min(order, size - GRAM + 1)[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) != 1) | (np.diff(least) != 0)
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(at)) - 1
                bucket = (grams[least[head]] % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[by])) + 1
                lo, hi = begin[at[head]], begin[at[tail] + size] - 1
                text = words.text[at[head]]
                for part in np.split(by, cuts):
                    out["bucket"].append(int(bucket[part[0]]))
                    strings = [packed[a:b] for a, b in zip(lo[part].tolist(), hi[part].tolist(), strict=True)]
                    out["packed"].append(zstandard.compress(b"\n".join(strings), 1))
                    own = first + text[part]
                    out["place"].append(_pack(ids[own], keys[own], at[head[part]] - words.first[text[part]]))
                    out["spans"].append(None)
                yield pa.record_batch([pa.array(out["bucket"], pa.int64()), pa.array(out["packed"], pa.binary()), pa.array(out["place"], pa.binary()), pa.array(out["spans"], pa.binary())], ["bucket", "packed", "place", "spans"])

    return run


def _gather(size: int):
    def run(table: pa.Table) -> pa.Table:
        found = [_unpack(x, 4) for x in table.column("spans").to_pylist() if x]
        packed = [zstandard.decompress(x) for x in table.column("packed").to_pylist() if x]
        if packed:
            place = np.concatenate([_unpack(x, 3) for x in table.column("place").to_pylist() if x], axis=1)
            data = np.frombuffer(b"\n".join(packed), np.uint8)
            words = Words(data, np.concatenate([[0], np.flatnonzero(data == 0x0A) + 1, [len(data)]]))
            at, twice, *_ = _repeats(words, size)
            flags = np.zeros(len(words), bool)
            flags[at[twice]] = True
            s, e = runs_of(flags)
            run_no = words.text[s]
            shift = place[2, run_no] - words.first[run_no]
            found.append(np.stack([place[0, run_no], place[1, run_no], s + shift, e - 1 + size + shift]))
        all_found = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        release()
        return pa.table({"r_id": all_found[0], "r_key": all_found[1].astype(np.int32), "s": all_found[2], "e": all_found[3]})

    return run


def repeated_spans(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(r_id, r_key, s, e): word ranges [s, e) covered by repeated windows, perhaps overlapping.

    ``docs`` has r_id long, r_key int and text; r_id and r_key name a document.
    """
    total, heavy = _survey(docs)
    buckets = max(1, 3 * total // BUCKET_WORDS)
    runs = docs.select("r_id", "r_key", "text").mapInArrow(_scatter(size, buckets, heavy), "bucket long, packed binary, place binary, spans binary")
    return runs.groupBy("bucket").applyInArrow(_gather(size), "r_id long, r_key int, s long, e long")


def _apply_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        where = batch.column(names.index("r_spans"))
        for first, last, data, offsets in slices(batch.column(names.index("r_text"))):
            total, gone, digest, kept, cut = [], [], [], [], []
            raw = data.tobytes() if "r_want" in names else b""
            words = Words(data, offsets)
            packed, begin = words.joined()
            for t, ranges in enumerate(where.slice(first, last - first).to_pylist()):
                lo, n = int(words.first[t]), int(words.counts[t])
                rest_of = raw[offsets[t] : offsets[t + 1]] if raw else b""
                if not ranges:
                    left, removed = packed[begin[lo] : begin[lo + n] - 1] if n else b"", 0
                else:
                    s, e = np.array([(r["s"], r["e"]) for r in ranges], np.int64).T
                    mask = covered(n, s, e)
                    removed = int(mask.sum())
                    left = b" ".join(packed[begin[lo + a] : begin[lo + b] - 1] for a, b in zip(*(x.tolist() for x in runs_of(~mask)), strict=True))
                    if raw:  # a removed run goes with the white space behind it
                        edge = [offsets[t], *(x for a, b in zip(*(y.tolist() for y in runs_of(mask)), strict=True) for x in (words.starts[lo + a], words.starts[lo + b] if b < n else offsets[t + 1])), offsets[t + 1]]
                        rest_of = b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
                cut.append(rest_of)
                total.append(n)
                gone.append(removed)
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            rest = {k: batch.column(i).slice(first, last - first) for i, k in enumerate(names) if k not in ("r_spans", "r_text")}
            text = {k: pa.array(x, pa.binary()).cast(pa.string()) for k, x in (("r_kept", kept), ("r_cut", cut))} if "r_want" in names else {}
            release()
            yield pa.record_batch({**rest, "r_words": pa.array(total, pa.int64()), "r_removed": pa.array(gone, pa.int64()), "r_sha": pa.array(digest, pa.string()), **text})


def substring_dedup(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """One row for each document: id, carried columns, n_words, n_removed, kept_sha256 and, if asked for, kept_text and cut_text.

    In kept_text the kept words are joined by one space; cut_text is the text
    itself without the removed words and the white space behind them.
    """
    named = docs.select(F.col(id_col).alias("r_0"), *[F.col(c).alias(f"r_c{i}") for i, c in enumerate(carry)], F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("r_id"), F.hash(text_col).alias("r_key"), F.col(text_col).alias("r_text"))
    spans = repeated_spans(named.select("r_id", "r_key", F.col("r_text").alias("text")), size)
    spans = spans.groupBy("r_id", "r_key").agg(F.collect_set(F.struct("s", "e")).alias("r_spans"))
    joined = named.join(spans, ["r_id", "r_key"], "left").drop("r_id", "r_key")
    if with_text:
        joined = joined.withColumn("r_want", F.lit(True))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name not in ("r_spans", "r_text")]
    out = joined.mapInArrow(_apply_spans, ", ".join([*kinds, "r_words long, r_removed long, r_sha string", *["r_kept string, r_cut string"] * with_text]))
    return out.select(F.col("r_0").alias(id_col), *[F.col(f"r_c{i}").alias(c) for i, c in enumerate(carry)], F.col("r_words").alias("n_words"), F.col("r_removed").alias("n_removed"), F.col("r_sha").alias("kept_sha256"), *[F.col("r_kept").alias("kept_text"), F.col("r_cut").alias("cut_text")] * with_text)
