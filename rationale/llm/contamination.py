"""Benchmark decontamination: a broadcast hash set of test n-grams, and one scan of the training texts.

A word is a maximal run of ASCII letters, digits and bytes beyond ASCII, with A-Z
lower-cased.  A window is ``SIZE`` consecutive words of a test item; an item with
fewer words is one window as a whole.  The distinct windows, as text and 64-bit
fingerprint, are copied to every task.  There each run of as many words of a
document is looked up, first in a bitmap, then among the sorted fingerprints, and
every hit is compared as text before it counts.  A word inside any occurrence of a
window is hit; maximal runs of hit words are spans.  Spans can be cut out of the
texts, or documents with hits dropped.

Scale.  The documents are read once, and nothing of them is shuffled; their number
doesn't matter to the memory of a task, which holds the set and a slice of texts.
Items are cut to pieces of ``PIECE`` windows and collected a block of at most
``BLOCK`` bytes (and one piece) at a time, so what is copied is bounded.  Items of
more than one block, which a benchmark hardly has, take one scan of the documents
for each block; the spans of a document, found in several scans, are then joined
by row.  A passage that stands in a third of all documents costs its comparison in
each of them and no more.

Null and empty texts have no words and no hits; a null or empty item has no window;
an item without an id (null) hits words but isn't listed; items that share an id
are one item.  Repeated rows have equal results; texts of any length are scanned
whole; further columns go along (``carry``) or are kept (``decontaminated``),
whatever their names.  No documents: no rows; no items: no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .session import stored
from .text import Words, covered, equal_neighbours, runs_of, slices

SIZE = 10
PIECE = 4096
BLOCK = 16 << 20
CHUNK = 1 << 20  # bytes compared at a time
SPANS = "array<struct<first:long,last:long,start:long,end:long>>"

_NORMAL = np.full(256, 0x20, np.uint8)
_NORMAL[0x30:0x3A] = np.arange(0x30, 0x3A)
_NORMAL[0x41:0x5B] = np.arange(0x61, 0x7B)
_NORMAL[0x61:0x7B] = np.arange(0x61, 0x7B)
_NORMAL[0x80:] = np.arange(0x80, 0x100)


def normal_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(_NORMAL[data], offsets)


def _pieces(size: int):
    """(item, text): the normal words of each item joined by spaces, in pieces that share no window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, _, data, offsets in slices(batch.column(1)):
                words = normal_words(data, offsets)
                text, at = words.joined()
                items, out = [], []
                for i, n in enumerate(words.counts.tolist()):
                    base, windows = int(words.first[i]), max(n - size + 1, min(n, 1))
                    for w in range(0, windows, PIECE):
                        end = base + min(min(w + PIECE, windows) + size - 1, n)
                        items.append(names[first + i])
                        out.append(text[at[base + w] : at[end] - 1])
                yield pa.record_batch({"item": pa.array(items, pa.string()), "text": pa.array(out, pa.binary())})

    return run


def _blocks(pieces: DataFrame, limit: int) -> Iterator[tuple[list, list]]:
    """Items and texts of a bounded number of bytes at a time; at least one block."""
    names, texts, held = [], [], 0
    for row in pieces.toLocalIterator():
        if held and held + len(row.text) > limit:
            yield names, texts
            names, texts, held = [], [], 0
        names.append(row["item"])
        texts.append(bytes(row.text))
        held += len(row.text)
    yield names, texts


def _flat(starts: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one range after the other."""
    before = np.cumsum(width) - width
    return np.repeat(starts - before, width) + np.arange(int(width.sum()))


class _Grams:
    """The distinct windows of one length: sorted fingerprints, places in the text, numbers of their lists of items."""

    def __init__(self, words: Words, text: bytes, at: np.ndarray, size: int, chosen: np.ndarray, item_of: np.ndarray, lists: dict):
        first, codes = words.windows(size)
        mine = chosen[words.text[first]]
        first, codes = first[mine], codes[mine]
        order, same = equal_neighbours(codes, lambda i: text[at[first[i]] : at[first[i] + size] - 1])
        head = np.flatnonzero(~same)
        items = item_of[words.text[first[order]]]
        last = np.append(head[1:], len(order))
        group = [tuple(sorted(set(items[a:b].tolist()) - {-1})) for a, b in zip(head.tolist(), last.tolist(), strict=True)]
        self.size = size
        place, codes = first[order][head], codes[order][head]
        numbers = np.array([lists.setdefault(g, len(lists)) for g in group], np.int64)
        order = np.argsort(codes, kind="stable")  # the order above isn't by fingerprint where two texts shared one
        self.codes, self.lists = codes[order], numbers[order]
        self.starts, self.ends = at[place[order]], at[place[order] + size] - 1
        self.shift = np.uint64(64 - min(max((8 * len(self.codes)).bit_length(), 12), 25))
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bitmap[self.codes >> self.shift] = True

    def candidates(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number of the window) of each pair with equal fingerprints."""
        first, codes = words.windows(self.size)
        some = np.flatnonzero(self.bitmap[codes >> self.shift])
        lo = np.searchsorted(self.codes, codes[some])
        n = np.searchsorted(self.codes, codes[some], "right") - lo
        return np.repeat(first[some], n), _flat(lo, n)


class WindowSet:
    """The windows of a block of items, ready to be looked up."""

    def __init__(self, names: list, texts: list[bytes], size: int):
        known = sorted({n for n in names if n is not None})
        self.names = np.array(known, object)
        number = {n: i for i, n in enumerate(known)} | {None: -1}
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        words = normal_words(np.frombuffer(b"".join(texts), np.uint8), offsets)
        joined, at = words.joined()
        self.text = np.frombuffer(joined, np.uint8)
        length = np.minimum(words.counts, size)
        item_of = np.array([number[n] for n in names], np.int64)
        lists: dict[tuple, int] = {}
        self.grams = [_Grams(words, joined, at, int(s), length == s, item_of, lists) for s in np.unique(length[length > 0])]
        self.lists = list(lists)

    def scan(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are hit, and the (text, list of items) pairs found."""
        hit = np.zeros(len(words), bool)
        pairs, joined = [], None
        for g in self.grams:
            first, window = g.candidates(words)
            if not len(first):
                continue
            if joined is None:
                joined, at = words.joined()
                joined = np.frombuffer(joined, np.uint8)
            equal = self._equal(joined, at[first], at[first + g.size] - 1, g.starts[window], g.ends[window])
            first, window = first[equal], window[equal]
            hit |= covered(len(words), first, first + g.size)
            pairs.append(words.text[first] * len(self.lists) + g.lists[window])
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return hit, both // max(len(self.lists), 1), both % max(len(self.lists), 1)

    def _equal(self, theirs: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Whether theirs[a:b] is text[c:d], a stretch of bytes at a time."""
        out = b - a == d - c
        some = np.flatnonzero(out)
        width = (b - a)[some]
        part = np.cumsum(width) // CHUNK
        for i in np.split(np.arange(len(some)), np.flatnonzero(np.diff(part)) + 1):
            if len(i):
                w = width[i]
                same = theirs[_flat(a[some[i]], w)] == self.text[_flat(c[some[i]], w)]
                out[some[i]] = np.logical_and.reduceat(same, np.cumsum(w) - w)
        return out


def _scanned(windows, at: int, keep: list[int], all_rows: bool):
    """Adds n_words, n_hit, spans and item_ids to the columns ``keep``; rows without a hit may be left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = windows.value
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(at)):
                words = normal_words(data, offsets)
                hit, text, lists = found.scan(words)
                n_hit = np.bincount(words.text[hit], minlength=last - first)
                begin, end = _spans(words, hit)
                of_text = np.searchsorted(words.text[begin], np.arange(last - first + 1)) if len(begin) else np.zeros(last - first + 1, np.int64)
                base = offsets[words.text[begin]]
                spans = pa.StructArray.from_arrays([pa.array(x) for x in (begin - words.first[words.text[begin]], end - words.first[words.text[begin]], words.starts[begin] - base, words.ends[end - 1] - base)], ["first", "last", "start", "end"])
                cut = np.searchsorted(text, np.arange(last - first + 1))
                cache: dict[bytes, list[str]] = {}  # copies of a passage have one list
                items = []
                for i in range(last - first):
                    mine = lists[cut[i] : cut[i + 1]]
                    if mine.tobytes() not in cache:
                        cache[mine.tobytes()] = found.names[sorted(set().union(*(found.lists[k] for k in mine)))].tolist() if len(mine) else []
                    items.append(cache[mine.tobytes()])
                columns = [batch.column(k).slice(first, last - first) for k in keep]
                columns += [pa.array(words.counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.ListArray.from_arrays(pa.array(of_text.astype(np.int32)), spans), pa.array(items, pa.list_(pa.string()))]
                out = pa.record_batch(columns, [*(batch.schema.names[k] for k in keep), "n_words", "n_hit", "spans", "item_ids"])
                yield out if all_rows else out.filter(pa.array(n_hit > 0))

    return run


def _spans(words: Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and last word + 1 of each maximal run of hit words inside one text."""
    begin, end = runs_of(hit)
    inner = words.first[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(hit))])
    inner = inner[hit[inner] & hit[inner - 1]]
    return np.sort(np.concatenate([begin, inner])), np.sort(np.concatenate([end, inner]))


def _joined_spans(found: DataFrame) -> DataFrame:
    """(r_row, n_hit, spans, item_ids): the finds of all scans of a row as one; overlapping and adjacent spans unite."""
    each = found.select("r_row", F.explode("spans").alias("s")).select("r_row", "s.*")
    before = Window.partitionBy("r_row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("r_row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)
    islands = each.withColumn("new", F.coalesce(F.col("first") > F.max("last").over(before), F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(so_far))
    spans = islands.groupBy("r_row", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("r_row").agg(F.sum(F.col("last") - F.col("first")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("first", "last", "start", "end"))).alias("spans"))
    items = found.groupBy("r_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    return spans.join(items, "r_row")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = (), size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """(id, carried columns, n_words, n_hit, spans, item_ids) for each document.

    A span has its first word and the one behind its last, and the same as byte
    offsets; ``item_ids`` are sorted as strings.
    """
    spark = docs.sparkSession
    # positions, not names, lead to the columns; these names can't clash with carried ones
    rows = docs.select(F.col(id_col).alias("r_id"), F.col(text_col).alias("r_text"), *[F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)])
    names = {"r_id": id_col, **{f"c_{i}": c for i, c in enumerate(carry)}}
    kept = rows.drop("r_text").schema.fields
    added = StructType.fromDDL(f"n_words long, n_hit long, spans {SPANS}, item_ids array<string>")
    ends = ["n_words", "n_hit", "spans", "item_ids"]
    pieces = stored(items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).mapInArrow(_pieces(size), "item string, text binary"))
    if pieces.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] <= block:
        windows = spark.sparkContext.broadcast(WindowSet(*next(_blocks(pieces, block)), size))
        keep = [i for i, c in enumerate(rows.columns) if c != "r_text"]
        out = rows.mapInArrow(_scanned(windows, 1, keep, True), StructType([*kept, *added]))
    else:
        rows = stored(rows.withColumn("r_row", F.monotonically_increasing_id()))
        found, texts, kept = None, rows.select("r_row", "r_text"), rows.drop("r_text").schema.fields
        for part in _blocks(pieces, block):
            windows = spark.sparkContext.broadcast(WindowSet(*part, size))
            one = stored(texts.mapInArrow(_scanned(windows, 1, [0], False), StructType([*texts.schema.fields[:1], *added])))
            windows.destroy()
            found = one if found is None else found.union(one)
        counted = rows.mapInArrow(_counted(1, [i for i, c in enumerate(rows.columns) if c != "r_text"]), StructType([*kept, *added.fields[:1]]))
        out = counted.join(_joined_spans(found), "r_row", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "spans": F.coalesce("spans", F.array().cast(SPANS)), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})
    return out.select(*[F.col(k).alias(v) for k, v in names.items()], *ends)


def _counted(at: int, keep: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [normal_words(data, offsets).counts for _, _, data, offsets in slices(batch.column(at))]
            yield pa.record_batch([*(batch.column(k) for k in keep), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64))], [*(batch.schema.names[k] for k in keep), "n_words"])

    return run


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` less its spans; what stands around them, white space included, stays."""
    raw = F.encode(text, "UTF-8")
    begin = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    end = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text).cast("long")))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.zip_with(begin, end, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8")), ""))


def decontaminated(docs: DataFrame, items: DataFrame, remove: str = "spans", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """``docs`` without the hit words (``remove="spans"``) or without the documents that hold any (``"documents"``)."""
    if remove not in ("spans", "documents"):
        raise ValueError("spans or documents can be removed")
    rows = docs.select(F.col(id_col), F.col(text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r_all"))
    out = contamination(rows, items, id_col, text_col, item_col, item_text_col, ("r_all",), size, block)
    if remove == "documents":
        return out.where("n_hit = 0").select("r_all.*")
    return out.select(*[(without_spans(F.col(f"r_all.`{c}`"), F.col("spans")) if c == text_col else F.col(f"r_all.`{c}`")).alias(c) for c in docs.columns])


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each document."""
    found = contamination(docs, items)
    listed = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
