"""Packing along a space-filling curve.

Each whole text becomes token ids (with a closing id).  Its hashed bag of tokens
is projected to three dimensions by fixed random signs, and the point's place on
a Hilbert curve is its key.  Documents are range-sorted by key, so neighbours on
the curve, and copies above all, stand side by side.  In that order they form one
long row of ids, cut into sequences of ``capacity``: the ids of all ranges before
a range tell where its first sequence goes on, so sequences run across ranges.
Only what is left at the very end goes into sequences whose lengths are powers of
two, so no sequence needs padding.

Scale.  One range shuffle into parts of about ``PART_IDS`` ids; the sorted rows
are written with their places in the range, and a table of the ranges' sums (one
row for each part, ``MOST_PARTS`` at most) is joined to them.  The low bits of a
key differ among equal documents, so a third of all documents with one text fills
no single part.  Ids travel as two bytes each where they fit.  Null texts are
empty: they hold the closing id alone.  A very long text is one row, in as many
pieces as it needs.  Repeated rows and null ids are packed each by itself; other
columns play no part.  No rows: no rows.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import stored
from .text import _BYTE_CODE, mix, range_hashes, slices

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
CLOSING_ID = 2
DIMENSIONS, BITS, LOW_BITS = 3, 16, 15
CACHED_PIECES = 500_000
PART_IDS = 8_000_000
MOST_PARTS = 100_000

# Fixed value of the default tokenizer: how it splits a lower-cased text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Letters that stand for bytes in its vocabulary: printable ones for themselves, the others from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
SPACE, LETTER, DIGIT, OTHER = range(4)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[97:123] = LETTER
_KIND[48:58] = DIGIT


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def latin_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``SPLIT`` matches in texts of ASCII and Latin-1 letters: lower-cased bytes, starts and ends of pieces, and texts with other characters."""
    n = len(data)
    folded = data.copy()
    folded[(data >= 65) & (data <= 90)] += 32
    two = np.zeros(n, bool)  # second bytes of U+00C0 to U+00FF
    two[1:] = data[:-1] == 0xC3
    folded[two & (data <= 0x9E) & (data != 0x97)] += 32
    kind = _KIND[folded]
    letters = np.flatnonzero(two & (folded != 0x97) & (folded != 0xB7))
    kind[letters] = kind[letters - 1] = LETTER
    first = offsets[:-1][offsets[:-1] < n]
    begins = kind != SPACE
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    begins[first] = kind[first] != SPACE

    quote = np.flatnonzero((folded == 0x27) & begins)
    stop = offsets[np.searchsorted(offsets, quote, "right")]
    x, y = (np.where(quote + k < stop, folded[np.minimum(quote + k, n - 1)], 0) for k in (1, 2))
    short = np.isin(x, np.frombuffer(b"stmd", np.uint8))
    long = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
    begins[quote[short | long] + 1] = False
    after = np.where(long, quote + 3, quote + 2)[short | long]
    after = after[after < stop[short | long]]
    begins[after] |= kind[after] == LETTER

    ends = kind != SPACE
    ends[:-1] &= begins[1:] | (kind[1:] == SPACE)
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = kind[last] != SPACE

    odd = (data >= 0x80) & ~two & (data != 0xC3)
    marks = np.flatnonzero(data == 0xE2)  # U+2010 to U+2027 are neither letters, digits nor spaces
    marks = marks[(data[marks + 1] == 0x80) & (data[marks + 2] >= 0x90) & (data[marks + 2] <= 0xA7)]
    odd[marks] = odd[marks + 1] = odd[marks + 2] = False
    odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))  # may start a special token
    return folded, np.flatnonzero(begins), np.flatnonzero(ends) + 1, np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)


class WordCoder:
    """Ids of texts, piece by piece.

    In texts of ASCII and Latin-1 letters pieces are the tokenizer's own, found
    for a slice of texts at a time; each distinct one (by a 64-bit fingerprint
    within the slice) is encoded once.  Else they stand between blanks and line
    ends, as the tokenizer drops white space and joins nothing across it.  Ids of
    about ``CACHED_PIECES`` pieces are kept.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known = _tokenizer(path), {}
        self.between = next(((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if not (t.lstrip or t.rstrip or t.single_word)), None)
        with open(path, encoding="utf-8") as f:
            splits = (json.load(f).get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.latin = [x.get("type") for x in splits] == ["Split", "ByteLevel"] and splits[0].get("pattern") == {"Regex": SPLIT}
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode many pieces in one go, a special token between them."""
        odd = pieces
        if self.between:
            number, content = self.between
            odd = [w for w in pieces if content[:1].encode() in w]
            pieces = [w for w in pieces if content[:1].encode() not in w]
            for i in range(0, len(pieces), 20_000):
                part = pieces[i : i + 20_000]
                ids = np.array(self.tokenizer.encode_batch_fast([content.encode().join(part).decode()], add_special_tokens=False)[0].ids, self.kind)
                raw, ends, width = ids.tobytes(), np.append(np.flatnonzero(ids == number), len(ids)), self.kind.itemsize
                starts = np.concatenate([[0], ends[:-1] + 1])
                self.known.update((w, raw[width * a : width * b]) for w, a, b in zip(part, starts.tolist(), ends.tolist(), strict=True))
        for w in odd:
            self.known[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, self.kind).tobytes()

    def _ids(self, pieces: list[bytes], own: bool = False) -> list[bytes]:
        """Ids of each piece; with ``own``, of pieces as the tokenizer splits them."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        if own:
            merge, kind = self.tokenizer.model.tokenize, self.kind
            self.known.update((p, np.array([t.id for t in merge(p.decode("latin-1").translate(BYTE_LETTERS))], kind).tobytes()) for p in new)
        else:
            self._learn(new)
        return [self.known[p] for p in pieces]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text of a slice as little-endian numbers of this coder's kind."""
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        texts = len(offsets) - 1
        if not self.latin:
            odd, out = np.arange(texts), [b""] * texts
        else:
            folded, starts, ends, odd = latin_pieces(data, offsets)
            text = np.searchsorted(offsets, starts, "right") - 1
            use = ~np.isin(text, odd)
            text, starts, ends = text[use], starts[use], ends[use]
            _, first, which = np.unique(range_hashes(folded, starts, ends, _BYTE_CODE), return_index=True, return_inverse=True)
            raw = folded.tobytes()
            ids = self._ids([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], own=True)
            length = np.array([len(x) for x in ids], np.int64) // self.kind.itemsize
            begin = np.cumsum(length) - length
            n = length[which]
            at = np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            coded = np.frombuffer(b"".join(ids), self.kind)[at].tobytes()
            cuts = self.kind.itemsize * np.append(0, np.cumsum(np.bincount(text, n, texts))).astype(np.int64)
            out = [coded[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for t in odd.tolist():
            out[t] = b"".join(self._ids(data[offsets[t] : offsets[t + 1]].tobytes().replace(b"\n", b" ").split(b" ")))
        return out


@lru_cache(maxsize=2)
def _coder(path: str) -> WordCoder:
    """One for each worker process, so that it lasts over tasks."""
    return WordCoder(path)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2**bits (one row each)."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of each level
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        fix ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= fix
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def curve_keys(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose ids stand one after the other."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sums = np.zeros((DIMENSIONS, len(ids) + 1), np.int64)
    for k in range(DIMENSIONS):
        np.cumsum(((h >> np.uint64(40 + k)) & np.uint64(1)).astype(np.int64) * 2 - 1, out=sums[k, 1:])
    ends = np.cumsum(lengths)
    point = (sums[:, ends] - sums[:, ends - lengths]) / np.sqrt(np.maximum(lengths, 1))
    return hilbert_key(((np.tanh(point / 8) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64).T)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        closing = np.array([CLOSING_ID], coder.kind).tobytes()
        row = np.uint64(TaskContext.get().partitionId() << 40)
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                blobs = [b + closing for b in coder.encode(data, offsets)]
                lengths = np.array([len(b) for b in blobs]) // len(closing)
                low = mix(np.arange(len(blobs), dtype=np.uint64) + row) >> np.uint64(64 - LOW_BITS)
                row += np.uint64(len(blobs))
                key = curve_keys(np.frombuffer(b"".join(blobs), coder.kind), lengths) << LOW_BITS | low.astype(np.int64)
                yield pa.record_batch([batch.column(0).slice(first, last - first), pa.array(key), pa.array(lengths.astype(np.int64)), pa.array(blobs, pa.binary())], ["id", "key", "n", "ids"])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of the part, and the ids that stand before each document in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(2).to_numpy()
        before = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pa.record_batch([batch.column(0), pa.array(n), batch.column(3), pa.array(np.full(len(n), part, np.int32)), pa.array(before)], ["id", "n", "ids", "part", "before"])


def sequence_starts(total: int, capacity: int) -> list[int]:
    """Where the sequences of the rest start that doesn't fill ``capacity``, by powers of two, and the end."""
    starts = [total - total % capacity]
    while starts[-1] < total:
        starts.append(starts[-1] + (1 << ((total - starts[-1]).bit_length() - 1)))
    return starts


def _pieces(total: int, capacity: int):
    rest = sequence_starts(total, capacity)
    whole = rest[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, length, crc, tokens, sequence, offset = ([] for _ in range(7))
            for i, (n, blob, at) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                ids = memoryview(np.frombuffer(blob, f"<u{len(blob) // n}").astype("<u4").tobytes())
                cuts = [*range(at - at % capacity + capacity, min(at + n, whole), capacity), *(x for x in rest if at < x < at + n)]
                for a, b in zip([at, *cuts], [*cuts, at + n], strict=True):
                    k = max(0, bisect_right(rest, a) - 1)
                    row.append(i)
                    start.append(a - at)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * (a - at) : 4 * (b - at)]))
                    tokens.append(n)
                    sequence.append(a // capacity if a < whole else whole // capacity + k)
                    offset.append(a % capacity if a < whole else a - rest[k])
            yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens, sequence, offset))], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", part_ids: int = PART_IDS) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece of a document.

    ``tokenizer`` is a path that every executor can open; a public one by default.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    encoded = stored(named.mapInArrow(_encode(path), f"id {kind}, key long, n long, ids binary"))
    total = encoded.agg(F.sum("n")).first()[0] or 0
    parts = min(MOST_PARTS, max(1, -(-total // part_ids)))
    ordered = encoded.repartitionByRange(parts, "key").sortWithinPartitions("key")
    placed = stored(ordered.mapInArrow(_places, f"id {kind}, n long, ids binary, part int, before long"))
    sums = placed.groupBy("part").agg(F.sum("n").alias("of_part"))
    base = sums.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("base"))
    at = placed.join(F.broadcast(base), "part").select("id", "n", "ids", (F.col("base") + F.col("before")).alias("at"))
    out = at.mapInArrow(_pieces(total, capacity), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
