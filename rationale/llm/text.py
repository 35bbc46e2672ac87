"""Words and rolling fingerprints over Arrow text columns, vectorised with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Texts are
handled as the Arrow data buffer of a batch, in slices of bounded size; a null
text is an empty one.  A text beyond that size comes alone, and its fingerprints
are still computed a stretch of bytes at a time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
STRETCH = 1 << 17  # bytes or codes that are summed up at a time
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xA0761D6478BD642B)  # 3 mod 8, so 1 - base has a single factor two

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_CODE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED_CODE = _BYTE_CODE.copy()
_FOLDED_CODE[65:91] = _BYTE_CODE[97:123]


def release() -> None:
    """Give freed memory back to the system: worker processes live on over stages, and idle ones count too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    return _power_table(1 << max(20, n.bit_length()))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """S with S[0] = 0 and S[i] = sum of codes[j] * base**j over j < i."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A fingerprint of each sequence codes[start:end], equal for equal sequences."""
    _, down = powers(len(sums))
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _GOLDEN)


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of codes[start:end] for sorted starts and sorted ends, a stretch of codes at a time.

    With a table, ``codes`` are numbers of its entries.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(int(np.searchsorted(ends, lo + STRETCH, "right")), i + 1)
        part = codes[lo : ends[j - 1]]
        out[i:j] = range_hash(prefix_sums(part if table is None else table[part]), starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``limit`` bytes: first row, last row + 1, their bytes, offsets from 0.

    A text longer than ``limit`` comes alone.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.binary() if pa.types.is_binary(column.type) else pa.string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.binary() else "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int32, n + 1, column.offset * 4).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """The words of a slice of texts: byte ranges, text number and 64-bit code of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False):
        self.data, self.offsets = data, offsets
        solid = np.zeros(len(data) + 2, dtype=bool)
        solid[1:-1] = ~_IS_SPACE[data]
        begins = solid[1:-1] & ~solid[:-2]
        stops = solid[1:-1] & ~solid[2:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] |= solid[1:-1][edges]
        stops[edges - 1] |= solid[1:-1][edges - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)  # words of text t: first[t] .. first[t + 1]
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.codes = range_hashes(data, self.starts, self.ends, _FOLDED_CODE if fold else _BYTE_CODE)

    def __len__(self) -> int:
        return len(self.starts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and fingerprint of each run of ``size`` words inside one text."""
        if len(self) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[: len(self) - size + 1] == self.text[size - 1 :])
        return at, range_hashes(self.codes, at, at + size)

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words, each followed by one space, and where each word starts in that."""
        width = self.ends - self.starts + 1
        at = np.zeros(len(self) + 1, np.int64)
        np.cumsum(width, out=at[1:])
        out = np.full(at[-1], 0x20, np.uint8)
        keep = np.ones(at[-1], bool)
        keep[at[1:] - 1] = False
        out[keep] = self.data[~_IS_SPACE[self.data]]
        return out.tobytes(), at


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys."""
    out, have = keys, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def equal_neighbours(codes: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal texts side by side (stable), and which equals the one before it.

    Fingerprints decide the order; every pair that they call equal is compared
    as text.  Should two texts share a fingerprint, the texts themselves are
    numbered and sorted instead.
    """
    order = np.argsort(codes, kind="stable")
    same = np.zeros(len(codes), bool)
    same[1:] = codes[order][1:] == codes[order][:-1]
    later = np.flatnonzero(same)
    if all(text_of(a) == text_of(b) for a, b in zip(order[later - 1].tolist(), order[later].tolist(), strict=True)):
        return order, same
    numbers: dict[bytes, int] = {}
    exact = [numbers.setdefault(text_of(i), len(numbers)) for i in range(len(codes))]
    return equal_neighbours(np.array(exact, np.uint64), text_of)


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true flags."""
    padded = np.zeros(len(flags) + 2, np.int8)
    padded[1:-1] = flags
    edge = np.diff(padded)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the ranges."""
    depth = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(depth)[:n] > 0
