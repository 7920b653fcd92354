"""Texts of an Arrow batch as one byte array, and hashes of words and byte windows computed over it.

All functions take whole texts. A batch is handled in slices of a few MB of text (a longer text is a slice of
its own), so memory follows the longest text, never the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20


def _odd(n: int) -> int:
    return (n * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % 2**64 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes: every input bit reaches every output bit (murmur-style finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end and their n + 1 offsets; null counts as empty."""
    column = column.fill_null("").cast(pa.binary()).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``size`` bytes each, at least one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def batch_slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of each slice of a batch."""
    data, offsets = text_bytes(batch.column(text))
    for a, b in slices(offsets, size):
        yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


class Hasher:
    """Polynomial hashes modulo 2^64 of any byte range of an array, through one running sum.

    Each byte value stands for a fixed random 64-bit number. The powers of the odd base grow on demand and are
    kept for the life of a task.
    """

    def __init__(self, seed: int = 1):
        self.base = _odd(seed + 10)
        self.inverse = pow(self.base, -1, 2**64)
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_odd(seed)))
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte range; equal bytes give equal hashes wherever they stand."""
        raw = (sums[ends] - sums[starts]) * self.down[starts]
        return mix(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))


def white_bytes() -> np.ndarray:
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    return white


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words (runs without space and \\x09-\\x0D), and the row of each."""
    inside = ~white_bytes()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    finishes[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(offsets, starts, "right") - 1


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a row, and their rows.

    A row with fewer words gives one shingle of all its words; a row without words gives none.
    """
    counts = np.bincount(rows, minlength=n_rows)
    weights = [np.uint64(_odd(100 + i)) for i in range(width)]
    n = len(words)
    parts, owners = [], []
    if n >= width:
        total = np.zeros(n - width + 1, np.uint64)
        for i, w in enumerate(weights):
            total += mix(words[i : n - width + 1 + i] + w) * w
        whole = rows[: n - width + 1] == rows[width - 1 :]
        parts.append(mix(total[whole]))
        owners.append(rows[: n - width + 1][whole])
    first = np.concatenate(([0], np.cumsum(counts)))
    for row in np.flatnonzero((counts > 0) & (counts < width)):
        run = words[first[row] : first[row + 1]]
        total = np.uint64(len(run))
        with np.errstate(over="ignore"):
            for w, x in zip(weights, run):
                total += mix(np.array([x + w]))[0] * w
        parts.append(mix(np.array([total])))
        owners.append(np.array([row]))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return hashes[order], owner[order]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased, other letters as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
