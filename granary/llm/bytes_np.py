"""Word spans and hashes of whole Arrow text columns, computed on their UTF-8 bytes.

All functions work inside a task on one Arrow batch. Words are runs of bytes other than
space and 0x09-0x0D, which are the runs ``[^\\x20\\x09-\\x0D]+`` of the decoded text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer text or word is still handled whole.
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: As _TABLE, with A-Z hashed as a-z.
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or have.size < n:
        with np.errstate(over="ignore"):
            row = np.full(max(n, BLOCK + 4096), base, np.uint64)
            row[0] = 1
            have = _powers[name] = np.multiply.accumulate(row)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and its row offsets; null is empty."""
    kind = pa.large_binary()
    column = column.cast(kind) if column.type in (pa.binary(), kind) else column.cast(pa.large_string()).cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any span of ``buf``."""
    out = np.zeros(buf.size + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_TABLE[buf] * _power("up", _BASE, buf.size), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (sums[end] - sums[start]) * _power("down", _INVERSE, sums.size)[start]


@dataclass
class Words:
    start: np.ndarray  # byte offset in the column
    end: np.ndarray
    row: np.ndarray  # row of the column, ascending
    hash: np.ndarray  # 64 bits
    first: np.ndarray  # index of each row's first word, one more entry than rows


def words(buf: np.ndarray, at: np.ndarray, lower: bool = False, separator: np.ndarray = SPACE) -> Words:
    n = buf.size
    rows = at.size - 1
    word = ~separator.take(buf)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~word[:-1]
    after[:-1] = ~word[1:]
    start = np.flatnonzero(word & (before | edge[:-1]))
    end = np.flatnonzero(word & (after | edge[1:])) + 1
    row = np.searchsorted(at, start, "right") - 1
    table, out = _LOWER if lower else _TABLE, np.empty(start.size, np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < start.size:
            j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
            lo, hi = int(start[i]), int(end[j - 1])
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(table.take(buf[lo:hi]) * _power("up", _BASE, hi - lo), out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * _power("down", _INVERSE, hi - lo)[s]
            i = j
    return Words(start, end, row, mix(out), np.searchsorted(row, np.arange(rows + 1)))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k-word window that lies in one row, and the index of its first word."""
    n = w.hash.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = w.hash[:n].copy()
        for i in range(1, k):
            h = mix(h * _BASE + w.hash[i : n + i])
    ok = np.flatnonzero(w.row[:n] == w.row[k - 1 :])
    return h[ok], ok


def slices(batch: pa.RecordBatch, text: str, size: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Cut a batch between rows so that a slice holds about ``size`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
