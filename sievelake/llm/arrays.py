"""Texts as numpy byte arrays: whole Arrow batches are hashed, split and compared without a Python loop per word."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd base of the rolling hash, its inverse modulo 2**64, and odd factors for combining hashes.
BASE = 0x9E3779B97F4A7C15
FACTORS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], U64)
#: A random word for each byte value, so that the hash isn't linear in the bytes.
BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: Text bytes handled at once by the array code.
CHUNK = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

_powers = [np.ones(1, U64), np.ones(1, U64)]


def tune(spark) -> None:
    """Small Arrow batches, as some texts are very long: at most 16 MB or 1000 rows go to Python at once."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))):
        try:
            spark.conf.set(key, value)
        except Exception as e:  # an older Spark doesn't know the second setting
            if "maxBytes" not in key:
                raise e


def rested(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, which gives freed memory back to the system at its end: a Python worker lives on for later tasks of other kinds, and what each kind holds at its peak would add up."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * FACTORS[0]
    x = x ^ (x >> U64(27))
    x = x * FACTORS[1]
    return x ^ (x >> U64(31))


class Rolling:
    """Hash of any byte range of a buffer, after one pass. Linear in the bytes, so for ranges under 512 bytes only: longer ones can be built to collide."""

    def __init__(self, buf: np.ndarray, table: np.ndarray = BYTE):
        p, self.inv = powers(len(buf))
        self.h = np.zeros(len(buf) + 1, U64)
        np.cumsum(table[buf] * p[: len(buf)], out=self.h[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.h[end] - self.h[start]) * self.inv[start] + (end - start).astype(U64) * FACTORS[2])


#: Eight-byte lanes of a word that are mixed in numpy; longer words are digested one by one. What is kept of a lane of 0 to 8 bytes.
LANES = 8
_KEPT = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges. Eight bytes at a time go through a bijection that spreads every bit, so no two texts collide by their structure."""
    n = ends - starts
    lanes = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(n.astype(U64) * FACTORS[2] + FACTORS[3])
    todo = np.flatnonzero((n > 0) & (n <= 8 * LANES))
    at, left = starts[todo], n[todo]
    while len(todo):
        h[todo] = mix(h[todo] * FACTORS[4] + (lanes[at] & _KEPT[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > 8 * LANES):
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def texts(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts, ends) for runs of rows of about `limit` bytes. Null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, data[off[at] : off[to]], off[at:to] - off[at], off[at + 1 : to + 1] - off[at]
        at = to


def words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between gap bytes, and per row the index of its first word (one more entry than rows)."""
    inside = ~gap[buf]
    full = ends > starts
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[starts[full]] = inside[starts[full]]
    last[ends[full] - 1] = inside[ends[full] - 1]
    ws, we = np.flatnonzero(first), np.flatnonzero(last) + 1
    return ws, we, np.append(np.searchsorted(ws, starts), len(ws))


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row (all words, in rows of fewer), and the row of each."""
    n = np.diff(at)
    rows = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(hashes)) - at[:-1][rows]
    ok = pos + k <= n[rows]
    idx = np.flatnonzero(ok)
    out = np.zeros(len(idx), U64)
    for j in range(k):
        out += hashes[idx + j] * FACTORS[j]
    got, row = [mix(out)], [rows[idx]]
    for m in range(1, k):
        short = np.flatnonzero(n == m)
        if len(short):
            x = np.full(len(short), m, U64)
            for j in range(m):
                x = mix(x + hashes[at[short] + j] * FACTORS[j])
            got.append(x)
            row.append(short)
    return np.concatenate(got), np.concatenate(row)


def distinct(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, hash) once, sorted by row and hash."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[keep], r[keep]
