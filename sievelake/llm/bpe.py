"""Byte-level BPE with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves whole pre-tokens
that are entries already. Tier two: other pre-tokens are merged with a heap of
candidate pairs over a linked list of byte pieces, always the pair of lowest
rank and, among equals, the leftmost. Texts are cut where no match of the
pattern can go on (before white space, and between letters, digits and ASCII
punctuation); of some megabytes each distinct span is matched and encoded once,
and a task keeps what it has resolved in a table of CACHE spans, and of as many
older ones. Ids are laid out, written and decoded as Arrow arrays.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import batched
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.arrays import rested, texts, tune

#: Spans of a table; when full it becomes the older one, from which what is asked for again is taken over.
CACHE = 500_000
#: Text bytes, and spans, that are encoded at once.
CHUNK = 4 << 20
WINDOW = 1 << 20
#: Patterns that cuts() knows; texts of others are matched whole.
CUTTABLE = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}
#: Kinds of characters: letters, digits, punctuation, the apostrophe (a contraction may begin), white space; _SOLID is none of the last, whatever else.
_LETTER, _DIGIT, _POINT, _QUOTE, _SPACE, _SOLID = range(1, 7)
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _POINT
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[39] = _QUOTE
_KIND[[32, *range(9, 14)]] = _SPACE
#: By kind * 8 + kind of the next: no match holds both characters, and none looks from one to the other.
_CUT = np.zeros(64, bool)
for _a, _next in ((_LETTER, (_DIGIT, _POINT, _QUOTE, _SPACE)), (_DIGIT, (_LETTER, _POINT, _QUOTE, _SPACE)), (_POINT, (_LETTER, _DIGIT, _SPACE)), (_QUOTE, (_SPACE,)), (_SOLID, (_SPACE,))):
    _CUT[[_a * 8 + b for b in _next]] = True


def cuts(buf: np.ndarray) -> np.ndarray:
    """Whether the UTF-8 text may be cut before each byte but the first: it is a character's first, and the spans on both sides match as they do in the text."""
    first = _KIND[buf]
    last = first
    if len(buf) and buf.max() > 127:
        last = first.copy()
        at = np.flatnonzero(buf >= 0xC3)  # first bytes of characters from U+00C0 on
        lead = buf[at]
        for lo, hi, more in ((0xC3, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0x100, 3)):
            last[at[(lead >= lo) & (lead < hi)] + more] = _SOLID
        latin = at[lead == 0xC3]
        latin = latin[(buf[latin + 1] != 0x97) & (buf[latin + 1] != 0xB7)]  # but for two signs, letters
        first[latin] = last[latin + 1] = _LETTER
        wide = at[(lead >= 0xE1) & (lead <= 0xE3)]
        end = buf[wide + 2]
        last[wide[(end <= 0x8A) | (end == 0x9F) | (end == 0xA0) | (end == 0xA8) | (end == 0xA9) | (end == 0xAF)] + 2] = 0  # all white space beyond U+00FF, and more
    cut = _CUT[last[:-1] * np.uint8(8) + first[1:]]
    line = np.flatnonzero(cut[:-1] & (buf[1:-1] < 14)) + 1  # after a line feed or tab that stands alone
    cut[line] = (first[line + 1] > 0) & (first[line + 1] < _SPACE)
    return cut


class PerfectHash:
    """Minimal perfect hash of byte strings (hash and displace): every key has a slot of its own below len(keys).

    Buckets of several keys search a displacement that puts all of them on
    free slots, large buckets first; buckets of one key name a slot directly.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.m = m = max(1, n // 2)
        self.keys: list[bytes] = [b""] * n
        self.seeds = [0] * m
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for k in keys:
            h = self._hash(k)
            buckets.setdefault(h % m, []).append((h, k))
        free = bytearray(b"\1") * n
        single = []
        for b, members in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                single.append((b, members[0][1]))
                continue
            d = 1
            while True:
                at = [self._slot(h, d) for h, _ in members]
                if all(map(free.__getitem__, at)) and len(set(at)) == len(at):
                    break
                d += 1
            self.seeds[b] = d
            for s, (_, k) in zip(at, members, strict=True):
                free[s] = 0
                self.keys[s] = k
        spare = (s for s in range(n) if free[s])
        for (b, k), s in zip(single, list(spare), strict=True):
            self.seeds[b] = -s - 1
            self.keys[s] = k

    @staticmethod
    def _hash(key: bytes) -> int:
        return crc32(key) | crc32(key, 0x5BD1E995) << 32 if len(key) < 1 << 16 else hash_long(key)

    def _slot(self, h: int, d: int) -> int:
        return (h ^ h >> 29) * (2 * d + 1) % 0x1FFFFFFFFFFFFFFF % self.n if d > 0 else -d - 1

    def slot(self, key: bytes) -> int:
        """The key's slot, or -1 if it is none of the keys."""
        if not self.n:
            return -1
        h = self._hash(key)
        d = self.seeds[h % self.m]
        if not d:
            return -1
        s = self._slot(h, d)
        return s if self.keys[s] == key else -1


def hash_long(key: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little")


class Codec:
    """Encoder and decoder for a vocabulary of ranks, one base64 token and its rank a line."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.findall = regex.compile(pattern).findall
        self.finditer = regex.compile(pattern).finditer
        self.cut = pattern in CUTTABLE
        #: Rank of what two neighbouring pieces, by rank, merge to.
        self.pair = [{} for _ in range(max(ranks.values()) + 1)]
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pair[a][b] = rank
        token_of = {r: t for t, r in ranks.items()}
        self.hash = PerfectHash(list(ranks))
        self.rank_at = [ranks[k] for k in self.hash.keys]
        self.byte = [ranks[bytes([b])] for b in range(256)]
        #: By rank: its bytes, and the rank as text after a space; by slot: the rank as an int32.
        self.tokens = pa.array([token_of.get(r, b"") for r in range(len(self.pair))], pa.large_binary())
        self.names = pa.array([b" %d" % r for r in range(len(self.pair))], pa.large_binary())
        self.alone = [array("i", [r]).tobytes() for r in self.rank_at]
        #: The same of two bytes.
        self.first = {(a, b): r for a in range(256) for b in range(256) if (r := self.pair[self.byte[a]].get(self.byte[b])) is not None}
        self.forget()

    def forget(self) -> None:
        #: int32 ids of spans, and of pre-tokens of spans of several.
        self.whole: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.seen: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no entry: a heap of (rank, place) over linked bytes."""
        pair, n = self.pair, len(piece)
        bits = 14 if n < 1 << 14 else 32
        low = (1 << bits) - 1
        ids = list(map(self.byte.__getitem__, piece))
        #: What each piece and the next one merge to now; an entry of the heap that says otherwise is stale.
        now = list(map(self.first.get, zip(piece, piece[1:], strict=False)))
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [r << bits | i for i, r in enumerate(now) if r is not None]
        now.append(None)
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, rank = top & low, top >> bits
            if now[i] != rank:
                continue
            j = after[i]
            ids[i], ids[j], now[j] = rank, -1, None
            after[i] = j = after[j]
            r = None
            if j < n:
                before[j] = i
                r = pair[rank].get(ids[j])
                if r is not None:
                    heappush(heap, r << bits | i)
            now[i] = r
            j = before[i]
            if j >= 0:
                now[j] = r = pair[ids[j]].get(rank)
                if r is not None:
                    heappush(heap, r << bits | j)
        return [x for x in ids if x >= 0]

    def piece(self, piece: bytes) -> bytes:
        """Int32 ids of one pre-token."""
        s = self.hash.slot(piece)
        return self.alone[s] if s >= 0 else array("i", self.merge(piece)).tobytes()

    def known(self, token: str) -> bytes:
        """The same of a pre-token that may have been seen before."""
        got = self.seen.get(token)
        if got is None:
            got = self.piece(token.encode())
            if len(token) <= 64:
                if len(self.seen) >= CACHE:
                    self.seen = {}
                self.seen[token] = got
        return got

    def learn(self, span: bytes) -> bytes:
        """Int32 ids of a span that isn't in the table."""
        got = self.older.get(span)
        if got is None:
            word = span[1:] if span[0] == 32 else span
            if self.cut and (word.isalpha() or len(word) <= 64 and (said := word.decode()).isalpha() and max(said) <= "ÿ"):  # letters up to U+00FF are one match
                got = self.piece(span)
            elif len(span) <= 1 << 16:
                got = b"".join(map(self.known, self.findall(span.decode())))
            else:
                got = b"".join(b"".join(map(self.known, part)) for part in batched((m.group() for m in self.finditer(span.decode())), 1 << 16))
        if len(span) <= 64:
            if len(self.whole) >= CACHE:
                self.older, self.whole = self.whole, {}
            self.whole[span] = got
        return got

    def runs(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, memoryview, memoryview]]:
        """(row, ids, ids as text with a space before each, bytes they decode to) of texts laid end to end; a text of very many spans comes in several parts, an empty one in none."""
        if not len(buf):
            return
        mark = np.zeros(len(buf) + 1, bool)
        if self.cut:
            mark[1:-1] = cuts(buf)
        mark[starts] = mark[-1] = True
        bounds = np.flatnonzero(mark)
        first, end = np.searchsorted(bounds, starts), np.searchsorted(bounds, ends)
        data = pa.py_buffer(buf)
        for lo in range(0, len(bounds) - 1, WINDOW):
            hi = min(lo + WINDOW, len(bounds) - 1)
            spans = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(bounds[lo : hi + 1]), data]).dictionary_encode()
            words = spans.dictionary.to_pylist()
            found = list(map(self.whole.get, words))
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self.learn(words[i])
            each = np.zeros(len(found) + 1, np.int64)
            np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4, out=each[1:])
            laid = pa.LargeListArray.from_arrays(pa.array(each), pa.array(np.frombuffer(b"".join(found), np.int32))).take(spans.indices)
            at, ids = laid.offsets.to_numpy(), laid.values
            said, back = self.names.take(ids), self.tokens.take(ids)
            said_at, back_at = (np.frombuffer(x.buffers()[1], np.int64) for x in (said, back))
            said, back = (memoryview(x.buffers()[2] or b"") for x in (said, back))
            ids = ids.to_numpy()
            for row in range(int(np.searchsorted(end, lo, "right")), int(np.searchsorted(first, hi, "left"))):
                i, j = at[max(first[row], lo) - lo], at[min(end[row], hi) - lo]
                if i < j:
                    yield row, ids[i:j], said[said_at[i] : said_at[j]], back[back_at[i] : back_at[j]]

    def encode(self, text: str) -> list[int]:
        return [i for ids, _ in self.pieces(text) for i in map(int, ids.split(" "))]

    def decode(self, ids) -> bytes:
        return b"".join(self.tokens.take(pa.array(ids, pa.int32())).to_pylist())

    def pieces(self, text: str) -> Iterator[tuple[str, bytes]]:
        """The text's ids as text and the bytes they decode to, a bounded number at a time."""
        buf = np.frombuffer(text.encode(), np.uint8)
        for _, _, said, back in self.runs(buf, np.array([0]), np.array([len(buf)])):
            yield bytes(said[1:]).decode(), bytes(back)


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, warm: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row of docs.

    Pre-tokens are the pattern's matches, each encoded by itself; no special
    tokens. decoded_sha256 is of the bytes that the ids decode to. Null text is
    empty: no tokens. Repeated rows each come back; an empty table gives no
    rows. Other columns play no part, whatever their names. warm: a task leaves its
    tables to the worker's next one, for jobs in which nothing else needs the memory.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for at, to, buf, starts, ends in texts(batch.column(1), CHUNK):
                n, full = np.zeros(to - at, np.int64), []
                said, back = ([hashlib.sha256() for _ in range(at, to)] for _ in range(2))
                for row, x, text, decoded in c.runs(buf, starts, ends):
                    said[row].update(text[0 if n[row] else 1 :])
                    back[row].update(decoded)
                    n[row] += len(x)
                    if ids:
                        full.append(x)
                cols = [batch.column(0).slice(at, to - at), pa.array(n), *(pa.array([h.hexdigest() for h in x]) for x in (said, back))]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *full]))))
                yield pa.RecordBatch.from_arrays(cols, names)
        if not warm:
            c.forget()

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    tune(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(rested(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
