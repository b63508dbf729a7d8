"""Exact repeats over a merged Burrows-Wheeler order, and their removal.

A byte is removed if a string of `length` bytes that covers it starts anywhere
else too. The order is built over content-defined anchors instead of single
bytes: an anchor is the position whose eight-byte hash is least in some window
of `w` positions, so equal strings have equal anchors. Every string start p
belongs to one anchor, the first at or after p + w, and both lie in the string.

1. Each shard of documents sorts its anchors by their right context (the
   `length - 2w` bytes that every string of the anchor contains); beside each
   stands its Burrows-Wheeler symbol, here the digest of all that the anchor's
   strings reach to the left and right. Equal rows of a shard become one with a count.
2. Buckets of contexts merge the shards' runs by interleave refinement: the
   interleave starts as shard after shard and is refined by one column at a
   time, last column first, each a stable pass; nothing is sorted anew
   by its suffix. Neighbours in the final interleave have a common prefix of 0, 1
   or 2 columns. Two: all strings of the anchor repeat. An interval of common
   prefix 1 that holds a symbol of its own: a repeat begins or ends there.
3. At such places only, every string is digested (128 bits), merged in the same
   way, and the strings of common prefix 2 repeat.
4. Each shard takes the answers back and deletes what they cover.

Refining single bytes would need `length` passes over the corpus. Shards and
buckets hold a fixed number of bytes, so tasks don't grow with the corpus; a
context that a third of the corpus shares brings one row a shard to its bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm import arrays as A

LENGTH = 400
#: Text bytes of a shard; anchors of a bucket.
SHARD_BYTES = 3 << 20
BUCKET_ROWS = 400_000
_OTHER = A.mix(A.BYTE)
_RUNS = "bucket int, shard long, keys binary, counts binary"
_ANSWERS = "shard long, kind int, bucket int, flags binary"


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, context digest, symbol) of each anchor of texts laid end to end."""
    w = (length - 8) // 4
    n = len(buf) - 7
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none.view(A.U64), none.view(A.U64)
    gram = np.ndarray((n,), "<u8", np.ascontiguousarray(buf).data, 0, (1,))
    v = (A.mix(gram) & A.U64(0xFFFFFFFF00000000)) | (A.U64(0xFFFFFFFF) - np.arange(n, dtype=A.U64))
    span = 1
    while span * 2 <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if w > span:
        v = np.minimum(v[: span - w], v[w - span :])
    at = 0xFFFFFFFF - (v & A.U64(0xFFFFFFFF)).astype(np.int64)
    b = at[np.append(True, at[1:] != at[:-1])]
    before = np.append(-2 * length, b[:-1])
    row = np.searchsorted(starts, b, "right") - 1
    lo = np.maximum(before - w + 1, starts[row])
    hi = np.minimum(b - w, ends[row] - length)
    ok = lo <= hi
    b, lo, hi = b[ok], lo[ok], hi[ok]
    roll = A.Rolling(buf)
    return lo, hi, roll.of(b, b + length - 2 * w), A.mix(A.Rolling(buf, _OTHER).of(lo, hi + length) + (b - lo).astype(A.U64))


def run_of(x: np.ndarray, y: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct rows (n, 2), their counts up to 2, and for each input row its place among them."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    place = np.empty(len(x), np.int64)
    group = np.cumsum(new) - 1
    place[order] = group
    total = np.bincount(group, count[order], minlength=int(new.sum())).astype(np.int64)
    return np.stack([x[new], y[new]], axis=1), np.minimum(total, 2).astype(np.uint8), place


def interleave(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted runs of rows: the order over their concatenation, and the common prefix of each row with the one before."""
    rows = np.concatenate(runs)
    order = np.arange(len(rows))
    for column in range(rows.shape[1] - 1, -1, -1):
        order = order[np.argsort(rows[order, column], kind="stable")]
    rows = rows[order]
    same = rows[1:] == rows[:-1]
    prefix = np.zeros(len(rows), np.int64)
    prefix[1:] = np.cumprod(same, axis=1).sum(axis=1)
    return order, prefix


def answers(runs: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """Per run and row: 1 if the whole row occurs again, 2 if its strings must be looked at one by one."""
    order, prefix = interleave(runs)
    c = np.concatenate(counts).astype(np.int64)[order]
    lead2, lead1 = np.flatnonzero(prefix < 2), np.flatnonzero(prefix < 1)
    g2 = np.cumsum(prefix < 2) - 1
    total = np.add.reduceat(c, lead2)
    whole = (total > 1)[g2]
    in1 = np.cumsum(prefix < 1) - 1
    open_ = (np.add.reduceat(c, lead1) > 1) & (np.add.reduceat((~whole).astype(np.int64), lead1) > 0)
    flags = whole.astype(np.uint8) | np.where(open_[in1] & (prefix < 2), 2, 0).astype(np.uint8)
    back = np.empty_like(flags)
    back[order] = flags
    return np.split(back, np.cumsum([len(r) for r in runs])[:-1])


def _laid(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The shard's rows in an order that every pass finds again, and their bytes."""
    t = t.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    _, _, buf, starts, ends = next(A.texts(t["text"], 1 << 62))
    return t, buf, starts, ends


def _dealt(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x >> A.U64(24)) % A.U64(buckets)).astype(np.int64)


def _packed(keys: np.ndarray, counts: np.ndarray, shard: int, buckets: int) -> pa.Table:
    to = _dealt(keys[:, 0], buckets)
    order = np.argsort(to, kind="stable")
    ids, first = np.unique(to[order], return_index=True)
    parts = np.split(order, first[1:]) if len(ids) else []
    return pa.table({"bucket": pa.array(ids, pa.int32()), "shard": pa.array([shard] * len(ids), pa.int64()), "keys": pa.array([keys[p].tobytes() for p in parts], pa.binary()), "counts": pa.array([counts[p].tobytes() for p in parts], pa.binary())})


def _unpacked(keys: np.ndarray, buckets: int, flags: dict[int, bytes]) -> np.ndarray:
    to, out = _dealt(keys[:, 0], buckets), np.zeros(len(keys), np.uint8)
    for b, x in flags.items():
        out[to == b] = np.frombuffer(x, np.uint8)
    return out


def _strings(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All starts from lo to hi, the index of their range, and their two digests as rows."""
    n = hi - lo + 1
    rng = np.repeat(np.arange(len(lo)), n)
    p = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[rng]
    return p, rng, np.stack([A.Rolling(buf).of(p, p + length), A.Rolling(buf, _OTHER).of(p, p + length)], axis=1)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, bucket_rows: int = BUCKET_ROWS, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row of docs.

    Texts are UTF-8 bytes; null text is empty. Matches never cross rows; a row
    repeated as it is counts as a further place. Texts shorter than `length` lose nothing.
    Strings are judged on the input. Other columns play no part, whatever
    their names. An empty table gives no rows. kept (binary) holds the bytes that stay.
    """
    if length < 64:
        raise ValueError("length must be 64 at least")
    A.tune(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    buckets = max(1, -(-size // (length // 8) // bucket_rows))
    more = buckets * 4
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(shards)).alias("shard"))

    def contexts(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        _, buf, starts, ends = _laid(t)
        _, _, x, y = anchors(buf, starts, ends, length)
        keys, counts, _ = run_of(x, y, np.ones(len(x), np.int64))
        return _packed(keys, counts, key[0].as_py(), buckets)

    def merged(which: int):
        def merge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            t = t.sort_by("shard")
            runs = [np.frombuffer(x.as_py(), A.U64).reshape(-1, 2) for x in t["keys"]]
            found = answers(runs, [np.frombuffer(x.as_py(), np.uint8) for x in t["counts"]])
            return pa.table({"shard": t["shard"], "kind": pa.array([which] * len(runs), pa.int32()), "bucket": t["bucket"], "flags": pa.array([f.tobytes() for f in found], pa.binary())})

        return merge

    def flags_of(a: pa.Table, which: int) -> dict[int, bytes]:
        return {r["bucket"]: r["flags"] for r in a.to_pylist() if r["kind"] == which}

    def looked(buf, starts, ends, a: pa.Table):
        lo, hi, x, y = anchors(buf, starts, ends, length)
        keys, _, place = run_of(x, y, np.ones(len(x), np.int64))
        flags = _unpacked(keys, buckets, flags_of(a, 0))
        first = np.zeros(len(x), bool)
        first[np.unique(place, return_index=True)[1]] = True
        f = flags[place]
        open_ = (f & 2 > 0) & first
        p, rng, rows = _strings(buf, lo[open_], hi[open_], length)
        return lo, hi, f & 1 > 0, p, rows, np.where(f[open_] & 1 > 0, 2, 1)[rng]

    def strings(key: tuple[pa.Scalar, ...], t: pa.Table, a: pa.Table) -> pa.Table:
        _, buf, starts, ends = _laid(t)
        _, _, _, _, rows, count = looked(buf, starts, ends, a)
        keys, counts, _ = run_of(rows[:, 0], rows[:, 1], count)
        return _packed(keys, counts, key[0].as_py(), more)

    def cleaned(key: tuple[pa.Scalar, ...], t: pa.Table, a: pa.Table) -> pa.Table:
        t, buf, starts, ends = _laid(t)
        lo, hi, whole, p, rows, count = looked(buf, starts, ends, a)
        keys, _, place = run_of(rows[:, 0], rows[:, 1], count)
        again = p[_unpacked(keys, more, flags_of(a, 1))[place] & 1 > 0]
        edge = np.zeros(len(buf) + 1, np.int32)
        for at, to in ((lo[whole], hi[whole] + length), (again, again + length)):
            np.add.at(edge, at, 1)
            np.subtract.at(edge, to, 1)
        gone = np.cumsum(edge[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        full = starts < ends
        begins[starts[full]] = gone[starts[full]]
        cut, runs = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(begins))
        removed = cut[ends] - cut[starts]
        kept = [(buf[s:e][~gone[s:e]] if r else buf[s:e]).tobytes() for s, e, r in zip(starts, ends, removed, strict=True)]
        cols = {"doc_id": t["doc_id"], "n_bytes": pa.array(ends - starts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs[ends] - runs[starts], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])}
        return pa.table(cols | ({"kept": pa.array(kept, pa.binary())} if keep_text else {}))

    shard = dealt.groupBy("shard")
    flags = shard.applyInArrow(contexts, _RUNS).groupBy("bucket").applyInArrow(merged(0), _ANSWERS)
    exact = shard.cogroup(flags.groupBy("shard")).applyInArrow(strings, _RUNS).groupBy("bucket").applyInArrow(merged(1), _ANSWERS)
    said = flags.unionByName(exact).groupBy("shard")
    return shard.cogroup(said).applyInArrow(cleaned, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
