"""Ranked search against scores from their definition, with ties, repeats, nulls, long texts, many small shards and empty tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from sievelake.llm import arrays as A
from sievelake.llm import lexical, queries
from test_llm import DATA, frame, lower

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(t):
    return re.findall(TERM, lower(t or ""))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        hits = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if b[t])
            if s > 0:
                hits.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if x else i, -s) for r, (s, x, i) in enumerate(sorted(hits)[:k])]
    return sorted(out, key=repr)


def case():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["été", "日本", "x9", "ÀB", "İ"]
    pick = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.06)), 64)] for _ in range(n))
    docs = [(k, pick(rng.randrange(1, 60))) for k in range(160)] + [(200, None), (201, ""), (202, " ... "), (None, pick(20)), (None, pick(20)), (5, pick(9)), (203, "W1 w1,W1;w1"), (204, "zq\x00zq\x01b")]
    docs += [(300 + k, "same rare words here") for k in range(40)]  # ties beyond the tenth
    docs += [(400, pick(20_000))]
    items = [(k, pick(12)) for k in range(9)] + [(9, "same rare words"), (10, None), (11, ""), (12, "nowhere at all"), (1, "w1 w1 W1"), (None, "日本 été"), (13, "q" * 5000), (14, "b zq")]
    return docs, items


@pytest.mark.parametrize("shard,block", [(1 << 24, 2000), (600, 4)])
def test_search_equals_brute_force(spark, shard, block):
    docs, items = case()
    table = lexical.index(frame(spark, docs).repartition(3), shard_bytes=shard).cache()
    found = lexical.search(table, frame(spark, items, "item_id long, text string"), block=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items)
    if shard == 600:
        assert table.count() > 10


def test_index_as_a_table_and_empty(spark, tmp_path):
    docs, items = case()
    lexical.index(frame(spark, docs)).write.parquet(str(tmp_path / "index"))
    items = frame(spark, items, "item_id long, text string")
    assert sorted(map(tuple, lexical.search(spark.read.parquet(str(tmp_path / "index")), items, k=3).collect()), key=repr) == brute(docs, case()[1], 3)
    none = lexical.index(frame(spark, []))
    assert lexical.search(none, items).count() == 0
    assert lexical.search(lexical.index(frame(spark, docs)), items.limit(0)).count() == 0
    assert lexical.search(lexical.index(frame(spark, [(1, None), (2, "..")])), items).count() == 0


def test_query_equals_sql(spark):
    assert oracle.compare(spark, oracle.connect(DATA), DATA, queries.op12_search, lexical.sql()) == ""


def test_top_is_safe_with_ties():
    rng = np.random.default_rng(3)
    for _ in range(200):
        score = rng.integers(0, 4, rng.integers(1, 60))
        order = rng.permutation(len(score))
        k = int(rng.integers(1, 12))
        want = sorted((i for i in range(len(score)) if score[i] > 0), key=lambda i: (-score[i], order[i]))[:k]
        assert lexical.best(score, order, k).tolist() == want


def test_word_hashes():
    """Equal bytes, equal hashes, wherever they stand; different ones differ, built pairs of long words too."""
    rng = random.Random(8)
    words = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 200))) for _ in range(4000)} | {b"\0" * k for k in range(100)}
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
        words |= {a.encode(), b.encode()}
    words = sorted(words)
    seen = {}
    for offset in (0, 3):
        buf = np.frombuffer(b"#" * offset + b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words]) + offset
        starts = ends - [len(w) for w in words]
        for w, h in zip(words, A.word_hashes(buf, starts, ends).tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(words)
