"""Containment and similarity joins against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from sievelake.operators import contain as C


def word(rng, alphabet="abcd", most=9):
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(most)))


def test_containing_pairs_equal_all_pairs(spark):
    rng = random.Random(1)
    patterns = [(k, word(rng, most=6)) for k in range(120)] + [(500, "日本"), (501, "a"), (501, "a"), (502, None), (503, "")]
    texts = [(k, word(rng, most=30)) for k in range(150)] + [(600, "x日本y"), (601, None), (602, ""), (603, "aaaa" * 5000)]
    got = C.containing_pairs(spark.createDataFrame(patterns, "pid long, p string"), spark.createDataFrame(texts, "tid long, t string"))
    want = {(i, p, j, t) for i, p in patterns for j, t in texts if p and t and p in t}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    none = spark.createDataFrame([], "pid long, p string")
    assert C.containing_pairs(none, spark.createDataFrame(texts, "tid long, t string")).count() == 0


def test_longest_and_closest(spark):
    rng = random.Random(2)
    texts = [(k, " ".join(word(rng) for _ in range(4))) for k in range(80)]
    names = [word(rng, most=5) for _ in range(60)]
    got = {r.tid: r.answer for r in C.longest_within(spark.createDataFrame(texts, "tid long, t string"), spark.createDataFrame([(n,) for n in names], "p string")).collect()}
    assert got == {k: max(h, key=lambda n: (len(n), n)) for k, t in texts if (h := [n for n in names if n and n in t])}
    present = [(k, word(rng, most=12)) for k in range(90)]
    orphans = [(k, word(rng, most=12)) for k in range(90)]
    got = {r.oid: r.pid for r in C.closest_names(spark.createDataFrame(orphans, "oid long, key string"), spark.createDataFrame(present, "pid long, key string")).collect()}
    assert got == {o: min(h, key=lambda x: (-len(x[1]), x[0]))[0] for o, k in orphans if k and (h := [(p, n) for p, n in present if n and (n in k or k in n)])}


@pytest.mark.parametrize("least", [0.7, 0.85, 0.92])
def test_similar_texts_lose_no_pair(spark, least):
    rng = random.Random(3)
    texts = [word(rng, "abcdefgh ", 26) for _ in range(60)]
    for t in texts[:40]:
        x = list(t)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randrange(2)] = rng.choice(["", "q", "zz", x[0] if x else ""])
        texts.append("".join(x))
    texts += [texts[0], "", None, "é日", "日é"]
    got = C.similar_texts(spark.createDataFrame([(t,) for t in texts], "t string"), least)
    ratio = lambda a, b: max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio())
    plain = sorted({t for t in texts if t})
    want = {(a, b) for i, a in enumerate(plain) for b in plain[i + 1 :] if ratio(a, b) >= least}
    assert want and {(r.a, r.b) for r in got.pairs.collect()} == want
    assert got.all == len(plain) * (len(plain) - 1) // 2
    if least > 0.9:
        assert got.compared < 0.1 * got.all  # few pairs reach Python
    with pytest.raises(ValueError):
        C.similar_texts(spark.createDataFrame([("a",)], "t string"), 0.6)
