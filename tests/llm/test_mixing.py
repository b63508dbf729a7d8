"""Mixing by weights against rounds of resharing and a walk over sorted rows, with nulls, repeats, ties and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

import oracle
from sievelake.llm import mixing, queries
from test_llm import DATA, frame

SCHEMA = "doc_id long, text string, source string"


def brute(rows, epochs=3, seed=mixing.SEED):
    """Shares by weight, excess dealt again in rounds until none is above its stop; then a walk in order of keys."""
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    total = defaultdict(int)
    for _, s, n in sized:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(total.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > epochs * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: float(epochs * total[s]) for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    key = lambda r: int(hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[2]}:{seed}".encode()).hexdigest()[:15], 16)
    out = []
    for s in names:
        copies, rest = divmod(math.floor(target[s] + 1e-9), total[s]) if total[s] else (0, 0)
        for r in sorted((r for r in sized if r[1] == s), key=lambda r: (key(r), r[0] is not None, r[0] or 0, r[2])):
            part = min(r[2], rest)
            rest -= part
            out.append((r[0], s, r[2], total[s], round(target[s], 6), copies * r[2] + part))
    return sorted(out, key=repr)


def told(df):
    return sorted(((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr)


def case(kind):
    rng = random.Random(kind)
    text = lambda n: " ".join(rng.choice("abcdef") for _ in range(n)) + rng.choice(["", " ", "\n", "\t \x0b"])
    if kind == "hot":
        return [(k, text(rng.randrange(40)), rng.choice(["big"] * 12 + ["a", "é", "z", "Z", None])) for k in range(400)]
    if kind == "tiny sources":
        return [(k, text(30), "only") for k in range(50)] + [(100 + k, text(1), f"s{k}") for k in range(6)]
    if kind == "odd":
        return [(1, None, "a"), (1, None, "a"), (2, "", "b"), (3, " \n", None), (None, "x y", "c"), (None, "x y", "c"), (4, "word " * 30_000, "d"), (5, "one", "d"), (5, "one", "d"), (6, "no break", "e")]
    return [(1, None, "a"), (2, " ", None)] if kind == "no words" else []


@pytest.mark.parametrize("kind", ["hot", "tiny sources", "odd", "no words", "empty"])
def test_mix_equals_brute_force(spark, kind):
    rows = case(kind)
    df = frame(spark, rows, SCHEMA)
    got = told(mixing.mix(df))
    assert got == brute(rows)
    taken, aim = Counter(), {}
    for i, s, n, _, t, k in got:
        taken[s] += k
        aim[s] = t
        assert k <= 3 * n
    assert all(abs(taken[s] - t) <= 1 for s, t in aim.items())
    assert told(mixing.mix(df.repartition(3))) == got  # however the rows are dealt


def test_query_equals_sql(spark):
    con = oracle.connect(DATA)
    assert oracle.compare(spark, con, DATA, queries.op13_mixing, mixing.sql()) == ""


def test_mixed_rows_and_given_weights(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(k % 7 + 1)), "ab"[k % 2]) for k in range(40)]
    weights = spark.createDataFrame([("a", 5.0), ("b", 0.0)], "source string, weight double")
    plan = {r.doc_id: r for r in mixing.mix(frame(spark, rows, SCHEMA), weights).collect()}
    assert all(r.taken == 0 for r in plan.values() if r.source == "b")
    got = defaultdict(int)
    for r in mixing.mixed(frame(spark, rows, SCHEMA), weights=weights).collect():
        got[r.doc_id] += len(r.text.split())
        assert dict((i, t) for i, t, _ in rows)[r.doc_id].startswith(r.text)
    assert {i: n for i, n in got.items() if n} == {i: r.taken for i, r in plan.items() if r.taken}
    assert mixing.mixed(frame(spark, [], SCHEMA)).count() == 0
