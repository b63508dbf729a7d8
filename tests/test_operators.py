"""Operators on small hand-made tables: edge cases and brute force."""

import difflib
import itertools
import random

from pyspark.sql import functions as F

from sievelake.functions import measures, text, timed
from sievelake.operators import evidence, graph, quorum, rank
from sievelake.sources import files
from sievelake.streaming import store


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(1, None), (5, 5)]
    up = {i: i for e in edges for i in e if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    linked = set()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            linked |= {a, b}
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: find(i) for i in linked}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)]
    got = graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(got) == 301 and {r["component"] for r in got} == {0}


def test_aliases_with_chain_and_self(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d"), ("e", None)], "name string, alias string")
    assert {tuple(r) for r in graph.resolve_aliases(m).collect()} == {("a", "c"), ("b", "c")}


def test_upsert_is_idempotent_and_keeps_first_seen(spark):
    schema = "entity string, field string, source string, query_key string, state string, value string, first_seen long, seen_at long"
    old = spark.createDataFrame([("t", "f", "s", "q", "FOUND", "v", 1, 1), ("t", "g", "s", "q", "NO_MATCH", None, 1, 1)], schema)
    new = spark.createDataFrame([("t", "f", "s", "q", "FOUND", "v", 0, 9), ("t", "g", "s", "q", "FOUND", "w", 0, 9), ("u", "f", "s", "q", "NO_MATCH", None, 0, 9)], schema).drop("first_seen")
    once = evidence.upsert(old, new)
    got = {(r.entity, r.field): (r.value, r.first_seen, r.seen_at) for r in once.collect()}
    assert got == {("t", "f"): ("v", 1, 9), ("t", "g"): ("w", 9, 9), ("u", "f"): (None, 9, 9)}
    assert sorted(map(tuple, evidence.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_quorum_human_beats_numbers(spark):
    rows = [("t", "f", "x", "a"), ("t", "f", "x", "b"), ("t", "f", "y", "human"), ("t", "f", "z", "local"), ("t", "f", "", "c")]
    r = quorum.agreement(spark.createDataFrame(rows, "entity string, field string, value string, family string")).first()
    assert (r.value, r.agree, r.dissent, r.runner_up, r.margin) == ("y", "human", "a,b", "x", -1)


def test_band_and_hamming_pairs(spark):
    rng = random.Random(2)
    rows = [(i, rng.uniform(0, 40), rng.getrandbits(16) & rng.getrandbits(16)) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, v double, w long").withColumn("g", F.lit(1))
    pairs = list(itertools.combinations(rows, 2))
    got = {(r.a, r.b) for r in rank.band_pairs(df, "k", "v", 2.5, ["g"]).collect()}
    assert got == {(x[0], y[0]) for x, y in pairs if abs(x[1] - y[1]) <= 2.5}
    got = {(r.a, r.b, r.distance) for r in rank.hamming_pairs(df, "k", "w", 3, 16).collect()}
    assert got == {(x[0], y[0], (x[2] ^ y[2]).bit_count()) for x, y in pairs if (x[2] ^ y[2]).bit_count() <= 3}


def test_names(spark):
    df = spark.createDataFrame([("Čaj & Kafić – Đura (Official Video) [HD]", "A feat. B & C; D"), ("", None)], "s string, c string")
    artist, title = text.split_name(F.col("s"))
    r = df.select(text.norm(F.col("s")).alias("n"), artist.alias("a"), title.alias("t"), text.credits(F.col("c")).alias("c")).collect()
    assert r[0].n == "caj kafic djura official video hd" and (r[0].a, r[0].t) == ("Čaj & Kafić", "Đura") and r[0].c == ["A", "B", "C", "D"]
    assert r[1].n == "" and r[1].a is None and r[1].c is None
    got = df.limit(1).select(text.sequence_ratio(F.lit("abcd"), F.lit("bcde")).alias("x")).first().x
    assert got == difflib.SequenceMatcher(None, "abcd", "bcde").ratio()


def test_timed_text(spark):
    assert timed.shifted("[00:59.50]a\n[1:00]b", 0.5) == "[01:00.00]a\n[1:00]b" or timed.shifted("[00:59.50]a", 0.5) == "[01:00.00]a"
    assert timed.shifted("[00:00.2]x", -5) == "[00:00.0]x" and timed.shifted(None, 1) is None
    df = spark.createDataFrame([(1, "[00:01.5][00:10.25] la\n[00:20]\n[00:30] ♪\nplain")], "k long, s string")
    assert sorted((r.sec, r.words) for r in timed.lines(df, "s", "k").collect()) == [(1.5, "la"), (10.25, "la")]


def test_measures(spark):
    df = spark.createDataFrame([(40.0, -20.0, 0.5), (130.0, None, None)], "bpm double, l double, p double")
    r = df.select(measures.octave(F.col("bpm")).alias("b"), measures.gain(F.col("l"), F.col("p")).alias("g"), measures.grade(F.lit(18.0)).alias("q")).collect()
    assert (r[0].b, round(r[0].g, 3), r[0].q) == (80.0, 5.021, "good") and (r[1].b, r[1].g) == (130.0, None)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "hints.tsv").write_text("﻿file\thint\na.mp3\ty\nb.mp3\t\n")
    got = files.delimited(spark, str(tmp_path / "hints.tsv")).collect()
    assert [(r.file, r.hint) for r in got] == [("a.mp3", "y"), ("b.mp3", None)]
    assert files.read_or_empty(spark, str(tmp_path / "none"), "a long").count() == 0
    df = spark.createDataFrame([("x", "1.mp3"), ("x", "0.mp3"), ("y/z", "2.mp3")], "crate string, path string")
    files.write_playlists(df, str(tmp_path / "lists"))
    assert sorted(p.name for p in (tmp_path / "lists").iterdir() if p.is_dir()) == ["crate=x", "crate=y%2Fz"]
    (tmp_path / "only.txt").write_text("# note\na\nzz\n\n")
    assert {(r.entry, r.resolved) for r in files.restrict_list(spark, str(tmp_path / "only.txt"), spark.createDataFrame([("a",)], "key string")).collect()} == {("a", True), ("zz", False)}


def test_streaming_equals_batch(spark, tmp_path):
    schema = "entity string, field string, source string, query_key string, state string, value string, seen_at long"
    rows = [("t", "f", "s", "q", "FOUND", "v", 1), ("t", "f", "s", "q", "FOUND", "w", 2), ("u", "f", "s", "q", "NO_MATCH", None, 3), ("u", "f", "s", "q", "BOGUS", "x", 4)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    store.run_available(spark, str(tmp_path / "in"), schema, str(tmp_path / "store"), str(tmp_path / "cp"))
    got = {(r.entity, r.value) for r in store.current(spark, str(tmp_path / "store")).collect()}
    assert got == {("t", "w"), ("u", None)}
