"""Resolver rounds against a plain loop over each entity, the memo, the limit, and the catalogue resolvers on written-out records."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sievelake.operators import resolve as R
from sievelake.operators.facts import TRUST

SOURCES = ["musicbrainz", "deezer", "itunes", "other"]


def loop(seeds, resolvers, rounds):
    """Facts and attempts of one entity after at most `rounds` passes over the resolvers (name, needs, gives, table, offers), and whether any could still be asked."""
    facts = {f: (v, "seed") for f, v in sorted(seeds.items()) if v}
    fired, log = set(), []
    ready = lambda r: all(k in facts for k in r[1]) and any(k not in facts for k in r[2]) and (r[0], tuple(facts[k][0] for k in r[1])) not in fired
    for n in range(1, rounds + 1):
        changed = False
        for r in resolvers:
            if not ready(r):
                continue
            question = tuple(facts[k][0] for k in r[1])
            fired.add((r[0], question))
            for field, value, source in r[3].get(question, []):
                if not value:
                    continue
                mine = facts.get(field)
                if mine is None:
                    why = "accepted"
                elif mine[0] == value:
                    why = "agrees"
                elif TRUST.get(source, 0) <= TRUST.get(mine[1], 0):
                    why = f"outranked by {mine[1]}"
                else:
                    why = "accepted"
                log.append((n, r[0], field, value, source, why == "accepted", why))
                if why == "accepted":
                    facts[field] = (value, source)
                    changed = True
        if not changed:
            break
    return facts, log, not any(map(ready, resolvers))


def made(spark, spec):
    out = []
    for name, needs, gives, table in spec:
        rows = [(*q, k, f, v, s) for q, offers in table.items() for k, (f, v, s) in enumerate(offers)]
        df = spark.createDataFrame(rows, ", ".join([*(f"{n} string" for n in needs), "rank int", "field string", "value string", "source string"]))
        ask = lambda questions, df=df, needs=needs: df.join(questions, list(needs)).select(*needs, "rank", F.struct("field", "value", "source").alias("record"))
        out.append(R.Resolver(name, needs, gives, ask, lambda get, records: records))
    return out


@pytest.mark.parametrize("seed,rounds", [(1, 5), (2, 1)])
def test_rounds_equal_the_loop(spark, seed, rounds):
    rng = random.Random(seed)
    fields = [f"f{k}" for k in range(7)]
    spec = []
    for k in range(5):
        needs = tuple(rng.sample(fields, rng.choice([1, 1, 2])))
        gives = tuple(rng.sample([f for f in fields if f not in needs], 2))
        table = {}
        for _ in range(60 if len(needs) == 2 else 10):
            q = tuple(str(rng.randrange(5)) for _ in needs)
            table[q] = [(rng.choice([*gives, *gives, rng.choice(fields)]), rng.choice(["", *map(str, range(5))]), rng.choice(SOURCES)) for _ in range(rng.randrange(5))]
        spec.append((f"r{k}", needs, gives, table))
    seeds = {e: {f: rng.choice(["", "0", "1", "2", "3", "4"]) for f in rng.sample(fields, rng.randrange(1, 4))} for e in range(150)}
    rows = [(e, f, v) for e, fs in seeds.items() for f, v in fs.items()] + [(900, "f1", None), (901, None, "x"), (902, "f0", "2"), (902, "f0", "1")]
    seeds[902] = {"f0": "1"}
    got = R.resolve(spark.createDataFrame(rows, "entity long, field string, value string"), made(spark, spec), rounds=rounds)
    want = {e: loop(fs, spec, rounds) for e, fs in seeds.items() if any(fs.values())}
    facts, attempts = {}, {}
    for r in got.facts().collect():
        facts.setdefault(r.entity, {})[r.field] = (r.value, r.source)
    for r in sorted(got.attempts().collect(), key=lambda r: (r.entity, r.seq)):
        attempts.setdefault(r.entity, []).append(tuple(r)[2:])
    assert facts == {e: f for e, (f, _, _) in want.items()}
    assert attempts == {e: log for e, (_, log, _) in want.items() if log}
    assert {r.entity for r in got.unsettled().collect()} == {e for e, (_, _, done) in want.items() if not done}
    memo = got.memo.collect()
    assert len({(r.resolver, r.question) for r in memo}) == len(memo)  # no question twice
    if rounds == 1:
        assert got.unsettled().count()  # a limit that is reached is reported


def test_rounds_read_what_changed(spark):
    """Each round asks for the entities that the round before changed, each question once."""
    asked = []
    chain = {str(k): str(k + 1) for k in range(6)}
    spec = [("next", ("at",), ("end",), {(k,): [("at", v, "musicbrainz"), *([("end", "x", "musicbrainz")] if v == "6" else [])] for k, v in chain.items()})]
    resolver = made(spark, spec)[0]
    ask = lambda questions: asked.append(sorted(r["at"] for r in questions.collect())) or resolver.ask(questions)
    watched = R.Resolver(resolver.name, resolver.needs, resolver.gives, ask, resolver.offers)
    rows = [(e, "at", "0") for e in range(500)] + [(1000 + e, "at", "3") for e in range(500)] + [(2000, "at", "9")]
    got = R.resolve(spark.createDataFrame(rows, "entity long, field string, value string"), [watched], trust={"seed": 0, "musicbrainz": 3}, rounds=9)
    # A fact of the same trust isn't replaced, so a chain goes one step from its seed.
    assert asked == [["0", "3", "9"], ["1", "4"]]
    assert got.unsettled().count() == 0 and {r.rounds for r in got.rows.collect()} == {1, 2}


def test_entities_of_equal_facts_are_resolved_as_one(spark, monkeypatch):
    """The rounds' rows are distinct sets of facts and their partitions don't add up, whether answers are broadcast or shuffled; every entity gets its own rows."""
    seen, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: (lambda out: seen.append((out.count(), out.rdd.getNumPartitions())) or out if "fired" in out.columns else out)(cut(df)))
    spec = [(f"r{k}", (f"f{k}",), (f"f{k + 1}",), {("a",): [(f"f{k + 1}", "a", "deezer")], ("b",): [(f"f{k + 1}", "b", "deezer")]}) for k in range(4)]
    rows = [(e, "f0", "abc"[e % 3]) for e in range(300)] + [(e, "x", "y") for e in range(0, 300, 2)]
    want = sorted((e, k, 1, f"r{k}", f"f{k + 1}", "ab"[e % 3], "deezer", True, "accepted") for e in range(300) if e % 3 < 2 for k in range(4))
    for small in (R.broadcast_if_small, lambda df, rows=0: df):
        monkeypatch.setattr(R, "broadcast_if_small", small)
        seen.clear()
        got = R.resolve(spark.createDataFrame(rows, "entity long, field string, value string"), made(spark, spec))
        assert sorted(tuple(r) for r in got.attempts().collect()) == want
        assert [n for n, _ in seen] == [6] * 5 and max(p for _, p in seen) <= 8


def test_empty_and_blank(spark):
    spec = made(spark, [("r", ("a",), ("b",), {("1",): [("b", "2", "deezer")]})])
    schema = "entity long, field string, value string"
    for rows in ([], [(1, "a", None), (2, None, "1"), (3, "a", "")]):
        got = R.resolve(spark.createDataFrame(rows, schema), spec)
        assert got.facts().count() == got.attempts().count() == got.memo.count() == 0
    got = R.resolve(spark.createDataFrame([(None, "a", "1"), (1, "a", "7")], schema), spec)
    assert {(r.entity, r.field, r.value) for r in got.facts().collect()} == {(None, "a", "1"), (None, "b", "2"), (1, "a", "7")}


def test_catalogue_resolvers(spark):
    """A name leads to a track, its code to a recording, that to its album and cover; other versions and covers of other albums are refused."""
    make = spark.createDataFrame
    track = "id string, artist string, title string, isrc string, track_number int, disc_number int, explicit boolean, bpm double, release_date string, album_id string, album string, cover string, contributors array<string>, q_artist string, q_title string, rank int"
    tracks = make([
        ("t0", "Bon Jovi", "It's My Life (Live)", None, 1, 1, False, 0.0, None, "a9", "Live", "live.jpg", [], "Bon Jovi", "It's My Life", 0),
        ("t1", "Bon Jovi", "It's My Life", "USMR10000123", 1, 1, False, 119.96, "2000-05-29", "a1", "Hits", "hits.jpg", ["Bon Jovi", "Max"], "Bon Jovi", "It's My Life", 1),
    ], track)
    albums = make([("a1", "Hits", "Island", "2005", 20, "hits2.jpg", [])], "id string, title string, label string, release_date string, total_tracks int, cover string, genres array<string>")
    recording = "id string, title string, artists array<string>, artist_id string, isrcs array<string>, length_ms long, genres array<string>, tags array<string>, album string, year string, group_id string, release_id string, release_type string"
    recordings = make([
        ("m0", "It's My Life (radio live)", ["Bon Jovi"], "p1", ["USMR10000123"], 1, [], [], None, None, None, None, None),
        ("m2", "It's My Life", ["Bon Jovi"], "p1", ["USMR10000123", "bad"], 224000, [], list("abcdefg"), "Crush", "2000-06-13", "g1", "r1", "Album"),
        ("m3", "It's My Life", ["Bon Jovi"], "p1", ["USMR10000123"], 2, [], [], None, None, None, None, None),
    ], recording)
    groups = make([], "id string, title string, artists array<string>, release_date string, kind string, q_artist string, q_album string, rank int")
    covers = make([("g1", "back.jpg", False), ("g1", "front.jpg", True)], "group_id string, url string, front boolean")
    artists = make([("p1", "Bon Jovi", ["BJ", "Bongiovi"])], "id string, name string, aliases array<string>")
    seeds = make([(1, "artist", "Bon Jovi"), (1, "title", "It's My Life"), (1, "album", "Crush"), (2, "artist", "Nobody"), (2, "title", "Nothing")], "entity long, field string, value string")
    got = R.resolve(seeds, R.catalogue_resolvers(tracks, albums, recordings, groups, covers, artists))
    facts = {r.field: (r.value, r.source) for r in got.facts().where("entity = 1").collect()}
    assert facts["deezer_id"] == ("t1", "deezer") and facts["isrc"] == ("USMR10000123", "deezer")
    assert facts["recording_id"] == ("m2", "musicbrainz")  # the same version, then the smallest id
    assert facts["cover_url"] == ("front.jpg", "coverartarchive")  # covers of Hits aren't of Crush
    assert facts["album"] == ("Crush", "seed") and facts["year"] == ("2000", "deezer") and facts["bpm_deezer"] == ("120.0", "deezer")
    assert facts["all_artists"] == ("Bon Jovi; Max", "deezer") and facts["genres"] == ("a; b; c; d; e", "musicbrainz") and facts["label"] == ("Island", "deezer")
    assert facts["artist_canonical"] == ("Bon Jovi", "musicbrainz") and facts["artist_aliases"] == ("BJ; Bongiovi", "musicbrainz")
    said = {(r.field, r.value, r.why) for r in got.attempts().where("entity = 1").collect()}
    assert ("album", "Hits", "outranked by seed") in said and ("title", "It's My Life", "agrees") in said
    assert {r.field for r in got.facts().where("entity = 2").collect()} == {"artist", "title"}
    assert json.loads(got.memo.where("resolver = 'mb-by-isrc'").first().question) == ["USMR10000123"]
