"""Wanted outputs against a plain comparison, what is read of them, and tags of three dialects."""

import random


from sievelake.operators import desired

SCHEMA = "entity string, field string, value string"


def plain(old, new):
    out = set()
    for k in old.keys() | new.keys():
        a, b = old.get(k, "-"), new.get(k, "-")
        if b == "-":
            out.add((*k, "released", a, None))
        elif b is None:
            if a is not None:
                out.add((*k, "deleted", None if a == "-" else a, None))
        elif a in ("-", None):
            out.add((*k, "set", None, b))
        elif a != b:
            out.add((*k, "changed", a, b))
    return out


def test_changes_equal_the_comparison_and_unmoved_buckets_stay(spark, tmp_path):
    rng = random.Random(4)
    outputs = desired.Outputs(spark, str(tmp_path / "out"), buckets=16)
    state = {(f"e{e}", f): rng.choice(["a", "b", None]) for e in range(60) for f in ("artist", "title", "genre") if rng.random() < 0.8}
    frame = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], SCHEMA)
    assert {tuple(r) for r in outputs.apply(frame(state)).collect()} == plain({}, state)
    assert outputs.moved(frame(state)) == [] and outputs.apply(frame(state)).count() == 0 and outputs.store.versions() == [1]
    new = dict(state)
    for k in [k for k in state if k[0] in ("e3", "e4")]:
        new[k] = rng.choice(["c", None])
    new["e3", "year"] = "1999"
    new = {k: v for k, v in new.items() if k[0] != "e5"}
    moved = outputs.moved(frame(new))
    assert 1 <= len(moved) <= 3
    read = outputs.store._read(outputs.store.manifest(), moved).inputFiles()
    assert {int(p.split("/b=")[1].split("/")[0]) for p in read} <= set(moved)  # nothing else is read
    assert {tuple(r) for r in outputs.apply(frame(new)).collect()} == plain(state, new)
    assert {tuple(r) for r in outputs.store.current().select("entity", "field", "value").collect()} == {(*k, v) for k, v in new.items()}
    m = outputs.store.manifest()
    assert set(m["touched"]) == set(moved) and all(v == 1 for b, v in m["buckets"].items() if int(b) not in moved)
    assert {tuple(r) for r in outputs.apply(frame({})).collect()} == plain(new, {})


def test_tags_of_three_dialects(spark):
    rows = [
        ("a.mp3", "id3", 0, "TPE1", None, "A"), ("a.mp3", "id3", 1, "TPE1", None, "B"), ("a.mp3", "id3", 2, "TXXX", "stamp", "7"), ("a.mp3", "id3", 3, "APIC", None, "bytes"), ("a.mp3", "id3", 4, "XXXX", None, "no"), ("a.mp3", "id3", 5, "TALB", None, None),
        ("b.flac", "vorbis", 0, "ARTIST", None, "C"), ("b.flac", "vorbis", 1, "Date", None, "1999"), ("b.flac", "vorbis", 2, "stamp", None, "8"), ("b.flac", "vorbis", 3, "lyrics", None, "la"),
        ("c.m4a", "mp4", 0, "\u00a9nam", None, "T"), ("c.m4a", "mp4", 1, "----:com.apple.iTunes:stamp", None, "9"), ("c.m4a", "mp4", 2, "----:com.apple.iTunes:TITLE", None, "own"), ("c.m4a", "mp4", 3, "title", None, "T2"), ("c.m4a", "mp4", 4, "covr", None, "x"),
    ]
    got = {}
    for r in desired.tags_of(spark.createDataFrame(rows, "path string, dialect string, seq int, key string, name string, value string")).collect():
        got.setdefault(r.path, {})[r.field] = r.value
    assert got == {
        "a.mp3": {"artist": "A", "x:stamp": "7", "_art": "true"},
        "b.flac": {"artist": "C", "year": "1999", "x:ARTIST": "C", "x:DATE": "1999", "x:STAMP": "8", "x:LYRICS": "la", "_lyrics": "true"},
        "c.m4a": {"title": "T2", "x:\u00a9NAM": "T", "x:stamp": "9", "x:TITLE": "own", "x:COVR": "x", "_art": "true"},
    }
    assert desired.tags_of(spark.createDataFrame([], "path string, dialect string, seq int, key string, name string, value string")).count() == 0
