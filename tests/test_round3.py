"""What the third round of findings turned on."""

from pyspark.sql import functions as F

from sievelake.functions import fields, measures
from sievelake.operators import candidates, copies


def test_words_end_at_letters_beyond_ascii(spark):
    d = spark.createDataFrame([("teßheit",), ("ßte x",), ("tex",), ("a_te",), ("TE.",)], "c string")
    assert [r.x for r in d.select(fields.in_cohort(F.col("c")).alias("x")).collect()] == [True, True, False, False, True]


def test_halves_as_doubles_have_them(spark):
    xs = [0.39135, 0.46875, -0.46875, 0.0, 1.0, 0.39145, 156540.0 / 400000]
    d = spark.createDataFrame([(x,) for x in xs], "x double").select(measures.rounded(F.col("x"), 4).alias("y"), measures.rounded(F.lit(None).cast("double"), 4).alias("n"))
    want = [(lambda y: (int(abs(y)) + (abs(y) - int(abs(y)) >= 0.5)) * (1 if y >= 0 else -1) / 1e4)(x * 1e4) for x in xs]
    got = d.collect()
    assert [r.y for r in got] == want and all(r.n is None for r in got)
    assert want[0] == 0.3913 or 0.39135 * 1e4 >= 3913.5


def test_durations_about_the_knee_meet(spark):
    pairs = [(139.0, 151.0), (138.5, 150.4), (150.0, 163.0), (149.9, 161.9), (138.0, 150.0), (12.0, 24.0), (0.5, 12.5), (300.0, 276.0)]
    d = spark.createDataFrame(pairs, "x double, y double").where(F.abs(F.col("x") - F.col("y")) <= F.greatest(F.lit(12.0), 0.08 * F.greatest("x", "y")))
    assert d.count() == len(pairs)
    assert d.where(F.abs(copies._band(F.col("x"), 12.0) - copies._band(F.col("y"), 12.0)) > 1).count() == 0


def _sounds(spark, n=60, seed=3):
    import random

    g = random.Random(seed)
    base = [[g.getrandbits(32) for _ in range(g.choice([19, 24, 40]))] for _ in range(8)]
    out = []
    for k in range(n):
        x = list(g.choice(base))
        for i in range(len(x)):
            for _ in range(g.choice([0, 2, 4])):
                x[i] ^= 1 << g.randrange(32)
        x = [g.getrandbits(32)] * g.choice([0, 1, 3]) + x
        if k % 9 == 0:
            x[g.randrange(len(x))] = None
        out.append((k, g.choice([99.9, 100.0, 101.5, 102.5, 104.0, 250.0]), x))
    out += [(1000 + k, 300.0, base[3] + base[4]) for k in range(4)] + [(2000 + k, 300.0, base[3][:5]) for k in range(2)]
    return spark.createDataFrame(out, "path long, seconds double, items array<bigint>")


def test_sounds_in_blocks_are_all_pairs(spark):
    d = _sounds(spark)
    x, y = (d.select(*[F.col(n).alias(n + k) for n in d.columns]) for k in "xy")
    near = x.join(y, (F.col("pathx") < F.col("pathy")) & (F.abs(F.col("secondsx") - F.col("secondsy")) <= 2.5)).where(copies.bit_error_rate(F.col("itemsx"), F.col("itemsy")) <= copies.SAME)
    want = {tuple(r) for r in copies.connected_components(near, "pathx", "pathy").collect()}
    assert len(want) > 20 and {p for p, _ in want} >= {1000, 1001, 1002, 1003} and 2000 not in {p for p, _ in want}
    for block in (1000, 4):
        assert {tuple(r) for r in copies.groups_by_sound(d, block=block).collect()} == want


def test_openings_in_blocks_are_all_pairs(spark):
    import random

    g = random.Random(5)
    base = [[g.getrandbits(32) for _ in range(3)] for _ in range(6)]
    rows = [(f"p{k}", [x ^ sum(1 << b for b in g.sample(range(32), g.choice([0, 2, 3, 4]))) for x in g.choice(base)]) for k in range(80)] + [("n", [None, 1, 2])]
    d = spark.createDataFrame(rows, "path string, items array<bigint>")
    far = lambda x, y: max(bin(p ^ q).count("1") for p, q in zip(x[:2], y[:2], strict=True))
    want = sorted((min(p, q), max(p, q)) for i, (p, x) in enumerate(rows[:-1]) for q, y in rows[i + 1 : -1] if far(x, y) <= 6)
    for block in (1000, 7):
        assert sorted(tuple(r) for r in copies._met_openings(d, 6, block).collect()) == want


def test_names_borne_by_many_meet_once(spark, monkeypatch):
    from sievelake.operators import contain

    seen, pairs = [], contain.containing_pairs
    monkeypatch.setattr(contain, "containing_pairs", lambda p, t: (lambda got: seen.append(got.count()) or got)(pairs(p, t)))
    orphans = spark.createDataFrame([(k, ("amazing red ring", "ring", "none")[k % 3]) for k in range(30)] + [(99, None)], "oid long, key string")
    present = spark.createDataFrame([(100 - k, ("red ring", "ring")[k % 2]) for k in range(40)], "pid long, key string")
    got = {tuple(r) for r in contain.closest_names(orphans, present).collect()}
    assert got == {(k, 62) for k in range(30) if k % 3 < 2}
    assert sum(seen) <= 6


def test_answers_that_tie_are_told_apart_in_any_order(spark):
    asked = spark.createDataFrame([(1, "Ana", "Zora", 100.0)], "track long, artist string, title string, duration double")
    rows = [(1, "direct", "deezer", 1, a, t, 100.0, False) for a, t in (("Ana Iva", "Zora"), ("Ana Zed", "Zora"), ("Ana Bob", "Zora"))]
    kind = "track long, stage string, source string, pos int, artist string, title string, duration double, failed boolean"
    got = [tuple(candidates.corroborate(asked, spark.createDataFrame(x, kind).coalesce(1)).collect()) for x in (rows, rows[::-1], rows[1:] + rows[:1])]
    assert got[0] == got[1] == got[2] and got[0][0].artist == "Ana Zed"
