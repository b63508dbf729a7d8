"""Sheets of mixed delimiters, restrict lists with fingerprints, functions by name in SQL, and counts without a pass of their own."""

from pyspark.sql import functions as F

from sievelake.functions import timed
from sievelake.operators import evidence
from sievelake.runtime import observed
from sievelake.sources import files


def test_sheets_of_mixed_delimiters(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("﻿file\thint\n1.mp3\tone, two\n2.mp3\told\n")
    (tmp_path / "b.csv").write_text("file,hint,link\n2.mp3,new,http://x\n")
    (tmp_path / "c.csv").write_text("hint;file\nthree;3.mp3\n")
    df = files.sheets(spark, str(tmp_path / "*.?sv"))
    assert {(r.file, r.hint, r.link, r._order) for r in df.collect()} == {("1.mp3", "one, two", None, 1), ("2.mp3", "old", None, 1), ("2.mp3", "new", "http://x", 2), ("3.mp3", "three", None, 3)}
    frames = [df.where(F.col("_order") == k).select("file", "hint", F.lit(False).alias("is_note")) for k in (1, 2, 3)]
    assert {(r.file, r.hint) for r in files.latest_answers(frames, "file").collect()} == {("1.mp3", "one, two"), ("2.mp3", "new"), ("3.mp3", "three")}


def test_restrict_list_with_fingerprints(spark, tmp_path):
    (tmp_path / "only.txt").write_text("# note\nfp1\nb.mp3\nfp2\nzz\n\n")
    prints = spark.createDataFrame([("fp1", "a.mp3"), ("fp2", "gone.mp3"), ("fp3", None)], "fingerprint string, path string")
    got = files.restrict_list(spark, str(tmp_path / "only.txt"), spark.createDataFrame([("a.mp3",), ("b.mp3",)], "key string"), prints)
    assert {tuple(r) for r in got.collect()} == {("fp1", True, "a.mp3"), ("b.mp3", True, "b.mp3"), ("fp2", False, "gone.mp3"), ("zz", False, "zz")}


def test_functions_by_name(spark):
    timed.register(spark)
    rows = [(1, "[00:01.50][01:02]la la\n[00:03] ♪\nno stamp\n[0:05.125]x"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "k int, t string")
    df.createOrReplaceTempView("sheets_of_test")
    got = spark.sql("SELECT k, l.* FROM sheets_of_test, LATERAL timed_lines(t) l").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, timed.lines(df, "t", "k").collect())) and len(got) == 3
    assert spark.sql("SELECT sheet_shifted('[00:01.50]x', 2.0D) AS s, texts_ratio('abcd', 'bcde') AS r").first() == ("[00:03.50]x", 0.75)


def test_counts_ride_along(spark):
    df = spark.range(1000).withColumn("state", F.when(F.col("id") % 3 == 0, "FOUND").otherwise("NO_MATCH"))
    out, seen = observed(df, "stage", found=F.col("state") == "FOUND", late=F.col("id") > 900)
    assert out.where("id < 1000").groupBy("state").count().count() == 2
    want = df.agg(F.count("*"), F.count_if(F.col("state") == "FOUND"), F.count_if(F.col("id") > 900)).first()
    assert seen.get == {"rows": want[0], "found": want[1], "late": want[2]}


def test_relocation_by_ancestors(spark):
    paths = ["/m/a/1", "/m/a", "/m/ab/1", "/m/b/2", "/x/1", "rel/1", "/m//y", None]
    moves = [("/m", "/n"), ("/m/a", "/z"), ("rel", "/n/b"), ("/m/", "/q")]
    got = {r.path: (r.new_path, r.clash) for r in evidence.relocation(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(moves, "old string, new string")).collect()}
    best = lambda p: max(((o, n) for o, n in moves if p == o or p.startswith(o + "/")), key=lambda x: len(x[0]), default=("", ""))
    want = {p: best(p)[1] + p[len(best(p)[0]) :] for p in paths if p}
    assert {p: n for p, (n, _) in got.items()} == want
    assert all(c == (list(want.values()).count(n) > 1) for n, c in got.values())
