"""Titles, notes, folds and credits on written-out examples: capitals with accents, quoted titles, wide letters and ligatures, white space beyond ASCII."""

import random
import unicodedata
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from sievelake.functions import answers as A
from sievelake.functions import names as N
from sievelake.functions import text as X
from sievelake.functions import titles as T


def each(spark, values, column, schema="c string"):
    df = spark.createDataFrame([(k, *v) if isinstance(v, tuple) else (k, v) for k, v in enumerate(values)], "k int, " + schema)
    return [r.x for r in df.select("k", column.alias("x")).orderBy("k").collect()]


def test_video_titles_with_capitals(spark):
    want = {"Pesma (UŽIVO)": "Pesma", "Pesma (uživo)": "Pesma", "Песма ИЗ ФИЛЬМА": "Песма", "Canción (VERSIÓN OFICIAL)": "Canción", "Ljubav (OFFICIAL VIDEO) 2018": "Ljubav", "Sarvagon 2015": "Sarvagon 2015", None: None}
    assert dict(zip(want, each(spark, list(want), T.video_title(F.col("c"))), strict=True)) == want


def test_names_from_videos(spark):
    case = [
        # title, channel, description, artist, title, how
        ('"This is my Biome"- A Minecraft Parody', "Captain", None, "Captain", "This is my Biome", "quoted title, uploader"),
        ('"This is my Biome" - A Minecraft Parody of Payphone', "Captain - Topic", None, "Captain", "This is my Biome", "quoted title, uploader"),
        ('"This is my Biome" - A Minecraft Parody', None, None, None, "This is my Biome", "quoted title, artist unknown"),
        ('"Weird Al" Yankovic - Eat It', "WeirdAlVEVO", None, 'Weird Al" Yankovic', "Eat It", "video title"),
        ("„Song", "Ch", "IZVOĐAČ: Novi Fosili\nPJESMA: Tonka", "Novi Fosili", "Tonka", "description field"),
        ("„Song", "Ch", "izvođač: Novi Fosili", "Novi Fosili", "„Song", "description field"),
        ("Prljavo Kazaliste-Zbog mene ne placi", "lusy1995", None, "Prljavo Kazaliste", "Zbog mene ne placi", "video title"),
    ]
    n = T.names_from(F.col("t"), F.col("ch"), F.col("d"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    got = each(spark, [c[:3] for c in case], n, "t string, ch string, d string")
    assert [tuple(x) for x in got] == [c[3:] for c in case]


def test_note_fields_scan_on(spark):
    u = "https://v.example/1 "
    want = {
        u + "artist: Foo, title: Bar": ("Foo, title: Bar", None, None, None),
        u + "artist: Foo; title: Bar": ("Foo", "Bar", None, None),
        u + "(Blackbear is the artist) YEAR=1999": ("Blackbear", None, None, "1999"),
        u + "title: One; title: Two": (None, "One", None, None),
        u + "subtitle: No": (None, None, None, None),
        None: (None, None, None, None),
    }
    got = each(spark, list(want), A.note_fields(F.col("c")))
    assert [(x.artist, x.title, x.album, x.year) for x in got] == list(want.values())


def test_folds_of_wide_letters_and_ligatures(spark):
    want = {"ＡＢＢＡ": "abba", "ĳs ﬁn": "ijs fin", "Ǆep": "dzep", "ﬄ１２": "ffl12", "Grše": "grse", "naïve café": "naive cafe", None: ""}
    assert each(spark, list(want), N.norm_identity(F.col("c"))) == list(want.values())
    assert each(spark, ["ＡＢＢＡ ﬁn"], N.norm_store(F.col("c"))) == ["abba fin"]


def test_credits_part_at_any_white_space(spark):
    want = {"A x B": ["A", "B"], "A feat. B": ["A", "B"], "A x B": ["A", "B"], "Axb": ["Axb"], "A & B; C": ["A", "B", "C"]}
    assert each(spark, list(want), N.split_credit(F.col("c"))) == list(want.values())


def test_decorations_come_off_up_to_the_bound(spark):
    assert each(spark, ["A - B" + " (official video)" * 8, "A - B [HD] (lyrics) uživo UŽIVO"], N.clean_stem(F.col("c"))) == ["A - B", "A - B"]


def test_python_functions_against_the_standard_library(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdéßЖ 日ﬁ½") for _ in range(rng.randrange(0, 14))) for _ in range(120)]
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    assert each(spark, words, N.nfkd_fold(F.col("c"))) == [fold(w) for w in words]
    pairs = list(zip(words, reversed(words), strict=True))
    ratio = each(spark, pairs, X.sequence_ratio(F.col("a"), F.col("b")), "a string, b string")
    assert all(abs(r - SequenceMatcher(None, a, b).ratio()) < 1e-9 for r, (a, b) in zip(ratio, pairs, strict=True))
