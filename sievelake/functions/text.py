"""Names and titles as column expressions: folding, splitting, version words, fits."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and what they fold to.
ACCENTED, PLAIN = "àáâãäåèéêëìíîïòóôõöùúûüñçýÿšžčćěřůłøı", "aaaaaaeeeeiiiiooooouuuuncyyszccerulio"
LIGATURES = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("đ", "dj"), ("þ", "th"))
VERSION_WORDS = ("remix", "live", "acoustic", "instrumental", "cover", "edit", "demo", "mix", "original")


def deaccent(c: Column) -> Column:
    """Lower case without accents."""
    out = F.translate(F.lower(c), ACCENTED, PLAIN)
    for a, b in LIGATURES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def norm(c: Column) -> Column:
    """Folded, everything but letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(deaccent(c), "[^a-z0-9]+", " "))


def skeleton(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def strip_decorations(c: Column, rounds: int = 4) -> Column:
    """Bracketed decorations at the end go, one a round, and white space is tidied."""
    for _ in range(rounds):
        c = F.regexp_replace(c, r"(?i)\s*[(\[](official[^)\]]*|lyrics?|hd|hq|audio|video)[)\]]\s*$", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def split_name(c: Column) -> tuple[Column, Column]:
    """(artist, title) of a file's stem: parts at spaced dashes, artist null where there is one part only."""
    parts = F.split(strip_decorations(c), r"\s+[-–—]\s+")
    many = F.size(parts) > 1
    return F.when(many, parts[0]), F.when(many, F.array_join(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts) - 1)), " - ")).otherwise(parts[0])


def credits(c: Column) -> Column:
    """Names in a credit, in order, blanks dropped."""
    parts = F.split(c, r"(?i)\s*(?:;|,|\s&\s|\sx\s|\s(?:feat|ft|featuring)\.?\s)\s*")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def version_words(c: Column) -> Column:
    """Marker words of a title, sorted; `original` makes `mix` mean nothing."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\b(" + "|".join(VERSION_WORDS) + r")\b"), 1))
    return F.sort_array(F.when(F.array_contains(words, "original"), F.array_remove(words, "mix")).otherwise(words))


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def fit(want: Column, got: Column) -> Column:
    """0 to 1 of two normal forms: equal 1, one within the other 0.85, else shared words over all words; blank 0."""
    a, b = F.array_distinct(F.split(want, " ")), F.array_distinct(F.split(got, " "))
    jac = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((want == "") | (got == "") | want.isNull() | got.isNull(), 0.0).when(want == got, 1.0).when(F.contains(want, got) | F.contains(got, want), 0.85).otherwise(F.round(jac, 6))


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    """Ratcliff-Obershelp ratio, for which there is no SQL; null counts as empty."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return run(a, b)


def containment(t: Column, l: Column) -> Column:  # noqa: E741
    """Share of t's distinct members that l has; 0 if either is empty."""
    return F.when((F.size(t) > 0) & (F.size(l) > 0), F.round(F.size(F.array_intersect(t, l)) / F.size(t), 6)).otherwise(0.0)
