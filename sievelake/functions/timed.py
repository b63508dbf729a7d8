"""Timed text: stamps, lines, shifts, positions."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_STAMP = r"\[([0-9]+):([0-9]{2})(?:[.:]([0-9]{1,3}))?\]"


def lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, sec, words) of a sheet: a line of several stamps comes once for each, blank and music-only lines not at all."""
    one = df.select(*keys, F.explode(F.split(text, "\n")).alias("l"))
    words = F.trim(F.regexp_replace("l", _STAMP, ""))
    s = one.select(*keys, words.alias("words"), F.explode(F.regexp_extract_all("l", F.lit(_STAMP), 0)).alias("s")).where(~F.col("words").rlike(r"^[\s♪♫]*$"))
    frac = F.regexp_extract("s", _STAMP, 3)
    sec = F.regexp_extract("s", _STAMP, 1).cast("double") * 60 + F.regexp_extract("s", _STAMP, 2).cast("double") + F.when(frac == "", 0.0).otherwise(frac.cast("double") / F.pow(F.lit(10.0), F.length(frac)))
    return s.select(*keys, F.round(sec, 3).alias("sec"), "words")


class TimedLines:
    """Table function: (sec, words) of a sheet, as lines() gives them, in order of its lines."""

    def eval(self, text: str | None) -> Iterator[tuple[float, str]]:
        for line in (text or "").split("\n"):
            words = re.sub(_STAMP, "", line).strip(" ")
            if re.fullmatch(r"[\s♪♫]*", words, re.ASCII):
                continue
            for m in re.finditer(_STAMP, line):
                yield round(int(m[1]) * 60.0 + int(m[2]) + (int(m[3]) / 10.0 ** len(m[3]) if m[3] else 0.0), 3), words


def register(spark: SparkSession) -> None:
    """Makes the functions of this library that SQL lacks callable by name: the table function timed_lines(text), and sheet_shifted(text, seconds) and texts_ratio(a, b)."""
    spark.udtf.register("timed_lines", udtf(TimedLines, returnType="sec double, words string"))
    spark.udf.register("sheet_shifted", F.pandas_udf(lambda s, d: pd.Series([shifted(t, x) for t, x in zip(s, d, strict=True)]), "string"))
    spark.udf.register("texts_ratio", F.pandas_udf(lambda a, b: pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)]), "double"))


def shifted(text: str | None, delta: float) -> str | None:
    """The sheet with every stamp moved, never below zero, fractions as wide as before."""

    def move(m: re.Match) -> str:
        width = len(m[3] or "")
        unit = 10**width
        total = max(0, round((int(m[1]) * 60 + int(m[2])) * unit + int(m[3] or 0) + delta * unit))
        whole, part = divmod(total, unit)
        return f"[{whole // 60:0{len(m[1])}d}:{whole % 60:02d}" + (f".{part:0{width}d}]" if width else "]")

    return None if text is None else re.sub(_STAMP, move, text)


def shift(text: Column, delta: float) -> Column:
    """shifted() as a column: replacing with a computed value has no SQL form."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: shifted(t, delta))

    return run(text)
