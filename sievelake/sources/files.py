"""Files as tables: delimited sheets, lists, binary trees; and the writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """The table at path, or no rows of the schema where there is none."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def tree(spark: SparkSession, path: str, pattern: str = "*.{mp3,m4a,flac,opus,ogg,wav}") -> DataFrame:
    """(path, length, modificationTime) of the files under a folder; contents are read only if asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).dropDuplicates(["path"])


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """A sheet whose delimiter is the most frequent of tab, comma and semicolon in its header; a byte-order mark is dropped."""
    head = spark.read.text(path).first()
    line = (head[0] if head else "").lstrip("﻿")
    sep = max("\t,;", key=line.count)
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def latest_answers(frames: list[DataFrame], key: str, note: str = "is_note") -> DataFrame:
    """Sheets merged by key: later sheets win, but a note never displaces a real answer."""
    all_ = None
    for i, f in enumerate(frames):
        f = f.withColumn("_file", F.lit(i))
        all_ = f if all_ is None else all_.unionByName(f)
    rest = [c for c in all_.columns if c not in (key, "_file")]
    return all_.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(~F.col(note), "_file")).alias("r")).select(key, "r.*")


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """All sheets that a path or pattern names, each with its own delimiter, sniffed from its header: their columns by name (missing ones null), and _file and _order, the place of the file in order of paths, for latest_answers()."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    heads = lines.groupBy("file").agg(F.min_by("value", F.struct("at", "id")).alias("head")).orderBy("file").collect()  # a row for each sheet
    by: dict[str, list[str]] = {}
    for r in heads:
        by.setdefault(max("\t,;", key=(r["head"] or "").count), []).append(r["file"])
    out = None
    for sep, paths in by.items():
        for columns in _by_header(heads, set(paths), sep).values():
            df = spark.read.option("header", True).option("sep", sep).csv(columns)
            df = df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns]).withColumn("_file", F.col("_metadata.file_path"))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], "_file string, _order int")
    order = F.array_position(F.array(*[F.lit(r["file"]) for r in heads]), F.col("_file")).cast("int")
    return out.withColumn("_order", order)


def _by_header(heads: list, paths: set[str], sep: str) -> dict[tuple, list[str]]:
    """The files of equal header columns."""
    out: dict[tuple, list[str]] = {}
    for r in heads:
        if r["file"] in paths:
            out.setdefault(tuple((r["head"] or "").split(sep)), []).append(r["file"])
    return out


def restrict_list(spark: SparkSession, path: str, known: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """(entry, resolved, path) of a list's lines, blank ones and # comments left out, against known (key). An entry that is a fingerprint of prints (fingerprint, path) stands for that path."""
    lines = spark.read.text(path).select(F.trim("value").alias("entry")).where("entry <> '' AND NOT startswith(entry, '#')").distinct()
    if prints is not None:
        named = prints.where("path IS NOT NULL").groupBy(F.col("fingerprint").alias("entry")).agg(F.max("path").alias("p"))
        lines = lines.join(named, "entry", "left").select("entry", F.coalesce("p", "entry").alias("path"))
    else:
        lines = lines.withColumn("path", F.col("entry"))
    d = lines.join(known.select(F.col("key").alias("path"), F.lit(True).alias("k")).distinct(), "path", "left")
    return d.select("entry", F.coalesce("k", F.lit(False)).alias("resolved"), "path")


def write_table(df: DataFrame, path: str) -> None:
    """df as parquet; the committer makes it visible only once every task is done."""
    df.write.mode("overwrite").parquet(path)


def write_playlists(df: DataFrame, path: str, crate: str = "crate", member: str = "path") -> None:
    """One folder of text for each crate, members in order."""
    df.select(crate, F.col(member).alias("value")).repartition(crate).sortWithinPartitions(crate, "value").write.mode("overwrite").partitionBy(crate).text(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """A review sheet as tab-separated text with a header."""
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
