"""Benchmark decontamination in DataFrame operations only: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Windows of an item's size are laid at every start where the shingles they share
with it, wherever these stand, could make them similar enough. Each window's
SimHash (64 bits, shingles weighted by their rarity among the items) is cut
into RADIUS + 1 blocks; two fingerprints within RADIUS bits agree in one block at
least, so joining on (item, block, value) each window with the items it was laid for finds them all. What lies within the
radius is verified: sum of the smaller over sum of the larger weighted shingle counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.runtime import broadcast_if_small, cut

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
#: Rows up to which shingles of items, and windows, are broadcast; their number is counted first.
SMALL = 200_000


def words(text):
    """Runs of letters and digits, lower-cased; null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(w: str, k: int) -> str:
    args = ", ".join(f"{w}[i + {j}]" for j in range(k))
    return f"CASE WHEN size({w}) >= {k} THEN transform(sequence(0, size({w}) - {k}), i -> xxhash64({args})) ELSE array() END"


def _simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fp: the sign of the weighted sum of each bit over (keys, h, weight)."""
    sums = [F.sum(F.when(F.getbit("h", F.lit(b)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{b}") for b in range(64)]
    bits = F.lit(0).cast("long")
    for b in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return rows.groupBy(*keys).agg(*sums).select(*keys, bits.alias("fp"))


def _blocks(fp: str) -> str:
    n = RADIUS + 1
    at = [round(i * 64 / n) for i in range(n + 1)]
    parts = ", ".join(f"shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1}L" for a, b in zip(at, at[1:], strict=False))
    return f"array({parts})"


def _starts(hits: DataFrame, similarity: float, least: float) -> DataFrame:
    """doc_id, t, item_id, k, len, size, start: windows that may be similar enough, from the text positions p whose shingle an item has.

    A shingle at p is in the windows that start from p - size + k to p, so what a window shares with the item changes
    only there, and is summed up along the text. Its other shingles weigh `least` each, or more.
    """
    item = ["doc_id", "t", "item_id", "k", "size"]
    enough = F.col("all") >= F.lit(similarity) * F.col("theirs") - 1e-6
    hits = hits.withColumn("all", F.sum("weight").over(Window.partitionBy(*item))).where(enough)
    last = F.greatest(F.lit(0), F.col("n") - F.col("size"))
    first, after = F.greatest(F.lit(0), F.col("p") - F.col("size") + F.col("k")), F.least(F.col("p"), last) + 1
    ends = F.explode(F.array(F.struct(first.alias("at"), F.col("weight").alias("dw"), F.lit(1).alias("dc")), F.struct(after.alias("at"), (-F.col("weight")).alias("dw"), F.lit(-1).alias("dc"))))
    along = Window.partitionBy(*item).orderBy("at")
    steps = hits.select(*item, "n", "theirs", ends.alias("x")).select(*item, "n", "theirs", "x.*")
    steps = steps.select(*item, "n", "theirs", "at", F.sum("dw").over(along).alias("shared"), F.sum("dc").over(along).alias("c"), F.lead("at").over(along).alias("to"))
    size = F.least("n", "size")
    others = (size - F.col("k") + 1 - F.col("c")) * F.lit(least)
    bound = F.least("shared", "theirs") / (F.greatest("shared", "theirs") + others)
    steps = steps.where((F.col("to") > F.col("at")) & (F.col("c") > 0)).where(bound >= similarity - 1e-6)
    return steps.select("doc_id", "t", "item_id", "k", size.alias("len"), "size", F.explode(F.sequence(F.col("at"), F.col("to") - 1)).alias("start"))


def find(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words, distance): each leak of an item into a row of docs, at its best window.

    Words are runs of letters and digits, lower-cased; shingles are of five
    words, of all of an item's words where it has fewer. Of a text shorter than
    an item the whole is its window. Null and empty texts and items leak nothing. Rows
    repeated with id and text are one; of rows that share an id only, each counts and the best is returned. Other
    columns play no part, whatever their names. Empty tables give no rows.
    """
    it = items.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("w")).where("size(w) > 0")
    it = it.withColumn("size", F.size("w")).withColumn("k", F.least(F.lit(SHINGLE), "size"))
    ks = sorted(r["k"] for r in it.select("k").distinct().collect())
    shingles = None
    for k in ks:
        part = it.where(F.col("k") == k).select("item_id", "size", "k", F.posexplode(F.expr(_hashes("w", k))).alias("j", "h"))
        shingles = part if shingles is None else shingles.unionByName(part)
    out = "doc_id {0}, item_id {1}, similarity double, first_word int, n_words int, distance int".format(docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString())
    if shingles is None:
        return docs.sparkSession.createDataFrame([], out)
    shingles = cut(shingles)
    n_items = shingles.select("item_id").distinct().count()
    weights = shingles.groupBy("k", "h").agg((F.log(F.lit(n_items + 1.0) / (F.countDistinct("item_id") + 1.0)) + 1.0).alias("weight"))
    unseen = math.log((n_items + 1.0) / 2.0) + 1.0  # as if one item had it
    least = min(weights.agg(F.min("weight")).first()[0], unseen)
    heavy = broadcast_if_small(weights, SMALL)
    theirs = cut(shingles.groupBy("item_id", "k", "size", "h").agg(F.count(F.lit(1)).alias("c")).join(heavy, ["k", "h"]))
    whole = theirs.groupBy("item_id", "k", "size").agg(F.sum(F.col("c") * F.col("weight")).alias("theirs"))
    lay = broadcast_if_small(theirs.join(whole, ["item_id", "k", "size"]).select("item_id", "k", "size", "h", "weight", "theirs"), SMALL)

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("length(text) > 0")
    w = d.select("doc_id", F.xxhash64("text").alias("t"), words(F.col("text")).alias("w"))
    hits = None
    for k in ks:
        at = w.where(F.size("w") >= k).select("doc_id", "t", F.size("w").alias("n"), F.posexplode(F.expr(_hashes("w", k))).alias("p", "h")).withColumn("k", F.lit(k))
        hit = at.join(lay, ["k", "h"]).drop("h")
        hits = hit if hits is None else hits.unionByName(hit)
    laid = cut(_starts(hits.distinct(), similarity, least).distinct())
    # The windows' own shingles, from the texts that have any.
    by = laid.groupBy("doc_id", "t").agg(F.collect_set(F.struct("k", "len", "size", "start")).alias("x"))
    full = w.join(F.broadcast(by) if laid.limit(SMALL + 1).count() <= SMALL else by, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).select("doc_id", "t", "w", F.explode("x").alias("x"))
    piece = full.select("doc_id", "t", "x.*", F.expr("slice(w, x.start + 1, x.len)").alias("v"))
    keys = ["doc_id", "t", "k", "size", "start"]
    inside = None
    for k in ks:
        part = piece.where(F.col("k") == k).select(*keys, F.explode(F.expr(_hashes("v", k))).alias("h"))
        inside = part if inside is None else inside.unionByName(part)
    counts = cut(inside.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("c")).join(heavy, ["k", "h"], "left").withColumn("weight", F.coalesce("weight", F.lit(unseen))))

    def prints(rows: DataFrame, keys: list[str]) -> DataFrame:
        return _simhash(rows.withColumn("weight", F.col("c") * F.col("weight")), keys)

    # A window meets the items that it was laid for, no others.
    aims = broadcast_if_small(laid.select(*keys, "item_id"), SMALL)
    mine = prints(counts, keys).join(aims, keys).select("*", F.posexplode(F.expr(_blocks("fp"))).alias("b", "v"))
    other = prints(theirs, ["item_id", "k", "size"]).select("item_id", "k", "size", F.col("fp").alias("ifp"), F.posexplode(F.expr(_blocks("fp"))).alias("b", "v"))
    near = mine.join(broadcast_if_small(other, SMALL), ["item_id", "k", "size", "b", "v"]).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))))
    near = near.where(F.col("distance") <= RADIUS).select(*keys, "item_id", "distance").distinct()

    total = counts.groupBy(*keys).agg(F.sum(F.col("c") * F.col("weight")).alias("mine"))
    both = near.join(counts.withColumnRenamed("c", "cm"), keys).join(broadcast_if_small(theirs.select("item_id", "k", "size", "h", F.col("c").alias("ct")), SMALL), ["item_id", "k", "size", "h"])
    common = both.groupBy(*keys, "item_id", "distance").agg(F.sum(F.least("cm", "ct") * F.col("weight")).alias("common"))
    sim = common.join(total, keys).join(broadcast_if_small(whole, SMALL), ["item_id", "k", "size"]).withColumn("similarity", F.round(F.col("common") / (F.col("mine") + F.col("theirs") - F.col("common")), 6))
    best = sim.where(F.col("similarity") >= similarity).groupBy("doc_id", "item_id").agg(F.max_by(F.struct("similarity", F.col("start").alias("first_word"), F.col("size").alias("n_words"), "distance"), F.struct("similarity", -F.col("start"), F.col("t"))).alias("x"))
    return best.select("doc_id", "item_id", "x.*")


def remove(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, **more) -> DataFrame:
    """docs without the rows that an item leaked into."""
    ids = find(docs.select("doc_id", "text"), items, similarity, **more).select("doc_id").distinct()
    return docs.join(broadcast_if_small(cut(ids)), "doc_id", "left_anti").select(docs.columns)
