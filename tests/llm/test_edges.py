"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for operators and every stage of the pipeline; and statistics against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelake.llm import arrays as A
from sievelake.llm import bpe, fingerprints, langid, licences, near_dup, pages, quality
from test_llm import CLASH, DATA, frame, odd

STAGE_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def stage_rows():
    return [(i, t, None if i == 3 else "en", None, None if t is None else len(t)) for i, t in odd()] + [(None, "no id at all", None, None, None), (None, None, None, None, None)]


@pytest.mark.parametrize("k", range(5))
def test_stage_edges(spark, k):
    """Every stage over awkward rows, over null-only and empty texts, and over an empty table, with clashing columns."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    for rows in (stage_rows(), [(1, None, None, None, None), (2, "", None, None, 0), (2, "", None, None, 0)], []):
        df = frame(spark, rows, STAGE_COLUMNS)
        out = stage(spark, df, DATA)
        if k < 4:
            assert out.columns == df.columns, name
        got = out.collect()
        ids = Counter(r.doc_id for r in got)
        assert all(n <= Counter(r[0] for r in rows)[i] for i, n in ids.items())
        if name in ("pii", "tokens"):
            assert len(got) == len(rows)
        if name == "near_duplicates":
            assert ids[3] == 2 * (len(rows) > 3) and ids[None] == 2 * (len(rows) > 3) and not ids[6] and not ids[7]
        if name in ("quality", "decontamination"):
            assert ids[None] == Counter(r[0] for r in rows)[None]


def brute_means(texts, target, raw):
    """Mean log ratio of each text's n-grams, from their definition."""
    def grams(t):
        t = re.sub("[A-Z]", lambda m: m.group().lower(), t)
        w = [x for x in re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+|[^0-9A-Za-z_\u0080-\U0010ffff\x20\x09-\x0D]+", t)]
        return [(x,) for x in w] + [("=", "=") if x == y else (x, y) for x, y in zip(w, w[1:], strict=False)]

    def bucket(g):
        h = [int(A.word_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x.encode())]))[0]) for x in g]
        if g == ("=", "="):
            return int(quality._SAME >> np.uint64(50))
        if len(h) == 1:
            return h[0] >> 50
        return int(A.mix(np.array([h[0]], np.uint64) * A.FACTORS[5] + np.array([h[1]], np.uint64))[0]) >> 50

    count = lambda ts: Counter(bucket(g) for t in ts for g in grams(t))
    t, r = count(target), count(raw)
    nt, nr = sum(t.values()), sum(r.values())
    q = lambda b: (r[b] + 0.5) / (nr + 0.5 * quality.BUCKETS)
    ratio = lambda b: np.log((t[b] + quality.SHARE * nt * q(b)) / (nt + quality.SHARE * nt) / q(b))
    return [sum(ratio(bucket(g)) for g in grams(x)) / len(grams(x)) if grams(x) else None for x in texts]


def test_quality_weights_and_draw(spark):
    rng = random.Random(5)
    words = ["the", "of", "Größe", "and", "x_1", "river", "stone"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "!", "?!"]) for _ in range(rng.randrange(3, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "the the the of")]
    good = list(range(0, 40))
    docs = frame(spark, rows)
    got = {r.doc_id: r.log_weight for r in quality.weights(docs, spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()}
    text = {i: t or "" for i, t in rows}
    fold = {r.i: r.f for r in spark.createDataFrame([(i,) for i in good], "i long").select("i", F.pmod(F.xxhash64("i", F.lit(7)), F.lit(quality.FOLDS)).alias("f")).collect()}
    raw = list(text.values())
    unseen = [brute_means([text[i]], [text[j] for j in good if fold[j] != fold[i]], raw)[0] for i in good]
    mid, low = np.percentile(unseen, [50, 5])
    mean = dict(zip(text, brute_means(list(text.values()), [text[i] for i in good], raw), strict=True))
    for i in text:
        want = 0.0 if mean[i] is None else (mean[i] - mid) * quality.UNIT / max(mid - low, 1e-3)
        assert abs(got[i] - want) < 1e-6, i
    k = 20
    out = quality.resample(docs, spark.createDataFrame([(i,) for i in good], "doc_id long"), k=k).withColumn("g", quality.gumbel(1)).collect()
    keys = sorted((int(np.floor((r.log_weight + r.g) * 1024)) for r in out), reverse=True)
    assert {r.doc_id for r in out if r.kept} == {r.doc_id for r in out if int(np.floor((r.log_weight + r.g) * 1024)) >= keys[k - 1]}
    few = quality.resample(docs, spark.createDataFrame([(1,), (2,)], "doc_id long")).collect()
    assert all(r.kept and r.log_weight == 0 for r in few)


def test_quality_rejects_junk_whatever_its_length(spark):
    """Junk goes with few labels too, and repeating a junk text doesn't lift it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    bad = labels.where("quality = 0").select("doc_id").distinct()
    more = docs.join(bad, "doc_id").select((F.col("doc_id") + 10**6).alias("doc_id"), F.repeat(F.concat("text", F.lit(" ")), 20).alias("text"))
    good = labels.where("quality = 1")
    kept = {r.doc_id: r.kept for r in quality.resample(docs.unionByName(more), good).collect()}
    long = [v for i, v in kept.items() if i >= 10**6]
    assert sum(long) <= 0.15 * len(long) and all(kept[r.doc_id] for r in good.collect())


def test_densification_is_unbounded_probing():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 9).astype(np.uint64) * np.uint64(2)
    rows = np.array([0, 0, 1, 2, 2, 2, 2, 2, 2])
    sig = near_dup.signatures(h, rows, 4)
    for r in range(3):
        mine = h[rows == r]
        full = {}
        for x in sorted(mine, reverse=True):
            full[int(x) >> 55] = x
        for b in range(0, near_dup.BINS, 37):
            t, at = 0, b
            while at not in full:
                at = int(near_dup._probe(np.array([b]), t)[0])
                t += 1
            assert sig[r, b] == full[at]
    assert (sig[3] == near_dup._EMPTY).all()


def test_near_duplicates_recall_and_shared_ids(spark):
    """Links of every document whose id is divisible by 20, against all documents, by brute force."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))) if w else frozenset()
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    links = [(a, b) for a in sets if a % 20 == 0 for b in sets if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links and all(got[a] == got[b] for a, b in links)
    base = [f"w{i}" for i in range(100)]
    near = base[:95] + [f"v{i}" for i in range(5)]
    both = near_dup.near_duplicates(frame(spark, [(1, " ".join(base)), (2, "quite another text of more words"), (2, " ".join(near)), (3, " ".join(near[:99]))])).collect()
    assert sorted((r.doc_id, r.component_id) for r in both) == [(1, 1), (2, 1), (2, 1), (3, 1)]


def test_language_edges(spark):
    de, en = "und der die das ist nicht ein eine mit auf ", "the and of to in is that it was for "
    rows = [(i, (de if i % 2 else en) * 30, "de" if i % 2 else "en") for i in range(60)]
    far = [(200 + i, "1234567890 " * (400 + i) + de * 100, "de") for i in range(12)]
    docs = frame(spark, rows + far + [(None, en * 3, "en"), (70, None, "en"), (71, "", None), (72, "77 ?", "de"), (73, en, None), (73, en, None)], "doc_id long, text string, lang string")
    got = langid.identify(docs).collect()
    assert len(got) == 78 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].held_out and {by[i].lang_pred for i in (70, 71, 72)} == {"und"} and by[73].lang_pred == "en"
    assert all(by[i].lang_pred == ("de" if i % 2 else "en") for i in range(60))
    seen = langid.drawn(docs, "text", "lang", "doc_id", 1000).where("label = 'de'").collect()
    assert any(b"und der" in bytes(r.windows) for r in seen if b"1234567890" in bytes(r.windows)), "windows come from the whole text"
    assert len(langid.drawn(docs, "text", "lang", "doc_id", 7).collect()) in (13, 14)  # one text has no letter
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_pages_unclosed_and_long():
    read = lambda h: pages.text_at(h, [])
    assert read("<p>Hello one.</p><svg width=1/><p>Second para here.</p>") == "Hello one. Second para here."
    assert read("<p>Hello one.</p><button>Go<p>Second para here.</p>") == "Hello one. Go Second para here."
    assert read("<div><p>Hello one.</p><button>Go</button><p>Second.</p></div><button>A<button>B</button>") == "Hello one. Second."
    assert read("<p>a</p><script>x < y</script><svg><path d=1></svg><p>b</p><script>open to the end <p>c</p>") == "a b"
    long = "<html><body><article>" + "<p>word &amp; word</p>" * 60_000 + "<svg>" * 3000 + "</article></body></html>"
    assert read(long) == " ".join(["word & word"] * 60_000)


def test_empty_tables_and_clashing_columns(spark):
    none = frame(spark, [])
    assert bpe.encode(none, *bpe.default_vocabulary()).count() == 0
    assert licences.scan(none).count() == 0
    assert fingerprints.compare_with_edits(frame(spark, [(1, None)])).first().near_next == 1.0
    assert {"n", "fold", "label", "mean"} - set(CLASH)
    assert quality.resample(none, none.select("doc_id")).count() == 0


def test_licence_texts(spark):
    """Whole texts get their own label alone; a phrase that two licences share names neither."""
    rows = [(i, f"Copyright someone. {t} And more text.") for i, (_, t) in enumerate(licences.TEMPLATES)]
    rows += [(900, "This work is licensed under the house rules of nobody"), (901, " ".join([licences.TEMPLATES[4][1]] * 2))]
    got = {r.doc_id: (r.labels, r.spans) for r in licences.scan(frame(spark, rows)).collect()}
    for i, (label, _) in enumerate(licences.TEMPLATES):
        assert got[i][0] == label, (i, got[i])
    assert got[900] == ("", "") and len(got[901][1].split(",")) == 2


def test_fingerprint_retries_grow(spark):
    """Groups that no small sketch can peel are read from larger ones."""
    keys = ", ".join(f"xxhash64({i})" for i in range(600))
    row = spark.range(1).selectExpr(f"array({keys}) AS a", "array(xxhash64(1), xxhash64(9999)) AS b").selectExpr(f"{fingerprints._group('a', 'b')} AS x").first().x
    assert (row.l, row.r) == (599, 1)


def test_arrow_lists_stay_plain():
    h, rows = np.array([5, 1 << 60], np.uint64), np.array([0, 1])
    assert near_dup._bitmaps(h, rows, 2).shape == (2, near_dup.BITS // 8) and pa.array(rows).type == pa.int64()
