"""The ten operators against brute force, round trips and held-out accuracy, with nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import html as html_lib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.llm import bpe, fingerprints, langid, leaks, licences, near_dup, pages, pii, quality, queries, repeats

DATA = "/root/testdata/sf0.001"
#: Columns that clash with names used inside the operators.
CLASH = ["n", "key", "shard", "c1", "bands", "a", "b", "w", "h", "t", "r", "q", "host", "size", "start", "value", "kept", "_terms"]


def frame(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def odd(seed=3):
    """Rows of every awkward kind."""
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(60)) for _ in range(5)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (3, "one"), (4, "one two three"), (5, base[0]), (6, base[0]), (7, base[0] + " extra"), (8, base[1]), (9, base[1].upper()), (10, base[2] + ". " + base[3]), (11, base[3]), (12, "y" * 3000), (13, "y" * 3000), (14, "long " * 40_000), (15, base[4] + "\n" + base[4])]
    for k in range(12):
        w = base[2].split()
        w[k * 5 % 60] = f"new{k}"
        rows.append((20 + k, " ".join(w)))
    return rows


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    rows = odd()
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[b]]
    want = components(sets, links)
    got = near_dup.near_duplicates(frame(spark, rows), k=k).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), want[i], i == want[i]) for i in sets}
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_open_buckets_lose_no_link():
    """Members of one bucket in many components: the bitmap bound never drops a true link."""
    rng = np.random.default_rng(5)
    core = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.append(rng.permutation(core)[: rng.integers(150, 200)], rng.integers(0, 2**63, rng.integers(1, 40)).astype(np.uint64))) for _ in range(40)]
    rows = np.repeat(np.arange(40), [len(s) for s in sets])
    bits = near_dup._bitmaps(np.concatenate(sets), rows, 40).view(np.uint64)
    for a in range(40):
        for b in range(a):
            far = int(np.bitwise_count(bits[a] ^ bits[b]).sum())
            assert far <= len(np.setxor1d(sets[a], sets[b]))


def brute_repeats(rows, length):
    seen = Counter((t or "").encode()[p : p + length] for _, t in rows for p in range(len((t or "").encode()) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 900])
def test_repeats(spark, shard_bytes):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdef ") for _ in range(700)) for _ in range(5)]
    rows = [(0, None), (1, ""), (2, base[0]), (2, base[0]), (3, base[1][100:600]), (4, base[1] + base[2]), (5, "x" * 900), (6, base[3][:399]), (7, base[3][:399] + "q"), (8, base[4][:400] + "zz"), (9, "yy" + base[4][:400]), (10, base[2][:500] + "1" + base[2][500:]), (11, "é" * 260 + base[1][50:460])]
    got = repeats.remove_repeats(frame(spark, rows), shard_bytes=shard_bytes, bucket_rows=4).collect()
    assert sorted(map(tuple, got)) == brute_repeats(rows, 400)
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_repeats_query_gives_the_text_that_is_left(spark):
    got = queries.op1_repeats(spark, DATA)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(texts) and any(r.n_removed for r in rows)
    for r in rows:
        assert r.n_removed or r.text == texts[r.doc_id]
        if "\ufffd" not in r.text:
            assert len(r.text.encode()) == r.n_bytes - r.n_removed and hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256


def test_interleave_is_the_sorted_order():
    rng = np.random.default_rng(1)
    runs = [np.unique(rng.integers(0, 9, (n, 2)).astype(np.uint64), axis=0) for n in (5, 0, 30, 12)]
    order, prefix = repeats.interleave(runs)
    rows = np.concatenate(runs)[order]
    assert [tuple(r) for r in rows] == sorted(tuple(r) for r in np.concatenate(runs))
    assert all(p == (0 if a[0] != b[0] else 1 if a[1] != b[1] else 2) for a, b, p in zip(rows, rows[1:], prefix[1:], strict=False))


def brute_pii(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(a, c, k) for a, _, c, k in sorted(out)]


def test_pii_patterns():
    rng = random.Random(1)
    parts = ["a", "B", "@", "@", ".", " ", "-", "+", "1", "25", "4111111111111111", "9.", "%", "(", ")", "é", "_", "1.2.3.4", "001"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 22)))
        assert pii.base_spans(t) == brute_pii(t), t


def test_pii_terms_and_rows(spark):
    rows = [(i, f"Zebulon lives here {'xyz' if i % 2 else 'abc'} mail zeb@corp.example.com the and {i}") for i in range(6)]
    rows += [(i, f"the and noise word{chr(97 + i % 26) * 3} mail lives here {i}") for i in range(6, 200)] + [(500, None), (501, ""), (502, "solo@one.example.org"), (502, "solo@one.example.org"), (503, "w" * 200_000 + "@")]
    df = frame(spark, rows)
    got = pii.find(df).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t or "" for i, t in rows if i == r.doc_id]
        want = [",".join(f"{k}:{a}:{b}" for a, b, k in brute_pii(t)) for t in texts]
        assert r.base_sha256 in [hashlib.sha256(w.encode()).hexdigest() for w in want]
    zeb = next(r for r in got if r.doc_id == 0)
    assert zeb.spans.split(",")[0] == "gone:0:7" and "email:" in zeb.spans
    clean = pii.sanitise(df)
    assert clean.columns == df.columns
    text = {r.doc_id: r.text for r in clean.collect()}
    assert "zeb@" not in text[0] and "Zebulon" not in text[0] and "<EMAIL>" in text[0] and "the and" in text[0]
    assert text[500] is None and text[6] == rows[6][1]
    assert pii.find(frame(spark, [])).count() == 0


def test_pii_counts_distinct_texts(spark):
    """Copies of a text with the term, or with the entity, don't change what is found."""
    rows = [(i, f"filler{chr(97 + i % 26) * 3} text number {i}") for i in range(300)]
    rows += [(1000 + i, f"Zebulon wrote from zeb@corp.example.com as number {i}") for i in range(5)] + [(1100, "Zebulon stands alone as number")]
    want = pii.find(frame(spark, rows)).where("doc_id = 1000").first()
    assert want.n_term >= 1 and "term:0:7" in want.spans
    for copied in (rows[-1][1], rows[-2][1]):
        got = pii.find(frame(spark, rows + [(2000 + i, copied) for i in range(400)])).where("doc_id = 1000").first()
        assert got.spans == want.spans


def test_pii_terms_of_a_single_text(spark, monkeypatch):
    """An entity of one text is scored, with terms of the whole text, however far off."""
    rows = [(i, f"common words stand here {i}") for i in range(300)]
    rows += [(1000, "Zebulon common " + "words stand here " * 200 + "solo@one.example.org"), (1001, "Quentin common words stand here")]
    got = {r.doc_id: r for r in pii.find(frame(spark, rows)).where("doc_id >= 1000").collect()}
    assert got[1000].spans.split(",")[0] == "gone:0:7" and got[1000].n_term == 1
    assert got[1001].spans == ""
    monkeypatch.setattr(pii, "TERM_ROWS", 0)
    assert {r.doc_id: r for r in pii.find(frame(spark, rows)).where("doc_id >= 1000").collect()} == got
    spans = pii.base_spans("écorp@x.com abc 1.2.3.4 def")
    assert [m.group() for m in pii.outside("écorp@x.com abc 1.2.3.4 def", spans)] == ["abc", "def"]


def test_bpe_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.default_vocabulary()
    c = bpe.codec(path, pattern)
    ranks = dict(zip(c.hash.keys, c.rank_at, strict=True))
    assert all(c.hash.slot(k) == s for s, k in enumerate(c.hash.keys)) and c.hash.slot(b"no such key at all") == -1
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = odd() + [(90, "naïve Ωmega 日本語 <|endoftext|> don't  \n\n x"), (91, "q" * 5000), (92, "́�  end ")]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in bpe.encode(frame(spark, rows), path, pattern).collect()}
    want = set()
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids)))
    assert got == want


def test_fingerprints(spark):
    rows = sorted(((i, t) for i, t in odd()), key=lambda x: x[0])
    rows = [r for k, r in enumerate(rows) if k == 0 or rows[k - 1][0] != r[0]] + [(99, "a. b. c. " * 3), (100, "\n".join(f"line {i}" for i in range(700)))]

    def parts(t):
        return {q.strip(" ") for q in re.split(r"\n+|(?<=[.!?]) +", t) if q.strip(" ")}

    def dice(x, y):
        return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0

    got = {r.doc_id: r for r in fingerprints.compare_with_edits(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - dice(parts(t), parts(edited))) < 1e-9 and abs(r.near_next - dice(parts(t), parts(nxt))) < 1e-9
    by = defaultdict(set)
    for i, t in rows:
        by[t or ""].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by.values())
    assert fingerprints.compare_with_edits(frame(spark, [])).count() == 0


def test_next_row_over_ranges(spark):
    ids = random.Random(2).sample(range(10**6), 300)
    df = spark.createDataFrame([(i, f"t{i} " * 5) for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text.split()[0] for r in fingerprints.with_next(df, range_bytes=200).collect()}
    order = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_leaks(spark):
    rng = random.Random(8)
    item = {i: [f"w{rng.randrange(500)}" for _ in range(rng.randrange(15, 40))] for i in range(12)}
    rows = [(900, None), (901, ""), (902, "w1 w2")]
    for i, w in item.items():
        near = list(w)
        near[len(w) // 2 :: 40] = ["zzz"]
        rows += [(i, "Foo, bar! " + " ".join(w).upper() + " baz"), (100 + i, "q r s " + " ".join(near) + " t u"), (200 + i, " ".join(w[::-1])), (300 + i, " ".join(w[:-1]))]
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in item.items()] + [(50, None), (51, "")], "item_id long, text string")

    def shingles(w):
        return Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))

    want = set()
    for d, t in rows:
        x = re.findall(r"[^\W_]+", (t or "").lower())
        for i, w in item.items():
            windows = [x[s : s + len(w)] for s in range(max(1, len(x) - len(w) + 1))]
            if x and max(sum((shingles(v) & shingles(w)).values()) / max(1, sum((shingles(v) | shingles(w)).values())) for v in windows) >= 0.8:
                want.add((d, i))
    got = leaks.find(frame(spark, rows), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    left = leaks.remove(frame(spark, rows), items)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert leaks.find(frame(spark, []), items).count() == 0 and leaks.find(frame(spark, rows), items.limit(0)).count() == 0


def test_leaks_out_of_order(spark):
    """Passages with moved or swapped sentences, against every window of the text."""
    rng = random.Random(4)
    item = {i: [f"w{i}x{j}" for j in range(60)] for i in range(6)}
    item[6] = ["so", "it", "goes"] * 20
    rows = []
    for i, w in item.items():
        for j, x in enumerate((w[10:] + w[:10], w[50:] + w[:50], w[30:] + w[:30], w[20:40] + w[:20] + w[40:], w[10:] + ["odd"] * 40 + w[:10], w[10:] + w[:10] + w)):
            rows.append((100 * i + j, " ".join([f"f{rng.randrange(10**6)}" for _ in range(rng.randrange(70))] + x + [f"f{rng.randrange(10**6)}" for _ in range(rng.randrange(70))])))

    def shingles(w):
        return Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))

    want = {}
    for d, t in rows:
        x = t.split()
        for i, w in item.items():
            best = max(sum((shingles(v) & shingles(w)).values()) / sum((shingles(v) | shingles(w)).values()) for v in (x[s : s + len(w)] for s in range(max(1, len(x) - len(w) + 1))))
            if best >= 0.8:
                want[d, i] = best
    assert {(100 * i, i) for i in range(6)} <= set(want)
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks.find(frame(spark, rows), spark.createDataFrame([(i, " ".join(w)) for i, w in item.items()], "item_id long, text string")).collect()}
    assert set(got) == set(want)
    assert all(abs(got[x] - want[x]) < 1e-5 for x in want if x[1] < 6)


def test_pages(spark):
    page = '<html><body><header>Site</header><div class="cookie-notice">Accept</div><div id="main" class="content-12"><h1>T &eacute;</h1><p>One  <b>tw</b>o<p>Three<ul><li>four</ul></div><div class="comments"><p>Nice</p></div><form><p>Name</p></form><aside>s</aside></body></html>'
    rows = [(1, "http://a.example/1", page), (2, "http://a.example/2", page.replace("-12", "-77")), (3, None, None), (4, "http://b.example/", ""), (5, "http://b.example/x", "<p>un<b>closed &lt; text"), (5, "http://b.example/x", "<p>un<b>closed &lt; text")]
    got = [tuple(r) for r in pages.extract(frame(spark, rows, "page_id long, url string, html string")).collect()]
    text = "T é One two Three four"
    assert sorted(got, key=repr) == sorted([(1, rows[0][1], text, len(text)), (2, rows[1][1], text, len(text)), (3, None, "", 0), (4, rows[3][1], "", 0), (5, rows[4][1], "unclosed < text", 15), (5, rows[4][1], "unclosed < text", 15)], key=repr)
    assert pages.extract(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_pages_of_the_table(spark):
    table = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r.text for r in queries.op5_main_text(spark, DATA).collect()}
    for r in table.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S).group(1)
        assert got[r.page_id] == " ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?(b|i|a)\b[^>]*>", "", inner))).split())


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identify(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    out = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert out and sum(out) / len(out) >= 0.9
    net = langid.train(docs.where(~langid.held_out()))
    edge = langid.predict(frame(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "the and of")]), net).collect()
    assert [(r.doc_id, r.lang_pred) for r in sorted(edge)][:3] == [(1, "und"), (2, "und"), (3, "und")] and edge[3].lang_pred != "und"
    assert langid.predict(frame(spark, [(1, "x")]), None).first().lang_pred == "und"


def test_language_gradient():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b"])
    x, y = rng.integers(0, 256, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1])
    g = net.gradient(x, y)

    def loss():
        return -net.forward(x)[np.arange(4), y].mean()

    for name, at in (("o", (3, 1)), ("f3", (5, 2)), ("b", (0,)), ("e", (int(x[0, 0]), 1))):
        old, step = net.p[name][at], 1e-2
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / (2 * step) - g[name][at]) < 5e-3


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.resample(docs, labels.where("quality = 1")).collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    good, bad = [got[i].kept for i, q in marks.items() if q == 1], [got[i].kept for i, q in marks.items() if q == 0]
    assert len(got) == docs.count() and all(good) and sum(bad) <= 0.15 * len(bad)
    edge = quality.resample(frame(spark, [(1, None), (2, ""), (3, "a b"), (3, "a b")]), labels.limit(0)).collect()
    assert len(edge) == 4 and all(r.kept for r in edge)
    assert quality.resample(frame(spark, []), labels).count() == 0


def test_kth_largest(spark):
    rng = random.Random(3)
    keys = [rng.randrange(1 << 36) for _ in range(400)] + [5, 5, 5, (1 << 36) - 1]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 2, 57, 400, 403, 404):
        assert quality.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]
    assert quality.kth_largest(df, 0) is None


def test_licences(spark):
    rows = odd() + [(70, "Released UNDER the MIT-license; Apache License, Version 2.0 and CC BY NC"), (71, "under the mit"), (72, "This work is licensed under the GNU General Public License, version 3."), (73, "x Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = sorted(tuple(r)[:6] for r in licences.scan(frame(spark, rows)).collect())
    want = []
    for i, t in rows:
        w, at, labels = word.findall(lower(t or "")), [], set()
        for p, label in licences.PHRASES:
            p = p.split()
            hits = [j for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert got == sorted(want)
    labels = {r.doc_id: (r.labels, r.score) for r in licences.scan(frame(spark, rows)).collect()}
    assert labels[72] == ("gpl-3", 1.0) and labels[73][0] == "mit" and labels[5] == ("", 0.0)


def test_licence_lines_back_to_back(spark):
    """Each of several repeated licence lines has its own span."""
    line = "Licensed under CC BY-NC 4.0."
    rows = [(1, "\n".join([line] * 3)), (2, " ".join([line] * 500)), (3, line)]
    n = len(re.findall("[a-z0-9]+", line.lower()))
    got = {r.doc_id: r.spans for r in licences.scan(frame(spark, rows)).collect()}
    for i, k in ((1, 3), (2, 500), (3, 1)):
        assert got[i] == ",".join(f"cc-by-nc:{n * j}:{n * j + n}" for j in range(k))


def test_automaton_matching_statistics():
    rng = random.Random(6)
    seqs = [[rng.randrange(4) for _ in range(30)] for _ in range(3)]
    auto = licences.Automaton(seqs)
    text = [rng.randrange(4) for _ in range(200)]
    grams = {tuple(s[i:j]) for s in seqs for i in range(30) for j in range(i + 1, 31)}
    for end, n, s in auto.matches(text, 3):
        m = tuple(text[end - n : end])
        assert m in grams and (end == len(text) or m + (text[end],) not in grams)
        assert {(t, e) for t, q in enumerate(seqs) for e in range(n - 1, 30) if tuple(q[e - n + 1 : e + 1]) == m} == auto.ends[s]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "near_duplicates" and len(corpus_pipeline.STAGES) == 5
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, seen, DATA)
        assert after.columns == docs.columns, name
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        assert set(ids) <= {r.doc_id for r in seen.select("doc_id").collect()} and len(ids) == len(set(ids)), name
        seen = spark.createDataFrame(after.collect(), docs.schema)
    last = corpus_pipeline.STAGES[4][1](spark, seen, DATA).collect()
    text = {r.doc_id: r.text for r in seen.collect()}
    c = bpe.codec(*bpe.default_vocabulary())
    assert {r.doc_id: c.decode(r.ids).decode() for r in last} == text
