"""Disclosures against their definition over all pairs of entity and term, texts of very many of both, and planted quasi-identifiers."""

import math
import random
import time
from collections import Counter

from sievelake.llm import pii
from test_llm import frame


def brute(texts, alpha=pii.ALPHA, smooth=pii.SMOOTH):
    """{(text, term): risk} from every pair of an entity and a term of a text."""
    texts = sorted({t for t in texts if t})
    spans = {t: pii.base_spans(t) for t in texts}
    n = len(texts)
    n_t = Counter(w for t in texts for w in {x.lower() for x in pii._TERM.findall(t)})
    held = {t: ({pii.entity(t, s) for s in spans[t]}, {m.group().lower() for m in pii.outside(t, spans[t])}) for t in texts if spans[t]}
    n_e = Counter(e for es, _ in held.values() for e in es)
    n_et = Counter((e, w) for es, ws in held.values() for e in es for w in ws)
    out = {}
    for t, (es, ws) in held.items():
        for w in ws:
            risks = [math.log2((n * n_et[e, w] / n_e[e] + smooth) / (n_t[w] + smooth)) / ic for e in es if (ic := math.log2((n + smooth) / (n_e[e] + smooth))) > 0]
            if risks and max(risks) >= 1 / alpha:
                out[t, w] = max(risks)
    return out


def told(spark, texts):
    df = frame(spark, list(enumerate(texts)))
    keys = {r.key: r.text for r in df.selectExpr("text", "xxhash64(text) AS key").collect()}
    words = {pii.key64(w): w for t in texts if t for w in {x.lower() for x in pii._TERM.findall(t)}}
    return {(keys[r.key], words[r.term]): r.risk for r in pii.disclosures(df).collect()}


def test_disclosures_equal_the_definition(spark):
    rng = random.Random(11)
    names = [f"p{k}@x.example.org" for k in range(25)] + ["10.0.0.1", "+1 555 010 2030", "4111 1111 1111 1111"]
    letters = "abcdefgh"
    words = ["".join(x) for x in zip(*[[rng.choice(letters) for _ in range(90)] for _ in range(4)], strict=True)] + ["1984-03-12", "17", "12.50", "7"]
    texts = []
    for k in range(260):
        mine = [words[min(int(rng.expovariate(0.05)), 93)] for _ in range(rng.randrange(1, 25))]
        who = rng.sample(names, rng.choice([0, 0, 0, 1, 1, 2, 9])) + ([f"only{k}@y.example.org", f"also{k}@y.example.org"] if rng.random() < 0.2 else [])
        mine += who
        rng.shuffle(mine)
        texts.append(" ".join(mine))
    texts += [texts[3]] * 5 + [None, "", " ".join(names)]
    got, want = told(spark, texts), brute(texts)
    assert want and set(got) == set(want)
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_numbers_are_terms(spark):
    texts = [f"plain words of text {chr(97 + k % 26) * 4} stand here" for k in range(300)] + ["born 1961-07-23, lives in flat 4711, write to solo@one.example.org"]
    found = {w for _, w in told(spark, texts)}
    assert {"1961-07-23", "4711"} <= found


def test_planted_terms(spark):
    """A quasi-identifier stands with its entity alone; everyday words stand everywhere. Rare words of other texts aren't touched."""
    rng = random.Random(4)
    common = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    rows, planted = [], set()
    for k in range(400):
        body = [rng.choice(common) for _ in range(60)]
        if k % 8 == 0:
            nick = f"Zz{'abcdefghij'[k // 8 % 10]}{'klmnopqrst'[k // 80]}nick"
            planted.add(nick.lower())
            body = body[:30] + [nick, f"u{k}@mail.example.org"] + body[30:]
        elif k % 9 == 0:
            body.append(f"Rr{'abcdefghij'[k // 9 % 10]}{'klmnopqrst'[k // 90]}rare")
        rows.append(" ".join(body))
    found = {w for _, w in told(spark, rows)}
    assert planted <= found and len(planted) / len(found) > 0.9


def test_very_many_entities_and_terms_in_one_text(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    archive = " ".join(f"m{k}@list.example.org {' '.join(word() for _ in range(10))}" for k in range(3000))
    texts = [f"some plain text {word()} {k}" for k in range(200)] + [archive]
    began = time.time()
    r = pii.find(frame(spark, list(enumerate(texts)))).where("doc_id = 200").first()
    assert r.n_email == 3000 and r.n_term > 29_000
    assert time.time() - began < 120
