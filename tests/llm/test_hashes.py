"""Words built so that a polynomial hash modulo a power of two confuses them are told apart by the operators that hash words."""

import random

import numpy as np
import pytest

from sievelake.llm import arrays as A
from sievelake.llm import bpe, licences, near_dup
from test_llm import frame


def pair(n):
    """Two words of 2**n letters that are each other's complement."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_texts_of_complement_words_are_no_copies(spark):
    rows = []
    for n in (10, 11):
        a, b = pair(n)
        rows += [(n * 10, f"one two three {a}"), (n * 10 + 1, f"one two three {b}")]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows), k=4, percent=80).collect()}
    assert got == {i: (i, True) for i, _ in rows}


def test_hashes_differ():
    for n in (10, 11, 14):
        h = [licences.word_hashes(w)[0] for w in pair(n)]
        assert h[0] != h[1]
        low = [np.frombuffer(w.encode(), np.uint8) for w in pair(n)]
        assert len({int(A.word_hashes(x, np.array([0]), np.array([len(x)]))[0]) for x in low}) == 2


def test_bpe_matches_a_span_once_and_cuts_nothing(monkeypatch):
    c = bpe.Codec(*bpe.default_vocabulary())
    matched, find = [], c.findall
    monkeypatch.setattr(c, "findall", lambda text: matched.append(len(text)) or find(text))
    said = list(c.pieces("naïve words, don't " * 2000))
    assert sum(matched) < 100 and b"".join(x[1] for x in said) == ("naïve words, don't " * 2000).encode()
    rng = random.Random(4)
    odd = [" ", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "a", "bé", "don't", "'s", "1", "²", "!?", "日本", "́", "​", "y" * 70, " 'll"]
    for cache in (bpe.CACHE, 20):
        monkeypatch.setattr(bpe, "CACHE", cache)
        for _ in range(3000):
            text = "".join(rng.choice(odd) for _ in range(rng.randrange(14)))
            want = []
            for t in find(text):
                s = c.hash.slot(t.encode())
                want += [c.rank_at[s]] if s >= 0 else c.merge(t.encode())
            got = list(c.pieces(text))
            assert " ".join(x[0] for x in got) == " ".join(map(str, want)) and b"".join(x[1] for x in got) == text.encode()
    assert not [s for s in c.whole if len(s) > 64]


def test_bpe_lays_out_spans_and_matches_no_plain_words(monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.default_vocabulary()
    c = bpe.Codec(path, pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=dict(zip(c.hash.keys, c.rank_at, strict=True)), special_tokens={})
    matched, find = [], c.findall
    monkeypatch.setattr(c, "findall", lambda text: matched.append(text) or find(text))
    text = "Qxertherq, qxertherq. Qxertherq\nciónasñ (qxertherq) 12,5:\n" * 50
    assert c.encode(text) == enc.encode_ordinary(text)
    assert max(map(len, matched), default=0) < 10, "words, numbers and points are told apart without the pattern"
    for chars in (range(0x3100), range(0xF900, 0x10000, 7), range(0x10000, 0x20000, 97)):
        for ch in map(chr, chars):
            text = f"a{ch} b 1{ch}2 .{ch}. '{ch} {ch}{ch} x{ch}\nq'{ch}s"
            assert c.encode(text) == enc.encode_ordinary(text), text
    texts = ["", "a  b", "", "one two, three" * 9, "x" * 70 + " don't", ""]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    for window in (1, 2, 5, bpe.WINDOW):
        monkeypatch.setattr(bpe, "WINDOW", window)
        got = [([], b"", b"") for _ in texts]
        for row, ids, said, back in c.runs(buf, np.append(0, ends[:-1]), ends):
            a, b, d = got[row]
            got[row] = [*a, *ids.tolist()], b + bytes(said), d + bytes(back)
        assert [x for x, _, _ in got] == [enc.encode_ordinary(t) for t in texts]
        assert all(s.decode() == "".join(f" {i}" for i in x) and d == t.encode() for t, (x, s, d) in zip(texts, got, strict=True))
