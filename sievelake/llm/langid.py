"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, filters of several widths run over fixed-length windows,
each filter's maximum over the window feeds a softmax. A text is cut into
windows from its first byte to its last; its language is that of the largest
mean log probability, weighted by the windows' lengths.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm import arrays as A
from sievelake.runtime import broadcast_if_small, cut

#: Bytes of a window, size of a byte's embedding, filter widths and filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 96, 8, (2, 3, 4), 24
#: Rows of each label that the network is trained on at most, windows drawn from each, passes over them; and training steps at least, for small samples.
SAMPLE_ROWS, PER_TEXT, EPOCHS, RATE, BATCH, STEPS = 1000, 3, 4, 0.004, 128, 400
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def windows(b: bytes) -> np.ndarray:
    """The bytes in rows of WINDOW, the last one filled with zeros."""
    n = max(1, -(-len(b) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(b)] = np.frombuffer(b, np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"e": rng.normal(0, 0.3, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"c{w}"] = np.zeros(FILTERS, np.float32)
        self.p["o"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.p["b"] = np.zeros(len(labels), np.float32)

    def forward(self, x: np.ndarray, keep: bool = False):
        """Log probabilities of each window, and what the gradient needs if keep."""
        n = len(x)
        e = self.p["e"][x]
        pooled, kept = [], []
        for w in WIDTHS:
            cols = np.lib.stride_tricks.as_strided(e, (n, WINDOW - w + 1, w * EMBED), (e.strides[0], e.strides[1], e.strides[2]))
            flat = np.ascontiguousarray(cols).reshape(-1, w * EMBED)
            y = (flat @ self.p[f"f{w}"]).reshape(n, WINDOW - w + 1, FILTERS)
            if keep:
                top = y.argmax(axis=1)
                kept.append((cols, top))
                m = np.take_along_axis(y, top[:, None, :], 1)[:, 0]
            else:
                m = y.max(axis=1)
            pooled.append(m + self.p[f"c{w}"])
        z = np.concatenate(pooled, axis=1)
        h = np.maximum(z, 0)
        s = h @ self.p["o"] + self.p["b"]
        s -= s.max(axis=1, keepdims=True)
        logp = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
        return (logp, h, z, kept) if keep else logp

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        logp, h, z, kept = self.forward(x, True)
        n = len(x)
        d = np.exp(logp)
        d[np.arange(n), y] -= 1
        d /= n
        g = {"o": h.T @ d, "b": d.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        dh = (d @ self.p["o"].T) * (z > 0)
        for k, w in enumerate(WIDTHS):
            cols, top = kept[k]
            dm = dh[:, k * FILTERS : (k + 1) * FILTERS]
            picked = cols[np.arange(n)[:, None], top]
            g[f"f{w}"] = np.einsum("nfe,nf->ef", picked, dm)
            g[f"c{w}"] = dm.sum(axis=0)
            back = (dm[:, :, None] * self.p[f"f{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(g["e"], x[np.arange(n)[:, None], top + j], back[:, :, j])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
        """Adam on cross-entropy, classes weighted by drawing each equally often."""
        rng = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(p) for k, p in self.p.items()}, {k: np.zeros_like(p) for k, p in self.p.items()}, 0
        by = [np.flatnonzero(y == c) for c in range(len(self.labels))]
        steps = max(STEPS, epochs * len(x) // BATCH)
        for step in range(steps):
            idx = np.concatenate([rng.choice(b, max(1, BATCH // len(by))) for b in by if len(b)])
            t += 1
            rate = RATE * (1 - step / steps) + 1e-5
            for k, g in self.gradient(x[idx], y[idx]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def letters(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def drawn(labelled: DataFrame, text_col: str, label_col: str, id_col: str, sample_rows: int) -> DataFrame:
    """(label, windows): PER_TEXT windows, drawn from the whole text by its checksum, of the sample_rows rows of each label with the smallest id hashes."""
    some = labelled.where(F.col(label_col).isNotNull() & (F.length(text_col) > 0) & F.col(id_col).isNotNull())
    h = F.shiftrightunsigned(F.xxhash64("id"), 1)
    keys = some.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label")).withColumn("h", h)
    # Hashes are even over their range, so of a label's n rows about half as many again as are wanted lie under this bound: only they are ranked.
    bound = keys.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", F.least(F.lit(float(1 << 63)), F.lit(1.5 * sample_rows + 100) / F.col("n") * float(1 << 63)).alias("bound"))
    first = Window.partitionBy("label").orderBy("h", "id")
    near = keys.join(broadcast_if_small(cut(bound)), "label").where(F.col("h") <= F.col("bound"))
    ids = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample_rows).select("id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, found = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if letters(text):
                    b = text.encode()
                    w = windows(b)
                    label.append(name)
                    found.append(w[np.random.default_rng(zlib.crc32(b)).permutation(len(w))[:PER_TEXT]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(found, pa.binary())], ["label", "windows"])

    rows = some.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    return rows.join(broadcast_if_small(cut(ids)), "id", "left_semi").select("label", "text").mapInArrow(A.rested(run), "label string, windows binary")


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Network | None:
    """A network for the labels of labelled, from at most sample_rows ids of each (rows that repeat such an id count too). No labelled text with a letter: None."""
    A.tune(labelled.sparkSession)
    rows = sorted({(r["label"], bytes(r["windows"])) for r in drawn(labelled, text_col, label_col, id_col, sample_rows).distinct().toLocalIterator()})
    if not rows:
        return None
    order = sorted({name for name, _ in rows})
    x = [np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for _, w in rows]
    y = np.repeat([order.index(name) for name, _ in rows], [len(w) for w in x])
    return Network(order).fit(np.concatenate(x), y)


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs; score is the prediction's probability, 0 to 1.

    Null text and text without a letter are `und` with score 0, as is every row
    where nothing could be learned. Whole texts are read, in batches of windows.
    Repeated rows each come back; other columns play no part.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                lang, score = [], []
                for sums in _sums(net, part.column(1).to_pylist()):
                    if sums is None:
                        lang.append(UNKNOWN)
                        score.append(0.0)
                    else:
                        p = np.exp(sums - sums.max())
                        lang.append(net.labels[int(sums.argmax())])
                        score.append(float(p.max() / p.sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    A.tune(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(A.rested(run), f"doc_id {kind}, lang_pred string, score double")


def _sums(net: Network | None, texts: list[str | None], most: int = 1024) -> list[np.ndarray | None]:
    """Each text's mean log probabilities; windows of many texts go through the network together, `most` at a time."""
    full = [t.encode() if net is not None and letters(t) else None for t in texts]
    out: list[np.ndarray | None] = [None if b is None else np.zeros(len(net.labels)) for b in full]
    x, owner, share = [], [], []
    for i, b in enumerate(full):
        if b is not None:
            w = windows(b)
            size = np.full(len(w), WINDOW, np.float64)
            size[-1] = len(b) - WINDOW * (len(w) - 1)
            x.append(w)
            owner.append(np.full(len(w), i))
            share.append(size / len(b))
    if x:
        x, owner, share = np.concatenate(x), np.concatenate(owner), np.concatenate(share)
        for a in range(0, len(x), most):
            logp = net.forward(x[a : a + most]) * share[a : a + most, None]
            for c in range(len(net.labels)):
                for i, v in zip(*_by(owner[a : a + most], logp[:, c]), strict=True):
                    out[i][c] += v
    return out


def _by(owner: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lead = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return owner[lead], np.add.reduceat(v, lead)


def held_out(id_col: str = "doc_id"):
    """Every fifth row by checksum of its id: never learned from. Nor are rows with a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs (doc_id, text, lang), learned from the rows not held out.

    Repeated rows each come back, with equal predictions. A null id counts as
    held out. An empty table gives no rows; without a labelled text all are `und`.
    """
    net = train(docs.where(~held_out()))
    return predict(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
