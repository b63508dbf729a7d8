"""Personal data: patterns, and information-theoretic sanitisation of terms that give an entity away.

Patterns find the protected entities: e-mail addresses, IP addresses, card and
telephone numbers. Corpus co-occurrence then estimates what other terms reveal:
for an entity e and a term t that stands anywhere in a text with it, with
document frequencies over N distinct texts,

    PMI(e; t) = log2(N n(e,t) / (n(e) n(t))),    IC(e) = PMI(e; e) = log2(N / n(e)),

both smoothed by SMOOTH texts s in which t stands and e is as frequent as anywhere:

    PMI(e; t) = log2((N n(e,t) / n(e) + s) / (n(t) + s)),    IC(e) = log2((N + s) / (n(e) + s)),

and t discloses e if PMI(e; t) >= IC(e) / ALPHA (of all that e would tell, t
tells that share). In texts that hold e, such terms are generalised, or removed
where they tell all of it (PMI >= IC). Entities and terms of any frequency
count, also those of a single text. Terms are words of three letters or more, and numbers.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.arrays import rested, tune
from sievelake.runtime import broadcast_if_small, cut

KINDS = ("email", "ip", "card", "phone")
ALPHA, SMOOTH = 1.25, 1.0
#: Terms that a task counts before it hands on their counts.
HELD = 200_000
#: Rows of term counts, entities or disclosures up to which they are broadcast; more are joined by shuffle.
COUNT_ROWS = 200_000
#: Terms of all texts with such terms up to which they are broadcast; more are joined by shuffle.
TERM_ROWS = 200_000
#: Texts with copies, or with such terms, up to which their hashes are broadcast; more are joined by shuffle.
COPIED = 1_000_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+\Z")
# A number can't start inside a run of digits: what follows the run is the same, so the run's start would have matched.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
#: Words, and numbers of two digits or more with what joins their groups (dates, amounts, house and file numbers).
_TERM = re.compile(r"[^\W\d_]{3,}|[0-9]{2,}(?:[-/.:,][0-9]+)*|[0-9](?:[-/.:,][0-9]+)+")
_LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from each @ outwards, so long words cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCALS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS; code points, end exclusive."""
    if not _ANY.search(text):
        return []
    out = [(s, e, 0) for s, e in emails(text)]
    for m in _IP.finditer(text):
        # A part's value, not its length, decides; leading zeros don't make it larger.
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((*m.span(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def key64(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def entity(text: str, span: tuple[int, int, str]) -> str:
    """The entity a span names, whatever its spelling: kind and lower-case address, or digits."""
    s, e, kind = span
    value = text[s:e].lower()
    return kind + ":" + (value if kind in ("email", "ip") else re.sub("[^0-9]", "", value))


def outside(text: str, spans: list[tuple[int, int, str]]) -> Iterator[re.Match]:
    """The terms of the whole text that touch none of the spans, which are sorted by start."""
    ends: list[tuple[int, int]] = []
    for a, b, _ in spans:
        if ends and a < ends[-1][1]:
            ends[-1] = ends[-1][0], max(b, ends[-1][1])
        else:
            ends.append((a, b))
    j = 0
    for m in _TERM.finditer(text):
        while j < len(ends) and ends[j][1] <= m.start():
            j += 1
        if j == len(ends) or m.end() <= ends[j][0]:
            yield m


def said(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, entities, terms) of each distinct text with entities: its hash, the entities and all terms beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, list[int], list[int]]] = []
            for text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and (spans := base_spans(text)):
                    rows.append((key, [key64(e) for e in {entity(text, x) for x in spans}], [key64(t) for t in {m.group().lower() for m in outside(text, spans)}]))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.list_(pa.int64()))], ["key", "entities", "terms"])

    found = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key")).mapInArrow(rested(run), "key long, entities array<long>, terms array<long>")
    return found.groupBy("key").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"))


def copies(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, copies): the hash of each distinct text that isn't empty, and how many rows hold it."""
    return docs.where(F.length(text_col) > 0).groupBy(F.xxhash64(text_col).alias("key")).agg(F.count(F.lit(1)).alias("copies"))


def term_counts(docs: DataFrame, text_col: str, copied: DataFrame) -> DataFrame:
    """(term, n_t): in how many distinct texts each term stands. A task adds up what it has seen of each term, by the number of copies of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Counter[str]] = defaultdict(Counter)

        def counted() -> pa.RecordBatch:
            rows = [(key64(w), c, n) for c, seen in total.items() for w, n in seen.items()]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[], [], []])], ["term", "copies", "n"])

        for batch in batches:
            for text, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    total[c].update(set(map(str.lower, set(_TERM.findall(text)))))
            if sum(map(len, total.values())) >= HELD:
                yield counted()
        yield counted()

    many = broadcast_if_small(copied.where("copies > 1").select("key", F.col("copies").alias("c")), COPIED)
    rows = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key")).join(many, "key", "left").select("text", F.coalesce("c", F.lit(1)).alias("c"))
    # The rows of one text give c times 1 / c; the sum over all is a whole number but for rounding.
    return rows.mapInArrow(rested(run), "term long, copies long, n long").groupBy("term").agg(F.round(F.sum(F.col("n") / F.col("copies"))).cast("long").alias("n_t"))


def disclosures(docs: DataFrame, text_col: str = "text", alpha: float = ALPHA, smooth: float = SMOOTH) -> DataFrame:
    """(key, term, risk): for the hash of each distinct text the terms in it that disclose an entity in it, with the largest PMI / IC. All counts are of distinct texts of the whole table."""
    texts = cut(said(docs, text_col))
    copied = cut(copies(docs, text_col))
    n = float(copied.count())
    holds = texts.select("key", F.explode("entities").alias("entity"))
    # Entities of the same set of texts, which two digests of 64 bits tell, have the same counts with every term: one stands for all of them.
    sets = holds.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.bit_xor(F.xxhash64("key")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("s2"))
    n_e = cut(sets.groupBy("n_e", "s1", "s2").agg(F.min("entity").alias("entity")).select("entity", "n_e"))
    holds = cut(holds.join(broadcast_if_small(n_e, COUNT_ROWS), "entity"))
    most = F.col("most").cast("double")
    # A term of more texts than this can't disclose an entity of `most` texts, even if all of these hold it.
    bound = (n + smooth) / F.pow((n + smooth) / (most + smooth), F.lit(1.0 / alpha)) - smooth + 1e-6
    widest = holds.groupBy("key").agg(F.max("n_e").alias("most")).withColumn("bound", bound).drop("most")
    largest = widest.agg(F.max("bound")).first()[0] or 0.0
    rare = cut(term_counts(docs, text_col, copied).where(F.col("n_t") <= largest))
    terms = texts.select("key", F.explode("terms").alias("term")).join(broadcast_if_small(rare, COUNT_ROWS), "term").join(broadcast_if_small(widest, COUNT_ROWS), "key").where("n_t <= bound").drop("bound")
    both = cut(terms.join(broadcast_if_small(holds, COUNT_ROWS), "key"))
    ic = F.log2((n + smooth) / (F.col("n_e") + smooth))
    pmi = F.log2((n * F.col("n_et") / F.col("n_e") + smooth) / (F.col("n_t") + smooth))
    pairs = both.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    risky = pairs.withColumn("risk", F.when(ic > 0, pmi / ic)).where(F.col("risk") >= 1.0 / alpha).select("entity", "term", "risk")
    return both.select("key", "entity", "term").join(broadcast_if_small(cut(risky), COUNT_ROWS), ["entity", "term"]).groupBy("key", "term").agg(F.max("risk").alias("risk"))


def _marked(text: str, terms: list[dict] | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and spans of kind term or gone (terms that tell all) outside them."""
    spans = base_spans(text)
    if not terms or not spans:
        return spans, []
    risk = {t["term"]: t["risk"] for t in terms}
    keys: dict[str, int] = {}
    found = []
    for m in outside(text, spans):
        w = m.group().lower()
        if w not in keys:
            keys[w] = key64(w)
        if (r := risk.get(keys[w])) is not None:
            found.append((*m.span(), "gone" if r >= 1.0 - 1e-9 else "term"))
    return spans, found


def _terms_name(docs: DataFrame, name: str = "_terms") -> str:
    """A column name that docs doesn't have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def _with_terms(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """docs with a further, last column: the disclosures in each row's text, null where there are none."""
    name, key = _terms_name(docs), _terms_name(docs, "_key")
    by = cut(found.groupBy("key").agg(F.collect_list(F.struct("term", "risk")).alias(name)).withColumnRenamed("key", key))
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    if (by.agg(F.sum(F.size(name) + 1)).first()[0] or 0) <= TERM_ROWS:
        return keyed.join(F.broadcast(by), key, "left").select(*docs.columns, name)
    # Only rows with disclosures are shuffled to them.
    keys = broadcast_if_small(by.select(key), COPIED)
    told = keyed.join(keys, key, "left_semi").join(by, key).select(*docs.columns, name)
    return told.unionByName(keyed.join(keys, key, "left_anti").withColumn(name, F.lit(None).cast(by.schema[name].dataType)).select(*docs.columns, name))


def find(docs: DataFrame, alpha: float = ALPHA, smooth: float = SMOOTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) of every row of docs.

    base_sha256 digests the base spans, spans lists these and the method's
    (kinds term and gone), as kind:start:end by start. Null text is
    empty: no spans. Repeated rows each come back. An empty table
    gives no rows. Other columns play no part, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    tune(docs.sparkSession)
    docs = docs.select(F.col(id_col), F.col(text_col))
    joined = _with_terms(docs, disclosures(docs, text_col, alpha, smooth), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, said, more = np.zeros((4, len(batch)), np.int64), [], [], []
            for i, (text, terms) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                base, extra = _marked(text or "", terms)
                for s in base:
                    counts[KINDS.index(s[2]), i] += 1
                sums.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest())
                order = {k: j for j, k in enumerate((*KINDS, "term", "gone"))}
                said.append(",".join(f"{k}:{a}:{b}" for a, b, k in sorted(base + extra, key=lambda x: (x[0], order[x[2]], x[1]))))
                more.append(len(extra))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(sums, pa.string()), pa.array(said, pa.string()), pa.array(more, pa.int64())], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_term"]
    return joined.mapInArrow(rested(run), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long")


def clean(text: str, base: list[tuple[int, int, str]], extra: list[tuple[int, int, str]]) -> str:
    """The text with entities named by kind, disclosing terms generalised to <TERM>, and those that tell all removed. Of overlapping spans the text between the outer ends goes."""
    out, at = [], 0
    for a, b, kind in sorted(base + extra):
        if a >= at:
            out += [text[at:a], "" if kind == "gone" else f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, alpha: float = ALPHA, smooth: float = SMOOTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with personal data replaced in their texts; texts without any, null and empty ones, stay as they are. Columns and rows stay too, repeated ones each; an empty table stays empty."""
    tune(docs.sparkSession)
    joined = _with_terms(docs, disclosures(docs, text_col, alpha, smooth), text_col)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [t if not t or not (found := _marked(t, terms))[0] else clean(t, *found) for t, terms in zip(batch.column(at).to_pylist(), batch.column(len(schema)).to_pylist(), strict=True)]
            cols = [pa.array(new, batch.column(at).type) if i == at else batch.column(i) for i in range(len(schema))]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    at = schema.names.index(text_col)
    return joined.mapInArrow(rested(run), schema)
