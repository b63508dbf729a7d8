"""Main text of web pages by consensus of host: containers are scored page by page, hosts vote on generalised paths, pages are read again along the winning path."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.arrays import rested, tune
from sievelake.runtime import broadcast_if_small, cut

#: Winning paths of a host, which its pages try in turn; a page that has none of them is read at its own best box.
RANKS = 5
#: Share of a box's text that its parent must have outside the box, to stand for it, and that the page must have outside all boxes; steps of a path that are spelled; least share of a page's vote that counts.
SHARE, LOOSE, DEEP, LEAST = 0.05, 0.2, 32, 1e-6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    # Of these, one that closes itself or is never closed loses its tag only.
    r"|<(?P<box>svg|select|button|object|video|audio|canvas|math|noscript|template)\b(?:[^>]*/>|[^>]*>(?:(?!<(?P=box)\b).)*?</(?P=box)\s*>)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BOXES = frozenset("html body main article section div td th table tr tbody thead tfoot ul ol dl nav aside header footer form fieldset blockquote figure details dialog center menu".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input link meta source track".split())
_NEVER = frozenset("nav aside header footer form menu dialog fieldset".split())
_STRONG = re.compile(r"comments?|disqus|replies|ads?|advert\w*|sponsor\w*|cookies?|consent|gdpr|newsletter|subscribe|share|sharing|social|related|breadcrumbs?|pagination|pager|popup|modal|skip")
_WEAK = re.compile(r"header|footer|nav\w*|menu|sidebar|side|aside|banner|masthead|widget|widgets|notice|notices|notification|alert|promo\w*|search|login|form|toolbar|tags|meta")
_GOOD = re.compile(r"content|main|article|post|entry|story|text|body|page|wrapper|container")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_NAME = re.compile(r"[a-zA-Z]+")
_DIGITS = re.compile(r"[0-9]+")


def host_of(url):
    """Lower-case host of a url column; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def _boiler(tag: str, attrs: dict[str, str]) -> bool:
    if tag in _NEVER:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    if attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    # camelCase names fall into their words too
    names = [n.lower() for n in _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", attrs.get("class", "") + " " + attrs.get("id", "")))]
    if any(_STRONG.fullmatch(n) for n in names):
        return True
    return any(_WEAK.fullmatch(n) for n in names) and not any(_GOOD.fullmatch(n) for n in names)


def _step(tag: str, attrs: dict[str, str]) -> str:
    names = sorted({_DIGITS.sub("#", n) for n in attrs.get("class", "").lower().split()})
    return ".".join([tag, *names])


class Box:
    """A container that isn't boilerplate: its place among the pieces, the text and link text in it, and its score."""

    __slots__ = ("parent", "step", "depth", "digest", "first", "end", "score", "text", "links", "article", "goal")

    def __init__(self, parent: Box | None, step: str, first: int, article: bool):
        self.parent, self.step, self.first, self.end, self.article = parent, step, first, first, article
        self.depth = parent.depth + 1 if parent else 1
        self.digest = hashlib.blake2b((parent.digest if parent else b"") + step.encode("utf-8", "replace"), digest_size=8).digest()
        self.score, self.text, self.links = 0.0, 0, 0
        self.goal = self

    def path(self) -> str:
        """Steps from the root; of a deep box the digest of its path and its last DEEP steps."""
        steps, at = [], self
        while at and len(steps) < DEEP:
            if at.step:
                steps.append(at.step)
            at = at.parent
        return ">".join([*([f"#{self.digest.hex()}"] if at and at.step else []), *reversed(steps)])


def _grow(boxes: list[Box]) -> None:
    """Sets each box's goal, the container that it stands for; boxes come in order of their opening.

    A box in an article stands for the outermost article. Another, or an article in a main element, stands for what its parent stands for where the
    parent has text outside the box of at least SHARE of its own, less the links there, or itself stands for more.
    """
    for b in boxes:
        p = b.parent
        if p is None or b.step.split(".")[0] == "main":
            continue
        if p.article:
            b.goal = p.goal
        elif not b.article or p.step.split(".")[0] == "main":
            outside = p.text - b.text - (p.links - b.links)
            if outside > 0 and outside >= (SHARE if p.step else LOOSE) * b.text or p.goal is not p:
                b.goal = p.goal


def read(page: str) -> tuple[list[tuple[str, bool, bool]], list[Box]]:
    """Pieces (text, in a link, starts a block) that aren't boilerplate, and boxes in order of their opening.

    A box scores the length of the texts that stand in it directly, less what
    is in links, and half of what its inner boxes score.
    """
    pieces: list[tuple[str, bool, bool]] = []
    boxes: list[Box] = []
    stack: list[tuple[str, bool, Box | None]] = []  # tag, boilerplate, box outside of boilerplate
    open_: Counter[str] = Counter()
    skip = links = 0
    block = True
    at = 0

    def close() -> None:
        nonlocal skip
        tag, gone, box = stack.pop()
        open_[tag] -= 1
        skip -= gone
        if box:
            box.end = len(pieces)
            if p := box.parent:
                p.score += box.score / 2
                p.text += box.text
                p.links += box.links

    def say(text: str) -> None:
        nonlocal block
        if skip or not text:
            return
        if not text.isspace():
            pieces.append((text, links > 0, block))
            block = False
            if stack and (box := stack[-1][2]):
                n = len(text.strip())
                box.score += -n / 2 if links else n
                if links:
                    box.links += n
                else:
                    box.text += n
        elif not block:
            pieces.append((text, links > 0, False))

    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in _BOXES:
                block = True
                if open_[tag]:
                    while stack[-1][0] != tag:
                        close()
                    close()
                    links = 0
            elif tag == "a":
                links = max(0, links - 1)
            elif tag not in _INLINE:
                block = True
            continue
        if tag in _BOXES:
            raw = m["attrs"]
            attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(raw)} if raw.strip() else {}
            gone = _boiler(tag, attrs)
            skip += gone
            box = None
            if not skip:
                parent = stack[-1][2] if stack else None
                box = Box(parent, _step(tag, attrs), len(pieces), tag == "article" or bool(parent and parent.article))
                boxes.append(box)
            stack.append((tag, gone, box))
            open_[tag] += 1
            block, links = True, 0
        elif tag == "a":
            links = 1
        elif tag not in _INLINE:
            block, links = True, 0
    say(page[at:])
    while stack:
        close()
    if not boxes or sum(b.end - b.first for b in boxes if b.parent is None) < len(pieces):
        boxes = _rooted(pieces, boxes)
    _grow(boxes)
    return pieces, boxes


def _rooted(pieces: list[tuple[str, bool, bool]], boxes: list[Box]) -> list[Box]:
    """boxes under one more, the page, as a page may have text outside all of its boxes."""
    root = Box(None, "", 0, False)
    inside = 0
    root.end = len(pieces)
    for b in boxes:
        if b.parent is None:
            b.parent = root
            root.score += b.score / 2
            inside += b.text + b.links
    for text, link, _ in pieces:
        n = len(text.strip())
        root.text += 0 if link else n
        root.links += n if link else 0
    root.score += max(1.0, root.text + root.links - inside)
    return [root, *boxes]


def joined(pieces: list[tuple[str, bool, bool]]) -> str:
    """Character references decoded, white space of a block made one space, blocks joined by one space."""
    blocks: list[str] = []
    for text, _, lead in pieces:
        if lead or not blocks:
            blocks.append(text)
        else:
            blocks[-1] += text
    return " ".join(" ".join(html.unescape(b).split()) for b in blocks).strip()


def votes(page: str) -> list[tuple[str, float]]:
    """The paths of the containers that the page's boxes stand for, with their shares of its vote."""
    by: dict[Box, float] = {}
    for b in read(page)[1]:
        if b.score > 0:
            by[b.goal] = by.get(b.goal, 0.0) + b.score
    total = sum(by.values())
    named: dict[str, float] = {}
    for b, score in by.items():
        if score >= LEAST * total:
            path = b.path()
            named[path] = named.get(path, 0.0) + score / total
    return sorted(named.items())


def text_at(page: str, paths: list[str]) -> str:
    """The page's text along the first of the paths that it has text at, else at its own best container. A box on the path gives the text of the container that it stands for on this page."""
    pieces, boxes = read(page)
    wanted = dict.fromkeys(paths)
    last = {p.rpartition(">")[2] for p in wanted}
    on: dict[str, list[Box]] = {}
    for b in boxes:
        if b.step in last and (path := b.path()) in wanted:
            on.setdefault(path, []).append(b.goal)
    own: dict[Box, float] = {}
    for b in boxes:
        own[b.goal] = own.get(b.goal, 0.0) + b.score
    best = max(own, key=lambda b: (own[b], -b.first, b.depth))
    for found in [*(on[p] for p in paths if p in on), [best]]:
        out, done = [], 0
        for a, b in sorted((x.first, -x.end) for x in found):
            if -b > done:
                out += pieces[max(a, done) : -b]
                done = -b
        if text := joined(out):
            return text
    return ""


def winners(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, paths): the paths of each host by votes, at most RANKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], float] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, share in votes(page or ""):
                    sums[host, path] = sums.get((host, path), 0.0) + share
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.float64())], ["host", "path", "votes"])

    counted = pages.select(host_of(F.col(url_col)).alias("host"), html_col).mapInArrow(rested(run), "host string, path string, votes double").groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    return _ranked(counted)


def _ranked(counted: DataFrame) -> DataFrame:
    w = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    top = counted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= RANKS)
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    Null or empty html gives an empty text. Null urls and urls without a host
    vote together. Pages without the host's paths are read at their own best
    box. Rows repeated each come back; other columns play no part. An empty table gives no rows.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    tune(pages.sparkSession)
    best = cut(winners(pages, url_col, html_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    read_at = rows.withColumn("host", host_of(F.col("url"))).join(broadcast_if_small(best), "host", "left").select("page_id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                text = [text_at(p, paths or []) if p else "" for p, paths in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return read_at.mapInArrow(rested(run), f"page_id {kind}, url string, text string, n_chars long")
