"""Main text of web pages: the contiguous region of a page with the largest score.

Words score positive and tags negative. The weights are log-odds learned from labelled pages, which
are those that mark their article themselves: how often a word, or a tag, of each kind lies inside
the marked region. One linear scan finds the best contiguous run of words and tags. Names that hint
at other parts (class, id, role) and forms make words count less; they decide nothing alone.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcount.llm.shared import table, with_field

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas select textarea".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
#: Parts that are not the article by their tag, wherever they stand.
ASIDE = frozenset("nav header footer aside menu dialog button search".split())
#: Words in class, id or role that name such parts.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent notice popup modal overlay newsletter "
    "subscribe subscription signup login search comment comments disqus reply replies respond share sharing social related "
    "recommended toolbar pagination pager contentinfo complementary".split()
)
#: Of these, the names of parts that hold articles of their own.
READERS = frozenset("comment comments disqus reply replies respond".split())
#: Elements that are aside parts as a rule but may wrap a page.
WRAPS = frozenset("form fieldset".split())
#: What the score of words counts in a part that a whole name hints at, in one that is hinted at by a
#: piece of a longer name or by its tag alone, and at least.
NAMED, HINTED, LEAST = 0.02, 0.2, 1e-6
#: Tags that mark an article's region.
ARTICLE = frozenset(("article", "main"))
#: A p element ends where one of these begins.
ENDS_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z0-9]+")


def _doubt(tag: str, attributes: str) -> tuple[float, bool]:
    """How much the words of an element count by its names, and whether they are readers' words."""
    most, readers = HINTED if tag in WRAPS else 1.0, False
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            for name in (m[2] or m[3] or m[4] or "").lower().split():
                pieces = _NAME.findall(name)
                if not HINTS.isdisjoint(pieces):
                    most = min(most, NAMED if len(pieces) == 1 else HINTED)
                readers = readers or not READERS.isdisjoint(pieces)
    return most, readers


class _Open:
    """The open elements of a page, with the places of each tag, so that an end tag without a start costs nothing."""

    def __init__(self):
        self.stack: list[tuple[str, float, str, bool, int, bool]] = []  # tag, counts, block, link, articles, readers
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    @property
    def top(self) -> tuple[str, float, str, bool, int, bool]:
        return self.stack[-1] if self.stack else ("", 1.0, "body", False, 0, False)

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, element: tuple) -> None:
        self.places.setdefault(element[0], []).append(len(self.stack))
        if element[0] in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def cut(self, at: int) -> None:
        """Close all elements from a place on."""
        while len(self.stack) > at:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def end(self, tag: str) -> None:
        at = self.last(tag)
        # A stray inline end tag closes no block.
        if at >= 0 and (tag in BLOCK or not self.blocks or self.blocks[-1] < at):
            self.cut(at)


def pieces(page: str) -> Iterator[tuple[str, str, float, str, bool]]:
    """(kind, value, what its words count, closest block tag, in a link) of a page in order; kind: tag or text.

    Text is decoded; hidden parts, comments and markup are left out. ``value`` of a tag is its name,
    with a slash if it closes. Words count nothing in aside parts by their tag, less in those that
    names hint at, and in full again in an outermost article or main that these wrap, unless it is
    among readers' words. Time is linear in the page, however its tags are nested.
    """
    opened, unended = _Open(), set()
    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        begin = m.start() if m else len(page)
        if begin > at and (text := page[at:begin]):
            yield "text", html.unescape(text), *opened.top[1:4]
        if not m:
            return
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "tag", "/" + tag, *opened.top[1:4]
            opened.end(tag)
            continue
        if tag in RAW or tag in HIDDEN:
            yield "tag", tag, 0.0, tag, False
            if m[0].endswith("/>"):
                continue
            # Once no end tag follows, none does further on.
            if tag not in unended and (end := re.compile(rf"</{tag}\s*>", re.I).search(page, at)):
                at = end.end()
                continue
            unended.add(tag)
            if tag in ("script", "style"):
                return
            continue
        if tag in ENDS_P and opened.blocks and opened.blocks[-1] == opened.last("p"):
            opened.cut(opened.blocks[-1])
        if tag == "li" and opened.last("li") > opened.last("ul", "ol", "menu"):
            opened.cut(opened.last("li"))
        _, counts, block, link, articles, readers = opened.top
        whole = tag in ("html", "body")
        if tag in ARTICLE:
            if not articles and counts and not readers:
                counts = 1.0
            articles += 1
        elif tag in ASIDE:
            counts = 0.0
        elif not whole:
            own, theirs = _doubt(tag, m[3])
            counts = counts and max(counts * own, LEAST)
            readers = readers or theirs
        block = tag if tag in BLOCK else block
        link = link or tag == "a"
        yield "tag", tag, counts, block, link
        if tag not in VOID and not m[3].endswith("/"):
            opened.push((tag, counts, block, link, articles, readers))


def blocks(page: str) -> list[tuple[str, object]]:
    """A page as ("text", (words, kind, counts)) and ("tag", (name, counts)) in order.

    Text between two block tags is one block: inline markup and br leave it whole. A block's kind is
    its tag, or ``link`` if all its words stand in links. ``counts`` is what a word counts by the parts
    around it: 1 in none that is aside.
    """
    out: list[tuple[str, object]] = []
    parts: list[str] = []
    where, linked = (1.0, "body"), True

    def flush():
        words = "".join(parts).split()
        parts.clear()
        if words:
            counts, block = where
            out.append(("text", (words, "word link" if linked else f"word {block}", counts)))

    for kind, value, counts, block, link in pieces(page):
        if kind == "text":
            if (counts, block) != where and parts:
                flush()
            where = (counts, block)
            linked = link if not parts else linked and (link or value.isspace())
            parts.append(value)
            continue
        name = value.lstrip("/")
        if name in BLOCK or name in HIDDEN:
            flush()
        elif name == "br":
            parts.append(" ")
        out.append(("tag", (value, counts)))
    flush()
    return out


def evidence(page: str) -> Counter[tuple[str, bool]]:
    """Counts of (kind of word or tag, inside the marked article) of a labelled page; empty of others."""
    found: Counter[tuple[str, bool]] = Counter()
    depth = 0
    marked = False
    for kind, value in blocks(page):
        if kind == "tag":
            name = value[0].lstrip("/")
            if name in ARTICLE and value[1] == 1:
                depth = max(0, depth - 1) if value[0][0] == "/" else depth + 1
                marked = True
            elif name in BLOCK or name in VOID:
                found[f"tag {name}", depth > 0] += 1
        else:
            words, word, counts = value
            aside = counts < 1
            found["word aside" if aside else word, depth > 0 and not aside] += len(words)
    return found if marked else Counter()


def learn(df: DataFrame, column: str = "html") -> dict[str, float]:
    """Log-odds of each kind of word and tag from all pages that mark their article.

    The counts are combined in the tasks; kinds are the names of the HTML standard, so what is
    gathered is a table of a few hundred rows at most. Without labelled pages it is empty.
    """

    def run(batches):
        found: Counter[tuple[str, bool]] = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                found.update(evidence(page or ""))
        if found:
            kinds, inside = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(inside, pa.bool_()), pa.array(list(found.values()), pa.int64())],
                names=["kind", "inside", "n"],
            )

    counts = df.select(F.col(f"`{column}`").alias("page")).mapInArrow(run, "kind string, inside boolean, n long")
    rows = counts.groupBy("kind").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("n")
    )
    return {r["kind"]: math.log((r["inside"] + 1) / (r["n"] - r["inside"] + 1)) for r in rows.collect()}


def weight(weights: dict[str, float], kind: str) -> float:
    """The score of one word, 0.1 to 3, or tag, -0.5 to -0.01.

    A word of an unseen kind counts 1, in a block of links 0.1, an unseen tag -0.5.
    """
    if kind.startswith("word "):
        return min(3.0, max(0.1, weights.get(kind, 0.1 if kind == "word link" else 1.0)))
    return max(-0.5, min(-0.01, weights.get(kind, -0.5)))


def scores(parts: list[tuple[str, object]], weights: dict[str, float], least: float = 1.0) -> list[float]:
    """The score of each block of text and each tag, where parts whose words count less than ``least`` are aside.

    Words of an aside part count -3, five of a block at most, but nothing within a marked article,
    which goes on behind it; the edges of the outermost mark are walls of -30.
    """
    out, depth = [], 0
    for kind, value in parts:
        if kind == "text":
            words, word, counts = value
            out.append((0.0 if depth else -3.0 * min(len(words), 5)) if counts < least else len(words) * weight(weights, word))
            continue
        name, counts = value
        if name.lstrip("/") in ARTICLE and counts >= least:
            closes = name[0] == "/"
            out.append(-30.0 if depth == closes else -0.01)
            depth = max(0, depth - 1) if closes else depth + 1
        else:
            out.append(-0.01 if counts < least and depth else weight(weights, f"tag {name.lstrip('/')}"))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum, the longest of equals; (0, 0) if none is positive."""
    best, region = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best and total > 0 and i + 1 - start > region[1] - region[0]:
            best, region = total, (start, i + 1)
    return region


def main_text(page: str, weights: dict[str, float]) -> str:
    """The blocks of the best region outside aside parts, joined by newlines.

    The best region is looked for without the parts that names hint at, and with those that are in
    less doubt first; the score of a region counts as much as the least certain words it may hold. So
    an article in a wrapper with an unlucky name wins where little stands outside.
    """
    parts = blocks(page)
    levels = sorted({value[2] for kind, value in parts if kind == "text" and value[2]} | {1.0}, reverse=True)
    best, chosen = 0.0, (0, 0, 1.0)
    for least in levels:
        own = scores(parts, weights, least)
        start, end = best_region(own)
        if (total := least * sum(own[start:end])) > best:
            best, chosen = total, (start, end, least)
    start, end, least = chosen
    return "\n".join(" ".join(value[0]) for kind, value in parts[start:end] if kind == "text" and value[2] >= least)


def extract(df: DataFrame, column: str = "html", out: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """df with the main text of each page in ``out``, which replaces a column of that name.

    A null page, and one without words, has an empty text. Weights not given are learned from df.
    """
    weights = learn(df, column) if weights is None else weights
    kept = [c for c in df.columns if c != out]
    schema = with_field(df.select(*[F.col(f"`{c}`") for c in kept]), (out, "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "", weights) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=schema.names)

    return df.select(F.col(f"`{column}`").alias("__page"), *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages.select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )
