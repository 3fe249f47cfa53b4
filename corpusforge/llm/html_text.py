"""Operator 3: main text of a page by line-block distribution.

Markup is stripped into lines, one per block of the page, without what stands in
a menu, header, footer, sidebar, notice, advert, form, script, style or comment
section. Elements say so themselves, or words of class, id or role do; such words
(and form) are only evidence: an element that holds the page's only article or
main, or on a page without one nearly all the text, keeps its text. A line weighs
its characters outside links, in a list of references all of them, and an eighth
where it stands beside an article or main that has text. Weights, clipped so that a
long line cannot raise the bar for others, are summed over a sliding window of
lines, on every page alike. The text surges where the sum first reaches a share
of the page's largest, and at any line without links that no linked line
follows, unless it stands beside the article (what is left below the bar is the
label of a list of links). It dives where the sum falls to nothing, which is a
list of links or the end; at the edge of the article it must surge again. All lines
between a surge and its dive are kept. In the article, fewer linked lines than a
window before a surge belong to it (a linked title), and links are text where the
page has no other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

WINDOW = 3
SURGE = 0.15  # share of the largest window sum
CLIP = 40  # characters of a line that count in a sum
BESIDE = 8  # a line beside the article weighs this part of its characters

# fixed values: element names of the HTML standard
RAW = ("script", "style", "template", "noscript", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav header footer aside button dialog menu fieldset head".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre hr address figure details summary center nav header footer aside form fieldset dialog menu head".split()
)
CLOSED_BY_BLOCK = frozenset(("p",))
#: words of class, id or role that mark boilerplate
MARKS = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar widget widgets related recommended share sharing social footer header masthead toolbar pagination pager comment "
    "comments disqus reply replies responses reader search skip copyright legal disclaimer tags complementary contentinfo "
    "alert alertdialog".split()
)
#: of these, words that stand on no wrapper of a whole page, however much text it holds
SURE = frozenset("ad ads advert advertisement adverts cookie cookies consent gdpr comment comments disqus nav navbar navigation menu newsletter pagination".split())
#: words that mark a list of references, whose links are text
REFERENCES = frozenset("references reference reflist footnotes footnote endnotes bibliography citations works sources".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Line(NamedTuple):
    """One block of a page: its text, its characters outside links, whether it stands in an article or main, the innermost marked element around it."""

    text: str
    weight: int
    inside: bool
    mark: int


class Page(NamedTuple):
    lines: list[Line]
    around: list[int]  # by marked element, the next marked one around it; element 0 is the page
    sure: set[int]  # marked elements that can't wrap a page
    articles: list[tuple[int, bool]]  # the innermost marked element around each article or main, and is it marked itself


def _words(attributes: str) -> set[str]:
    """The words of class, id and role."""
    return {w.lower() for m in _NAMED.finditer(attributes) for w in _PARTS.split(m[1] or m[2] or m[3] or "")}


def page_lines(html: str) -> Page:
    """The blocks of a page in order, with what is marked as boilerplate around them."""
    page = Page([], [0], set(), [])
    buffer: list[str] = []
    linked = 0
    said = False  # a letter or digit outside links
    stack: list[tuple[str, bool, int, bool]] = []  # open elements: name, is it dropped, number of its mark (0: none), is it a list of references
    inmost = dropped = article = links = references = 0

    def flush() -> None:
        nonlocal linked, said
        text = " ".join(unescape("".join(buffer)).split())
        if text:
            # marks between links are no text
            own = max(len(text) - linked, 0) if said or not linked else 0
            page.lines.append(Line(text, len(text) if references else own, article > 0, inmost))
        buffer.clear()
        linked, said = 0, False

    def close(name: str) -> None:
        nonlocal inmost, dropped, article, links, references
        while stack:
            top, gone, mark, cited = stack.pop()
            if mark:
                flush()
            dropped -= gone
            references -= cited
            article -= top in ("article", "main")
            links -= top == "a"
            if mark:
                inmost = page.around[mark]
            if top == name:
                break

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else end]
        if text and not dropped:
            buffer.append(text)
            if links:
                linked += len(" ".join(unescape(text).split()))
            else:
                said = said or any(c.isalnum() for c in unescape(text))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if name in RAW and not closing:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = stop.end() if stop else end
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if closing:
            if any(x[0] == name for x in stack):
                close(name)
        elif name not in VOID:
            if name in BLOCKS and any(x[0] in CLOSED_BY_BLOCK for x in stack[-8:]) and name not in ("html", "body"):
                # a block inside an open paragraph ends the paragraph and what is open in it
                while any(x[0] == "p" for x in stack[-8:]):
                    close("p")
            words = _words(attributes) if attributes else set()
            header_of_article = article > 0 and (name == "header" or "header" in words)
            gone = (name in DROPPED and not header_of_article) or bool(attributes and _HIDDEN.search(attributes) and name not in ("html", "body"))
            marked = bool(words & MARKS) and not header_of_article and name not in ("html", "body")
            gone = gone or (marked and name not in BLOCKS)  # a part of a line wraps no page
            mark = 0
            if not gone and (name == "form" or (marked and name not in ("article", "main"))):
                mark = len(page.around)
                page.around.append(inmost)
                inmost = mark
                if name == "form" or words & SURE:
                    page.sure.add(mark)
            # the numbered notes of an article and what calls itself references
            cited = bool(words & REFERENCES) or (name == "ol" and article > 0)
            if name in ("article", "main") and not dropped:
                page.articles.append((inmost, marked))
            stack.append((name, gone, mark, cited))
            dropped += gone
            references += cited
            article += name in ("article", "main")
            links += name == "a"
    flush()
    return page


def kept_lines(page: Page, share: float) -> list[Line]:
    """Lines outside elements that their words mark as boilerplate.

    A marked element is none if the page has articles and each stands in it, or
    if the page has no article and the text found outside marked elements, from
    the outermost inwards, is less than ``share`` of the text in this one (words
    of SURE excepted). Linear in lines and elements, however deep.
    """
    around, n = page.around, len(page.around)
    if n == 1:
        return page.lines
    sure, open_ = [False] * n, [True] * n
    for k in range(1, n):
        sure[k] = k in page.sure or sure[around[k]]
    held = [0] * n
    if page.articles:
        # articles that are not marked themselves count, if any stands elsewhere than among comments and the like
        counted = [k for k, marked in page.articles if not marked]
        if all(sure[k] for k in counted):
            counted = [k for k, _ in page.articles]
        for k in counted:
            held[k] += 1
    else:
        for x in page.lines:
            held[x.mark] += x.weight
    own = held.copy()
    for k in range(n - 1, 0, -1):
        held[around[k]] += held[k]
    outside = own[0]
    for k in range(1, n):
        wraps = held[k] == held[0] if page.articles else not sure[k] and outside < share * held[k]
        open_[k] = open_[around[k]] and wraps
        if open_[k]:
            outside += own[k]
    return [x for x in page.lines if open_[x.mark]]


def main_text(html: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    """Main text of one page, blocks joined by a line feed; empty if there is none."""
    lines = kept_lines(page_lines(html or ""), surge)
    weights: list[float] = [x.weight for x in lines]
    if not any(weights):
        weights = [len(x.text) if x.inside else 0 for x in lines]
    if any(w and x.inside for w, x in zip(weights, lines)):
        beside = [not x.inside for x in lines]
        weights = [w / BESIDE if far else w for w, far in zip(weights, beside)]
    else:
        beside = [False] * len(lines)
    sums = [sum(min(w, CLIP) for w in weights[i : i + window]) for i in range(len(weights))]
    least = max(1.0, surge * max(sums, default=0))
    kept, title, reading = [], [], False
    for i, (line, weight, block) in enumerate(zip(lines, weights, sums)):
        if reading and beside[i] == beside[i - 1]:
            reading = block > 0  # dive
        elif weight:
            alone = not beside[i] and weight == len(line.text) and (i + 1 == len(lines) or weights[i + 1] > 0)
            reading = _here(weights, beside, i, window) >= least or alone  # surge
            if reading and len(title) < window:
                kept += title
        else:
            reading = False
        if reading:
            kept.append(line.text)
        if reading or weight or not line.inside:
            title = []
        elif len(title) < window:
            title.append(line.text)
    return "\n".join(kept)


def _here(weights: list[float], beside: list[bool], i: int, window: int) -> float:
    """The window sum at a line over lines of its own side of the article's edge."""
    return sum(min(weights[k], CLIP) for k in range(i, min(i + window, len(weights))) if beside[k] == beside[i])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with text and n_chars (code points) of the whole html.

    Null, empty or text-free html gives an empty text. Markup that is never
    closed ends with the page. Columns of these names are replaced; every row
    and other column stays.
    """
    plain = pages.drop("text", "n_chars")
    n = len(plain.columns)
    schema = StructType([*plain.schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(h) for h in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*part.schema.names[:n], "text", "n_chars"],
                )

    return plain.select(*plain.columns, F.col("html").cast("string").alias("__html")).mapInArrow(rows, schema)
