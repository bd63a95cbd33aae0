"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with its root-to-leaf path of block tags.  For every
path the text outside links per node and the punctuation per node are aggregated (tag-path ratios); both
are smoothed along the page with a Gaussian kernel, so that a short block among long ones is lifted and an
isolated one is not, and fused as the geometric mean of text and 1 + punctuation, and, for nodes that their
surroundings make doubtful, ``doubt``.  A node is content if the mean fused score of its path
reaches ``share`` of the page's best path without doubt (and, outside articles, most of its
path's text is not linked); so is what stands, undoubted and not mostly linked, between two content nodes of one part of the body (a table
amid paragraphs).  A page with doubtful nodes only has no main text.

Doubtful is what lies in navigation, headers outside articles, footers, asides,
forms, dialogs, hidden parts, and elements whose class, id or role says so.  A name counts if it is a whole
class (``share``, ``cookie-notice``) or, for names that leave no doubt, the end of one (``site-nav``); it is ignored on an element
that holds an article or main element, or most of the page's text (comments excepted).  An article next
to one with over ``1 / related`` times its text is a teaser and doubtful too.

Within a block, character references are decoded and white space is one space; blocks are joined in page
order by one newline.  Nothing else is dropped or cut.

Defined results: a null or empty html, and a page without content, give the empty text; broken markup
(unclosed or crossed tags, a missing end) is read as browsers do, with implied ends; an open element
whose content is not read (a button, say) ends at the next block tag; repeated rows give
equal results; an empty table gives an empty result; extra columns pass through (outputs replace columns
of the same name, working columns get free names).
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import scratch

# fixed values: HTML element names and common names of page parts
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre header footer nav aside form fieldset figure figcaption address details summary dialog menu center hgroup search".split())
RAW = frozenset("script style title textarea iframe noscript".split())  # their content is no markup
SKIPPED = RAW | frozenset("template object svg select button canvas audio video map datalist".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset search".split())
PLAIN_NAMES = frozenset("nav navbar navigation menu sidebar footer breadcrumb breadcrumbs comments comment advert adverts advertisement ads ad cookies cookie masthead toolbar pagination".split())
WHOLE_NAMES = PLAIN_NAMES | frozenset(
    "adv advertising banner sponsor sponsored promo promotion side disqus reply replies respond responses notice consent gdpr privacy popup modal overlay newsletter "
    "subscribe subscription signup login register search share sharing social related recommended recommendations toc tags pager skip widget widgets alert disclaimer copyright header".split()
)
REMARKS = frozenset("comments comment disqus reply replies respond responses".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Tags that end an open element when they start: element -> the tags that end it.
ENDS = {
    "p": BLOCKS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
SCOPES = frozenset("table ul ol dl".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+|[^>]*+)>|<[!?][^>]*>", re.S)
NAMED = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
ENDING = re.compile(rf"<(/?)({'|'.join(sorted(SKIPPED))})\b", re.I)
BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})[\s/>]", re.I)


@dataclass(frozen=True)
class Extraction:
    """``sigma``: reach of the smoothing in nodes; ``share``: of the best path's fused score that content
    needs; ``doubt``: what remains of the score of a doubtful node; ``related``: an article with less than this share of the largest one's text is a teaser."""

    sigma: float = 1.0
    share: float = 0.3
    doubt: float = 0.12
    related: float = 0.2


@dataclass
class Element:
    tag: str
    parent: Element | None
    path: int  # a hash of the tags from the root
    depth: int
    names: frozenset[str]  # the boilerplate names it bears; "" for its tag
    in_article: bool  # an article or main element, itself included, lies around
    inner: bool = False  # lies in an article
    top: Element | None = None  # the outermost element around, itself included, below the body
    implied: Element | None = None  # the innermost element around, itself included, whose end may be implied
    size: int = 0  # text inside, outside links
    holds: bool = False  # an article or main element that bears no name lies inside
    dull: bool = False


@dataclass
class Block:
    text: str
    element: Element
    linked: int


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)  # parents before children


def _names(tag: str, attributes: str, in_article: bool) -> frozenset[str]:
    """What marks the element as something else than the article."""
    out = {""} if tag in BOILERPLATE_TAGS or (tag == "header" and not in_article) else set()
    if attributes and ("=" in attributes or "hidden" in attributes):
        for m in NAMED.finditer(attributes):
            for name in (m[2] or m[3] or m[4] or "").lower().split():
                if m[1].lower() == "role":
                    out |= {name} & BOILERPLATE_ROLES
                    continue
                pieces = re.split(r"[-_]+", name)
                if WHOLE_NAMES.issuperset(pieces):
                    out.update(pieces)
                elif pieces[-1] in PLAIN_NAMES and pieces[0] not in ("has", "no", "with", "without"):
                    out.add(pieces[-1])
        if HIDDEN.search(attributes):
            out.add("hidden")
    return frozenset(out)


class Unread:
    """Where elements whose content is not read end; the page is scanned for their tags once."""

    def __init__(self, source: str):
        self.source, self.tags, self.blocks = source, None, None

    def end(self, tag: str, pos: int) -> int:
        if self.tags is None:
            self.tags = {t: [] for t in SKIPPED}
            for m in ENDING.finditer(self.source):
                self.tags[m[2].lower()].append((m.start(), bool(m[1])))
        seen = self.tags[tag]
        at = bisect_left(seen, (pos, False))
        if tag in RAW:
            at = next((i for i in range(at, len(seen)) if seen[i][1]), len(seen))
        if at < len(seen) and seen[at][1]:
            close = self.source.find(">", seen[at][0])
            return close + 1 if close >= 0 else len(self.source)
        if tag in ("script", "style"):
            return len(self.source)
        if self.blocks is None:
            self.blocks = [m.start() for m in BLOCK.finditer(self.source)]
        at = bisect_left(self.blocks, pos)
        return self.blocks[at] if at < len(self.blocks) else len(self.source)


def parse(source: str) -> Page:
    """The text blocks of a page in order."""
    root = Element("", None, 0, 0, frozenset(), False)
    page = Page(elements=[root])
    open_tags: Counter[str] = Counter()
    unread = Unread(source)
    here, buffer, linked, in_link, pos, n = root, [], 0, 0, 0, len(source)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                page.blocks.append(Block(text, here, linked))
            buffer.clear()
        linked = 0

    def leave(e: Element) -> None:
        """Ends ``e`` and what is open inside it."""
        nonlocal here
        while here is not e.parent:
            open_tags[here.tag] -= 1
            here = here.parent

    while pos < n:
        m = TAG.search(source, pos)
        stop = m.start() if m else n
        if stop > pos:
            buffer.append(source[pos:stop])
            if in_link:
                linked += stop - pos
        if not m:
            break
        pos = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in SKIPPED:
            if not closing and not m[3].endswith("/"):
                pos = max(pos, unread.end(tag, pos))
            buffer.append(" ")
        elif tag in BLOCKS:
            flush()
            if closing:
                if open_tags[tag]:
                    up = here
                    while up.tag != tag:
                        up = up.parent
                    leave(up)
                continue
            up = here.implied
            while up is not None:
                if tag in ENDS[up.tag]:
                    leave(up)
                up = up.parent.implied
            new = Element(tag, here, hash((here.path, tag)), here.depth + 1, _names(tag, m[3], here.in_article), here.in_article or tag in ("article", "main"))
            new.inner = here.inner or here.tag == "article"
            new.top = here.top or (None if tag in ("html", "body") else new)
            new.implied = new if tag in ENDS else None if tag in SCOPES else here.implied
            page.elements.append(new)
            open_tags[tag] += 1
            here = new
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in ("br", "hr", "img", "input", "wbr"):
            if tag == "hr":
                flush()
            elif tag != "wbr":
                buffer.append(" ")
    flush()
    return page


def mark(page: Page, p: Extraction) -> None:
    """Marks the elements that are hardly part of the article, and all inside them, as dull."""
    for b in page.blocks:
        b.element.size += max(0, len(b.text) - b.linked)
    for e in reversed(page.elements[1:]):
        e.parent.size += e.size
        e.parent.holds |= e.holds or (e.tag in ("article", "main") and not e.names)
    total = page.elements[0].size
    largest = max((e.size for e in page.elements if e.tag == "article" and not e.names), default=0)
    for e in page.elements:
        spared = e.tag not in ("nav", "footer", "aside") and (e.holds or (2 * e.size > total and e.names.isdisjoint(REMARKS)))
        teaser = e.tag == "article" and not e.inner and not e.holds and e.size < p.related * largest
        e.dull = teaser or (bool(e.names) and not spared) or (e.parent is not None and e.parent.dull)


def path_scores(blocks: list[Block], p: Extraction) -> dict[int, float]:
    """The mean smoothed and fused tag-path ratio of each path's nodes."""
    nodes: dict[int, list[float]] = {}
    for b in blocks:
        x = nodes.setdefault(b.element.path, [0, 0, 0])
        x[0] += 1
        x[1] += max(0, len(b.text) - b.linked)
        x[2] += len(PUNCTUATION.findall(b.text))
    ratios = [(nodes[b.element.path][1] / nodes[b.element.path][0], nodes[b.element.path][2] / nodes[b.element.path][0]) for b in blocks]
    reach = max(1, math.ceil(3 * p.sigma))
    kernel = [math.exp(-(d * d) / (2 * p.sigma * p.sigma)) for d in range(-reach, reach + 1)]
    total: dict[int, float] = dict.fromkeys(nodes, 0.0)
    for i, b in enumerate(blocks):
        lo, hi = max(0, i - reach), min(len(blocks), i + reach + 1)
        k = kernel[lo - i + reach : hi - i + reach]
        text = sum(a * ratios[j][0] for a, j in zip(k, range(lo, hi), strict=True)) / sum(k)
        marks = sum(a * ratios[j][1] for a, j in zip(k, range(lo, hi), strict=True)) / sum(k)
        total[b.element.path] += math.sqrt(text * (1 + marks))
    return {path: total[path] / nodes[path][0] for path in nodes}


def main_text(source: str | None, p: Extraction = Extraction()) -> str:
    """The main text of a page."""
    if not source:
        return ""
    page = parse(source)
    mark(page, p)
    blocks = page.blocks
    if all(b.element.dull for b in blocks):
        return ""
    paths = path_scores(blocks, p)
    scores = [paths[b.element.path] * (p.doubt if b.element.dull else 1.0) for b in blocks]
    links: Counter[int] = Counter()
    for b in blocks:
        if not b.element.in_article:
            links[b.element.path] += 2 * b.linked - len(b.text)
    least = p.share * max(x for b, x in zip(blocks, scores, strict=True) if not b.element.dull)
    content = [x >= least and x > 0 and links[b.element.path] <= 0 for b, x in zip(blocks, scores, strict=True)]
    chosen = [i for i, c in enumerate(content) if c]
    for i, k in zip(chosen, chosen[1:], strict=False):
        if k - i > 1 and blocks[i].element.top is blocks[k].element.top is not None:
            content[i + 1 : k] = [not b.element.dull and 2 * b.linked <= len(b.text) for b in blocks[i + 1 : k]]
    return "\n".join(b.text for b, c in zip(blocks, content, strict=True) if c)


def _extract(batches: Iterator[pa.RecordBatch], p: Extraction, html: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(html)
        texts = [main_text(x.as_py(), p) for x in batch.column(at)]
        have = {k: batch.column(i) for i, k in enumerate(batch.schema.names) if i != at}
        yield pa.RecordBatch.from_pydict(have | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def extract(pages: DataFrame, p: Extraction = Extraction(), html: str = "html") -> DataFrame:
    """``pages`` without its html, with text and n_chars (code points of the text)."""
    (raw,) = scratch(pages, "html")
    base = pages.withColumn(raw, F.col(f"`{html}`")).drop(html)
    base = base.drop(*[c for c in base.columns if c.lower() in ("text", "n_chars")])
    keep = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.drop(raw).schema)
    return base.mapInArrow(partial(_extract, p=p, html=raw), f"{keep}text string, n_chars long")
