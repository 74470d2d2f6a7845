"""Main text of web pages by composite text density.

A page becomes a tree of elements, as lenient as browsers are about end tags. Elements that say by name or
role that they are furniture (menus, page headers, footers, sidebars, notices, adverts, forms, reader
comments) or not text (scripts, styles, head) stay out of the tree. A class or id that is a furniture word, or
made of such words and words of place and kind only (``site-footer``, not ``related-work``), leaves an element
out only if its text bears it out. Headings stay. In an article, blocks that are mostly links go, and
adverts by class; outside, all go. An element with most of the page's plain text stays, unless the page has
an article with text beside it; so does a form that holds the article. For every remaining
element the density is its characters per tag, adjusted by the share of its text and tags that are links,
against the same share of the whole body. The element whose children (blocks, not in-line elements) have
the greatest sum of densities is the main text. On the path from there to the body, a parent takes its
place unless it also holds a block of links, mostly, that is less dense than the body: so an article in
several sections comes whole, and a wrapper around article and menu does not.

Blocks are the stretches of text between block elements. Character references are decoded, white space
is turned into one space, blocks are trimmed and joined by two line breaks.

Defined results: a null or empty page, or one without text, gives an empty text and 0 characters. Rows
repeat as given; other columns are ignored, whatever their names. Markup cut off at the end of the page
counts as markup.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from burnish.llm.common import bounded_batches, only, result

# Fixed values of HTML: elements without end, raw text, in-line, and what an element's start closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(
    "script style textarea title xmp iframe noembed noframes noscript template svg select annotation annotation-xml".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded "
    "mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "tbody": ("thead tbody tfoot tr td th", ("table",)),
    "tfoot": ("thead tbody tfoot tr td th", ("table",)),
}
# Furniture by element, role, and word of a class or id; what may stand beside such a word; words that are never a topic.
FURNITURE = frozenset("nav footer aside dialog menu button object audio video canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar widget footer masthead topbar cookie cookies consent gdpr notice notices popup modal "
    "overlay newsletter subscribe signup login comment comments disqus replies respond share sharing social related "
    "recommended toolbar pagination pager skip".split()
)
BESIDE = frozenset(
    "site page main global top bottom left right upper lower header primary secondary mobile desktop sticky fixed box block "
    "bar container wrapper wrap holder slot unit area zone region section panel list item items link links button buttons "
    "icon icons post posts article articles story stories thread".split()
)
ADVERTS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo".split())
NAMELESS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())  # never furniture by class or id
WORD, ADVERT, FORM = 1, 2, 3  # what a class or id says, or that the element is a form

_TOKEN = re.compile(
    r"""<!--(?:.*?(?:-->|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>|</?[a-zA-Z!?][^>]*+(?:>|\Z)""",
    re.DOTALL,
)
# One attribute after the other, each with its value, so that nothing inside a value is taken for a name.
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_ASKED = re.compile("class|id|role|hidden", re.IGNORECASE)
_PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
_SIZE = re.compile(r"[0-9]+(?:x[0-9]+)?")
_FAR = re.compile(r"&#(?:[xX]0*+[0-9a-fA-F]{8,}|0*+[0-9]{8,});?")  # references beyond any character


def attributes_of(source: str) -> dict[str, str]:
    """Attributes of a tag; of a repeated one the first."""
    found: dict[str, str] = {}
    if source and _ASKED.search(source):
        for m in _ATTRIBUTE.finditer(source):
            value = m[2] or ""
            found.setdefault(m[1].lower(), value[1:-1] if value[:1] in ('"', "'") else value)
    return found


def is_furniture(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element names itself as something beside the main text."""
    if tag in FURNITURE or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true"
    return hidden or attributes.get("role", "").strip().lower() in ROLES


def named(tag: str, attributes: dict[str, str]) -> int:
    """Whether a class or id is a furniture word or a compound of one: ``WORD``, ``ADVERT`` for an advert's class, or 0.

    ``FORM`` for a form.
    """
    if tag == "form" or attributes.get("role", "").strip().lower() == "form":
        return FORM
    found = 0
    if not attributes or tag in NAMELESS:
        return found
    for kind in ("class", "id"):
        for name in attributes.get(kind, "").split():
            parts = [p.lower() for p in _PARTS.split(name) if p and not _SIZE.fullmatch(p)]
            if not WORDS.isdisjoint(parts) and all(p in WORDS or p in BESIDE for p in parts):
                found = max(found, ADVERT if kind == "class" and not ADVERTS.isdisjoint(parts) else WORD)
    return found


class Page:
    """Tree of a page's elements, and its text and block borders in page order."""

    def __init__(self, source: str) -> None:
        # Per element: parent, name, own characters, place of first and after last event.
        self.parents, self.tags, self.chars, self.first, self.last = [-1], ["body"], [0], [0], [-1]
        self.events: list[str | None] = []  # a text, or None for a block border
        self.stack = [0]
        self.suspects: dict[int, tuple[int, bool]] = {}  # furniture by class or id: what it says, whether in an article
        self.dropped: list[int] = []  # those of them that are none of the text
        self.hidden = 0  # height of the stack from which on nothing counts; 0: everything does
        self.articles = 0
        at, size = 0, len(source)
        while at < size:
            m = _TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._end(tag)
                elif tag in RAW:
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
                    if not m[3].endswith("/") or tag not in ("svg", "template", "annotation", "annotation-xml"):
                        at = close.end() if close else size
                else:
                    self._start(tag, m[3])
        while len(self.stack) > 1:
            self._pop()
        self.last[0] = len(self.events)

    def _text(self, raw: str) -> None:
        if self.hidden:
            return
        text = html.unescape(_FAR.sub("\ufffd", raw)) if "&" in raw else raw
        self.events.append(text)
        self.chars[self.stack[-1]] += len("".join(text.split()))

    def _start(self, tag: str, source: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            self._push(tag, True)
            return
        if tag in ("article", "main") and self.hidden and not self.articles:
            while self.hidden:  # furniture left open ends where the article starts
                self._pop()
        if tag in ("article", "main") and not self.hidden and not self.articles and self.suspects:
            open_ones = [d for d, node in enumerate(self.stack) if self.suspects.get(node, (FORM, False))[0] != FORM]
            while open_ones and len(self.stack) > open_ones[0]:
                self._pop()
        if tag not in INLINE:
            if tag in CLOSES:
                names, borders = CLOSES[tag]
                self._close(names.split(), borders)
            self._close(["p"], ("table", "button", "object"))
        if tag in VOID:
            if not self.hidden and tag != "wbr":
                self.events.append(" " if tag in INLINE else None)
            return
        attributes = attributes_of(source)
        hides = not self.hidden and is_furniture(tag, attributes, self.articles > 0)
        self._push(tag, hides)
        if not self.hidden and (says := named(tag, attributes)):
            self.suspects[self.stack[-1]] = says, self.articles > 0

    def _push(self, tag: str, hides: bool) -> None:
        self.parents.append(self.stack[-1])
        self.tags.append(tag)
        self.chars.append(0)
        if tag not in INLINE and not self.hidden:
            self.events.append(None)
        self.first.append(len(self.events))
        self.last.append(-1)
        self.stack.append(len(self.tags) - 1)
        self.articles += tag in ("article", "main")
        if hides:
            self.hidden = len(self.stack)

    def _pop(self) -> None:
        node = self.stack.pop()
        self.last[node] = len(self.events)
        self.articles -= self.tags[node] in ("article", "main")
        if self.hidden > len(self.stack):
            self.hidden = 0
            self.tags[node] = ""  # furniture: no part of the tree
        if self.tags[node] not in INLINE and not self.hidden:
            self.events.append(None)

    def _close(self, names: list[str], borders: tuple[str, ...]) -> None:
        """Close the innermost open element of these names, unless a border stands before it."""
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[depth]]
            if tag in names:
                while len(self.stack) > depth:
                    self._pop()
                names = [n for n in names if n != tag]
                if not names:
                    return
            elif tag in borders or (names == ["p"] and tag not in INLINE):
                return

    def _end(self, tag: str) -> None:
        if tag in ("html", "body", "br"):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            open_tag = self.tags[self.stack[depth]]
            if open_tag == tag:
                while len(self.stack) > depth:
                    self._pop()
                return
            if tag in INLINE and open_tag not in INLINE:
                return  # in-line ends do not reach out of a block

    def _sums(self, alive: list[bool]) -> tuple[list[int], list[int], list[int], list[int]]:
        """Per element, all below it counted: characters, tags, and those of links."""
        n = len(self.tags)
        chars, tags, link_chars, link_tags = self.chars[:], [1] * n, [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            if not alive[i]:
                continue
            if self.tags[i] == "a":
                link_chars[i], link_tags[i] = chars[i], tags[i]
            up = self.parents[i]
            chars[up] += chars[i]
            tags[up] += tags[i]
            link_chars[up] += link_chars[i]
            link_tags[up] += link_tags[i]
        return chars, tags, link_chars, link_tags

    def _alive(self, dropped: set[int]) -> list[bool]:
        alive = [True] * len(self.tags)
        for i in range(1, len(self.tags)):
            alive[i] = alive[self.parents[i]] and self.tags[i] != "" and i not in dropped
        return alive

    def _drop(self) -> None:
        """Which elements that are furniture by class or id their text shows to be so."""
        alive = self._alive(set())
        chars, _, links, _ = self._sums(alive)
        plain = [a - b for a, b in zip(chars, links, strict=True)]
        articles = [i for i, t in enumerate(self.tags) if alive[i] and plain[i] and t in ("article", "main")]
        article = bool(articles)
        holding = {up for i in articles for up in self._above(i)}
        for i, (says, inside) in self.suspects.items():
            small = 2 * plain[i] <= plain[0]
            if says == FORM:
                # A form around the page, or around its article, is no form to fill in.
                if i not in holding and (small or article and not inside):
                    self.dropped.append(i)
                continue
            linked = 2 * links[i] > chars[i]
            if (linked and self.tags[i] not in INLINE or small and says == ADVERT) if inside else (linked or small or article):
                self.dropped.append(i)

    def _above(self, node: int) -> Iterator[int]:
        while node:
            node = self.parents[node]
            yield node

    def main(self) -> int:
        """The element that holds the main text."""
        n = len(self.tags)
        if self.suspects:
            self._drop()
        alive = self._alive(set(self.dropped))
        chars, tags, link_chars, link_tags = self._sums(alive)
        share = link_chars[0] / max(chars[0], 1)
        density, total = [0.0] * n, [0.0] * n
        for i in range(n):
            if alive[i] and chars[i]:
                density[i] = composite(chars[i], tags[i], link_chars[i], link_tags[i], share)
        for i in range(1, n):
            if self.tags[i] not in INLINE:
                total[self.parents[i]] += density[i]
        best = max(range(n), key=lambda i: (total[i], -i))
        linked = (i for i in range(1, n) if 2 * link_chars[i] > chars[i] and self.tags[i] not in INLINE)
        thin = {self.parents[i] for i in linked if density[i] < density[0]}
        while best and self.parents[best] and self.parents[best] not in thin:
            best = self.parents[best]
        return best

    def text(self) -> str:
        """The main text: blocks joined by two line breaks."""
        node = self.main()
        blocks, parts, kept, at = [], [], [], self.first[node]
        for i in self.dropped:
            if at <= self.first[i] <= self.last[i] <= self.last[node]:
                kept += self.events[at : self.first[i]]
                at = self.last[i]
        for event in [*kept, *self.events[at : self.last[node]], None]:
            if event is not None:
                parts.append(event)
            elif parts:
                if block := " ".join("".join(parts).split()):
                    blocks.append(block)
                parts = []
        return "\n\n".join(blocks)


def composite(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, less where much of an element is links; ``share``: link share of the body."""
    plain = chars / tags
    if not share:
        return plain
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    return plain * math.log(chars / max(link_chars, 1) * tags / max(link_tags, 1)) / math.log(base)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text`` and ``n_chars`` (code points of the text)."""
    bounded_batches(pages.sparkSession)
    rows = only(pages, page_id=page_id, url=url, html=source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(source) for source in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, result(rows, ["page_id", "url"], "text string, n_chars long"))
