"""Main text of web pages by tag-path ratios.

1. A page's text is cut into blocks; each has a tag path from the root to its block element (inline elements
   add nothing to it, classes and ids do). Paths are nodes of a tree; many blocks may share one.
2. Ratio: over the blocks of a path, the mean length of text times one plus the mean number of punctuation
   marks. Prose scores high, menus and notices low.
3. Smoothing over the tree: a path's score is the sum of all paths' ratios, each weighted by a decay to the
   power of the steps between the two, so that a heading or a table cell shares in the score of the paragraphs
   beside it. Two passes over the tree's edges give all of them.
4. Fusing: scores fall with the share of a path's text that is inside links (headings apart), and with classes,
   ids and roles that name boilerplate on the way to it: much if that is all that a name says (`ad-box`), by half
   if it says something else too (`ad-hoc`). The article or main element's own names count only where they tell of
   comments. Names apart, comments are seen by their form: elements of one path, two or more, of which nearly all have an
   author or a time of their own, and which hold less than half of the page's prose.
5. Threshold, as a share of the page's best score: low within the article, which is the article or main element
   if these hold a fair share of the page's prose, else the element around the best path's blocks; higher
   outside, where scores also count less if the page has such an element.

Elements that are no running text by their kind (menus, headers, footers, sidebars, forms, and what browsers do
not show as text) take no part; a header inside an article does.

Blocks of the chosen paths are joined in page order. Inside a block, white space and line-break elements are
one space; character references are decoded; nothing else is changed or cut. Time and memory grow in proportion
to the page, however deep it nests and however many paths it has.

Defined results: null, empty or textless html gives an empty text, and so does a page whose names all tell of
boilerplate; broken markup is read as far as it goes, unclosed elements end with their parent; repeated rows
give repeated results; other columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_rows

#: Element kinds, words of classes, ids and roles that name boilerplate, and words that say no more beside them.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style title template noscript iframe svg canvas audio video textarea select option datalist".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus "
    "dialog footer form header masthead menu menubar modal nav navbar navigation newsletter notice notices pagination popup promo promotion promoted "
    "related respond replies search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
PARTS = frozenset(
    "area article articles bar block body bottom box button buttons center col container content entry footer global head icon icons inner item items label "
    "left link links list main media message mobile more news outer page panel policy post posts primary right row secondary section site slot space "
    "stories story tag text thread title top unit wrap wrapper".split()
)
CONTENT = frozenset(("article", "main"))
#: Words that tell even of a content element that it is none, and words beside which a header belongs to the article.
COMMENTS = frozenset("ad ads advert advertisement comment comments discussion disqus promo promoted promotion related respond replies sponsored".split())
ARTICLE_WORDS = frozenset("article content entry headline post story".split())
#: Words of classes and the like that name an author, and the share of a path's elements that have one, or a time, in a list of comments.
AUTHORS = frozenset("author authors avatar byline commenter poster username user".split())
SIGNED, MOST_PROSE = 0.8, 0.5
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Decay of a ratio with each step, inside and outside the article; the shares of the best score that a path needs there.
NEAR, FAR, LOW, HIGH = 0.5, 0.2, 0.01, 0.05
#: Weights of names that say boilerplate and of names that say it among other things, of text in links, and of paths outside
#: a content element; and the share of the page's prose that makes an element one.
TELLING, HINTING, LINKED, OUTSIDE, FAIR = 0.001, 0.5, 0.02, 0.05, 0.2
_names = re.compile(r"[a-z]+")
_having = re.compile(r"\b(?:has|no|with|without)[-_]+\w+")  # what an element merely has beside it
_marks = re.compile(r"[.,;:!?…。，、；：！？¡¿]")


def name_weight(tag: str, named: str) -> float:
    """What the class, id and role of an element leave of its score."""
    if not named or tag in ("html", "body", "main"):
        return 1.0
    allowed = NAMES - COMMENTS if tag in CONTENT else frozenset()
    weight = 1.0
    for name in _having.sub(" ", named).split():
        words = set(_names.findall(name))
        telling = words & NAMES - allowed
        if words & ARTICLE_WORDS:
            telling -= {"header"}
        if telling:
            weight = min(weight, TELLING if words <= NAMES | PARTS else HINTING)
    return weight


@dataclass(slots=True)
class Block:
    path: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass(slots=True)
class Element:
    tag: str
    path: int
    skipped: bool
    inline: bool
    block: Block | None = None
    turn: int = 0  # in which the block was begun
    signed: bool = False


class PathTree:
    """Paths by number, each behind its parent: parent, label, heading or not, inside a content element or not, names' weight."""

    def __init__(self):
        self.parent, self.heading, self.content, self.weight = [-1], [False], [False], [1.0]
        self.number: dict[tuple[int, str], int] = {}
        self.root = [True]  # html and body, which no article ends with
        self.elements, self.signed = [0], [0]  # how many there are of each path, and how many with an author or a time

    def child(self, parent: int, tag: str, label: str, weight: float) -> int:
        key = (parent, label)
        if key not in self.number:
            self.number[key] = len(self.parent)
            self.parent.append(parent)
            self.heading.append(tag in HEADINGS)
            self.content.append(self.content[parent] or tag in CONTENT)
            self.weight.append(weight if tag == "main" else weight * self.weight[parent])
            self.root.append(tag in ("html", "body"))
            self.elements.append(0)
            self.signed.append(0)
        return self.number[key]

    def smoothed(self, values: list[float], decay: float) -> list[float]:
        """For each path the sum of all values, each times decay to the power of the steps to it."""
        below = list(values)
        for i in range(len(below) - 1, 0, -1):
            below[self.parent[i]] += decay * below[i]
        whole = below[:]
        for i in range(1, len(whole)):
            whole[i] += decay * (whole[self.parent[i]] - decay * below[i])
        return whole


class PageReader(HTMLParser):
    """Blocks of text with their tag paths."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.paths = PathTree()
        self.stack = [Element("", 0, False, False)]
        self.open_tags: Counter[str] = Counter()
        self.links = self.turn = 0
        self.blocks: list[Block] = []

    def _close_to(self, at: int) -> None:
        ended = self.stack[at:]
        del self.stack[at:]
        signed = False
        for element in reversed(ended):
            signed = signed or element.signed
            self.paths.elements[element.path] += 1
            self.paths.signed[element.path] += signed
        self.stack[-1].signed |= signed
        self.open_tags.subtract(e.tag for e in ended)
        if not all(e.inline for e in ended):
            self._end_block()

    def _end_block(self) -> None:
        """What follows starts a new block: one that was begun before this turn is not gone on with."""
        self.turn += 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.handle_data(" ")
            return
        named, weight, hidden, label = "", 1.0, False, tag
        if attrs:
            named = " ".join(v.lower() for k, v in attrs if v and k in ("class", "id", "role"))
            weight = name_weight(tag, named)
            hidden = any(k == "hidden" for k, _ in attrs)
            label = f"{tag}.{'.'.join(sorted(set(_names.findall(named))))}" if named else tag
        if tag == "time" or named and AUTHORS.intersection(_names.findall(named)):
            self.stack[-1].signed = True
        inline = tag in INLINE
        if tag == "a":
            self.links += 1
        if inline and weight > TELLING and not hidden:
            return
        if tag in VOID:
            if tag == "hr":
                self._end_block()
            return
        if not inline:
            for i in range(len(self.stack) - 1, 0, -1):
                held = self.stack[i].tag
                if held == "p" or held in CLOSES.get(tag, ()):
                    self._close_to(i)
                elif held not in ("td", "th"):
                    break
            self._end_block()
        above = self.stack[-1]
        kind = tag in HIDDEN or tag in BOILERPLATE and not (tag == "header" and self.paths.content[above.path])
        path = self.paths.child(above.path, tag, label, weight)
        self.stack.append(Element(tag, path, kind or hidden or above.skipped, inline))
        self.open_tags[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # in HTML the slash of <div/> means nothing

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.links:
            self.links -= 1
        if not self.open_tags[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._close_to(i)
                return

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if top.skipped:
            return
        if top.block is None or top.turn != self.turn:
            if not data.strip():
                return
            top.block, top.turn = Block(top.path), self.turn
            self.blocks.append(top.block)
        top.block.parts.append(data)
        if self.links:
            top.block.linked += len(" ".join(data.split()))


def comment_lists(paths: PathTree, prose: list[float]) -> list[bool]:
    """For each path whether it is one of comments by their form, or below one."""
    below = list(prose)
    for p in range(len(below) - 1, 0, -1):
        below[paths.parent[p]] += below[p]
    found = [False] * len(below)
    for p in range(1, len(below)):
        own = paths.elements[p] > 1 and paths.signed[p] >= SIGNED * paths.elements[p] and below[p] < MOST_PROSE * below[0]
        found[p] = found[paths.parent[p]] or own
    return found


def content_paths(paths: PathTree, blocks: list[Block]) -> set[int]:
    """The paths whose smoothed and fused ratio reaches its threshold."""
    size = len(paths.parent)
    n, chars, marks, linked = ([0] * size for _ in range(4))
    for block in blocks:
        n[block.path] += 1
        chars[block.path] += len(block.text)
        marks[block.path] += len(_marks.findall(block.text))
        linked[block.path] += block.linked
    used = [p for p in range(size) if n[p]]
    ratio = [chars[p] / n[p] * (1 + marks[p] / n[p]) if n[p] else 0.0 for p in range(size)]
    comments = comment_lists(paths, [r * k for r, k in zip(ratio, n, strict=True)])
    weight = [paths.weight[p] * (TELLING if comments[p] else 1.0) * (1.0 if paths.heading[p] or not n[p] else max(LINKED, 1 - linked[p] / chars[p])) for p in range(size)]
    ratio = [r * w for r, w in zip(ratio, weight, strict=True)]
    if not any(paths.weight[p] > TELLING for p in used):
        return set()
    prose = lambda own: sum(ratio[p] * n[p] for p in own)
    placed = prose(p for p in used if paths.content[p]) >= FAIR * prose(used) > 0
    near, far = ([s * w for s, w in zip(paths.smoothed(ratio, decay), weight, strict=True)] for decay in (NEAR, FAR))
    inside = paths.content
    if not placed:
        around = paths.parent[max(used, key=lambda p: (far[p], -p))]
        inside = [False] * size
        if around > 0 and not paths.root[around]:
            inside[around] = True
            for p in range(around + 1, size):
                inside[p] = inside[paths.parent[p]]
    outside = OUTSIDE if placed else 1.0
    best_near = max((near[p] for p in used if inside[p]), default=0.0)
    best_far = max(far[p] * (1.0 if inside[p] else outside) for p in used)
    return {p for p in used if (near[p] >= LOW * best_near if inside[p] else far[p] * outside >= HIGH * best_far)}


def main_text(html: str | None) -> str:
    if not html:
        return ""
    reader = PageReader()
    reader.feed(html)
    reader.close()
    reader._close_to(1)
    for block in reader.blocks:
        block.text = " ".join("".join(block.parts).split())
    blocks = [b for b in reader.blocks if b.text]
    chosen = content_paths(reader.paths, blocks)
    return "\n".join(b.text for b in blocks if b.path in chosen)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    made = map_rows(pages.select("page_id", "url", "html"), "html", "page_id long, url string, text string", work)
    return made.withColumn("n_chars", F.char_length("text").cast("long"))
