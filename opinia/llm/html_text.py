"""Main text of a page by tag-path ratios.

The text nodes of a page are grouped by their path of tags from the root.  A path
has a text ratio (characters per node) and a punctuation ratio (marks per node),
which are fused, lowered by the share of link text, by telling names and, where the
page marks an article, outside of it.  Values are smoothed along the page, averaged per path and
compared with a share of the best one.  All nodes of a path stand or fall together,
so a short paragraph stays with the long ones.  What lies in the same container as
chosen paths, between them or as a heading before them, belongs to the text too.

Menus, headers, footers, asides, dialogs, scripts, styles and what is hidden are left
out by their tags, roles and attributes.  Forms and elements with a class or id that is,
as a whole, a name of sidebars, notices, adverts or reader comments have paths of their
own with a low factor, so they are text where nothing else is.  Names of headings, of
the article and of what wraps the page say nothing, nor does a form that holds most of
the text.  A page of which all is left out is read again with everything in it.

A page is one row; pages are spread over tasks by size alone, and nothing of a page
is capped.  Defined results: NULL and empty html give an empty text; unclosed and
stray tags are accepted as browsers do; character references are decoded; white
space inside a block becomes one space, blocks are joined by one; rows of equal
page_id are all returned.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinia.llm.common import bounded_batches, in_small_batches, table

#: Share of the best smoothed ratio that a path needs.
THRESHOLD = 0.15
#: Factor on paths outside the marked article of a page.
OUTSIDE = 0.05
#: Factor on paths within an element whose name or tag speaks against it.
NAMED = 0.05
#: Smoothing weights of a node and of its neighbours on either side.
KERNEL = (0.25, 0.5, 0.25)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(script|style|noscript|template|textarea|title|iframe|noembed|noframes|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    # A tag ends at the latest before a quote that is not closed, or with the page: no part is scanned twice.
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|(?=[\"'])|\Z)", re.I | re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、¡¿]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that end an open one of the listed kinds when they start.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl select td th article section div main body html aside nav footer header form "
                   "blockquote".split())
NO_TEXT = frozenset("head button select svg math canvas object audio video".split())
NOT_CONTENT = NO_TEXT | frozenset("nav footer aside dialog menu".split())
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar".split())
#: Whole classes and ids, with underscores read as hyphens.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising ad-container ad-slot ad-banner sponsor sponsored promo promotion "
    "banner cookie cookies consent cookie-notice cookie-banner cookie-bar cookie-consent gdpr notice notices popup modal "
    "overlay newsletter newsletter-signup subscribe subscription paywall signup login sidebar side-bar left-sidebar "
    "right-sidebar menu main-menu nav nav-menu main-nav navbar navigation site-navigation breadcrumb breadcrumbs footer "
    "site-footer page-footer header site-header masthead toolbar share sharing share-buttons social social-share "
    "social-links related related-posts related-articles recommended recommendations widget widgets widget-area comment "
    "comments commentlist comment-list comments-area comments-section comment-form user-comments reader-comments reply "
    "replies disqus disqus-thread respond pagination pager search search-form searchform form hidden".split())
#: Names that say the same after the part of the page they belong to, as in `site-sidebar`.
PARTS = "site page main blog post article entry left right user reader primary secondary".split()
PARTED = "sidebar comments discussion thread menu nav footer newsletter related widgets ads share".split()
NAMES |= {"discussion", "discussion-thread", "comment-thread", *(f"{part}-{name}" for part in PARTS for name in PARTED)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main".split())
#: Elements whose classes and ids say nothing.
UNNAMED = HEADINGS | ARTICLE | {"body", "html"}


class Paths:
    """Tag paths as numbers: a path is its parent and a tag, 0 is the empty one; parents come first."""

    def __init__(self) -> None:
        self.parent = [0]
        self._known: dict[tuple[int, str], int] = {}

    def step(self, path: int, tag: str) -> int:
        found = self._known.setdefault((path, tag), len(self.parent))
        if found == len(self.parent):
            self.parent.append(path)
        return found


class Open:
    """The open elements of a page, with what is asked of them kept up to date."""

    def __init__(self) -> None:
        self.paths = Paths()
        self.tags: list[str] = []
        self.heights: dict[str, list[int]] = defaultdict(list)  # of every tag, from the outside
        self.scopes = [-1]  # heights of elements that close nothing outside them
        self._at = [(0, 0)]  # the path with and without inline elements

    def push(self, tag: str) -> None:
        path, blocks = self._at[-1]
        self.heights[tag].append(len(self.tags))
        if tag in SCOPES:
            self.scopes.append(len(self.tags))
        self._at.append((self.paths.step(path, tag), blocks if tag in INLINE else self.paths.step(blocks, tag)))
        self.tags.append(tag)

    def pop(self) -> str:
        tag = self.tags.pop()
        self._at.pop()
        self.heights[tag].pop()
        if tag in SCOPES:
            self.scopes.pop()
        return tag

    def last(self, tag: str) -> int:
        """The height of the innermost such element, or -1."""
        held = self.heights.get(tag)
        return held[-1] if held else -1

    def any_of(self, tags: frozenset[str]) -> bool:
        return any(self.heights.get(t) for t in tags)

    @property
    def path(self) -> int:
        return self._at[-1][0]

    @property
    def around(self) -> int:
        """The path of blocks around the innermost block."""
        return self.paths.parent[self._at[-1][1]]


class Node:
    """A run of text of one block, where it stands, and what of it are links."""

    __slots__ = ("text", "path", "parent", "links", "inside", "heading", "named", "form")

    def __init__(self, text: str, path: int, parent: int, links: int, inside: bool, heading: bool, named: bool,
                 form: int) -> None:
        self.text, self.path, self.parent = text, (False, path), (False, parent)
        self.links, self.inside, self.heading = links, inside, heading
        self.named, self.form = named, form


def _left_out(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no content by its tag or role, or hidden."""
    if tag in NOT_CONTENT or tag == "header" and not inside:
        return True
    if not attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "role" and value in NOT_CONTENT_ROLES or name == "hidden":
            return True
        if name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _named(tag: str, attributes: str, inside: bool) -> bool:
    """Whether a class or id of an element speaks against its being content."""
    if not attributes or tag in UNNAMED or inside and tag == "header":
        return False
    return any(name.lower() in ("class", "id") and not NAMES.isdisjoint("".join(values).lower().replace("_", "-").split())
               for name, *values in ATTRIBUTE.findall(attributes))


def text_nodes(source: str, everything: bool = False) -> tuple[list[Node], Paths]:
    """The text nodes of a page that may be content, or all of them, in order, one per block, and their paths.

    Takes time in proportion to the page, however deep it is nested or wherever it breaks off.
    """
    nodes: list[Node] = []
    stack = Open()
    dead = 0  # height of the stack at the element that is left out, or 0
    named = 0  # the same for the outermost element with a telling name
    form = 0  # and for the outermost form
    forms = 0  # outermost forms so far
    pieces: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            nodes.append(Node(text, stack.path, stack.around, min(links, len(text)), stack.any_of(ARTICLE),
                              stack.any_of(HEADINGS), named > 0, forms if form else 0))
        links = 0

    def close(height: int) -> None:
        nonlocal dead, named, form
        if any(t not in INLINE for t in stack.tags[height:]):
            flush()
        elif named > height:  # an inline element with a name is a node of its own
            flush()
        while len(stack.tags) > height:
            stack.pop()
        if dead > height:
            dead = 0
        if named > height:
            named = 0
        if form > height:
            form = 0

    def keep(text: str) -> None:
        nonlocal links
        if text and not dead:
            pieces.append(text)
            if stack.last("a") >= 0:
                links += len(text)

    at = 0
    for token in TOKEN.finditer(source):
        keep(source[at:token.start()])
        at = token.end()
        if token.group(3) is None:
            if token.group().startswith("<![CDATA["):
                keep(html.escape(token.group()[9:].removesuffix("]]>")))
            continue
        tag, ending = token.group(3).lower(), token.group(2)
        if ending:
            if stack.last(tag) >= 0:
                close(stack.last(tag))
            elif tag in ("p", "br") and not dead:
                flush()
            continue
        if tag not in INLINE:
            if not dead:
                flush()
            if tag not in VOID and stack.last("p") > stack.scopes[-1]:  # a block ends an open paragraph
                close(stack.last("p"))
            for kind in ENDS.get(tag, ()):
                if stack.last(kind) >= max(0, stack.scopes[-1]):
                    close(stack.last(kind))
        if tag in VOID or token.group(4).endswith("/") and tag not in SCOPES and tag != "p":
            continue
        inside = stack.any_of(ARTICLE)
        stack.push(tag)
        if dead:
            continue
        if tag in NO_TEXT if everything else _left_out(tag, token.group(4), inside):
            flush()
            dead = len(stack.tags)
        elif not named and _named(tag, token.group(4), inside):
            stack.pop()
            flush()
            stack.push(tag)
            named = len(stack.tags)
        if tag == "form" and not form:
            forms += 1
            form = len(stack.tags)
    keep(source[at:])
    flush()
    return weighed(nodes), stack.paths


def weighed(nodes: list[Node]) -> list[Node]:
    """The nodes, where those of forms are named as well, unless the form has most of the text; named paths are marked."""
    sizes: dict[int, int] = defaultdict(int)
    for n in nodes:
        sizes[n.form] += len(n.text) - n.links
    total = sum(sizes.values())
    for n in nodes:
        n.named = n.named or n.form > 0 and 2 * sizes[n.form] <= total
        if n.named:
            n.path, n.parent = (True, n.path[1]), (True, n.parent[1])
    return nodes


def path_ratios(nodes: list[Node]) -> dict[tuple, float]:
    """The fused ratio of every path."""
    sums: dict[tuple, np.ndarray] = defaultdict(lambda: np.zeros(4))
    marked = any(n.inside for n in nodes)
    prior = {}
    for n in nodes:
        sums[n.path] += (1, len(n.text), len(PUNCTUATION.findall(n.text)), n.links)
        prior[n.path] = (1.0 if n.inside or not marked else OUTSIDE) * (NAMED if n.named else 1.0)
    return {path: float(prior[path] * np.sqrt(size / count * (1 + marks / count)) * (1 - links / size))
            for path, (count, size, marks, links) in sums.items()}


def smoothed(nodes: list[Node], ratios: dict[tuple, float]) -> dict[tuple, float]:
    """Path values after smoothing along the page, averaged over the nodes of a path."""
    values = np.array([ratios[n.path] for n in nodes])
    held = np.pad(values, 1, mode="edge")
    values = KERNEL[0] * held[:-2] + KERNEL[1] * held[1:-1] + KERNEL[2] * held[2:]
    marked = any(n.inside for n in nodes)
    found: dict[tuple, list[float]] = defaultdict(list)
    for n, value in zip(nodes, values, strict=True):
        weight = (1.0 if n.inside or not marked else OUTSIDE) * (NAMED if n.named else 1.0)  # not from neighbours
        weight *= 1 - n.links / len(n.text)
        found[n.path].append(float(value) * weight)
    return {path: sum(v) / len(v) for path, v in found.items()}


def main_text(source: str) -> str:
    """The text of the chosen nodes, joined by single spaces."""
    nodes, paths = text_nodes(source)
    if not nodes:
        nodes, paths = text_nodes(source, everything=True)
    if not nodes:
        return ""
    values = smoothed(nodes, path_ratios(nodes))
    least = THRESHOLD * max(values.values())
    chosen = np.array([values[n.path] >= least and values[n.path] > 0 for n in nodes])
    within = {n.parent for n, c in zip(nodes, chosen, strict=True) if c}
    for path, above in enumerate(paths.parent):  # parents first: what is below a chosen block is within it
        within.update((named, path) for named in (False, True) if above and (named, above) in within)
    held = [n.parent in within for n in nodes]
    first, last = np.flatnonzero(chosen)[[0, -1]] if chosen.any() else (0, -1)
    marked = any(n.inside for n in nodes)
    return " ".join(
        n.text for i, n in enumerate(nodes)
        if chosen[i] or marked and n.inside and not n.named
        or held[i] and (first < i < last and n.links < len(n.text) or n.heading and i < first))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded_batches(batches, "html"):
        found = [main_text(h or "") for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()),
             pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
            html_column: str = "html") -> DataFrame:
    """One row per page: page_id, url, text and n_chars (code points)."""
    read = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"),
                        F.col(html_column).alias("html"))
    return in_small_batches(read).mapInArrow(
        _extracted, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract(table(spark, sf_dir, "pages"))
