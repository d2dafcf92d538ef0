"""Reading captured review pages: one pass over the HTML of each page.

Selectors cannot be expressed over strings, so this is the one Python stage.
A page becomes a flat outline (elements in document order, each with the span
of its descendants and of its text), on which every selector is a short scan.
Everything typed happens afterwards in Column expressions.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from opinia.constants import NEXT_LINK_LABELS
from opinia.functions.pages import STATUS_MARKERS, USABLE_STATUS
from opinia.functions.urls import next_page_url
from opinia.schema import EXTRACTED

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SELF_CLOSING = frozenset(("li", "p", "option", "tr", "td", "th", "dt", "dd"))
# White space as a browser trims it.
_TRIM = "\t\n\v\f\r " + "".join(
    map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
              0x3000, 0xFEFF)))


_IN_TAG = r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*"""
# A letter in any case, with those that only case folding makes one.
_LETTER = "[A-Za-z\u0130\u0131\u017f\u212a]"
# An end tag, a script or style element up to its end tag, a start tag, or
# something without content; a "<" that begins none of them is text.
_MARKUP = re.compile(
    rf"""<(?: /({_LETTER}[^\s/>]*)[^>]*>
        | (?=[sS\u017f])((?i:script|style))(?![^\s/>])({_IN_TAG})>(.*?)(?=</(?i:\2)\b|\Z)
        | ({_LETTER}[^\s/>]*)({_IN_TAG})>
        | !--.*?(?:-->|\Z)
        | [!?/][^>]*> )""", re.S | re.X)
_ATTRIBUTE = re.compile(
    r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Attributes(NamedTuple):
    values: dict[str, str]
    classes: frozenset[str]
    hook: str


class Element(NamedTuple):
    """What a start tag says; tags written alike share one."""
    tag: str
    attributes: Attributes
    void: bool
    self_closing: bool
    # Block fields the element can supply, and its link to a review.
    fields: tuple[str, ...]
    review_href: str | None
    # Selectors of a page that the element matches by itself.
    marks: tuple[str, ...]


def _attributes(source: str) -> Attributes:
    """Attributes of a start tag; the first of a repeated one counts."""
    values: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        value = double or single or bare
        values.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return Attributes(values, frozenset(values.get("class", "").split()),
                      values.get("data-hook", ""))


# Hook of an element -> the block fields it can supply.
_FIELDS_BY_HOOK = {
    "review-title": ("title",),
    "review-body": ("body",),
    "review-star-rating": ("rating", "star_rating"),
    "review-date": ("date",),
    "avp-badge": ("verified", "avp_badge"),
    "verified-purchase-badge": ("verified",),
    "helpful-vote-statement": ("helpful",),
    "format-strip": ("variant",),
}


_BLOCK_CLASSES = frozenset(("a-section", "review", "aok-relative"))
_ROW_CLASSES = frozenset(("a-row", "a-spacing-base", "a-size-base"))
# Tests of one element, made once per distinct start tag.
_MARKS: dict[str, Callable[[str, Attributes], bool]] = {
    '[data-hook="review"]': lambda tag, a: a.hook == "review",
    '[id^="customer_review-"]':
        lambda tag, a: a.values.get("id", "").startswith("customer_review-"),
    'div[data-hook*="review"]': lambda tag, a: tag == "div" and "review" in a.hook,
    "div.a-section.review.aok-relative": lambda tag, a: tag == "div" and _BLOCK_CLASSES <= a.classes,
    "total": lambda tag, a: tag == "div" and a.hook == "cr-filter-info-review-count",
    "section": lambda tag, a: a.values.get("id") == "filter-info-section",
    "size": lambda tag, a: "a-size-base" in a.classes,
    "row": lambda tag, a: tag == "div" and _ROW_CLASSES <= a.classes,
    "jsonld": lambda tag, a: tag == "script" and a.values.get("type") == "application/ld+json",
    "rating_count": lambda tag, a: a.values.get("id") == "acrCustomerReviewText",
    "account": lambda tag, a: a.values.get("id") == "nav-link-accountList",
    "link": lambda tag, a: tag == "a",
    "last_item": lambda tag, a: tag == "li" and "a-last" in a.classes,
}


@lru_cache(maxsize=8192)
def _element(tag: str, source: str) -> Element:
    tag, attributes = tag.lower(), _attributes(source)
    values, classes, hook = attributes
    fields = list(_FIELDS_BY_HOOK.get(hook, ()))
    if "a-icon-alt" in classes:
        fields.append("rating")
    if "a-profile-name" in classes:
        fields.append("reviewer")
    href = values.get("href", "")
    return Element(tag, attributes, tag in _VOID, tag in _SELF_CLOSING, tuple(fields),
                   href if tag == "a" and "/reviews/" in href else None,
                   tuple(mark for mark, test in _MARKS.items() if test(tag, attributes)))


class Outline:
    """Elements of a document in order; element i contains i+1 .. last[i]."""

    def __init__(self, html: str):
        self.tags: list[str] = []
        self.elements: list[Element] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.texts: list[str] = []
        self.text_start: list[int] = []
        self.text_end: list[int] = []
        self.marked: defaultdict[str, list[int]] = defaultdict(list)
        self._open: list[int] = []
        # Text, then the six groups of a piece of markup, in turn; text ends it.
        parts = _MARKUP.split(html)
        texts, tags, opened = self.texts, self.tags, self._open
        elements, parent, last = self.elements, self.parent, self.last
        text_start, text_end, marked = self.text_start, self.text_end, self.marked
        node = -1
        for text, end, raw, raw_attrs, raw_text, tag, attrs in zip(
                *[parts[i::7] for i in range(7)]):
            if text:
                texts.append(unescape(text) if "&" in text else text)
            if end:
                end = end.lower()
                if opened and tags[opened[-1]] == end:
                    closed = opened.pop()
                    last[closed], text_end[closed] = node, len(texts)
                else:
                    self._end(end)
                continue
            if not tag and not raw:
                continue
            element = _element(tag or raw, attrs if tag else raw_attrs)
            name, _, void, self_closing, _, _, marks = element
            if self_closing and opened and tags[opened[-1]] == name:
                self._close_down_to(len(opened) - 1)
            node += 1
            at = len(texts)
            tags.append(name)
            elements.append(element)
            parent.append(opened[-1] if opened else -1)
            last.append(node)
            text_start.append(at)
            text_end.append(at)
            for mark in marks:
                marked[mark].append(node)
            if not void:
                opened.append(node)
            if not tag:
                texts.append(raw_text)
        if parts[-1]:
            texts.append(unescape(parts[-1]))
        self._close_down_to(0)

    def _end(self, tag: str):
        opened, tags = self._open, self.tags
        for depth in range(len(opened) - 1, -1, -1):
            if tags[opened[depth]] == tag:
                self._close_down_to(depth)
                return

    def _close_down_to(self, depth: int):
        last, at = len(self.tags) - 1, len(self.texts)
        for node in self._open[depth:]:
            self.last[node], self.text_end[node] = last, at
        del self._open[depth:]

    @property
    def attrs(self) -> list[Attributes]:
        return [e.attributes for e in self.elements]

    def text(self, node: int) -> str:
        return "".join(self.texts[self.text_start[node]:self.text_end[node]]).strip(_TRIM)

    def inside(self, node: int) -> range:
        return range(node + 1, self.last[node] + 1)

    def ancestors(self, node: int) -> Iterator[int]:
        while (node := self.parent[node]) >= 0:
            yield node

    def paginated(self, node: int) -> bool:
        return any(self.tags[a] == "ul" and "a-pagination" in self.elements[a].attributes.classes
                   for a in self.ancestors(node))


def extract_pages(pages: DataFrame, triaged: bool = False) -> DataFrame:
    """Replace `html` by what the page holds (see schema.EXTRACTED).

    A page that cannot be read yields a row with `error` set, never a failure.  With
    `triaged`, pages get the `page_status` of `functions.pages.triage`, found where they are
    read, and rejected ones are read as empty.
    """
    carried = [f for f in pages.schema.fields if f.name not in ("html", *(["page_status"] if triaged else []))]
    status = [T.StructField("page_status", T.StringType())] if triaged else []
    schema = T.StructType(carried + status + EXTRACTED.fields)
    arrow = to_arrow_schema(schema)
    names = [f.name for f in carried]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html").to_pylist()
            arrays = [batch.column(n).cast(arrow.field(n).type) for n in names]
            if triaged:
                found = [_status(h) for h in html]
                html = [h if s in USABLE_STATUS else None for h, s in zip(html, found)]
                arrays.append(pa.array(found, arrow.field("page_status").type))
            found = [_read_page(h) for h in html]
            arrays += [
                pa.array([page.get(f.name) for page in found], arrow.field(f.name).type)
                for f in EXTRACTED.fields
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return pages.mapInArrow(read, schema)


def _status(html: str | None) -> str:
    """`functions.pages.page_status` of one page: searching a text is many times faster here."""
    low = (html or "").lower()
    for status, markers in STATUS_MARKERS.items():
        if any(marker in low for marker in markers):
            return status
    return "ok"


def explode_blocks(extracted: DataFrame, strict: bool = False) -> DataFrame:
    """One row per review block, with its position on the page.

    `strict` takes the blocks of the first selector that matched instead of
    the standard ones.
    """
    blocks = F.coalesce("matched_blocks", "blocks") if strict else F.col("blocks")
    kept = [c for c in extracted.columns if c not in EXTRACTED.fieldNames()]
    return extracted.select(*kept, "matched_selector", F.posexplode(blocks).alias("pos", "b")) \
        .select(*kept, "matched_selector", "pos", "b.*")


def has_next() -> Column:
    """Whether an extracted page announces another one; a disabled link wins."""
    return ~F.col("next_disabled") & F.col("next_link")


def following_url(url: Column) -> Column:
    """Address of the next page, NULL on the last one."""
    return F.when(has_next(), next_page_url(url, F.col("next_href")))


def _read_page(html: str | None) -> dict:
    try:
        page = Outline(html or "")
        selector, matched = _review_blocks(page)
        blocks = [_read_block(page, n) for n in page.marked[_SELECTORS[0]]]
        return {
            "matched_selector": selector,
            "blocks": blocks,
            "matched_blocks":
                None if selector in (None, _SELECTORS[0]) else [_read_block(page, n) for n in matched],
            "header_text": _header_text(page),
            "jsonld_text": _jsonld_text(page),
            "rating_count_text": _first_text(page, "rating_count"),
            "account_text": _first_text(page, "account"),
            **_pagination(page),
            "error": None,
        }
    except Exception as failure:  # one broken page must not fail the job
        return {"error": f"{type(failure).__name__}: {failure}", "blocks": [],
                "next_disabled": False, "next_link": False}


# Block selectors, the standard one first.  Two narrower forms of it can never match first.
_SELECTORS = list(_MARKS)[:4]


def _review_blocks(page: Outline) -> tuple[str | None, list[int]]:
    """Elements of the first block selector that matches anything."""
    return next(((s, page.marked[s]) for s in _SELECTORS if page.marked[s]), (None, []))


def _read_block(page: Outline, block: int) -> dict:
    """Text of the first element, in document order, that supplies each field."""
    first: dict[str, int] = {}
    href = None
    for n, (_, _, _, _, fields, review_href, _) in enumerate(
            page.elements[block + 1:page.last[block] + 1], block + 1):
        for field in fields:
            if field not in first:
                first[field] = n
        if href is None:
            href = review_href
    return {"id_href": href, **{field: page.text(n) for field, n in first.items()}}


def _header_text(page: Outline) -> str | None:
    """Text of the first non-empty of the four places that show the total."""
    sections = page.marked["section"][:1]
    places = [
        page.marked["total"],
        [n for section in sections for n in page.marked["size"] if n in page.inside(section)],
        page.marked["row"],
        sections,
    ]
    return next((text for place in places if place and (text := page.text(place[0]))), None)


def _jsonld_text(page: Outline) -> str | None:
    scripts = page.marked["jsonld"]
    return "\n".join(map(page.text, scripts)) if scripts else None


def _first_text(page: Outline, mark: str) -> str | None:
    return page.text(page.marked[mark][0]) if page.marked[mark] else None


def _pagination(page: Outline) -> dict:
    links = page.marked["link"]
    last_items = [n for n in page.marked["last_item"] if page.paginated(n)]

    def values(n: int) -> dict[str, str]:
        return page.elements[n].attributes.values

    disabled = any(
        "a-disabled" in page.elements[n].attributes.classes
        or values(n).get("aria-disabled") == "true"
        or all(page.tags[d] != "a" for d in page.inside(n))
        for n in last_items)
    chain = [
        lambda n: any(n in page.inside(item) for item in last_items),
        *[lambda n, label=label: label in values(n).get("aria-label", "")
          for label in NEXT_LINK_LABELS],
        lambda n: page.elements[n].attributes.hook == "pagination-bar-next",
        lambda n: "pageNumber=" in values(n).get("href", "") and page.paginated(n),
    ]
    node = next((n for test in chain for n in links if test(n)), None)
    return {"next_disabled": disabled, "next_link": node is not None,
            "next_href": None if node is None else values(node).get("href")}
