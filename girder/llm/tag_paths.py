"""Operator 4: main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its tag path: the open elements from the root to it, by name and class. Per path
the blocks' text length, number, punctuation and linked text are added up. The text ratio (length by blocks) and the
punctuation ratio (marks by blocks) of the paths are taken in page order, smoothed with a Gaussian and fused into one value;
paths above a share of the weighted spread are content. A path inside an article or main element counts more, one below an
element whose class, id or role names something else (comments, adverts) far less: such names weigh, but what stands out
among them is still content.

The home of the content is the innermost element that holds all blocks of the best path. Blocks of other paths inside it, such
as headings and lists, belong to the text too, unless they lie below more telling names than the content, or are mostly links
outside an article; in a home that is the page's body only what lies between content does. Elements that are never part of an
article by their tag (scripts, styles, forms, navigation, headers, footers, asides) take no part at all.

Defined results: a null, empty or textless page gives an empty text; broken markup is read as far as it goes (unclosed
elements close with their parents, an unfinished tag or quote takes the rest of the page with it); character references are
decoded; equal pages give equal texts; pages are independent and read whole, in time that grows with their length however
deep they nest; other columns pass through `extract`, and if the new column's name is taken, underscores are added.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.common import bounded_batches, free_name

NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]*)(\s*=\s*)?")
UNQUOTED = re.compile(r"[^\s>]*")
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，？！；：¿¡]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset("nav header footer aside form menu dialog button select option fieldset audio video head".split()) | RAW
PARAGRAPH_ENDS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
MARKED = frozenset(("article", "main"))
# words of class, id and role that name what is no article
OTHER = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail widget footer foot header masthead topbar toolbar"
    " comment comments respond reply replies disqus discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended"
    " recommendations trending popular pagination pager tags copyright legal disclaimer skip hidden complementary contentinfo dialog form".split()
)
WORDS = re.compile(r"[a-z]+")
BONUS, MALUS = 4.0, 0.02  # weights of a path in an article element, and of each telling name above it
LINKED = 0.6  # share of linked text from which a block is mostly links


class Element:
    __slots__ = ("name", "path", "parent", "article", "other", "out", "size", "content")

    def __init__(self, name: str, path: int, parent: int, article: bool, other: int, out: bool) -> None:
        self.name, self.path, self.parent, self.article, self.other, self.out, self.size, self.content = name, path, parent, article, other, out, 1, 0


class Block:
    __slots__ = ("element", "pieces", "linked", "number", "text")

    def __init__(self, element: int, number: int) -> None:
        self.element, self.number, self.pieces, self.linked, self.text = element, number, [], 0, ""


def tags(html: str) -> Iterator[tuple[int, int, str, bool, dict[str, str], bool]]:
    """Start, end, lower-case name, whether it closes, attributes and whether it is self-closed of each tag; comments and
    declarations have no name, and what the page breaks off in has the page's end for its own."""
    at, n = 0, len(html)
    last = {q: html.rfind(q) for q in "'\""}
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = n if end < 0 else end + 3
            yield start, at, "", False, {}, False
            continue
        if html[start + 1 : start + 2] in ("!", "?"):
            end = html.find(">", start)
            at = n if end < 0 else end + 1
            yield start, at, "", False, {}, False
            continue
        closes = html[start + 1 : start + 2] == "/"
        m = NAME.match(html, start + 1 + closes)
        if not m:
            at = start + 1
            continue
        name, found, at, slash = m[0].lower(), {}, m.end(), False
        while at < n and html[at] != ">":
            m = ATTRIBUTE.match(html, at)
            slash = "/" in html[at : m.start(1)] and not m[1] and not m[2]
            at = max(m.end(), at + (not m[0]))
            value = ""
            if m[2]:
                quote = html[at : at + 1]
                if quote in last and quote:
                    end = html.find(quote, at + 1) if last[quote] > at else -1
                    value, at = (html[at + 1 : end], end + 1) if end >= 0 else ("", n)
                else:
                    value = UNQUOTED.match(html, at)[0]
                    at += len(value)
            if m[1]:
                found.setdefault(m[1].lower(), value)
        whole = at < n
        at = at + 1 if whole else n
        yield start, at, name if whole else "", closes, found, slash
        if whole and name in RAW and not closes and not slash:
            m = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(html, at)
            end = m.start() if m else n
            yield at, end, "", False, {}, False
            at = end


def telling(found: dict[str, str]) -> tuple[bool, bool]:
    """Whether attributes hide an element, and whether they name something that is no article."""
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    named = not OTHER.isdisjoint(WORDS.findall(" ".join(found.get(k, "") for k in ("class", "id", "role")).lower()))
    return hidden, named


def blocks(html: str) -> tuple[list[Element], list[Block]]:
    """The elements of a page in order (the first is the page) and the blocks of text outside those that are no article."""
    elements, found = [Element("", 0, -1, False, 0, False)], []
    paths: dict[tuple[int, str], int] = {}
    open_, outer, places = [0], [0], {}  # open elements, the places of those that are no inline ones, and of each name
    number, at, links = 0, 0, 0
    current: Block | None = None

    def text(piece: str) -> None:
        nonlocal current
        if not piece or elements[open_[-1]].out:
            return
        if current is None or current.number != number:
            if not piece.strip():
                return
            current = Block(open_[outer[-1]], number)
            found.append(current)
        piece = unescape(piece) if "&" in piece else piece
        current.pieces.append(piece)
        if links:
            current.linked += len(piece)

    def close(k: int) -> None:
        nonlocal number, links
        while len(open_) > k:
            name = elements[open_.pop()].name
            places[name].pop()
            links -= name == "a"
            if outer[-1] == len(open_):
                outer.pop()
                number += 1

    for start, end, name, closes, attributes, slash in tags(html):
        if start > at:
            text(html[at:start])
        at = end
        if not name:
            continue
        if closes:
            if name == "br":
                continue
            where = places.get(name)
            if where and (name not in INLINE or where[-1] > outer[-1]):
                close(where[-1])
            number += name not in INLINE
            continue
        if name in RAW:
            continue
        if name in VOID:
            if name == "br":
                text(" ")
            number += name not in INLINE and name != "br"
            continue
        if name in PARAGRAPH_ENDS and elements[open_[outer[-1]]].name == "p":
            close(outer[-1])
        for inner in CLOSES.get(name, ()):
            if elements[open_[outer[-1]]].name == inner:
                close(outer[-1])
                if name != "tr":
                    break
        number += name not in INLINE
        if slash and name not in INLINE:
            continue
        above = elements[open_[-1]]
        inline = name in INLINE
        hidden, named = telling(attributes) if attributes else (False, False)
        out = above.out or hidden or name in NEVER and not (name == "header" and above.article)
        if inline:
            path, other = above.path, above.other + named
        else:
            path = paths.setdefault((above.path, f"{name}.{attributes.get('class', '')}" if attributes else name), len(paths) + 1)
            other = above.other + (named and name not in ("html", "body", *MARKED))
        places.setdefault(name, []).append(len(open_))
        if not inline:
            outer.append(len(open_))
        elements.append(Element(name, path, open_[-1], above.article or name in MARKED, other, out))
        open_.append(len(elements) - 1)
        links += name == "a"
    text(html[at:])
    return elements, found


def smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing that keeps the ends' weight."""
    if len(x) < 3:
        return x
    r = math.ceil(2 * sigma)
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(np.pad(x, r, mode="edge"), k / k.sum(), "valid")


def ratios(sums: np.ndarray) -> np.ndarray:
    """The fused ratio of each path, in page order; `sums` has text length, blocks, marks, whether in an article, telling names."""
    length, count, marks, inside, other = sums.T
    fused = smooth(length / count) * smooth((marks + 1) / count)
    return fused * np.where(inside > 0, BONUS, 1.0) * MALUS ** np.minimum(other, 8)


def content_paths(sums: np.ndarray) -> set[int]:
    """Places of the paths whose fused, smoothed ratio of text and punctuation lies above the threshold."""
    fused, weight = ratios(sums), sums[:, 0] + 1
    mean = (fused * weight).sum() / weight.sum()
    limit = min(0.1 * np.sqrt((weight * (fused - mean) ** 2).sum() / weight.sum()) + 0.05 * mean, 0.5 * fused.max())
    return set(np.flatnonzero(fused >= limit).tolist())


def home_of(elements: list[Element], inside: list[int]) -> int:
    """The innermost element that holds all of `inside`; elements are in page order, so parents come first."""
    for e in elements:
        e.size, e.content = 1, 0
    for i in inside:
        elements[i].content += 1
    for e in reversed(elements[1:]):
        elements[e.parent].size += e.size
        elements[e.parent].content += e.content
    return max(i for i, e in enumerate(elements) if e.content == len(inside))


def main_text(html: str | None) -> str:
    """The article's blocks, white space made one, joined by an empty line."""
    elements, found = blocks(html or "")
    for b in found:
        b.text = SPACE.sub(" ", "".join(b.pieces)).strip()
    found = [b for b in found if b.text]
    if not found:
        return ""
    order: dict[int, int] = {}
    sums: list[list[float]] = []
    for b in found:
        e = elements[b.element]
        if (k := order.setdefault(e.path, len(order))) == len(sums):
            sums.append([0.0, 0.0, 0.0, float(e.article), float(e.other)])
        sums[k][0] += max(0, len(b.text) - 2 * b.linked)
        sums[k][1] += 1
        sums[k][2] += len(PUNCTUATION.findall(b.text))
    table = np.array(sums)
    good, best = content_paths(table), int(ratios(table).argmax())
    place = [order[elements[b.element].path] for b in found]
    own = [b.element for b, k in zip(found, place, strict=True) if k == best]
    home = home_of(elements, own)
    if len(set(own)) == 1 and elements[home].parent > 0:
        home = elements[home].parent  # a single paragraph's home is what it stands in
    root, last = elements[home], home + elements[home].size
    is_good = [k in good for k in place]
    first, end = is_good.index(True), len(found) - is_good[::-1].index(True)
    least = min(elements[i].other for i in own)
    out = []
    for i, (b, fits) in enumerate(zip(found, is_good, strict=True)):
        e = elements[b.element]
        inside = home <= b.element < last and e.other <= least and (e.article or b.linked <= LINKED * len(b.text))
        heads = e.name[:1] == "h" and e.name[1:].isdigit() and root.name != ""
        if fits or inside and (root.name not in ("", "html", "body") or first <= i < end or heads):
            out.append(b.text)
    return "\n\n".join(out)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """`pages` with the main text of each."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(main_text, na_action=None)

    return bounded_batches(pages).withColumn(free_name(pages, out), run(F.coalesce(F.col(html), F.lit(""))))


def digests(pages: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            text = [main_text(x) for x in part.pop("html")]
            yield part.assign(text=text, n_chars=[len(t) for t in text])

    return bounded_batches(pages).select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
