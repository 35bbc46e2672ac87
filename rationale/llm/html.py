"""Main text of web pages by tag-path ratios.

A page is read into text blocks; each block has the path of tags from the root
to it.  For each path the text length and the punctuation marks of its blocks
are added up and divided by the number of blocks.  Both ratios are smoothed over
the sequence of blocks, fused by multiplication, and paths above a threshold
that follows the page's own spread are content nodes.  They tell where the
article is: all ``article`` elements that hold content, if those hold half of it;
else ``main``; else the smallest element around the content.  There a block stays
if its path is content, or if its tag says what it is (a heading, a paragraph, an
item, a cell): so short lines of an article stay, and stray lines in neutral
boxes go.

Navigation, footers, forms and the like are left out by their tags.  Words in
class, id and role are a weaker sign: they count where all parts of a name are
known (``cookie-notice``, not ``notice-board``), and not for an element that
holds more than half of the page's text, unless it stands outside ``article`` and
``main`` on a page that has them.

Pages are independent rows: no shuffle, and time and memory in proportion to the
page, however deep it is nested (a path is a number: that of the parent's path
and a tag) and however broken: a page is read forward once.  A null page is an
empty one; its text is empty.  Markup that never closes ends with the page: a
comment, a script, a tag without ``>`` behind it.  A quote counts behind ``=``
only, and where it has a partner; where quotes leave a tag without an end, they
count no more from there on.  A character number that no character has is U+FFFD.
Repeated rows give repeated results, no rows none; other columns play no part,
whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: which elements are left out, start a block, are void, or hold raw text.
LEFT_OUT = frozenset("head nav footer aside form script style noscript template iframe svg math button select textarea dialog object canvas audio video".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("p b i em strong span a u small font".split())
RAW = frozenset("script style textarea title".split())
DRAWN = frozenset("svg math".split())
LEAVES = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd pre blockquote td th tr caption figcaption summary address".split())
# Names of what surrounds an article, and parts that go with them.
ASIDES = frozenset("ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus gdpr header footer login menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion recommended related replies respond search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split())
PARTS = frozenset("area article bar block body bottom box buttons container desktop entry fixed footer global group holder icons inner item items js left link links list main mobile outer page panel policy post primary reader region right secondary section site sticky text thread title top user wrap wrapper".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

LISTED = frozenset("ul ol dl table".split())

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
ATTRIBUTES = re.compile(r"[^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')?+[^>=]*+)*+>")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
NUMBER = re.compile(r"&#0*(?=\d)(\d*)(;?)", re.A)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
MARKS = re.compile(r"[.,;:!?。，！？]")


class _Element:
    __slots__ = ("tag", "parent", "path", "out", "aside", "article", "block", "number", "closes")

    def __init__(self, tag: str, parent: _Element | None, path: int, number: int):
        self.tag, self.parent, self.path, self.number = tag, parent, path, number
        self.out = parent.out if parent else False  # left out by tag
        self.aside = False  # named like a surrounding
        self.block = self if tag in BLOCKS or not parent else parent.block
        self.article = tag in ("article", "main") or (parent.article if parent else False)
        self.closes: dict[str, int] = {}


def closed_with(tag: str, depth: int, outer: dict[str, int]) -> dict[str, int]:
    """For each tag that ends open elements: the depth of the one it would end within this element, itself included.

    A block ends a paragraph around inline elements, an item its neighbour in the same list.
    """
    inner = outer
    if "p" in outer and tag not in INLINE or tag in LISTED and outer.keys() - {"p"}:
        inner = {t: d for t, d in outer.items() if (tag in INLINE if t == "p" else tag not in LISTED)}
    own = [t for t, ended in CLOSED_BY.items() if tag in ended] + (["p"] if tag == "p" else [])
    return inner | dict.fromkeys(own, depth) if own else inner


def decoded(text: str) -> str:
    """The text with its character references resolved, numbers of any length among them."""
    return entities.unescape(NUMBER.sub(lambda m: "\ufffd" if len(m[1]) > 7 else f"&#{m[1]}{m[2]}", text))


def named_aside(names: list[str], in_article: bool) -> bool:
    """Does one of the names (of class, id, role) consist of known parts, a surrounding among them?"""
    for name in names:
        parts = {x for x in re.split(r"[\d_-]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if x}
        own = parts & ASIDES - ({"header"} if in_article else set())
        if own and parts <= ASIDES | PARTS:
            return True
    return False


def page_blocks(page: str) -> tuple[list[_Element], list[tuple[_Element, str]]]:
    """All elements, parents first; element and text of each block that isn't left out by tag, in page order."""
    root = _Element("", None, 0, 0)
    elements, stack, open_ = [root], [root], {}
    paths: dict[tuple[int, str], int] = {}
    blocks: list[tuple[_Element, str]] = []
    pieces: list[str] = []
    holder = root

    def flush() -> None:
        text = " ".join(decoded("".join(pieces)).split()) if pieces else ""
        if text and not holder.out:
            blocks.append((holder, text))
        pieces.clear()

    def close(keep: int) -> None:
        while len(stack) > keep:
            open_[stack.pop().tag] -= 1

    def text(piece: str) -> None:
        nonlocal holder
        if not pieces:
            holder = stack[-1].block
        if not stack[-1].out:
            pieces.append(piece)

    at, n, quoted = 0, len(page), True
    while at < n:
        if page[at] != "<":
            start = page.find("<", at)
            start = n if start < 0 else start
            text(page[at:start])
            at = start
            continue
        m = NAME.match(page, at)
        if m is None and page[at + 1 : at + 2] in ("!", "?", "/"):
            end = page.find("-->", at + 2) + 2 if page.startswith("<!--", at) else page.find(">", at)
            if page[end : end + 1] != ">" or end < at:
                break
            at = end + 1
            continue
        if m is None:
            text("<")
            at += 1
            continue
        at, tag = m.end(), m[2]
        whole = ATTRIBUTES.match(page, at) if quoted else None
        quoted = whole is not None
        end = whole.end() if whole else page.find(">", at) + 1
        if not end:
            break
        attributes, at = page[at : end - 1], end
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            elif tag in ("td", "th"):
                pieces.append(" ")
            if open_.get(tag):
                at_stack = len(stack) - 1
                while stack[at_stack].tag != tag:
                    at_stack -= 1
                close(at_stack)
                if tag in BLOCKS:
                    holder = stack[-1]
            continue
        if tag in BLOCKS:
            flush()
            close(stack[-1].closes.get("p", len(stack)))
        if tag in CLOSED_BY:
            close(stack[-1].closes.get(tag, len(stack)))
        if tag in VOID:
            if tag == "br":
                pieces.append("\n")
            continue
        here = stack[-1]
        if attributes.endswith("/") and tag in RAW | DRAWN:
            continue
        element = _Element(tag, here, paths.setdefault((here.path, tag), len(paths) + 1), len(elements))
        element.out |= tag in LEFT_OUT or (tag == "header" and not here.article)
        if attributes and tag not in ("html", "body", "article", "main"):
            element.aside = named_aside([x for a, b, c in NAMED.findall(attributes) for x in (a or b or c).split()], here.article)
            element.out |= element.aside and tag not in BLOCKS  # within a block there is no text to weigh
        elements.append(element)
        if tag in RAW:
            ended = RAW_END[tag].search(page, at)
            at = page.find(">", ended.end()) + 1 if ended else n
            if not at:
                break
            continue
        element.closes = closed_with(tag, len(stack), here.closes)
        stack.append(element)
        open_[tag] = open_.get(tag, 0) + 1
        if tag in BLOCKS:
            holder = element
    flush()
    return elements, blocks


def _smooth(values: list[float]) -> list[float]:
    """Weighted means over two neighbours to either side."""
    weights = (1.0, 0.6, 0.15)
    out = []
    for i in range(len(values)):
        near = [(weights[abs(i - j)], values[j]) for j in range(max(0, i - 2), min(len(values), i + 3))]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def path_scores(blocks: list[tuple[_Element, str]]) -> tuple[dict[int, float], float]:
    """The fused, smoothed ratio of each tag path (its best block's), and the threshold above which paths are content."""
    sums: dict[int, list[float]] = {}
    for element, text in blocks:
        s = sums.setdefault(element.path, [0.0, 0.0, 0.0])
        s[0] += len(text)
        s[1] += len(MARKS.findall(text))
        s[2] += 1
    length, marks = (_smooth([sums[e.path][i] / sums[e.path][2] for e, _ in blocks]) for i in (0, 1))
    fused = [math.log1p(a * (1 + b)) for a, b in zip(length, marks, strict=True)]
    of_path: dict[int, float] = {}
    for (element, _), f in zip(blocks, fused, strict=True):
        of_path[element.path] = max(f, of_path.get(element.path, 0.0))
    mean = sum(fused) / len(fused)
    spread = math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    return of_path, min(mean - 0.5 * spread, 0.75 * mean, max(of_path.values()))


def _weights(elements: list[_Element], blocks: list[tuple[_Element, str]]) -> list[int]:
    """Characters of the blocks within each element."""
    weight = [0] * len(elements)
    for e, text in blocks:
        weight[e.number] += len(text)
    for e in reversed(elements):
        if e.parent:
            weight[e.parent.number] += weight[e.number]
    return weight


def _within(elements: list[_Element], chosen: set[int]) -> list[bool]:
    """Which elements lie in one of the chosen."""
    inside = [False] * len(elements)
    for e in elements:
        inside[e.number] = e.number in chosen or (e.parent is not None and inside[e.parent.number])
    return inside


def main_text(page: str | None) -> str:
    """The text of a page's content blocks, one a line."""
    elements, blocks = page_blocks(page or "")
    weight = _weights(elements, blocks)
    told = any(e.article for e, _ in blocks)
    aside = _within(elements, {e.number for e in elements if e.aside and (told and not e.article or 2 * weight[e.number] <= weight[0])})
    blocks = [(e, text) for e, text in blocks if not aside[e.number]]
    if not blocks:
        return ""
    score, bar = path_scores(blocks)
    content = [(e, text) for e, text in blocks if score[e.path] >= bar]
    weight = _weights(elements, content)
    around = set()
    for tag in ("article", "main"):
        found = {e.number for e in elements if e.tag == tag and weight[e.number]}
        inside = _within(elements, found)
        if 2 * sum(len(text) for e, text in content if inside[e.number]) >= weight[0] and found:
            around = found
            break
    if not around:
        around = {max(e.number for e in elements if weight[e.number] == weight[0])}
    inside = _within(elements, around)
    return "\n".join(text for e, text in blocks if inside[e.number] and (score[e.path] >= bar or e.tag in LEAVES))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p.as_py()) for p in batch.column(2)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["k0", "k1", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each page."""
    named = pages.select(F.col(id_col).alias("k0"), F.col(url_col).alias("k1"), F.col(html_col).alias("html"))
    kinds = [named.schema[c].dataType.simpleString() for c in ("k0", "k1")]
    out = named.mapInArrow(_extract, f"k0 {kinds[0]}, k1 {kinds[1]}, text string, n_chars long")
    return out.select(F.col("k0").alias(id_col), F.col("k1").alias(url_col), "text", "n_chars")
