"""Operator 5: main text of web pages from the events of the standard library's HTML parser.

1.  The events become lines, one for each block of text, with the number of tags inside and the
    characters in links.  What elements and roles themselves name as navigation, page header,
    footer, sidebar, advert, dialog, form, script or style gives no lines.
2.  The ratio of text to tags is smoothed along the page with a Gaussian; lines above a threshold,
    and not mostly links, are dense.
3.  The dense characters choose the content region: from the whole page down, the block that holds
    `HOLDS` of them is entered, until none does or the block is an article or main part (of those,
    the innermost that holds as much).  Where marked parts hold any, only theirs count.  So a lone
    article among teasers is found as well as a plain `div`, and what stands outside the region
    falls away, whatever it is called.
4.  In the region, classes and ids are a hint only: a block named like comments, an advert or a
    notice goes unless it holds nearly all dense text itself; one with a vaguer name goes where
    it isn't dense.  In a region that isn't marked as an article, lines that are mostly links go
    too, and short ones outside its dense clusters that are no paragraphs or headings.  All else
    in the region is the text, short blocks too.

Null and empty pages, and pages without such text, give an empty text.  Pages of any length
are read whole.  Repeated rows and keys stay, null keys too; there are no ties; an empty table
gives an empty table; only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready
from .tokenize import binary_sizes, runs

#: HTML element names by their role.
NO_TEXT = frozenset("script style noscript template head title iframe object svg canvas audio video map math".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button select textarea input datalist fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(["article", "main"])
ENTERED = frozenset("html body div section center main article".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of classes and ids that name boilerplate, and vaguer ones.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising sponsored cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer comment comments disqus newsletter subscribe popup modal pagination".split()
)
VAGUE = frozenset("adv sponsor promo promotion banner notification alert masthead toolbar respond reply replies share sharing social related recommended subscription signup login overlay widget pager skip copyright".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Share of the dense characters that a block must hold to be entered.
HOLDS = 0.8
#: Share of them beyond which a block is not taken for boilerplate by its name.
NEARLY_ALL = 0.9


def hint(attrs: list[tuple[str, str | None]]) -> int:
    """2 if a class or id begins or ends with a word that names boilerplate, 1 for a vaguer one, else 0."""
    found = 0
    for name, value in attrs:
        if name in ("class", "id"):
            for token in (value or "").split():
                words = [w.lower() for w in _WORD.findall(token)]
                ends = set(words[:1] + words[-1:])
                found = max(found, 2 if ends & NAMED else int(bool(ends & VAGUE)))
    return found


class Lines(HTMLParser):
    """Lines of a page: text, tags inside, characters in links, block, element; blocks: parent, element, hint."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, str]] = []
        self.blocks: list[tuple[int, str, int]] = [(-1, "html", 0)]
        self.stack: list[tuple[str, bool]] = []  # element, whether it is left out
        self.left_out = self.main = 0
        self.open = [0]
        self.text: list[str] = []
        self.tags = self.links = self.linked = 0  # tags, characters in links, open links

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            element = next((name for name, _ in reversed(self.stack) if name not in INLINE), "html")
            self.lines.append((text, self.tags, self.links, self.open[-1], element))
        self.text, self.tags, self.links = [], 0, 0

    def is_boilerplate(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NO_TEXT or tag in BOILERPLATE or tag == "header" and not self.main:
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        return any(name == "role" and (value or "").lower() in ROLES or name == "hidden" or name == "aria-hidden" and (value or "").lower() == "true" for name, value in attrs)

    def pop(self) -> None:
        tag, out = self.stack.pop()
        self.left_out -= out
        self.main -= tag in MAIN
        self.linked -= tag == "a"
        if tag not in INLINE:
            self.open.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in INLINE:
            self.tags += 1
            if tag == "br":
                self.text.append(" ")
        else:
            self.end_line()
            if tag in MAIN and self.left_out and not any(t in MAIN for t, _ in self.stack):
                while self.left_out:  # what was left open before the main part
                    self.pop()
            if tag == "p" or tag not in VOID:
                self.implied_ends(tag)
        if tag in VOID:
            return
        out = self.is_boilerplate(tag, attrs)
        self.stack.append((tag, out))
        self.left_out += out
        self.main += tag in MAIN
        self.linked += tag == "a"
        if tag not in INLINE:
            self.blocks.append((self.open[-1], tag, 0 if tag in ("html", "body") else hint(attrs)))
            self.open.append(len(self.blocks) - 1)

    def implied_ends(self, tag: str) -> None:
        """A block ends an open paragraph; an item ends its predecessor."""
        same = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}.get(tag, ())
        for at in range(len(self.stack) - 1, -1, -1):
            name = self.stack[at][0]
            if name == "p" or name in same:
                while len(self.stack) > at:
                    self.pop()
            elif name not in INLINE:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.tags += 1
        else:
            self.end_line()
        for at in range(len(self.stack) - 1, -1, -1):
            name = self.stack[at][0]
            if name == tag:
                while len(self.stack) > at:
                    self.pop()
                return
            if tag in INLINE and name not in INLINE:
                return  # a stray end tag

    def handle_data(self, data: str) -> None:
        if not self.left_out:
            self.text.append(data)
            if self.linked:
                self.links += len(data)

    def close(self) -> None:
        super().close()
        self.end_line()


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(round(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def region_of(blocks: list[tuple[int, str, int]], place: np.ndarray, weight: np.ndarray) -> tuple[int, np.ndarray]:
    """The block that holds the dense characters, and each block's share of them."""
    held = np.bincount(place, weights=weight, minlength=len(blocks))
    for i in range(len(blocks) - 1, 0, -1):  # children come after their parents
        held[blocks[i][0]] += held[i]
    at, children = 0, {}
    for i, (parent, tag, _) in enumerate(blocks):
        if i and tag in ENTERED:
            children.setdefault(parent, []).append(i)
    while True:
        best = max(children.get(at, []), key=lambda i: held[i], default=0)
        if not best or held[best] < HOLDS * held[at]:
            return at, held
        if blocks[at][1] in MAIN:  # only another marked part is entered from here
            inner = [i for i in range(at + 1, len(blocks)) if blocks[i][1] in MAIN and held[i] >= HOLDS * held[at] and at in ancestors(blocks, i)]
            return (inner[-1] if inner else at), held
        at = best


def ancestors(blocks: list[tuple[int, str, int]], i: int) -> list[int]:
    out = []
    while i >= 0:
        out.append(i)
        i = blocks[i][0]
    return out


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.25) -> str:
    """The page's main text, a line for each block.  `share`: the threshold's part of the
    standard deviation of the smoothed ratios."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    if not page.lines:
        return ""
    texts, tags, links, places, elements = zip(*page.lines, strict=True)
    blocks, place, size = page.blocks, np.array(places), np.array([len(t) for t in texts])
    score = smoothed(size / (1 + np.array(tags)), sigma)
    mostly_links = 2 * np.array(links) > size
    dense = (score >= share * score.std()) & ~mostly_links
    # blocks named as boilerplate do not draw the region, unless they hold nearly all text
    weight = np.where(dense, size, 0)
    _, held = region_of(blocks, place, weight)
    named = np.zeros(len(blocks), dtype=np.int64)
    for i, (parent, _, own) in enumerate(blocks):
        named[i] = max(own if held[i] <= NEARLY_ALL * held[0] else 0, named[parent] if i else 0)
    weight = np.where(named[place] == 2, 0, weight)
    marked = np.zeros(len(blocks), dtype=bool)
    for i, (parent, tag, _) in enumerate(blocks):
        marked[i] = tag in MAIN or i > 0 and marked[parent]
    if weight[marked[place]].any():  # the text is in a marked part; which, the dense characters tell
        weight = np.where(marked[place], weight, 0)
    region, _ = region_of(blocks, place, weight)
    inside = np.zeros(len(blocks), dtype=bool)
    for i, (parent, _, _) in enumerate(blocks):
        inside[i] = i == region or i > region and inside[parent]
    chosen = inside[place] & (named[place] < 2) & ~((named[place] == 1) & ~dense)
    if blocks[region][1] not in MAIN:
        at = np.flatnonzero(chosen & dense)
        if not len(at):
            return ""
        among = np.zeros(len(texts), dtype=bool)
        among[at[0] : at[-1] + 1] = True  # the clusters and what stands between them
        prose = np.array([e in PROSE for e in elements])
        chosen &= ~mostly_links & (among | prose)
    return "\n".join(t for t, c in zip(texts, chosen, strict=True) if c)


def extract(frame: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """Keys, text and n_chars of every page."""
    ready(frame.sparkSession)
    source = frame.select(*keys, F.col(html).alias("__html"))
    schema = T.StructType([*(source.schema[k] for k in keys), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs(binary_sizes(batch.column(len(keys)))):
                part = batch.slice(a, b - a)
                texts = [main_text(h) for h in part.column(len(keys)).to_pylist()]
                columns = [*part.columns[: len(keys)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return source.mapInArrow(work, schema)
