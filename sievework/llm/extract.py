"""Main text of web pages: flat text blocks, classified by a decision tree on block features.

A page is flattened into blocks at block-level tags. A block knows its word count and link density, those
of its neighbours, and which containers it stands in. The tree is grown on the small labelled pages below.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.llm.common import plain, text_column

# HTML element names by role, and words in class, id or role attributes that name page furniture.
SKIPPED = {"script", "style", "noscript", "template", "textarea", "select", "svg", "iframe", "title", "object", "button"}
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter nobr q "
    "rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split()
)
VOID = {"br", "img", "input", "hr", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track", "param"}
CONTENT = {"article", "main"}
CHROME = {"nav", "footer", "aside", "form", "dialog", "menu", "fieldset", "header"}
FURNITURE = set(
    "nav navbar navigation menu sidebar aside footer header masthead topbar toolbar breadcrumb breadcrumbs ad ads advert "
    "adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login register search share "
    "sharing social related recommended comment comments reply replies respond disqus discussion feedback widget "
    "pagination pager form hidden copyright legal disclaimer tags skip".split()
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""\s(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}

FEATURES = [
    "words", "links", "words_before", "links_before", "words_after", "links_after",
    "in_article", "in_chrome", "furniture", "page_has_article", "heading",
]


_IN_TAG = re.compile("[\"'>]")
# A page in lower case may be longer than the page, so end tags are searched in the page itself.
_ENDS = {name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in SKIPPED}


class _Tags:
    """Ends of the tags of one page, each place looked at a bounded number of times."""

    def __init__(self, text: str):
        self.text = text
        self.last = {q: text.rfind(q) for q in "\"'"}
        self.open: set[int] = set()  # quotes from which no tag ends

    def end(self, at: int) -> int:
        """Position after the tag that begins at ``at``; quoted ``>`` do not end it.

        If a quote stays open to the end of the page, the first ``>`` ends the tag.
        """
        text, i, seen = self.text, at + 1, []
        first = text.find(">", i)
        if first < 0:
            return len(text)
        if '"' not in text[i:first] and "'" not in text[i:first]:
            return first + 1
        while m := _IN_TAG.search(text, i):
            at, c = m.start(), m[0]
            if c == ">":
                return m.end()
            i = m.end()
            if text[at - 1] in "= \t\n":
                if at in self.open:
                    break
                seen.append(at)
                if i > self.last[c]:
                    break
                i = text.find(c, i) + 1
        self.open.update(seen)
        return first + 1


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """The text blocks of a page in order, and their features. Text outside any tag is a block as well."""
    texts: list[str] = []
    rows: list[list[float]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, in article, in chrome, furniture
    parts: list[str] = []
    linked, link_depth, heading, any_article = 0, 0, False, False
    n, at = len(page), 0
    tags = _Tags(page)

    def flush():
        nonlocal parts, linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            top = stack[-1] if stack else ("", False, False, False)
            words = len(text.split(" "))
            texts.append(text)
            rows.append([words, min(1.0, linked / words), *map(float, top[1:]), float(heading)])
        parts, linked = [], 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            piece = page[at:lt]
            parts.append(piece)
            if link_depth:
                linked += len(piece.split())
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            at = tags.end(lt)
            continue
        m = _NAME.match(page, lt)
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        at = tags.end(lt)
        name, closing = m[1].lower(), page[lt + 1] == "/"
        if name in SKIPPED and not closing:
            end = _ENDS[name].search(page, at)
            at = tags.end(end.start()) if end else n
            continue
        if name == "a":
            link_depth = 0 if closing else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE or name in SKIPPED:
            continue
        flush()
        link_depth = 0
        if name in _HEADING:
            heading = not closing
        if name in VOID or name in ("p", *_HEADING):
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        _, article, chrome, odd = stack[-1] if stack else ("", False, False, False)
        marks = {
            w for _, v in _ATTRIBUTE.findall(page[lt:at]) for w in re.findall(r"[a-z]+", re.sub("([A-Z])", r" \1", v).lower())
        }
        if article:
            marks -= {"header"}
        chrome = chrome or (name in CHROME and not (name == "header" and article))
        article = article or name in CONTENT
        any_article = any_article or name in CONTENT
        odd = odd or bool(marks & FURNITURE)
        if name not in ("html", "body"):
            stack.append((name, article, chrome, odd))
    flush()

    own = np.array(rows, float).reshape(-1, 6)
    edge = np.zeros((1, 2))
    size = own[:, :2]
    before, after = np.vstack([edge, size[:-1]])[: len(own)], np.vstack([size[1:], edge])[: len(own)]
    has = np.full((len(own), 1), float(any_article))
    return texts, np.hstack([size, before, after, own[:, 2:5], has, own[:, 5:]])


# The labelled table: blocks that begin with "+" belong to the main text.
_LONG = "word " * 40
_MID = "word " * 14
LABELLED = [
    f"<nav><ul><li><a>x y</a></li><li><a>z</a></li></ul></nav><div class=ad>word word word word</div><article><h1>+t word word</h1>"
    f"<p>+{_LONG}<p>+a b.<p>+{_MID}</article><footer>word word word word</footer>",
    f"<header><a>home</a></header><article><h1>+t</h1><p>+a.</p><p>+a b c</p></article><aside><p>{_LONG}</p></aside>"
    f"<footer><p>{_MID}</p><a>x</a></footer>",
    f"<div class=cookie-notice>{_MID}</div><main><h2>+t word</h2><p>+{_MID}</p><div class=promo>{_LONG}</div><p>+{_LONG}</p>"
    f"<p>+see <a>this link here</a></p><p>+<a>all link</a></p></main><section id=comments><p>{_LONG}</p><p>{_MID}</p></section>",
    f"<article><header><h1>+t word</h1></header><p>+{_LONG}</p><form><p>{_MID}</p></form><p>+a b</p><div class=comments>"
    f"<p>{_LONG}</p><p>word</p></div></article><div class=sidebar><p>{_LONG}</p><a>x</a></div>",
    f"<div id=menu><a>x y</a></div><div><h1>+t word word</h1><p>+{_LONG}</p><p>+{_MID}</p><p>+{_LONG}</p></div>"
    f"<div><a>more word</a></div><div class=footer>{_MID}</div>",
    f"<div><a>x</a> <a>y</a></div><div>word word</div><h1>+t word</h1><p>+{_LONG}</p><p>+{_LONG}</p><p>+{_MID}</p><div>word word</div>",
    f"<article><p>+word</p><p>+word word</p><p>+{_LONG}</p></article><p>word word word</p><p>{_LONG}</p><div class=related><a>x word</a></div>",
    f"<main><p>+{_MID}</p><ul><li>+word</li><li>+<a>word</a></li></ul><aside>{_MID}</aside><nav><a>x y z</a></nav><p>+{_MID}</p></main>",
    f"<p>+{_LONG}</p><p>+{_MID}</p><p><a>x y</a></p><footer>{_LONG}</footer>",
    f"<h1>+t word</h1><p>+{_MID}</p><p>+{_LONG}</p><p>word</p><p><a>x</a></p>",
]


class Tree:
    """A classification tree by Gini impurity, grown until its leaves are pure or ``depth`` is reached."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10):
        self.nodes: list[tuple[int, float, int, int, float]] = []
        self._grow(x, y, depth)

    def _grow(self, x, y, depth) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, at, at, float(y.mean())))
        if depth and 0 < y.mean() < 1:
            best = (0.0, None)
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    left = x[:, f] <= cut
                    worth = y.var() - left.mean() * y[left].var() - (~left).mean() * y[~left].var()
                    if worth > best[0] + 1e-12:
                        best = (worth, (f, cut))
            if best[1]:
                f, cut = best[1]
                left = x[:, f] <= cut
                low, high = self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)
                self.nodes[at] = (f, float(cut), low, high, float(y.mean()))
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        feature, cut, low, high, share = (np.array(c) for c in zip(*self.nodes))
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                return share[node] > 0.5
            at = node[inner]
            goes = x[inner, feature[at]] <= cut[at]
            node[inner] = np.where(goes, low[at], high[at])


@lru_cache(maxsize=1)
def main_text_tree() -> Tree:
    """The tree fitted on the labelled blocks."""
    found = [blocks(page) for page in LABELLED]
    y = np.array([float(t.startswith("+")) for texts, _ in found for t in texts])
    return Tree(np.vstack([x for _, x in found]), y)


def extract(page: str) -> str:
    """Main text of one page: its main blocks, one a line."""
    texts, x = blocks(page)
    if not texts:
        return ""
    return "\n".join(t for t, keep in zip(texts, main_text_tree().predict(x)) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [extract(p) for p in text_column(batch, "html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page row, from the whole html.

    A null or empty html, or one without main blocks, gives an empty text. Rows are independent: repeated
    rows give repeated results, other columns are not read, an empty table gives no rows.
    """
    return plain(pages, page_id="page_id:long", url="url:string", html="html:string").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )
