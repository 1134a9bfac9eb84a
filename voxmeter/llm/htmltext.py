"""HTML extraction by tag-path ratios.

Every text block of a page has a root-to-leaf tag path. Per path, text length outside links
and punctuation are summed: the path's ratios to the one element that a path is. Both are
smoothed along the page and fused into a product, times a weight for what elements and class
names say, which is never a filter. Paths within a factor of the page's best one are content:
a path of many paragraphs stands far above one of a single line, whatever their names. The
innermost element that holds nearly all content is the main one; in it blocks count by
themselves and a lower threshold holds, so that its headings, lists and short blocks stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A quote is one only after an equals sign: unquoted values and stray quotes are read as HTML does.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=\s*[^\s"'>][^\s>]*|=)*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
# The HTML elements by their kind.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img"}
P_ENDS = {"address", "article", "aside", "blockquote", "center", "dir", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
P_SCOPE = {"button", "td", "th", "table"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that are a piece of a text, not the place that holds it.
PIECES = {*HEADINGS, "p", "pre", "li", "dd", "dt", "blockquote", "figcaption"}
MARKS = ".,;:!?\u3002\uff0c\u3001\uff1b\uff1a\uff01\uff1f\u061f\u060c\u061b\u0964"

#: Weights on paths: outside a page's only article or main element (several are no hint), of elements and names that stand for other things than main text, and of those that may.
OUTSIDE, OTHER, MAYBE = 0.6, 0.1, 0.3
OTHER_TAGS = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "label", "fieldset", "datalist"}
OTHER_NAMES = set("ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion banner nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations pagination pager toolbar copyright complementary contentinfo notice notices alert alerts".split())
MAYBE_NAMES = set("header legal disclaimer tag tags search form side toc byline".split())
#: Parts of a name that say what the thing looks like, not what it is.
SHAPES = set("area articles bar block body bottom box button buttons center container content count cta desktop fixed form group head holder icon icons info inner item items label large left link links list main message mobile outer panel placeholder posts primary reading right row secondary section slot small sticky stories text thread title top unit wrap wrapper zone".split())
PREFIXES = set("has with without no is".split())
#: The fused ratio of blocks of 200 characters with four marks; above it a path is prose and no more.
FULL = float(np.log1p(200 * 5))
#: Power of a weight in a path's value, which is a product of sums: what lies outside the only article must have a dozen times its text and marks to count as much.
STRENGTH = 5.0
#: How many times the value of a content path the best path's may be; a block's share of the best block inside the main element, and what it gets from being inside.
FACTOR, LOW, INSIDE = 2.0, 0.25, 0.3
#: A page whose best block is less has no content.
LEAST = 0.03


def name_weight(value: str) -> float:
    """The weight of a class, id or role: each name counts by its last part that is no mere shape."""
    weight = 1.0
    for name in value.split():
        parts = [p for p in re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if p]
        if not parts or parts[0] in PREFIXES:
            continue
        while len(parts) > 1 and (parts[-1] in SHAPES or any(c.isdigit() for c in parts[-1])):
            parts.pop()
        last = parts[-1].rstrip("0123456789")
        weight = min(weight, OTHER if last in OTHER_NAMES or last.startswith("adsby") else MAYBE if last in MAYBE_NAMES else 1.0)
    return weight


def judged(name: str, attributes: str, in_main: bool) -> tuple[float, bool]:
    """An element's weight, and whether it is shown."""
    weight, shown = OTHER if name in OTHER_TAGS and not (name == "header" and in_main) else 1.0, True
    if attributes and name not in ("body", "html"):
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id", "role"):
                weight = min(weight, name_weight(value))
            elif key == "hidden" and value.lower() not in ("false", "until-found") or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and NOT_SHOWN.search(value):
                shown = False
    return weight, shown


class Page:
    """Text blocks of a page in order, and its elements: each block has its path, its element, its text and the characters of it in links."""

    def __init__(self, page: str):
        self.paths: dict[tuple, int] = {}  # (path above, name, weight) -> number
        self.weights: list[float] = []  # by path
        self.in_main: list[bool] = []
        self.parents: list[int] = []  # element above each block element; elements are numbered in page order
        self.names: list[str] = []
        self.blocks: list[tuple[int, int, str, int]] = []
        if self.read(page) == 1:
            self.weights = [w if inside else w * OUTSIDE for w, inside in zip(self.weights, self.in_main, strict=True)]

    def path(self, above: int, name: str, weight: float, in_main: bool) -> int:
        k = self.paths.setdefault((above, name, weight), len(self.weights))
        if k == len(self.weights):
            self.weights.append(weight * self.weights[above] if above >= 0 else weight)
            self.in_main.append(in_main)
        return k

    def read(self, page: str) -> int:
        """Fills the lists; the number of article and main elements that lie in no other."""
        # Open elements: name, path, element, in article or main, shown, number of links, open p, open li (places in the stack or -1).
        stack = [("", self.path(-1, "", 1.0, False), -1, False, True, 0, -1, -1)]
        mains = 0
        counts: dict[str, int] = {}
        parts: list[str] = []
        linked, at, end = 0, 0, len(page)

        def end_block() -> None:
            nonlocal parts, linked
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    self.blocks.append((stack[-1][1], stack[-1][2], text, min(linked, len(text))))
            parts, linked = [], 0

        def pop(to: int) -> None:
            while len(stack) > max(to, 1):
                counts[stack.pop()[0]] -= 1

        def text(s: str) -> None:
            nonlocal linked
            if s and stack[-1][4]:
                parts.append(s)
                if stack[-1][5]:
                    linked += len(s.strip())

        while at < end:
            lt = page.find("<", at)
            if lt < 0:
                text(page[at:])
                break
            text(page[at:lt])
            m = TOKEN.match(page, lt)
            if not m:
                text("<")
                at = lt + 1
                continue
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            inline = name in INLINE
            if m[1]:
                if not inline:
                    end_block()
                if counts.get(name):
                    # An inline end tag closes nothing across a block.
                    where = len(stack) - 1
                    while stack[where][0] != name and not (inline and stack[where][0] not in INLINE):
                        where -= 1
                    if stack[where][0] == name:
                        pop(where)
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else end
                continue
            if name == "br":
                text(" ")
                continue
            if not inline:
                end_block()
                if name == "li" and stack[-1][7] >= 0:
                    pop(stack[-1][7])
                elif name in P_ENDS and stack[-1][6] >= 0:
                    pop(stack[-1][6])
            if name in VOID or m[3].endswith("/"):
                continue
            _, path, element, in_main, shown, links, p, li = stack[-1]
            own, own_shown = judged(name, m[3], in_main) if m[3] or not inline else (1.0, True)
            counts[name] = counts.get(name, 0) + 1
            if inline:
                stack.append((name, path, element, in_main, shown and own_shown, links + (name == "a"), p, li))
                continue
            if name in ("article", "main") and not in_main:
                mains, in_main = mains + 1, True
            self.parents.append(element)
            self.names.append(name)
            place = len(stack)
            p = place if name == "p" else -1 if name in P_SCOPE else p
            li = place if name == "li" else -1 if name in ("ul", "ol") else li
            stack.append((name, self.path(path, name, own, in_main), len(self.names) - 1, in_main, shown and own_shown, links, p, li))
        end_block()
        return mains


def smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.array([0.054, 0.242, 0.408, 0.242, 0.054])
    return np.convolve(np.pad(x, 2, mode="edge"), kernel, "valid")


def path_values(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """The logarithm of each path's weighted value (-inf for paths without a block), and each block's weighted value, from 0 to 1."""
    of = np.array([b[0] for b in page.blocks])
    size, linked = (np.array([f(b) for b in page.blocks], dtype=float) for f in (lambda b: len(b[2]), lambda b: b[3]))
    marks = np.array([sum(map(b[2].count, MARKS)) for b in page.blocks], dtype=float)
    n = np.bincount(of)
    total = lambda x: np.bincount(of, x, minlength=len(n))
    mean = lambda x: total(x) / np.maximum(n, 1)
    weights = np.array(page.weights)
    fused = smooth(np.log1p(total(size - linked))[of]) + smooth(np.log1p(total(marks))[of])
    paths = np.where(n > 0, mean(fused) + STRENGTH * np.log(np.maximum(weights[: len(n)], 1e-300)), -np.inf)
    own = np.log1p(smooth(mean(size - linked)[of]) * (1 + smooth(mean(marks)[of])))
    return paths, np.minimum(own, FULL) / FULL * weights[of]


def content(page: Page, factor: float = FACTOR, low: float = LOW) -> list[str]:
    """The texts of the blocks that belong to the main text; of elements that hold as much the innermost is the main one."""
    if not page.blocks:
        return []
    value, own = path_values(page)
    best = own.max()
    if best < LEAST:
        return []
    of, element = (np.array([b[i] for b in page.blocks]) for i in (0, 1))
    chosen = value[of] >= value.max() - np.log(factor)
    size = np.array([len(b[2]) for b in page.blocks])
    held = np.zeros(len(page.names) + 1, dtype=np.int64)  # the last one is the page
    np.add.at(held, element[chosen], size[chosen])
    for k in range(len(page.names) - 1, -1, -1):
        held[page.parents[k]] += held[k]
    # From the page down to the innermost element with nine tenths of the content.
    main = -1
    for k in range(len(page.names)):
        if page.parents[k] == main and page.names[k] not in PIECES and held[k] >= 0.9 * held[-1]:
            main = k
    inside = np.zeros(len(page.names) + 1, dtype=bool)
    inside[main] = True
    for k in range(len(page.names)):
        inside[k] |= inside[page.parents[k]]
    within = inside[element]
    if main < 0 or page.names[main] in ("html", "body"):
        # The whole page is no place of its own: in it only content counts, and headings next to it.
        within &= np.array([e >= 0 and page.names[e] in HEADINGS for e in element])
        floor = 0.0
    else:
        floor = INSIDE * np.array(page.weights)[of]
    keep = np.where(within, np.maximum(own, floor) >= low * best, chosen)
    return [b[2] for b, k in zip(page.blocks, keep, strict=True) if k]


def main_text(page: str | None) -> str:
    return "\n".join(content(Page(page))) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    Null and empty pages and pages without main text give an empty text; broken markup is
    read as far as it goes; repeated rows are all kept; long and deeply nested pages are read
    whole, in time that grows with their length; other columns are ignored; an empty table
    gives no rows.
    """
    names = ["page_id", "url", "text", "n_chars"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names)

    return pages.select(pages[id_col].cast("long"), pages[url_col].cast("string"), pages[html_col]).mapInArrow(task, "page_id long, url string, text string, n_chars long")
