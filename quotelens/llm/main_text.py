"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks of text, each with the path of tags from the root to it. For every distinct path the text length
and the punctuation of its blocks are summed up and divided by the number of blocks; both ratios are smoothed over the
blocks in page order and fused. A class or id whose words mark boilerplate lowers the score of its paths by a factor; it
never decides alone. Blocks on paths above the threshold are content. The smallest element that holds all of them, widened
to the article or main element around it, is the content root: its other blocks without such a mark (headings, short
paragraphs, lists, quotes, cells) belong to the text as well, unless all of a block is link text. What HTML itself declares
to be no content (elements, roles, hidden parts) is left out everywhere.

Null and empty html give empty text. Pages are independent; whole pages are read whatever their length or nesting, in time
that grows with the page alone. Broken markup is read as browsers do in the main: missing end tags are implied, stray ones
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNCLOSED = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
TOKEN = re.compile(UNCLOSED.pattern + r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<odd_end>/?)(?P<odd>[a-zA-Z][^\s/>]*)(?P<odd_rest>[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")

INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never content.
OUTSIDE = set("head nav aside footer form dialog menu template noscript button select option datalist svg canvas object video audio map script style textarea title iframe".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words in a class or id that mark boilerplate; those of them that also name parts of articles; words that say nothing; words that mark a container of content.
HINTS = set("ad ads adsense advert advertisement adverts banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus footer form forms gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promos promoted promotion recommended related replies reply responses share sharing sidebar signup social sponsor sponsored sponsors subscribe subscription teaser toolbar widget widgets".split())
DOUBTFUL = set("discussion form forms menu menus notice notices recommended related responses social".split())
NEUTRAL = set("area bar block body bottom box button center col column container fixed inner item items left line links list main middle outer page panel right row section side site sticky text top unit wrap wrapper".split())
CONTAINERS = set("article content entry main post story".split())
#: An open element of the second kind ends where one of the first kind starts.
BLOCKS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}

#: Share of the mean score that a path must reach, reach of the smoothing in blocks.
THRESHOLD, REACH = 0.5, 2
#: Factor by which a mark lowers the score of the paths below it; inside a container a doubtful mark counts less.
MARKED, DOUBTED = 0.1, 0.6


def mark_of(token: str) -> float:
    """The factor of a class or an id: a mark has a boilerplate word and none that says anything else."""
    words = {w.lower() for w in WORDS.findall(token)}
    telling = {w for w in words if w not in NEUTRAL and not w.isdigit() and w not in CONTAINERS}
    if not telling or words & (CONTAINERS - NEUTRAL) or not telling <= HINTS:
        return 1.0
    return DOUBTED if telling <= DOUBTFUL else MARKED


class Element:
    """number: place among the page's elements; path: number of its tag path; block: the innermost element that is not inline."""

    __slots__ = ("name", "parent", "number", "depth", "path", "outside", "container", "inside", "factor", "block")

    def __init__(self, name: str, parent: Element | None, attributes: str, number: int, paths: dict):
        self.name, self.parent, self.number, self.depth = name, parent, number, parent.depth + 1 if parent else 0
        words: list[str] = []
        tokens: list[str] = []
        role, hidden = "", False
        if attributes and not attributes.isspace():
            for key, *values in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), unescape("".join(values))
                if key in ("class", "id"):
                    tokens += value.split()
                elif key == "role":
                    role = value.strip().lower()
                hidden = hidden or key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I) is not None
            words = sorted({w.lower() for t in tokens for w in WORDS.findall(t)})
        above = parent is not None and parent.inside
        self.container = name in ("article", "main") or role in ("main", "article") or not CONTAINERS.isdisjoint(words)
        own = name in OUTSIDE or hidden or role in ROLES
        if (name == "header" or "header" in words) and not above and not self.container:
            own = True
        self.inside = above or self.container
        self.outside = own or (parent is not None and parent.outside)
        mark = 1.0
        if tokens and name not in ("html", "body", "article", "main") and not (above and name in HEADINGS):
            mark = min(map(mark_of, tokens))
        self.factor = (parent.factor if parent else 1.0) * (mark if above or mark != DOUBTED else MARKED)
        self.path = paths.setdefault((parent.path if parent else -1, name, *words), len(paths))
        self.block = parent.block if name in INLINE and parent else self


class Open:
    """The stack of open elements, and where in it the elements of each name are."""

    def __init__(self):
        self.paths: dict = {}
        self.count = 1
        self.stack = [Element("", None, "", 0, self.paths)]
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, name: str, attributes: str) -> None:
        self.places[name].append(len(self.stack))
        self.stack.append(Element(name, self.stack[-1], attributes, self.count, self.paths))
        self.count += 1

    def close(self, k: int) -> None:
        while len(self.stack) > k:
            self.places[self.stack.pop().name].pop()

    def last(self, names) -> int:
        """Place of the innermost open element with one of the names, 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def end(self, name: str) -> None:
        """An end tag closes its element and all in it; that of an inline element does not reach out of a block."""
        k = self.last([name])
        if k and not (name in INLINE and self.stack[k].block is not self.stack[-1].block):
            self.close(k)

    def imply(self, name: str) -> None:
        """Closes what ends where an element of this name starts."""
        if name in BLOCKS and self.stack[-1].block.name == "p":
            self.close(self.last(["p"]))
        if name in IMPLIED:
            ended, limits = IMPLIED[name]
            limit = self.last(limits)
            first = [x[bisect_right(x, limit)] for n in ended if (x := self.places.get(n)) and x[-1] > limit]
            if first:
                self.close(min(first))


def blocks_of(html: str) -> list[tuple[Element, str, bool]]:
    """(element, text, whether all of it is link text) of every block in page order, boilerplate elements included."""
    tree, out, parts, at, size = Open(), [], [], 0, len(html)
    linked, lower, last = True, None, html.rfind(">")

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((tree.stack[-1].block, text, linked))
            parts.clear()
        linked = True

    while at < size:
        # behind the last bracket only a comment or declaration that is never closed can begin
        m = (TOKEN if at <= last else UNCLOSED).search(html, at)
        text = html[at : m.start() if m else size]
        if text:
            parts.append(text)
            linked = linked and (bool(tree.places.get("a")) or text.isspace())
        if not m:
            break
        at = m.end()
        name = (m.group("name") or m.group("odd") or "").lower() if m.re is TOKEN else ""
        if not name:
            continue
        if name not in INLINE:
            flush()
        if m.group("end") or m.group("odd_end"):
            tree.end(name)
            continue
        tree.imply(name)
        attributes = m.group("rest") if m.group("name") else m.group("odd_rest")
        if name in VOID or attributes.endswith("/") and name not in INLINE and name not in BLOCKS and name not in RAW:
            continue
        if name in RAW:
            lower = lower if lower is not None else html.lower()
            at = lower.find("</" + name, at)
            at = size if at < 0 else at
            continue
        tree.push(name, attributes)
    flush()
    return out


def fused_ratios(blocks: list[tuple[Element, str, bool]]) -> np.ndarray:
    """For each block the fused, smoothed ratios of its path; blocks of links alone form paths of their own."""
    keys = [(e.path, links) for e, _, links in blocks]
    sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0])
    for key, (_, text, _) in zip(keys, blocks, strict=True):
        s = sums[key]
        s[0] += len(text)
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += 1
    ratios = np.array([[sums[k][0] / sums[k][2], sums[k][1] / sums[k][2]] for k in keys])
    weights = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / max(1, REACH / 2)) ** 2)
    norm = np.convolve(np.ones(len(keys)), weights)[REACH:-REACH]
    smooth = [np.convolve(ratios[:, i], weights)[REACH:-REACH] / norm for i in (0, 1)]
    own = np.sqrt(ratios[:, 0] * (1 + ratios[:, 1]))
    near = np.sqrt(smooth[0] * (1 + smooth[1]))
    fused = np.sqrt(own * near)
    paths: dict[tuple, list[float]] = defaultdict(list)
    for key, value in zip(keys, fused.tolist(), strict=True):
        paths[key].append(value)
    means = {key: sum(v) / len(v) for key, v in paths.items()}
    return np.array([means[k] for k in keys])


def main_text(html: str | None, threshold: float = THRESHOLD) -> str:
    blocks = [b for b in blocks_of(html or "") if not b[0].outside]
    if not blocks:
        return ""
    factors = np.array([e.factor for e, _, _ in blocks])
    score = fused_ratios(blocks) * factors
    sizes = np.array([len(t) for _, t, _ in blocks])
    weights = sizes * factors  # marked text says little about how content looks here
    content = score >= threshold * float((score * weights).sum() / weights.sum())
    # elements above content, inner ones (with larger numbers) first: how many content blocks each of them holds
    elements: dict[int, Element] = {}
    holds: dict[int, int] = defaultdict(int)
    for (element, _, _), good in zip(blocks, content.tolist(), strict=True):
        e: Element | None = element
        while e is not None and e.number not in elements:
            elements[e.number] = e
            e = e.parent
        holds[element.number] += good
    order = sorted(elements, reverse=True)
    for number in order:
        if (parent := elements[number].parent) is not None:
            holds[parent.number] += holds[number]
    found = int(content.sum())
    root = max((elements[n] for n in order if holds[n] == found), key=lambda e: e.depth)
    e, widened = root, None
    while e is not None:
        widened = e if e.container else widened
        e = e.parent
    root = widened or root
    if not root.container and root.name == "p":
        root = root.parent
    under: dict[int, bool] = {}
    for number in reversed(order):
        e = elements[number]
        under[number] = e is root or (e.parent is not None and under[e.parent.number])
    weak = [under[e.number] and not links and e.factor == root.factor for e, _, links in blocks]
    return " ".join(t for (_, t, _), good, w in zip(blocks, content.tolist(), weak, strict=True) if good or w)


def extract(pages: DataFrame, html: str = "html", to: str = "text") -> DataFrame:
    """Replaces html by the main text of each page; other columns stay."""
    rest = [c for c in pages.columns if c not in (html, to)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column(html)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), texts], names=[*rest, to])

    schema = ", ".join([*([pages.select(rest)._jdf.schema().toDDL()] if rest else []), f"`{to}` STRING"])
    return pages.select(*rest, html).mapInArrow(run, schema)


def tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
