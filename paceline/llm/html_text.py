"""Main text of web pages, by tag-path ratios.

A page is a list of blocks, each with its root-to-leaf path of tags (classes
included).  Over every path, text length and punctuation are summed up and divided
by its blocks; both ratios are smoothed along the page, fused by their product and
compared with a threshold that follows the page's spread.  The paths that pass are
content nodes, on every page.  They are grouped by the innermost article or main
around them; what stands in the deepest element around a group's nodes belongs to the
text too, so headings, lists and short paragraphs stay, and an article without content
nodes (a teaser) gives nothing.  Navigation, forms and the like never belong to it, by
tag.  A class word (advert, comments, sidebar) takes an element out as well, but never
html, body or one that holds most of the text.

Defined results: null and empty pages give an empty text; a comment or script that is
not closed ends with the page, and so does a tag; after a tag with a quote that is not
closed, tags of that page end at their first >; repeated rows are judged each; other
columns are not read.  Time and memory follow the length of a page, however deep its
elements lie.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column

_OPEN = re.compile(r"<(?:!--|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "svg", "iframe")}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
BOILERPLATE = frozenset("nav footer aside form button select option head title dialog menu object canvas".split())
#: Words in a class, id or role that mark something other than the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice pagination popup promo promoted promotion respond sidebar signup sponsor sponsored subscribe".split()
)
#: Words that mark it only where links make up half of the text or more (related posts, not related work).
LINK_MARKS = frozenset("related search share sharing social toolbar widget".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CONTAINERS = frozenset("article main".split())


@dataclass(frozen=True)
class TagPaths:
    smooth: tuple[float, ...] = (0.25, 0.5, 0.25)
    spread: float = 0.5  # the threshold: this many standard deviations, at most the mean
    article: float = 4.0  # text in an article weighs so much against a marked element elsewhere


@dataclass(eq=False)
class _Node:
    tag: str
    path: int  # number of the path from the root to here
    boilerplate: bool  # by its tag or that of an element around it
    marked: int  # by a word of its own class, id or role: 2, or 1 if links have to bear it out
    unit: _Node | None  # the innermost article or main that it is or lies in
    parent: _Node | None
    first: int  # its place among the elements of the page
    last: int = 0  # that of the last element inside it


@dataclass
class _Block:
    node: _Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of each piece of a page; kind is text, open, close or gap.

    Every character is passed over a fixed number of times: a search that has run to the
    end of the page without a result is not made again.
    """
    at = found = 0
    quotes = True
    while (m := _OPEN.search(page, found)) is not None:
        end = None
        tag = m[3].lower() if m[3] else None
        if m[0] == "<!--":
            k = page.find("-->", m.end())
            end = k + 3 if k >= 0 else len(page)
        else:
            if tag is not None and quotes:
                t = _TAG_END.match(page, m.end())
                end = t.end() if t else None
                quotes = t is not None
            if end is None:
                k = page.find(">", m.end())
                end = k + 1 if k >= 0 else len(page)
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = found = end
        if tag is None:
            continue
        if tag in _RAW and not m[2]:
            t = _RAW[tag].search(page, end)
            at = found = t.end() if t else len(page)
            yield "gap", tag, ""
        else:
            yield "close" if m[2] else "open", tag, page[m.end() : end - 1]
    if at < len(page):
        yield "text", page[at:], ""


def blocks(page: str) -> list[tuple[_Node, str, int]]:
    """(node, text, characters of it inside links) of each block with text, in page order."""
    node = root = _Node("", 0, False, 0, None, None, 0)
    nodes, paths, out = [root], {}, []
    opened: dict[str, int] = {}
    block = _Block(node)
    link = 0

    def done():
        text = " ".join(entities.unescape("".join(block.parts)).split())
        if text:
            out.append((block.node, text, block.linked))

    for kind, tag, more in tokens(page):
        if kind == "text":
            block.parts.append(tag)
            block.linked += link * len(tag)
            continue
        if kind == "gap":
            block.parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                link = int(kind == "open")
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img", "input", "wbr"):
                block.parts.append(" " if tag != "wbr" else "")
            continue
        done()
        if kind == "close":
            if opened.get(tag):
                up = node
                while up.tag != tag:
                    opened[up.tag] -= 1
                    up = up.parent
                opened[tag] -= 1
                node = up.parent
        else:
            closes = _CLOSES.get(tag, {"p"})
            while node.tag in closes:
                opened[node.tag] -= 1
                node = node.parent
            names = [x for y in _NAMES.findall(more) for x in y if x]
            words = {w for x in names for w in re.split(r"[^a-z0-9]+", x.lower())}
            bad = node.boilerplate or tag in BOILERPLATE or (tag == "header" and node.unit is None)
            mark = 0 if tag in ("html", "body") else 2 if words & MARKS else int(bool(words & LINK_MARKS))
            path = paths.setdefault((node.path, tag + "".join("." + x for x in names)), len(paths) + 1)
            node = _Node(tag, path, bad, mark, node.unit, node, len(nodes))
            nodes.append(node)
            opened[tag] = opened.get(tag, 0) + 1
            if tag in _CONTAINERS:
                node.unit = node
        block, link = _Block(node), 0
    done()
    for n in nodes:
        n.last = max(n.last, n.first)
    for n in reversed(nodes[1:]):
        n.parent.last = max(n.parent.last, n.last)
    return out


def _unmarked(found: list[tuple[_Node, str, int]], params: TagPaths) -> list[tuple[_Node, str, int]]:
    """The blocks that no class word takes out.

    A word doesn't count on an element that holds most of the text, unless articles
    elsewhere weigh it up; a single block (an advert beside a short article) has to be
    on its own for that.
    """
    # Text, text in articles, blocks and text in links of each element, summed up from its last element to the first.
    sums: dict[int, list[int]] = {}
    nodes: dict[int, _Node] = {}
    for n, text, linked in found:
        s = sums.setdefault(n.first, [0, 0, 0, 0])
        s[0] += len(text)
        s[1] += len(text) * (n.unit is not None)
        s[2] += 1
        s[3] += linked
        while n is not None and n.first not in nodes:
            nodes[n.first] = n
            n = n.parent
    order = sorted(nodes, reverse=True)
    if not any(nodes[k].marked for k in order):
        return found
    for k in order:
        if (up := nodes[k].parent) is not None and k in sums:
            for i, x in enumerate(sums[k]):
                sums.setdefault(up.first, [0, 0, 0, 0])[i] += x
    whole, in_units = sums[0][:2]
    gone = {}
    for k in reversed(order):  # from the root down
        n = nodes[k]
        mass, units, several, linked = sums[k]
        elsewhere = in_units - units
        bad = (n.marked == 2 or n.marked == 1 and 2 * linked >= mass) and (2 * mass <= whole or elsewhere > 0 and (several == 1 or mass <= params.article * elsewhere))
        gone[k] = bad or (n.parent is not None and gone[n.parent.first])
    return [x for x in found if not gone[x[0].first]]


def main_text(page: str | None, params: TagPaths = TagPaths()) -> str:
    found = _unmarked([x for x in blocks(page or "") if not x[0].boilerplate], params)
    if not found:
        return ""
    paths = [n.path for n, _, _ in found]
    sums: dict[int, list[float]] = {}
    for path, (_, text, linked) in zip(paths, found, strict=True):
        s = sums.setdefault(path, [0, 0, 0])
        s[0] += max(len(text) - linked, 0)
        s[1] += len(_PUNCTUATION.findall(text))
        s[2] += 1
    length = _smooth([sums[x][0] / sums[x][2] for x in paths], params.smooth)
    marks = _smooth([sums[x][1] / sums[x][2] for x in paths], params.smooth)
    fused = [a * (1 + b) for a, b in zip(length, marks, strict=True)]
    best: dict[int, float] = {}
    for path, x in zip(paths, fused, strict=True):
        best[path] = max(best.get(path, 0), x)
    mean = sum(fused) / len(fused)
    limit = min(params.spread * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused)), mean)
    groups: dict[int, list[_Node]] = {}
    weight: dict[int, float] = {}
    taken = [best[path] >= limit and best[path] > 0 for path in paths]
    for yes, x, (n, _, _) in zip(taken, fused, found, strict=True):
        if yes:
            groups.setdefault(id(n.unit), []).append(n)
            weight[id(n.unit)] = weight.get(id(n.unit), 0) + x
    # Outside articles the nodes bring the element around them only if they are most of the content.
    tops = {k: _top(g) for k, g in groups.items() if k != id(None) or 2 * weight[k] > sum(weight.values())}
    keep = []
    for yes, (n, text, _) in zip(taken, found, strict=True):
        k = id(n.unit)
        if yes or (k in tops and _inside(n, tops[k])) or (n.tag == "h1" and n.unit is not None and k in groups):
            keep.append(text)
    return "\n".join(keep)


def _top(nodes: list[_Node]) -> _Node:
    """The deepest element around the nodes, and around paragraphs."""
    lo, hi = min(nodes, key=lambda n: n.first), max(n.first for n in nodes)
    top = lo.parent or lo
    while top.parent is not None and (top.last < hi or top.tag == "p"):
        top = top.parent
    return top


def _smooth(x: list[float], kernel: tuple[float, ...]) -> list[float]:
    half, n = len(kernel) // 2, len(x)
    return [sum(k * x[min(max(i + j - half, 0), n - 1)] for j, k in enumerate(kernel)) for i in range(n)]


def _inside(n: _Node, top: _Node) -> bool:
    return top.first <= n.first <= top.last


def extract(pages: DataFrame, params: TagPaths = TagPaths()) -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                text = [main_text((x or b"").decode("utf-8", "replace"), params) for x in column(part, "html").to_pylist()]
                yield pa.RecordBatch.from_arrays([column(part, "page_id"), column(part, "url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
