"""Main text of pages by composite text density.

A page becomes a tree of elements (``parse``), without those that never belong to an
article.  Every element has the density of its text: characters per tag, less the more of
them are links.  The element whose children's densities have the largest sum is the
core of the article.  The least density on the way from it up to ``body`` is the
threshold: what stands beside that way and is as dense belongs to it too.  A marked-up
``article`` (or ``main``) around the core is taken whole, and of what stands beside it only
elements of that name that are as dense.

Defined results: null and empty pages, pages without text, and what is no HTML at all give
an empty text or the plain text there is; unclosed elements end with their parent; null
page_id or url stay null; repeated rows are each extracted; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary
    table tbody td tfoot th thead tr ul caption""".split())
CLOSES_P = BLOCK - set("body html li dd dt td th tr tbody thead tfoot option caption legend summary".split())
SCOPE = set("html body table td th caption button object template article section div ul ol dl blockquote main".split())
# An opening of the first ends an open one of the others, within the nearest of the last.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
        "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}

# What no article holds: by element, by role, and by words of class and id.
NEVER = set("""script style noscript template head title nav header footer aside form button select textarea iframe svg
    canvas object embed dialog menu search audio video map""".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = set("""ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promos promotion banner
    cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar
    sidebars aside widget widgets related recommended recommendations share sharing social nav navbar navigation menu menus
    breadcrumb breadcrumbs toolbar header masthead footer comment comments disqus replies login pagination pager""".split())
KEPT = set("html body article main h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>"""
                 r"""|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?![^\s=/>])\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Tree:
    """Elements in page order; each begins after its parent.  ``parts`` holds texts and, as None, edges of blocks."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    begin: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    parts: list[tuple[int, str] | None] = field(default_factory=list)


def unwanted(tag: str, attributes: str) -> bool:
    if tag in NEVER:
        return True
    if not attributes or attributes.isspace():
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name in ("class", "id") and tag not in KEPT and not NAMES.isdisjoint(w.lower() for w in NAME.findall(value)):
            return True
    return False


def parse(page: str) -> Tree:
    t = Tree(["html"], [-1], [0], [0], [])
    open_ = [0]
    counts: dict[str, int] = {}
    dropped: list[str] = []  # open elements inside an unwanted one, that one first

    def shut(to: int) -> None:
        while len(open_) > to:
            k = open_.pop()
            counts[t.tag[k]] -= 1
            t.end[k] = len(t.parts)
            if t.tag[k] in BLOCK:
                t.parts.append(None)

    def ends(which: set[str], within: set[str]) -> None:
        if any(counts.get(w) for w in which):
            for k in range(len(open_) - 1, 0, -1):
                if t.tag[open_[k]] in which:
                    shut(k)
                elif t.tag[open_[k]] in within:
                    break

    at, last = 0, page.rfind(">")
    while at < len(page):
        # Behind the last ">" only a comment could still begin.
        m = TAG.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        stop = m.start() if m else len(page)
        if stop > at and not dropped:
            t.parts.append((open_[-1], page[at:stop]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if closing:
            if dropped:
                if tag in dropped:
                    while dropped.pop() != tag:
                        pass
                elif tag in ("body", "html", "article", "main") and counts.get(tag):
                    dropped.clear()  # an unclosed unwanted element ends with its parent
            if not dropped and tag not in ("html", "body") and counts.get(tag):
                k = len(open_) - 1
                while t.tag[open_[k]] != tag:
                    k -= 1
                shut(k)
            continue
        empty = tag in VOID
        if tag in RAW:
            close = re.compile(rf"</{tag}(?![^\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            if not dropped and tag not in NEVER:
                t.parts.append((open_[-1], " "))
            continue
        if dropped:
            if tag == "body" or tag in ("article", "main") and dropped[0] == "head":
                dropped.clear()
            else:
                if not empty:
                    dropped.append(tag)
                continue
        if tag in CLOSES_P:
            ends({"p"}, SCOPE)
        if tag in ENDS:
            ends(*ENDS[tag])
        if tag == "html" or tag == "body" and counts.get("body"):
            continue
        if not empty and unwanted(tag, attributes):
            if tag in BLOCK:
                t.parts.append(None)
            dropped.append(tag)
            continue
        t.tag.append(tag)
        t.parent.append(open_[-1])
        t.parts.append(None if tag in BLOCK else (open_[-1], " " if tag == "br" else ""))
        t.begin.append(len(t.parts))
        t.end.append(len(t.parts))
        if not empty:
            open_.append(len(t.tag) - 1)
            counts[tag] = counts.get(tag, 0) + 1
    shut(1)
    t.end[0] = len(t.parts)
    return t


def densities(t: Tree) -> tuple[list[float], list[float], list[int]]:
    """Of every element: composite density, sum of its children's densities, characters."""
    n = len(t.tag)
    chars, tags, link_chars, links = [0] * n, [0] * n, [0] * n, [0] * n
    for part in t.parts:
        if part:
            chars[part[0]] += sum(map(len, part[1].split()))
    for k in range(n - 1, -1, -1):
        if t.tag[k] == "a":
            link_chars[k] = chars[k]
        if k:
            p = t.parent[k]
            chars[p] += chars[k]
            tags[p] += tags[k] + 1
            link_chars[p] += link_chars[k]
            links[p] += links[k] + (t.tag[k] == "a")
    linked = link_chars[0] / max(1, chars[0])
    density = [0.0] * n
    for k in range(n):
        c, lc = chars[k], link_chars[k]
        if c:
            base = math.log(c / max(1, c - lc) * lc + linked * c + math.e)
            ratio = c / max(1, lc) * max(1, tags[k]) / max(1, links[k])
            density[k] = c / max(1, tags[k]) * max(0.0, math.log(max(ratio, 1e-9)) / math.log(base) if base > 1.0000001
                                                   else math.log(max(ratio, 1.0)))
    total = [0.0] * n
    for k in range(1, n):
        total[t.parent[k]] += density[k]
    return density, total, chars


def chosen(t: Tree) -> list[int]:
    """Elements of the article, in page order, none within another."""
    density, total, chars = densities(t)
    core = max(range(len(t.tag)), key=lambda k: total[k])
    if not total[core]:
        return [0]
    way = [core]
    while way[-1]:
        way.append(t.parent[way[-1]])
    marked = next((k for name in ("article", "main") for k in reversed(way) if t.tag[k] == name), None)
    above = set(way[way.index(marked) + 1 :]) if marked is not None else set()
    top = next((i for i, k in enumerate(way) if t.tag[k] == "body"), len(way) - 1)
    way = way[: top + 1]
    threshold = min(density[k] for k in way)
    if marked is not None:
        return [k for k in range(1, len(t.tag)) if k == marked or t.parent[k] in above and t.tag[k] == t.tag[marked] and chars[k]
                and density[k] >= threshold]
    on_way = set(way)
    inside = set(way[1:])
    beside = [k for k in range(1, len(t.tag)) if t.parent[k] in inside and k not in on_way and chars[k] and (
        density[k] >= threshold or t.tag[k] in ("h1", "h2", "h3"))]
    return sorted([core, *beside])


def main_text(page: str | None) -> str:
    if not page:
        return ""
    t = parse(page)
    blocks, held = [], []
    for root in chosen(t):
        for part in [*t.parts[t.begin[root] : t.end[root]], None]:
            if part:
                held.append(part[1])
            elif held:
                block = " ".join(html.unescape("".join(held)).split())
                if block:
                    blocks.append(block)
                held = []
    return "\n\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(map(main_text, batch.column("html").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
