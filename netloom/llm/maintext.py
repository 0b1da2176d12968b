"""Main text of web pages by scoring the element tree.

Each paragraph has points for its length and commas, less the share of it that stands in links. It passes them to the
element around it, half to the next one out, a sixth to the third, and two thirds of the step before to each beyond. The element with the most points, less its own
share of links, is the container; it stands for the ``article`` or ``main`` around it if there is one. Siblings that
score well or look like paragraphs are kept with it. Menus, headers, footers, asides, notices, adverts, forms, scripts
and reader comments are known by tag, role or by a word of their class or id, and never count.

Character references are decoded; white space inside a block becomes one space; blocks are joined in page order by one
space. Defined results: null or empty html gives an empty text, as does a page without any text to keep; equal scores go
to the element that opens first; text outside any element counts as text of the page's root. Broken markup is read as
browsers do it as far as needed: open paragraphs and list items end where the next begins, stray end tags are skipped,
an unclosed comment or script runs to the end. Nesting may be of any depth: the work grows with the page alone. Repeated rows get equal texts. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|</[^>]*+>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|href)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
SKIPPED = frozenset("nav header footer aside form script style noscript iframe template svg math canvas button select textarea input label dialog object head title menu audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label button img".split())
PARAGRAPH = frozenset("p pre td th li dd dt h1 h2 h3 h4 h5 h6 blockquote".split())
LISTS = frozenset("ul ol dl table div section".split())
CONTAINERS = frozenset(("article", "main"))
JUNK = frozenset((
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu sidebar footer header masthead "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social "
    "related recommended recommendations comment comments commentlist respond replies reply disqus breadcrumb breadcrumbs pagination pager toolbar widget "
    "login search disclaimer copyright").split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: An element that opens closes an open one of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
LEAST_POINTS, SIBLING_SHARE, LINK_SHARE = 25, 0.2, 0.7


@dataclass
class Tree:
    """Elements by number, in the order in which they open; the root is 0."""

    tag: list[str] = field(default_factory=lambda: ["html"])
    parent: list[int] = field(default_factory=lambda: [-1])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters in links


def _is_junk(rest: str) -> bool:
    """Whether attributes tell of an element that is no part of the article."""
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            if name != "hidden" or rest[m.start() - 1 : m.start()].isspace():
                return True
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name == "role":
            if value.strip().lower() in ROLES:
                return True
        elif name in ("class", "id"):
            for part in value.split():
                words = [w.lower() for w in WORD.findall(part)]
                if JUNK.intersection(words) and not {"has", "with", "no", "without"}.intersection(words):
                    return True
    return False


def parse(page: str) -> Tree:
    tree = Tree()
    stack: list[tuple[str, int, bool, bool]] = [("html", 0, False, False)]  # tag, element, skipped, in a link
    places: dict[str, list[int]] = {}  # depths of the open elements of each tag
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                tree.blocks.append((stack[-1][1], text, min(linked, len(text))))
            buffer.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not stack[-1][2]:
            text = html.unescape(text)
            buffer.append(text)
            if stack[-1][3]:
                linked += len(text.strip())

    def cut(depth: int) -> None:
        for entry in stack[depth:]:
            places[entry[0]].pop()
        del stack[depth:]

    def nearest(tags: Iterable[str]) -> int:
        """Depth of the innermost open element of these tags, 0 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        low = page.find("<", at)
        if low < 0:
            break
        unended = low > last and page.startswith("</", low) and not re.match("[a-zA-Z]", page[low + 2 : low + 3])
        m = None if unended else TOKEN.match(page, low)
        if not m:  # a bare "<"
            say(page[at : low + 1])
            at = low + 1
            continue
        say(page[at:low])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if tag == "br":
                flush()
            depth = nearest((tag,))
            if depth:
                if any(entry[0] not in INLINE for entry in stack[depth:]):
                    flush()
                cut(depth)
            continue
        if tag in ("br", "hr"):
            flush()
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            if tag not in INLINE:
                flush()
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in ("html", "body") and len(stack) == 1:
            continue
        block = tag not in INLINE
        if block:
            flush()
            closed, scope = CLOSES.get(tag, set()), SCOPES.get(tag, set())
            if tag not in SCOPES:
                closed, scope = {"p"}, {"td", "th", "li", "article", "section", "div", "blockquote", "button", "table"}
            depth = nearest(closed)
            if depth > nearest(scope):
                cut(depth)
        rest = m["rest"] or ""
        _, above, skipped, in_link = stack[-1]
        if not skipped:
            skipped = tag in SKIPPED or bool(rest) and tag not in ("html", "body", *CONTAINERS) and _is_junk(rest)
        element = above
        if block:
            element = len(tree.tag)
            tree.tag.append(tag)
            tree.parent.append(above)
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, element, skipped, in_link or tag == "a"))
    say(page[at:])
    flush()
    return tree


def _best(tree: Tree) -> tuple[set[int], list[float], list[float]]:
    """Elements whose contents are kept, scores, and link shares."""
    n = len(tree.tag)
    own, near, far, length, links = [0.0] * n, [0.0] * n, [0.0] * n, [0] * n, [0] * n
    for element, text, linked in tree.blocks:
        length[element] += len(text)
        links[element] += linked
        value = (1 + text.count(",") + min(len(text) / 100, 3)) if len(text) >= LEAST_POINTS else len(text) / LEAST_POINTS
        value *= 1 - linked / len(text)
        own[tree.parent[element] if tree.tag[element] in PARAGRAPH and element else element] += value
    for e in range(n - 1, 0, -1):  # an element comes after those around it
        around = tree.parent[e]
        length[around] += length[e]
        links[around] += links[e]
        near[around] += own[e]
        far[around] += near[e] / 6 + far[e] * 2 / 3
    points = [a + b / 2 + c for a, b, c in zip(own, near, far)]
    share = [a / b if b else 0.0 for a, b in zip(links, length)]
    score = [p * (1 - s) for p, s in zip(points, share)]
    top = max(range(n), key=lambda e: (score[e], -e))
    out = top
    while out >= 0 and tree.tag[out] not in CONTAINERS:
        out = tree.parent[out]
    if out >= 0:
        score[out] = max(score[out], score[top])
        top = out
    kept = {top}
    if top:
        for e in range(1, n):
            if e != top and tree.parent[e] == tree.parent[top] and length[e]:
                paragraph = tree.tag[e] == "p" and length[e] > 80 and share[e] < 0.25 and out < 0
                if paragraph or score[e] >= SIBLING_SHARE * score[top] and share[e] < 0.5:
                    kept.add(e)
    return kept, score, share


def main_text(page: str | None) -> str:
    tree = parse(page or "")
    if not tree.blocks:
        return ""
    kept, _, share = _best(tree)
    inside = [False] * len(tree.tag)
    for e in range(len(tree.tag)):
        above = tree.parent[e]
        inside[e] = e in kept or above >= 0 and inside[above]
        if inside[e] and e not in kept and tree.tag[e] in LISTS and share[e] > LINK_SHARE:
            inside[e] = False
    return " ".join(text for e, text, _ in tree.blocks if inside[e])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
