"""Main text of web pages by tag-path ratios.

A page is cut into blocks, each with its root-to-leaf path of block tags (with
class and id). Per path the text length and the punctuation marks are added up
and divided by the number of blocks; both ratios are smoothed over neighbouring
paths, weighted by how much the paths share, and fused. Paths over the threshold
carry the content; the article is the smallest container around all their weight.
Where only the page itself holds all of it, the container around most of the weight,
the other parts of the page with content, and headings are kept.

Names only settle what ratios can't tell: menus, adverts, notices, sidebars and readers'
comments may read like an article, so tags, roles and names that say so take a
block out. Names that an article's own parts have as well (legal, tags, search ...) take
out only what the ratios, too, find without content, or what stands outside the
container. Blocks that mostly hold link text count as content where they carry as much
punctuation as prose, as references do; menus carry none. Inline elements
with such a name stay where text goes on behind them.

Of an article's own header the headings stay and the rest (bylines, dates) goes, as do
forms and fieldsets and what is named as a reply.

Nulls and pages without content give an empty string.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_map

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title noscript template svg math iframe object canvas select option button xmp noembed noframes".split()
BLOCK = frozenset("""html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure
figcaption nav header footer aside form fieldset address details summary hgroup dialog center menu search""".split())
CLOSES_P = BLOCK - frozenset("html body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that end an open element of the same kind inside the given containers.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog head search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar note".split())
#: Words of class and id names that mark what is not the article.
BOILERPLATE_WORDS = frozenset("""ad ads advert adverts advertisement advertisements advertising adbox adslot adunit sponsor sponsored promo promos promotion banner banners nav navbar
navigation menu menus topbar toolbar breadcrumb breadcrumbs crumbs header masthead footer foot sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice
notices alert alerts popup modal overlay dialog lightbox newsletter subscribe subscription signup login register search share sharing social follow comment comments
disqus reply replies responses discussion related recommended recommendations trending pager pagination paging skip byline tags taglist tracking disclaimer legal
copyright hidden""".split())
#: Those of them that parts of an article have as well.
WEAK_WORDS = frozenset("legal copyright disclaimer tags search tracking notice notices alert alerts note responses discussion social follow register header foot banner skip".split())
#: Words that say nothing of what an element holds.
NEUTRAL_WORDS = frozenset("list section box container wrapper wrap block area inner outer item items bar links link site page top bottom left right global js is has the of and slot unit col row".split())
CONTENT_WORDS = frozenset("article content main post entry story body text".split())

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDES = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"[\s​]+")
MARK = re.compile(r"[.,;:!?…、。，！？]")
#: Share of the fused weight that the article's main container must hold.
CONTAINER_SHARE = 0.6
#: Marks in a block of links from which on it reads like prose.
PROSE_MARKS = 3
#: Part of the best content path's ratio from which on a path reads like content.
PROSE_SHARE = 0.25
#: What names say of an element: nothing, boilerplate unless the ratios say otherwise, boilerplate.
PLAIN, WEAK, STRONG = 0, 1, 2


class _Node:
    __slots__ = ("tag", "label", "parent", "boiler", "number")

    def __init__(self, tag, label, parent, boiler, number):
        self.tag, self.label, self.parent, self.boiler, self.number = tag, label, parent, boiler, number


def _named(value: str) -> int:
    """What the names of a class or id attribute say; boilerplate words must make up half of a name's telling words."""
    found = PLAIN
    for name in value.split():
        words = [w.lower() for w in WORDS.findall(name) if not w.isdigit()]
        telling = [w for w in words if w not in NEUTRAL_WORDS]
        boiler = [w for w in telling if w in BOILERPLATE_WORDS]
        if boiler and 2 * len(boiler) >= len(telling):
            found = max(found, WEAK if all(w in WEAK_WORDS for w in boiler) else STRONG)
    return found


def _describe(tag: str, attributes: str) -> tuple[str, int]:
    """The label of an element in paths, and what it says of its content."""
    label, boiler = tag, STRONG if tag in BOILERPLATE_TAGS else PLAIN
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), entities.unescape(value.strip("\"'"))
            if name == "role":
                boiler = STRONG if value.lower() in ROLES else boiler
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                boiler = STRONG
            elif name == "style":
                boiler = STRONG if "display:none" in value.replace(" ", "").lower() else boiler
            elif name in ("class", "id"):
                words = {w.lower() for w in WORDS.findall(value)}
                label += ("." if name == "class" else "#") + value
                if tag not in ("html", "body", "main", "article") and not words & CONTENT_WORDS - {"text", "body"}:
                    boiler = max(boiler, _named(value))
                if words & {"comment", "comments"} and tag not in ("html", "body", "main"):
                    boiler = STRONG
    return label, boiler


def blocks(html: str) -> list[tuple[_Node, str, int]]:
    """Blocks of a page in order: element, text with white space folded, characters inside links."""
    root = _Node("", "", None, PLAIN, 0)
    stack, out, piece, made = [root], [], [], 1
    owner, linked, links = root, 0, 0

    def flush():
        nonlocal piece, linked
        if piece:
            text = SPACE.sub(" ", "".join(piece)).strip()
            if text:
                out.append((owner, text, min(linked, len(text))))
        piece, linked = [], 0

    at, size = 0, len(html)
    while at < size:
        found = TOKEN.search(html, at)
        start = found.start() if found else size
        if start > at:
            text = entities.unescape(html[at:start])
            piece.append(text)
            if links:
                linked += len(text)
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                piece.append(found[0][9:-3])
            continue
        tag = tag.lower()
        if found[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        flush()
                        del stack[k:]
                        owner = stack[-1]
                        links = 0
                        break
                else:
                    if tag == "p":
                        flush()
            continue
        attributes = found[3]
        if tag in RAW_END:
            if not attributes.endswith("/"):
                end = RAW_END[tag].search(html, at)
                at = end.end() if end else size
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush() if tag == "hr" else piece.append(" ")
            continue
        if tag == "a":
            links += 1
        if tag not in BLOCK:
            label, boiler = _describe(tag, attributes)
            if boiler and not attributes.endswith("/"):  # an inline element that names boilerplate: leave its text out
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                if end and "".join(piece).strip() and html[end.end():end.end() + 2].strip()[:1] not in ("", "<") and not HIDES.search(attributes):
                    continue  # text before and behind it: a part of the sentence
                if end and not re.search(rf"<{re.escape(tag)}\b", html[at:end.start()], re.I):
                    at = end.end()
                    links -= tag == "a"
            continue
        flush()
        links = 0
        if tag in CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        if tag in ENDS:
            same, within = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in within:
                    break
                if stack[k].tag in same:
                    del stack[k:]
                    break
        label, boiler = _describe(tag, attributes)
        parent = stack[-1]
        if tag == "header" and any(n.tag in ("article", "main") for n in stack) and not any(n.boiler for n in stack):
            boiler = PLAIN  # an article's own head: its headings belong to the text, the rest is left out below
        owner = _Node(tag, label, parent, max(boiler, parent.boiler), made)
        made += 1
        stack.append(owner)
    flush()
    return out


def _path(node: _Node) -> tuple[str, ...]:
    labels = []
    while node.parent is not None:
        labels.append(node.label)
        node = node.parent
    return tuple(reversed(labels))


def _shared(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    return 2.0 * same / max(len(a) + len(b), 1)


def path_ratios(found: list[tuple[tuple[str, ...], int, int, int, bool]], reach: int = 3) -> dict[tuple[str, ...], tuple[float, float, int]]:
    """(own, smoothed, blocks) of each path; found: path, length, marks, linked, boilerplate per block.

    Both are the geometric mean of text length and punctuation a block: of the
    path itself, and smoothed over its neighbours by how much the paths share.
    """
    totals: dict[tuple[str, ...], list[float]] = {}
    for path, length, marks, linked, boiler in found:
        row = totals.setdefault(path, [0, 0, 0, 0])
        row[0] += 0 if boiler else length
        row[1] += 0 if boiler else marks
        row[2] += linked
        row[3] += 1
    paths = list(totals)
    values = np.array([totals[p] for p in paths], dtype=float)
    text, marks, linked, count = values.T
    own = np.where((linked <= 0.5 * np.maximum(text, 1)) | (marks >= PROSE_MARKS * count), 1.0, 0.0)
    ratios = np.stack([own * text / count, own * (marks + 0.5 * (text > 0)) / count])
    smooth = np.zeros_like(ratios)
    for i, path in enumerate(paths):
        near = range(max(0, i - reach), min(len(paths), i + reach + 1))
        weight = np.array([np.exp(-0.5 * (i - j) ** 2) * _shared(path, paths[j]) if j != i else 1.0 for j in near])
        smooth[:, i] = (ratios[:, list(near)] * weight).sum(1) / weight.sum()
    fused = [np.sqrt(r[0] * r[1]) * (text > 0) for r in (ratios, smooth)]
    return {p: (float(a), float(b), int(n)) for p, a, b, n in zip(paths, *fused, count)}


def path_weights(ratios: dict[tuple[str, ...], tuple[float, float, int]]) -> dict[tuple[str, ...], float]:
    """Smoothed ratio times blocks of each path over the threshold."""
    fused = np.array([smooth * blocks for _, smooth, blocks in ratios.values()])
    limit = min(fused.std(), 0.5 * fused.max())
    return {p: float(w) for p, w in zip(ratios, fused) if w > 0 and w >= limit}


def main_text(html: str | None) -> str:
    """The article of one page, one line per block."""
    if not html:
        return ""
    found = blocks(html)
    if not found:
        return ""
    paths = [_path(node) for node, _, _ in found]
    ratios = path_ratios([(p, len(t), len(MARK.findall(t)), linked, n.boiler == STRONG) for p, (n, t, linked) in zip(paths, found)])
    weights = path_weights(ratios)
    if not weights:
        return ""
    # Paths whose blocks, few as they may be, read like those of the content.
    prose = PROSE_SHARE * max((ratios[p][0] for p in weights), default=0.0)
    reads = {p for p, (own, _, _) in ratios.items() if own > 0 and own >= prose}
    # Weight of each block of a content path, added to all elements around it.
    per_path: dict[tuple[str, ...], int] = {}
    for p in paths:
        per_path[p] = per_path.get(p, 0) + 1
    held: dict[int, float] = {}
    nodes: dict[int, _Node] = {}
    total = 0.0
    for p, (node, text, _) in zip(paths, found):
        if node.boiler or p not in weights:
            continue
        share = weights[p] / per_path[p]
        total += share
        while node is not None:
            held[node.number] = held.get(node.number, 0.0) + share
            nodes[node.number] = node
            node = node.parent
    if not total:
        return ""
    named = [n for n in nodes.values() if n.tag in ("article", "main") and held[n.number] >= CONTAINER_SHARE * total]
    inner = [n for n in nodes.values() if held[n.number] >= CONTAINER_SHARE * total and n.tag not in ("p", "li", "td", "th", "tr", "ul", "ol", "pre", "blockquote", "dd", "dl", "figure") and n.tag not in HEADINGS]
    best = max(named or inner or [nodes[0]], key=lambda n: n.number)
    strict = best.tag not in ("article", "main")
    # What holds the whole weight: of the page itself, only its parts with content and its headings belong to the article.
    whole = max((n for n in nodes.values() if held[n.number] >= (1 - 1e-9) * total), key=lambda n: n.number)
    page = whole.tag in ("", "html", "body")
    out = []
    for p, (node, text, linked) in zip(paths, found):
        if node.boiler == STRONG:
            continue
        up, below, inside, around, head = node, node, False, False, False
        while up is not None:
            inside |= up is best
            head |= up.tag == "header"
            if up is whole:
                around = not page or node.tag in HEADINGS or node is whole and p in weights or below is not whole and below.number in held
            below = up
            up = up.parent
        if node.boiler == WEAK and not (inside and p in reads):
            continue
        if (strict or not inside) and linked > 0.5 * len(text) and p not in reads:
            continue
        if (inside or around) and (not head or node.tag in HEADINGS):
            out.append(text)
    return "\n".join(out)


def extract(df: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text) of every row; repeated rows stay repeated."""

    def run(columns):
        return {"page_id": columns["page_id"], "url": columns["url"], "text": [main_text(x) for x in columns["html"]]}

    kinds = [df.schema[c].dataType.simpleString() for c in (id_column, url_column)]
    chosen = df.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    return row_map(chosen, run, f"page_id {kinds[0]}, url {kinds[1]}, text string")
