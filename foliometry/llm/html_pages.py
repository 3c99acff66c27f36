"""One HTML page as containers and text blocks, forgiving about missing end tags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
DIGITS = re.compile(r"\d+")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: What HTML says about its elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg annotation annotation-xml object canvas audio video select noframes xmp".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "legend", "li", "dd", "dt", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "summary"}
#: An opening tag ends these open elements, up to the nearest of the others.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

SKIPPED_TAGS = frozenset("nav footer aside form button menu dialog head header label fieldset".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SKIPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner cookie cookies consent gdpr notice notices"
    " popup modal overlay newsletter subscribe subscription signup menu nav navbar navigation breadcrumb breadcrumbs sidebar sidebars footer header masthead"
    " topbar comment comments disqus reply replies respond discussion reactions related recommended recommendations share sharing social toolbar pagination"
    " pager login search disclaimer alert widget widgets aside teaser teasers outbrain taboola".split()
)
#: Of these, the ones that also name parts of an article: they skip only what is mostly links, or lies outside the main container, and no heading.
AMBIGUOUS_WORDS = frozenset("discussion related social share sharing search header notice notices alert".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT_WORDS = frozenset("with without has no not after before".split())
#: A block left outside a container is prose from this many characters outside links on, and a container keeps nearly all with this share.
PROSE_CHARS = 40
KEPT_PERCENT = 90
CONTAINERS = frozenset("article main section div td body center blockquote table tbody tr".split())


@dataclass
class Node:
    parent: int
    tag: str
    path: str
    skipped: bool
    prose: int = 0
    title: bool = False
    doubtful: bool = False
    chars: int = 0
    links: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _unwanted(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in SKIPPED_TAGS and not (tag == "header" and in_article):
        return True
    if attributes.get("role", "").lower() in SKIPPED_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if tag in ("html", "body", "main"):
        return False
    return any(word in SKIPPED_WORDS and word not in AMBIGUOUS_WORDS for word in _outer_words(attributes))


def _outer_words(attributes: dict[str, str]) -> list[str]:
    """The first and the last word of each class and id without a word of KEPT_WORDS."""
    found = []
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = [w.lower() for w in WORDS.findall(name)]
        if parts and not KEPT_WORDS.intersection(parts):
            found += [parts[0], parts[-1]]
    return found


def _doubtful(tag: str, attributes: dict[str, str]) -> bool:
    return tag not in HEADINGS and tag not in ("html", "body", "main", "article") and not AMBIGUOUS_WORDS.isdisjoint(_outer_words(attributes))


def parse(html: str) -> Page:
    """Containers with their generalised tag-class paths and prose (characters outside links), and the wanted blocks in page order.

    Doubtful elements, with an ambiguous word, add no prose to containers; their blocks are dropped where most of their text is in links.
    """
    page = Page([Node(-1, "#", "", False)])
    nodes, lower = page.nodes, None
    stack: list[tuple[str, int, bool]] = [("#", 0, False)]
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text and not stack[-1][2]:
                at = stack[-1][1]
                prose = 0 if nodes[at].doubtful else max(0, len(text) - linked)
                page.blocks.append((at, text, prose))
                while at >= 0:
                    nodes[at].prose += prose
                    nodes[at].chars += len(text)
                    nodes[at].links += min(linked, len(text))
                    at = nodes[at].parent
            parts, linked = [], 0

    def pop(size: int) -> None:
        nonlocal links
        for tag, _, _ in stack[size:]:
            links -= tag == "a"
        del stack[size:]

    def end_open(tags: set[str], stops: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                pop(k)
                return
            if stack[k][0] in stops:
                return

    at = 0
    while True:
        found = TOKEN.search(html, at)
        chunk = html[at : found.start()] if found else html[at:]
        if chunk and not stack[-1][2]:
            parts.append(chunk)
            linked += len(chunk) if links else 0
        if found is None:
            break
        at = found.end()
        tag = found.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if found.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if any(t in BLOCKS for t, _, _ in stack[k:]):
                        flush()
                    pop(k)
                    break
                if tag not in BLOCKS and stack[k][0] in BLOCKS:
                    break
            else:
                if tag in BLOCKS:
                    flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            if not found.group(3).endswith("/"):
                lower = html.lower() if lower is None else lower
                close = lower.find(f"</{tag}", at) if len(lower) == len(html) else (m.start() if (m := re.compile(f"</{tag}", re.I).search(html, at)) else -1)
                end = html.find(">", close) if close >= 0 else -1
                at = len(html) if close < 0 or end < 0 else end + 1
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P:
                end_open({"p"}, BLOCKS - {"p"})
            if tag in ENDS:
                end_open(*ENDS[tag])
        if tag in VOID:
            continue
        raw = found.group(3)
        attributes = {}
        if raw:
            attributes = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(raw)}
            if re.search(r"(^|\s)hidden(\s|$|/)", re.sub(r"""("[^"]*"|'[^']*')""", "", raw)):
                attributes["hidden"] = ""
        _, node, skipped = stack[-1]
        if not skipped and (attributes or tag in SKIPPED_TAGS):
            skipped = _unwanted(tag, attributes, any(t == "article" for t, _, _ in stack))
        doubtful = not skipped and bool(attributes) and _doubtful(tag, attributes)
        if doubtful and tag not in BLOCKS:
            close = html.find(f"</{tag}", at)
            skipped = tag == "a" or links > 0 or re.search("<(a|button)[^a-z]", html[at : close if close >= 0 else at], re.I) is not None
        if tag in BLOCKS:
            classes = sorted({DIGITS.sub("#", c) for c in attributes.get("class", "").split()})
            nodes.append(Node(node, tag, f"{nodes[node].path}>{'.'.join([tag, *classes])}", skipped))
            above, node = node, len(nodes) - 1
            nodes[node].doubtful = doubtful or nodes[above].doubtful and tag not in ("article", "main")
            if tag == "h1" and not skipped:
                up = node
                while up >= 0:
                    nodes[up].title = True
                    up = nodes[up].parent
        links += tag == "a"
        stack.append((tag, node, skipped))
    flush()
    dense = [False] * len(nodes)
    for k, n in enumerate(nodes):
        dense[k] = n.doubtful and (2 * n.links > n.chars or dense[n.parent])
    page.blocks = [b for b in page.blocks if not dense[b[0]]]
    return page


def under(page: Page, roots: set[int]) -> list[bool]:
    """Of each node, whether it is one of these containers or inside one."""
    inside = [False] * len(page.nodes)
    for k, node in enumerate(page.nodes):
        inside[k] = k in roots or node.parent >= 0 and inside[node.parent]
    return inside


def loses_prose(page: Page, whole: int, roots: set[int]) -> bool:
    """Whether the blocks of the container `whole` that are in none of the roots hold a block of prose rather than links, or much prose in all."""
    wanted, kept = under(page, {whole}), under(page, roots)
    outside = [(text, prose) for at, text, prose in page.blocks if wanted[at] and not kept[at]]
    if any(prose >= PROSE_CHARS and 2 * prose > len(text) for text, prose in outside):
        return True
    return 100 * sum(prose for _, prose in outside) > (100 - KEPT_PERCENT) * page.nodes[whole].prose


def best_container(page: Page) -> int:
    """The largest article with a third of the page's prose, else the main element, else the deepest container that loses no prose and keeps the title."""
    nodes = page.nodes
    total = nodes[0].prose
    for tag in ("article", "main"):
        fitting = [k for k, n in enumerate(nodes) if n.tag == tag and not n.skipped and 3 * n.prose >= total and n.prose]
        if fitting:
            return max(fitting, key=lambda k: (nodes[k].prose, -k))
    children: dict[int, list[int]] = {}
    for k, n in enumerate(nodes):
        if n.tag in CONTAINERS or n.tag == "html":
            children.setdefault(n.parent, []).append(k)
    at = 0
    while True:
        best = max(children.get(at, ()), key=lambda k: (nodes[k].prose, -k), default=-1)
        if best < 0 or not nodes[best].prose or nodes[at].title and not nodes[best].title:
            return at
        if nodes[best].prose < nodes[at].prose and loses_prose(page, 0, {best}):
            return at
        at = best


def text_under(page: Page, roots: set[int]) -> str:
    """The wanted blocks inside these containers, in page order."""
    inside = under(page, roots)
    return "\n".join(text for at, text, _ in page.blocks if inside[at])


def extract(page: Page, paths: list[str]) -> str:
    """Text under the first of the paths that the page has with text, else under its own best container. A path inside the page's own container
    counts only if it loses no prose of it."""
    own = best_container(page)
    inside = under(page, {own})
    for path in paths:
        roots = {k for k, n in enumerate(page.nodes) if n.path == path and not n.skipped and n.prose}
        if own not in roots and any(inside[k] for k in roots) and loses_prose(page, own, roots):
            continue
        if roots and (text := text_under(page, roots)):
            return text
    return text_under(page, {own})
