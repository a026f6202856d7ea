"""Main text of web pages by composite text density over a tolerant DOM."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from tessera.llm.common import map_texts, prepare

#: Elements by their part in HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
BOILERPLATE = frozenset("nav footer aside form button select option label input dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Last words of class and id names that say what an element is, if it is not the article (fixed values).
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored sponsors promo promotion promotions "
    "nav navbar navigation menu menubar topnav breadcrumb breadcrumbs crumbs pager pagination toc "
    "footer foot colophon copyright header masthead topbar sidebar side sidenav rail aside widget widgets "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments commentlist disqus reply replies respond responses discussion "
    "share sharing social related recommended recommendations trending popular tags tagcloud search searchbox form hidden skip toolbar".split()
)
#: Those that mark as much as a first word; and those that mark inside an article too (fixed values).
FIRST = frozenset("ad ads advert advertisement adslot nav navbar sidebar footer cookie gdpr breadcrumb breadcrumbs comment comments disqus share sharing social newsletter promo sponsored".split())
INSIDE = frozenset("ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo cookie cookies consent gdpr newsletter comment comments commentlist disqus respond share sharing sidebar nav navbar navigation menu hidden paywall popup modal".split())
#: Those that name readers' comments beside an article or main, and content where there is none (fixed values).
BESIDE = frozenset("thread threads".split())
#: Words that say no more than that there is a box, first words of states, and whose header is the article's own (fixed values).
BOXES = frozenset("list box wrapper wrap container area block bar slot unit links item items button buttons left right top bottom inner outer section group panel row col column main primary secondary global site page content".split())
STATES = frozenset("with has no without is js not".split())
OWN = frozenset("article entry post content story main section chapter".split())
#: A start tag of the first group closes an open element of the second (fixed values).
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
TAG_STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?=[\s=/>]|\Z)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}
_NAME_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "soft", "beside", "chars", "tags", "link_chars", "link_tags", "density", "total", "holds")

    def __init__(self, tag: str, parent: Node | None, said: str = ""):
        self.tag, self.parent = tag, parent
        self.dropped, self.soft, self.beside = said == "drop", said == "soft", said == "beside"
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.holds = False


def _named(name: str, inside_article: bool) -> str:
    """What a class or id says of its element: "drop" for what is not the article, "soft" for what may be, "beside" for what is
    not if there is an article or main on the page, "" for the rest.

    The last word that means more than a box counts, as in English: a reader-comments is comments, a notice-period none.
    """
    words = [w.lower() for w in _NAME_WORD.findall(name)]
    if not words or words[0] in STATES:
        return ""
    first = words[0]
    while len(words) > 1 and (words[-1] in BOXES or words[-1].isdigit()):
        words.pop()
    last = words[-1]
    if last in ("header", "masthead") and (inside_article or len(words) > 1 and words[-2] in OWN):
        return ""
    if last in NAMES and (not inside_article or last in INSIDE) or first in FIRST and (not inside_article or first in INSIDE and last in NAMES):
        return "drop"
    return "soft" if last in NAMES else "beside" if last in BESIDE and not inside_article else ""


def _unwanted(tag: str, attributes: str, inside_article: bool) -> str:
    """"drop" for an element that is boilerplate by its tag, role, visibility or name, "soft" for one that is if mostly links,
    "beside" for one that is beside an article."""
    if tag in BOILERPLATE or tag == "header" and not inside_article:
        return "drop"
    if tag in ("html", "body", "article", "main"):
        return ""
    soft = ""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            said = {_named(x, inside_article) for x in value.split()}
            if "drop" in said:
                return "drop"
            soft = next((x for x in ("soft", "beside") if x in said or x == soft), "")
        elif name == "hidden" or name == "role" and value.strip().lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return "drop"
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return "drop"
    return soft


def _tag_end(page: str, at: int) -> tuple[int, int]:
    """(end of the attributes, end of the tag) from a place after the tag's name; a quote that never closes is a character."""
    while (m := TAG_STOP.search(page, at)) is not None:
        if m[0] == ">":
            return m.start(), m.end()
        close = page.find(m[0], m.end())
        at = m.end() if close < 0 else close + 1
    return len(page), -1


class _Open:
    """The open elements, with the depths of those of each tag."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.depths: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def deepest(self, tags) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def outermost(self, tags, below: int) -> int:
        """The least depth over ``below`` of an open element of the tags, else 0."""
        found = [d[i] for t in tags if (d := self.depths.get(t)) and (i := bisect_right(d, below)) < len(d)]
        return min(found, default=0)

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.depths[self.stack.pop().tag].pop()


#: Elements that an open paragraph does not reach across.
_P_SCOPE = ("td", "th", "li", "div", "article", "section", "body", "blockquote", "table")


def parse(page: str) -> tuple[Node, list[Node]]:
    """(root, all elements in page order) of a page; open elements are closed as far as HTML implies, unknown ends ignored.

    Each character is read once, and open elements are met by their depths, so the time grows with the page.
    """
    root = Node("#root", None)
    nodes, at, unread = [root], 0, 0
    open_ = _Open(root)
    while (m := MARKUP.search(page, at)) is not None:
        if m.start() > unread:
            open_.stack[-1].parts.append(html.unescape(page[unread : m.start()]))
        at = unread = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                open_.stack[-1].parts.append(m[0][9:-3])
            continue
        tag = m[2].lower()
        stop, end = _tag_end(page, at)
        if end < 0:  # the page ends inside this tag
            unread = len(page)
            break
        attributes = page[at:stop]
        at = unread = end
        if m[1]:
            depth = open_.deepest((tag,))
            if depth:
                open_.close(depth)
            elif tag == "p":
                open_.stack[-1].parts.append("\n")
            continue
        if tag in RAW:
            closing = RAW_END[tag].search(page, at)
            at = unread = closing.end() if closing else len(page)
            continue
        if tag in BLOCK and tag != "body":
            depth = open_.deepest(("p",))
            if depth and depth > open_.deepest(_P_SCOPE):
                open_.close(depth)
        if tag in CLOSES:
            depth = open_.outermost(CLOSES[tag], open_.deepest(_SCOPE[tag]))
            if depth:
                open_.close(depth)
        node = open_.stack[-1]
        if tag == "br":
            node.parts.append(" ")
            continue
        said = _unwanted(tag, attributes, open_.deepest(("article", "main")) > 0)
        new = Node(tag, node, said)
        node.parts.append(new)
        nodes.append(new)
        if tag not in VOID and not attributes.endswith("/"):
            open_.push(new)
    if unread < len(page):
        open_.stack[-1].parts.append(html.unescape(page[unread:]))
    return root, nodes


def _rescue(nodes: list[Node]) -> None:
    """An element dropped by its name alone comes back if it wraps an article or main; without any of these on the
    page, if it wraps a first heading and at least half of the page's paragraphs. Readers' threads go where there is one."""
    anchors = {id(n) for n in nodes if n.tag in ("article", "main")}
    for n in nodes:
        n.dropped = n.dropped or n.beside and bool(anchors)
    paragraphs = {id(n): int(n.tag == "p") for n in nodes}
    heading = {id(n): n.tag == "h1" for n in nodes}
    for n in reversed(nodes):
        n.holds = n.holds or id(n) in anchors
        if n.parent is not None:
            n.parent.holds = n.parent.holds or n.holds
            paragraphs[id(n.parent)] += paragraphs[id(n)]
            heading[id(n.parent)] = heading[id(n.parent)] or heading[id(n)]
    if not anchors:
        for n in nodes:
            n.holds = heading[id(n)] and 0 < paragraphs[id(nodes[0])] <= 2 * paragraphs[id(n)]
    for n in nodes:  # parents come first
        wrapper = n.holds and n.tag not in BOILERPLATE and n.tag != "header"
        n.dropped = n.dropped and not wrapper or n.parent is not None and n.parent.dropped


def _drop_link_boxes(nodes: list[Node]) -> None:
    """Elements of a doubtful name go if at least half of their characters are links'."""
    chars, links = dict.fromkeys(map(id, nodes), 0), dict.fromkeys(map(id, nodes), 0)
    for n in reversed(nodes):
        if n.dropped:
            continue
        own = chars[id(n)] = chars[id(n)] + sum(len(x.strip()) for x in n.parts if isinstance(x, str))
        if n.tag == "a":
            links[id(n)] = own
        if n.soft and 2 * links[id(n)] >= own:
            n.dropped = True
        elif n.parent is not None:
            chars[id(n.parent)] += own
            links[id(n.parent)] += links[id(n)]
    for n in nodes:
        n.dropped = n.dropped or n.parent is not None and n.parent.dropped


def measure(nodes: list[Node]) -> None:
    """Characters, tags and link shares of each subtree that stays, its density, and the sum of its children's densities."""
    for n in reversed(nodes):
        if n.dropped:
            continue
        n.chars += sum(len(x.strip()) for x in n.parts if isinstance(x, str))
        n.tags += 1
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
        if n.parent is not None:
            p = n.parent
            p.chars, p.tags, p.link_chars, p.link_tags = p.chars + n.chars, p.tags + n.tags, p.link_chars + n.link_chars, p.link_tags + n.link_tags
    root = nodes[0]
    page_share = root.link_chars / max(1, root.chars)
    for n in reversed(nodes):
        if n.dropped or not n.chars:
            continue
        plain = max(1, n.chars - n.link_chars)
        base = math.log(n.chars / plain * n.link_chars + page_share * n.chars + math.e)
        ratio = n.chars / max(1, n.link_chars) * n.tags / max(1, n.link_tags)
        n.density = n.chars / n.tags * math.log(max(ratio, 1.0) + 1) / math.log(base + 1)
        if n.parent is not None:
            n.parent.total += n.density


#: Elements that hold blocks of text; others are blocks or parts of one, and no content by themselves (fixed values).
CONTAINERS = frozenset("#root html body article main section div td blockquote center details figure table".split())
#: Blocks of text, that may stand beside the element that holds most of it (fixed values).
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
#: A wrapper belongs to the content if it is at least so dense as the part of it that does; an article or main, so much less.
CLIMB, CLIMB_TAGGED = 0.5, 0.1
#: Links' share of the characters of what is not text but a list of links.
LINKS = 0.3
#: Characters from which a box beside the content is text of its own.
BOX_CHARS = 60


def content(nodes: list[Node]) -> list[Node]:
    """Roots of the main content: the subtree of the largest density sum among containers, and others as dense as its path to the body.

    A wrapper of articles that hold at least half of its characters gives way to the densest of them. The subtree grows to
    what wraps it while the wrapper is nearly as dense, or adds less than it has, up to an article or main if there is one, for
    which less will do: headings and short sections beside long ones are text too. Blocks of text and boxes of paragraphs beside
    it belong as well, and beside an article or main those that are not mostly links. If the subtree is outside of all articles, these
    belong too if they have words besides links.
    """
    stay = [n for n in nodes if not n.dropped and n.chars]
    if not stay:
        return []
    best = max((n for n in stay if n.tag in CONTAINERS), key=lambda n: n.total, default=nodes[0])
    if best.total <= 0:
        return [nodes[0]]
    article: dict[int, Node | None] = {}  # the outermost article or main around each node, itself included
    for n in nodes:
        above = article.get(id(n.parent)) if n.parent is not None else None
        article[id(n)] = above or (n if n.tag in ("article", "main") else None)
    if article[id(best)] is None:
        held = {id(n) for n in stay if article[id(n)] is n}
        inside, under = [], {id(best)}
        for n in stay:
            if n.parent is not None and id(n.parent) in under:
                under.add(id(n))
                if id(n) in held:
                    inside.append(n)
        if inside and 2 * sum(n.chars for n in inside) >= best.chars:
            best = max(inside, key=lambda n: n.total)
    own = article[id(best)]
    plain = lambda n: n.link_chars < LINKS * n.chars
    while best.parent is not None and best is not own and best.parent.tag not in ("body", "html", "#root"):
        up = best.parent
        dense = up.density >= (CLIMB_TAGGED if own is not None else CLIMB) * best.density and 2 * up.link_chars <= up.chars
        if not dense and not (plain(up) and 2 * best.chars >= up.chars):
            break
        best = up
    path, up = {id(best)}, best.parent
    threshold = best.density
    while up is not None:
        path.add(id(up))
        if up.tag not in ("html", "#root"):
            threshold = min(threshold, up.density)
        up = up.parent
    with_text: set[int] = set()  # what holds a block of text
    for n in reversed(stay):
        if n.parent is not None and (n.tag in TEXT_BLOCKS or id(n) in with_text):
            with_text.add(id(n.parent))
    box = lambda n: n.total >= 0.3 * best.total or own is None and n.chars >= BOX_CHARS and id(n) in with_text
    belongs = lambda n: n.tag in ("article", "main") or own is None and n.tag in TEXT_BLOCKS or n.tag in CONTAINERS and (n.tag == best.tag or own is None) and box(n)
    alike = {id(n) for n in stay if n.parent is best.parent and plain(n) and belongs(n)}
    if own is None:
        alike |= {id(n) for n in stay if article[id(n)] is n and n.link_chars < n.chars}
    out, kept = [], {id(best)}
    for n in stay:
        if n.parent is not None and id(n.parent) in kept:
            kept.add(id(n))
        elif n is best:
            out.append(n)
        elif (n.density >= threshold or id(n) in alike) and n.tag not in ("#root", "html", "body") and id(n) not in path:
            kept.add(id(n))
            out.append(n)
    return out


def blocks(node: Node) -> list[str]:
    """Texts of the blocks of a subtree in page order, white space as single spaces, none empty."""
    out: list[str] = []
    now: list[str] = []

    def flush():
        text = SPACE.sub(" ", "".join(now)).strip()
        now.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif not x.dropped:
            if x.tag in BLOCK or x.tag == "#root":
                flush()
                stack.append(None)
            stack.extend(reversed(x.parts))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by line ends; empty if there is none."""
    if not page or not page.strip():
        return ""
    _, nodes = parse(page)
    _rescue(nodes)
    _drop_link_boxes(nodes)
    measure(nodes)
    return "\n".join(b for n in content(nodes) for b in blocks(n))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of pages.

    Null, empty and boilerplate-only pages have empty texts; text outside any element counts as the body's; broken
    and unclosed markup is read as far as it goes; repeated rows get equal results. Very long pages are parsed whole, in time
    that grows with their length. Further columns are not read.
    """

    def make():
        return lambda ids, urls, pages: (ids, urls, [main_text(p) for p in pages])

    prepare(pages.sparkSession)
    return map_texts(pages, "page_id long, url string, text string", make, ["page_id", "url", "html"])
