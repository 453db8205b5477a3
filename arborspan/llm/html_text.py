"""Main text of web pages by tree scoring (operator 1).

A page is parsed into a tree with the usual implied end tags. Each paragraph
earns points for its length and its commas; the points go to its ancestors,
halved at every further step, and are discounted by link density. The best
container wins and its siblings that hold text of the same kind are kept. Inside
of what wins, containers that are mostly links go. Parsing takes time in
proportion to the page, however broken it is: open elements are a stack whose
places are known by name, and no pattern backtracks.
"""

from __future__ import annotations

import html as _entities
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_texts

#: Elements that are a paragraph of their parent.
PARAGRAPHS = frozenset("p pre td th li dd dt blockquote h1 h2 h3 h4 h5 h6 figcaption".split())
#: HTML's elements by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "head script style noscript iframe template svg math canvas object embed form button input select textarea option nav "
    "aside footer dialog menu title video audio map".split()
)
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An opening tag ends an open element of these names, looked for up to the given borders.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())

#: Words that, as parts of a class or id, mark what is not the article.
CLUTTER = frozenset(
    "ad ads adv advert advertisement advertising adsense adbox banner sponsor sponsored promo promotion popup modal overlay "
    "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login paywall "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc topbar toolbar masthead "
    "header footer foot sidebar aside rail widget widgets related recommended recommendations trending popular "
    "comment comments commentlist disqus reply replies respond discussion share sharing social follow tags tagcloud "
    "search searchbox form copyright legal disclaimer skip hidden print".split()
)
#: Words that mark the article itself.
CONTENT = frozenset("article body content entry main post story text page blog hentry".split())

#: A tag's attributes: a quote counts only after "=" and where it is closed again.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""", re.S)
_END_OF_RAW = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
_WHITE = re.compile(r"\s+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("name", "attrs", "parent", "holder", "items", "score", "text_n", "link_n", "links", "dropped")

    def __init__(self, name, attrs="", parent=None):
        self.name, self.attrs, self.parent = name, attrs, parent
        #: The block that text directly in this element belongs to.
        self.holder = self if parent is None or name in BLOCK else parent.holder
        self.items: list = []
        self.score = 0.0
        self.text_n = self.link_n = self.links = 0
        self.dropped = False


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): _entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /") else {}


class Open:
    """The open elements, outermost first, and the places of each name and of blocks."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        if node.name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def close(self, place: int) -> None:
        """End the element at ``place`` and all inside of it."""
        while len(self.stack) > place:
            node = self.stack.pop()
            self.places[node.name].pop()
            if node.name in BLOCK:
                self.blocks.pop()

    def last(self, names) -> int:
        """Place of the innermost open element of some names; 0 if there is none."""
        return max((p[-1] for p in map(self.places.get, names) if p), default=0)

    def first_after(self, names, place: int) -> int:
        """Place of the outermost open element of some names inside of ``place``."""
        found = [(p, bisect_right(p, place)) for p in map(self.places.get, names) if p]
        return min((p[k] for p, k in found if k < len(p)), default=0)


#: Elements that the end tag of an inline element doesn't reach out of.
WALLS = ("td", "th", "table", "div", "article", "section", "li", "body")


def parse(source: str) -> Node:
    """Tree of a page. Text that ends inside a tag or comment loses only that tag."""
    root = Node("#root")
    opened = Open(root)
    pos, end = 0, len(source)

    def add_text(node, s):
        if s:
            node.items.append(_entities.unescape(s))

    while pos < end:
        m = _TOKEN.search(source, pos)
        add_text(opened.stack[-1], source[pos : m.start() if m else end])
        if not m:
            break
        pos = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:  # an end tag
            place = opened.last((name,))
            if place and (name in BLOCK or place > opened.last(WALLS)):
                opened.close(place)
            continue
        if name in CLOSES_P and opened.blocks and opened.stack[opened.blocks[-1]].name == "p":
            opened.close(opened.blocks[-1])
        if name in IMPLIED:
            ends, borders = IMPLIED[name]
            place = opened.first_after(ends, opened.last(borders))
            if place:
                opened.close(place)
        now = opened.stack[-1]
        node = Node(name, m[3], now)
        now.items.append(node)
        if name in RAW:
            close = _END_OF_RAW[name].search(source, pos)
            if name in ("textarea", "title"):
                add_text(node, source[pos : close.start() if close else end])
            after = source.find(">", close.end()) if close else -1
            pos = after + 1 or end
        elif name not in VOID and (name in BLOCK or not m[3].endswith("/")):  # a stray slash doesn't close a block
            opened.push(node)
    return root


def words_of(value: str) -> set[str]:
    return {w.lower() for w in _PARTS.findall(value)}


def is_clutter(node: Node, in_article: bool) -> bool:
    """Whether an element is certainly no part of an article's text."""
    name = node.name
    if name in NEVER:
        return True
    if name == "header":
        return not in_article
    if not node.attrs:
        return False
    attrs = attributes(node.attrs)
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    if attrs.get("role", "").lower() in ROLES:
        return True
    if name in ("html", "body", "article", "main", "a") or name in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return False
    marks = words_of(attrs.get("class", "") + " " + attrs.get("id", ""))
    if marks & CLUTTER:
        return not (marks & CONTENT and not marks & {"ad", "ads", "advert", "sidebar", "comment", "comments", "footer", "nav", "menu", "related", "share", "social", "cookie", "notice", "newsletter", "promo", "sponsor", "sponsored"})
    return False


def _flow(node: Node, drop: bool):
    """Blocks of text below a node, in page order, with the element that holds each."""
    blocks: list[tuple[Node, str]] = []
    piece: list[str] = []

    def close(holder):
        text = _WHITE.sub(" ", "".join(piece)).strip()
        piece.clear()
        if text:
            blocks.append((holder, text))

    stack = [(node, iter(node.items))]
    while stack:
        at, items = stack[-1]
        for item in items:
            if isinstance(item, str):
                piece.append(item)
                continue
            if item.dropped and drop:
                if item.name in BLOCK:
                    close(at.holder)
                continue
            if item.name == "br":
                piece.append(" ")
                continue
            if item.name in BLOCK:
                close(at.holder)
            stack.append((item, iter(item.items)))
            break
        else:
            stack.pop()
            if at.name in BLOCK or at.name == "#root":
                close(at)
    close(node)
    return blocks


def _mark(root: Node) -> list[Node]:
    """Drop clutter; count text and link text of what stays; elements in page order."""
    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        order.append(node)
        inside = inside or node.name in ("article", "main")
        for item in reversed(node.items):
            if isinstance(item, Node):
                if is_clutter(item, inside):
                    item.dropped = True
                else:
                    stack.append((item, inside))
    for node in reversed(order):
        for item in node.items:
            if isinstance(item, str):
                n = len(item.strip())
                node.text_n += n
                node.link_n += n if node.name == "a" else 0
            elif not item.dropped:
                node.text_n += item.text_n
                node.link_n += item.text_n if node.name == "a" else item.link_n
                node.links += item.links + (item.name == "a")
    return order


#: Containers inside of an article that go when they are nearly all links, and how many.
LISTS, LINKS, LINK_SHARE = frozenset("div section ul ol dl table".split()), 4, 0.8


def _drop_link_lists(order: list[Node], kept: list[Node], around: list[Node]) -> None:
    stay = {id(n) for n in (*kept, *around)}
    for node in order:
        if node.name in LISTS and node.links >= LINKS and id(node) not in stay and link_density(node) > LINK_SHARE:
            node.dropped = True


def link_density(node: Node) -> float:
    return node.link_n / node.text_n if node.text_n else 0.0


def paragraph_points(text: str) -> float:
    """One point, one for each comma, and up to three for each hundred characters."""
    return 1.0 + sum(text.count(c) for c in ",،，、") + min(len(text) / 100.0, 3.0)


def extract(source: str | None) -> str:
    """Main text: blocks of the best container, joined by two line feeds."""
    if not source:
        return ""
    root = parse(source)
    order = _mark(root)
    scored: dict[int, Node] = {}
    blocks = _flow(root, True)
    for holder, text in blocks:
        if len(text) < 25:
            continue
        points = paragraph_points(text)
        if holder.name not in PARAGRAPHS:  # bare text in a container counts for both
            holder.score += points
            scored[id(holder)] = holder
        share, node = 1.0, holder.parent
        while node is not None and share > 0.05:
            node.score += points * share
            scored[id(node)] = node
            node, share = node.parent, share / 2
    if not scored:
        articles = [n for n in order if n.name in ("article", "main")]
        best = articles[0] if articles else root
        return "\n\n".join(t for _, t in _flow(best, True)) if best.text_n and link_density(best) < 0.5 else ""

    def value(node: Node) -> float:
        bonus = 1.0
        if node.name in ("article", "main"):
            bonus = 1.6
        elif node.attrs:
            a = attributes(node.attrs)
            if words_of(a.get("class", "") + " " + a.get("id", "")) & CONTENT:
                bonus = 1.3
        return node.score * bonus * (1 - link_density(node))

    best = max((n for n in order if id(n) in scored and n.name != "#root" or n is root), key=value)
    # an article (or else a main part) around the best container is the whole text
    around, up = [], best
    while up is not None:
        around.append(up)
        up = up.parent
    for name in ("article", "main"):
        best = next((n for n in around if n.name == name), best)
        if best.name == name:
            break
    kept = [best]
    if best.parent is not None and best.name not in ("article", "main", "body"):
        least = 0.2 * value(best)
        kept = [n for n in best.parent.items if isinstance(n, Node) and not n.dropped and (n is best or (n.score and value(n) >= least) or _reads_like_text(n) or (n.name in ("h1", "h2") and best.parent.name != "body"))]
    _drop_link_lists(order, kept, around)
    return "\n\n".join(t for node in kept for _, t in _flow(node, True))


def _reads_like_text(node: Node) -> bool:
    """A sibling with a long block and hardly any link text."""
    return link_density(node) < 0.2 and any(len(t) >= 80 for _, t in _flow(node, True))


def extract_main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns named in ``keep``, and ``text``, the page's main text.

    Null and empty pages, and pages without an article, give an empty text;
    every row gives one row; other columns are ignored. No shuffle.
    """
    names = [id_col, *keep]

    def run(batch):
        n = len(names)
        yield [*(batch.column(k) for k in range(n)), [extract(batch.column(n)[i].as_py()) for i in range(batch.num_rows)]]

    rows = df.select(*[F.col(c) for c in names], F.col(html_col).alias("__html"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return map_texts(rows, run, f"{kinds}, text string")
