"""Main text of web pages by composite text density.

A page becomes a tree in one pass over its markup. Subtrees that can't be the
article (menus, headers, footers, forms, adverts, notices, comments of readers,
by element, role or name) count for nothing. Every other node gets its
characters per tag, lowered by the share of linked characters (composite text
density; Sun, Song and Liao, "DOM based content extraction via text density",
2011). The node whose children's densities sum highest holds the article.

The lowest density on its path up to the body is the threshold: a subtree beside
that path belongs to the article too if it reaches it. Density grows with length,
so a headline or a short last section can't; such a subtree is taken if under
half of its characters are linked. The path is followed up to the ``article`` or ``main`` around the chosen node, or to
the body where there is none. Element names never choose the node.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from quillgraph.llm import text as tx

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.S)
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Never part of an article.
DROPPED = frozenset("script style noscript template iframe object embed applet svg math canvas audio video map nav aside footer form button select option textarea input label fieldset menu dialog head title meta link noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr nobr center".split()) - {"center"}
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar status tooltip".split())
#: A class or id names what is no part of an article if its last word, or its first one, is among these.
_LAST = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored banner sidebar nav navbar navigation navi menu menus breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal comments replies respond disqus footer header masthead topbar newsletter subscribe signup login searchform searchbox form".split())
_FIRST = frozenset("ad ads advert advertisement sponsored sidebar nav navbar menu breadcrumb breadcrumbs cookie cookies consent gdpr popup comments commentlist disqus footer masthead".split())
_PAIRS = ("side-bar", "comment-list", "comment-form", "comment-section", "comment-thread", "comment-area", "comment-respond", "sign-up", "skip-link", "site-header", "page-header", "search-form", "search-box")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A start tag that ends an open element of the first kind, inside the second kind of scope.
_CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "thead": ("tr td th thead tbody tfoot", ("table",)), "tbody": ("tr td th thead tbody tfoot", ("table",)), "tfoot": ("tr td th thead tbody tfoot", ("table",)), "option": ("option", ("select",)),
}
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_P_SCOPE = frozenset("body html article section div td th li blockquote button caption main aside nav header footer form figure dd dt".split())


class Node:
    __slots__ = ("tag", "kids", "parent", "drop", "chars", "tags", "linked", "links", "density", "total", "soft")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, soft: bool = False):
        self.tag, self.parent, self.drop, self.soft = tag, parent, drop, soft
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.linked = self.links = 0
        self.density = self.total = 0.0


def _noise(name: str) -> bool:
    words = [w for w in name.split("-") if w]
    return bool(words) and (words[-1] in _LAST or words[0] in _FIRST or "-".join(words[-2:]) in _PAIRS or "-".join(words[:2]) in _PAIRS)


def _marked(tag: str, raw: str) -> tuple[bool, bool]:
    """Whether an element and all in it is no part of an article: surely; by its name only."""
    if tag in DROPPED:
        return True, False
    if not raw or raw.isspace():
        return False, False
    names = ""
    for key, value in _ATTRIBUTE.findall(raw):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            names += " " + re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().replace("_", "-")
        elif key == "role" and value.lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True, False
    return False, any(_noise(name) for name in names.split())


def parsed(html: str) -> Node:
    """The tree of a page; unclosed and stray tags are mended as browsers do, roughly."""
    root = at = Node("#root", None)
    position, end = 0, len(html)
    while position < end:
        m = _TOKEN.search(html, position)
        if m is None:
            at.kids.append(html[position:])
            break
        if m.start() > position:
            at.kids.append(html[position : m.start()])
        position = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                at.kids.append(" ")
                continue
            n = at
            while n is not None and n.tag != tag:
                n = None if tag in INLINE and n.tag not in INLINE and n.tag != "#root" else n.parent
            if n is not None and n.parent is not None:
                at = n.parent
            continue
        if tag in _ENDS_P:
            n = at
            while n.tag in INLINE or n.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and tag == n.tag:
                n = n.parent
            if n.tag == "p":
                at = n.parent
        if tag in _CLOSES:
            kinds, scope = _CLOSES[tag]
            n, last = at, None
            kinds = kinds.split()
            while n is not None and n.tag not in scope:
                if n.tag in kinds:
                    last = n
                n = n.parent
            if last is not None and n is not None:
                at = last.parent
        if tag == "br" or tag in VOID:
            at.kids.append(" " if tag in ("br", "hr") else "")
            at.tags += 1
            continue
        if tag == "body" or tag == "html":
            # Their content stands at the top; a head ends where the body begins.
            while at.tag != "#root":
                at = at.parent
            continue
        sure, soft = _marked(tag, m[3])
        node = Node(tag, at, sure, soft)
        at.kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, position)
            if not sure:
                node.kids.append(html[position : close.start() if close else end])
            position = close.end() if close else end
            continue
        if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
            at = node
    return root


def _order(root: Node) -> list[Node]:
    """Nodes that count, parents first, without recursion."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [k for k in reversed(n.kids) if isinstance(k, Node) and not k.drop]
    return out


def _heading_only(n: Node) -> None:
    """Of a header inside an article only the headings stay."""
    kept = []
    for x in _order(n)[1:]:
        if re.fullmatch(r"h[1-6]", x.tag):
            kept.append(x)
    for x in kept:
        x.parent = n
    n.kids = list(kept)


def _composite(chars: int, tags: int, linked: int, links: int, share: float) -> float:
    """Composite text density of a node; share: linked characters of the body by all of it."""
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - linked, 1) * linked + share * chars + math.e)
    return max(0.0, chars / max(tags, 1) * math.log(max(chars / max(linked, 1) * max(tags, 1) / max(links, 1), 1.0 + 1e-9)) / base)


def _measure(nodes: list[Node]) -> float:
    """Fills in counts and densities; returns the share of linked characters."""
    for n in reversed(nodes):
        for k in n.kids:
            if isinstance(k, str):
                c = len(k) - k.count(" ") - k.count("\n")
                n.chars += c
                if n.tag == "a":
                    n.linked += c
            elif not k.drop:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.links += k.links + (k.tag == "a")
                n.linked += k.chars if n.tag == "a" else k.linked
    body = nodes[0]
    share = body.linked / body.chars if body.chars else 0.0
    for n in nodes:
        n.density = _composite(n.chars, n.tags, n.linked, n.links, share)
    for n in nodes:
        n.total = sum(k.density for k in n.kids if isinstance(k, Node) and not k.drop) or n.density
    return share


def _beside(path: list[Node], threshold: float, share: float) -> dict[Node, list[Node | str]]:
    """Of each node above the chosen one (the first of ``path``) the children that belong to the article, in order.

    Text and inline elements between two blocks are judged together."""

    def fits(kids: list[Node | str]) -> bool:
        chars = tags = linked = links = 0
        for k in kids:
            if isinstance(k, str):
                chars += len(k) - k.count(" ") - k.count("\n")
            elif not k.drop:
                chars, linked = chars + k.chars, linked + (k.chars if k.tag == "a" else k.linked)
                tags, links = tags + k.tags + (len(kids) > 1), links + k.links + (k.tag == "a")
        return 2 * linked < chars or _composite(chars, tags, linked, links, share) >= threshold

    held = set(path)
    out: dict[Node, list[Node | str]] = {}
    for n in path[1:]:
        mine, run = out.setdefault(n, []), []
        for k in [*n.kids, None]:
            if isinstance(k, str) or k is not None and k.tag in INLINE and k not in held:
                run.append(k)
                continue
            if run and fits(run):
                mine += run
            run = []
            if k is not None and (k in held or not k.drop and fits([k])):
                mine.append(k)
    return out


def _blocks(n: Node, own: dict[Node, list[Node | str]]) -> list[str]:
    """The blocks of a subtree in page order; ``own`` names the children of some nodes that count."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        block = _SPACE.sub(" ", unescape("".join(run))).strip()
        run.clear()
        if block:
            out.append(block)

    stack: list[tuple[Node | str, bool]] = [(n, False)]
    while stack:
        k, closing = stack.pop()
        if isinstance(k, str):
            run.append(k)
        elif closing:
            flush()
        elif not k.drop:
            if k.tag not in INLINE:
                flush()
                stack.append((k, True))
            stack += [(x, False) for x in reversed(own.get(k, k.kids))]
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article's text: blocks in page order, joined by one space; empty for null, empty or article-less pages."""
    if not html:
        return ""
    root = parsed(html)
    nodes = _order(root)
    inner = [n for n in nodes if n.tag in ("article", "main")]
    roots = set(inner)
    sound = any(not n.soft for n in inner)
    inside, above = set(), set()
    for n in nodes:
        if n.parent in inside or n in roots:
            inside.add(n)
    for n in inner:
        while n is not None and n not in above:
            above.add(n)
            n = n.parent
    for n in nodes:
        if n.tag == "header" and n not in above:
            if n in inside:
                _heading_only(n)
            else:
                n.drop = True
        elif n.soft and (n not in above or sound and n.tag == "article"):
            n.drop = True
    nodes = _order(root)
    share = _measure(nodes)
    if not root.chars:
        return ""
    # Inline elements are parts of blocks; a tie goes to the wider node, which comes first.
    best = max((n for n in nodes if n.tag not in INLINE), key=lambda n: n.total)
    if best is not root and re.fullmatch(r"p|h[1-6]|li|td|tr|tbody|blockquote|pre|dd|dt|figcaption", best.tag):
        best = best.parent
    path, n = [], best
    while n is not None:
        path.append(n)
        n = n.parent
    threshold = min(n.density for n in path)
    around = [k for tag in ("article", "main") for k, n in enumerate(path) if n.tag == tag] or [len(path) - 1]
    path = path[: around[0] + 1]
    return " ".join(_blocks(path[-1], _beside(path, threshold, share)))


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with text and n_chars (code points) appended (columns of these names are replaced).

    Every row gets a result; null and empty pages an empty text. Nothing is cut.
    """
    rest = [f for f in pages.schema if f.name not in (html_col, "text", "n_chars")]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, html_col):
                texts = [main_text(x) for x in part.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    from pyspark.sql import types as T

    schema = T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*[f"`{c}`" for c in names], html_col).mapInArrow(run, schema)
