"""Main text of web pages by tree scoring.

The page becomes a tree. Menus, headers, footers, sidebars, notices, adverts, forms, comments by readers, scripts and
the like are cut by element, role or class. Each paragraph then gives points for its length and commas to its
``LEVELS`` nearest ancestors (all to its parent, half to the next, a third of that and less to the others), each container's points
are discounted by the share of its text that lies in links, and the best container is kept with those siblings that score well
or read like text beside it. Where the best container lies in an article or main element, that is kept instead, whole.
The kept blocks are the text, in page order. An element that is cut for a word of its class or id only is let back in, before anything is scored,
if it holds most of the page's text that is not cut otherwise: such a word then names what the wrapper goes with, not what it is. It stays cut, however much it holds,
where an article or main element with text lies outside of it. Words that say the opposite (``has-sidebar``, ``no-comments``) are no noise. Every
step is linear in the page.

White space inside a block becomes one space, blocks are joined by an empty line, and character references are decoded.

Defined cases: null or empty html, and pages without text outside of cut parts, give empty text; repeated rows and null ids
give a row each; an empty table gives no row.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[\"'=])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CUT = {"script", "style", "noscript", "template", "head", "title", "nav", "aside", "footer", "form", "button", "select", "textarea", "iframe", "object", "svg", "canvas", "dialog", "menu", "xmp", "noembed", "noframes", "math", "audio", "video", "map", "label", "fieldset"}
_BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "aside"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|cookies?|consent|gdpr|notice|alert|warning-bar|popup|modal|overlay|newsletter|subscribe|subscription|signup"
    r"|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|toolbar|topbar|masthead|site-header|page-header|header|footer|foot|copyright|legal|sidebar|side|aside|rail|widgets?|related|recommend(?:ed|ations)?|recirc"
    r"|share|sharing|social|comments?|commentlist|respond|replies|reply|disqus|discussion|login|search)(?:$|[\s_-]|\d)",
    re.I,
)
#: What a class says that a wrapper has, lacks or goes with.
_WITH = re.compile(r"(?:^|(?<=\s))(?:has|have|no|not|without|with|hide|show|enable|disable|is|supports|includes?)[-_]\S*", re.I)
_SPACE = re.compile(r"\s+")
#: A sibling stays if it scores this part of the best container, which counts as ten at least, or if it reads like text: links are under
#: LINKED of it, and none of one of SHORT characters or less.
SIBLING, FLOOR, LINKED, SHORT = 0.2, 10.0, 0.25, 80
#: Ancestors that a paragraph's points reach.
LEVELS = 5
#: A wrapper that holds this part of the page's text is no noise.
MOST = 0.5
_READS = {"p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "div", "section", "ul", "ol", "dl", "table", "figure"}


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "named", "score", "inside", "total", "linked", "article")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, named: bool = False):
        self.tag, self.parent, self.cut, self.named = tag, parent, cut, named  # named: cut for its class or id only
        self.total = self.linked = self.article = 0
        self.children: list[Node | str] = []
        self.score = 0.0
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        if parent is not None:
            parent.children.append(self)


def _cuts(tag: str, attributes: str, parent: Node) -> tuple[bool, bool]:
    """Whether an element is cut, and whether only its class or id says so."""
    if tag in _CUT or tag == "header" and not (parent.inside or parent.tag in ("article", "main")):
        return True, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    found = {m[1].lower(): next((html.unescape(x) for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) or found.get("role", "").lower() in _ROLES:
        return True, False
    named = any(_NOISE.search(_WITH.sub(" ", found.get(name, ""))) for name in ("class", "id"))
    return named, named


def parse(page: str) -> Node:
    root = node = Node("#root", None)
    at, end = 0, len(page)
    open_: dict[str, int] = {}  # how many elements of each tag are open

    def close(tags: set[str], stop: set[str]) -> None:
        nonlocal node
        if not any(open_.get(t) for t in tags):
            return
        x = node
        while x.parent is not None and x.tag not in stop:
            if x.tag in tags:
                while node is not x.parent:
                    open_[node.tag] -= 1
                    node = node.parent
                return
            x = x.parent

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            node.children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            node.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                node.children.append(" ")
            close({tag}, set())
            continue
        if tag in _BLOCK:
            close({"p"}, _SCOPE - {"p"})
            if tag[0] == "h" and tag[1:].isdigit():
                close({"h1", "h2", "h3", "h4", "h5", "h6"}, _SCOPE)
        if tag in _CLOSES:
            close(_CLOSES[tag], _SCOPE - _CLOSES[tag])
        if tag in _VOID:
            if tag in ("br", "hr"):
                node.children.append(Node(tag, None) if tag == "hr" else " ")
            continue
        child = Node(tag, node, *_cuts(tag, m[3], node))
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if tag not in _CUT:
                child.children.append(html.unescape(page[at : stop.start() if stop else end]))
            at = stop.end() if stop else end
        elif not m[3].rstrip().endswith("/") or tag in _BLOCK:
            node = child
            open_[tag] = open_.get(tag, 0) + 1
    return root


def _walk(node: Node) -> Iterator[Node]:
    """Nodes that are not cut, parents first."""
    stack = [node]
    while stack:
        x = stack.pop()
        if x.cut:
            continue
        yield x
        stack += [c for c in reversed(x.children) if isinstance(c, Node)]


def _every(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        x = stack.pop()
        yield x
        stack += [c for c in x.children if isinstance(c, Node)]


def _measure(root: Node) -> None:
    """Characters below every node, those in links and those in article or main elements, from the leaves up."""
    nodes, stack = [], [(root, False)]
    while stack:
        x, link = stack.pop()
        link = link or x.tag == "a"
        nodes.append((x, link))
        stack += [(c, link) for c in x.children if isinstance(c, Node)]
    for x, link in reversed(nodes):
        own = sum(len(c.strip()) for c in x.children if isinstance(c, str))
        inner = [c for c in x.children if isinstance(c, Node) and not c.cut]
        x.total = own + sum(c.total for c in inner)
        x.linked = own * link + sum(c.linked for c in inner)
        x.article = x.total if x.tag in ("article", "main") else sum(c.article for c in inner)


def _density(node: Node) -> float:
    return node.linked / node.total if node.total else 0.0


def blocks(nodes: list[Node]) -> list[str]:
    """The text blocks below nodes, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not x.cut:
            if x.tag in _BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return out


def _paragraphs(root: Node) -> list[tuple[Node, str]]:
    """Text-bearing blocks: elements of the block kind with text of their own, inline elements included."""
    found = []
    for node in _walk(root):
        if node.tag in _BLOCK or node is root:
            own: list[str] = []
            stack = [c for c in reversed(node.children)]
            while stack:
                c = stack.pop()
                if isinstance(c, str):
                    own.append(c)
                elif not c.cut and c.tag not in _BLOCK:
                    stack += reversed(c.children)
            text = _SPACE.sub(" ", "".join(own)).strip()
            if text:
                found.append((node, text))
    return found


def _best(root: Node) -> Node | None:
    """The container with most points."""
    scored: dict[int, Node] = {}
    for node, text in _paragraphs(root):
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        up = node if node.tag not in ("p", "pre", "li", "td", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6") else node.parent
        for level in range(LEVELS):
            if up is None:
                break
            up.score += points / (1, 2)[level] if level < 2 else points / (3 * level)
            scored[id(up)] = up
            up = up.parent
    best, most = None, -1.0
    for node in _walk(root):
        if id(node) in scored:
            node.score *= 1 - _density(node)
            if node.tag in ("article", "main"):
                node.score *= 1.5
            if node.score > most:
                best, most = node, node.score
    return best


def _kept(best: Node) -> list[Node]:
    """The best container, or the article that it lies in, with the siblings that belong to it."""
    for kind in ("article", "main"):
        up = best
        while up is not None and up.tag != kind:
            up = up.parent
        if up is not None:
            best = up
            break
    if best.parent is None:
        return [best]
    bar, kept = max(FLOOR, best.score * SIBLING), []
    for s in best.parent.children:
        if s is best:
            kept.append(s)
        elif isinstance(s, Node) and not s.cut:
            reads = s.tag in _READS and s.total and (_density(s) < LINKED if s.total > SHORT else s.linked == 0)
            if s.score >= bar or reads or s.tag == best.tag == "article":
                kept.append(s)
    return kept


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    named = [n for n in _every(root) if n.named]
    if named:
        # Which of them are noise is told by their share of what is not cut for other reasons.
        for n in named:
            n.cut = False
        _measure(root)
        for n in named:
            n.cut = not n.total or n.total < MOST * root.total or not n.inside and n.article < root.article
    _measure(root)
    best = _best(root)
    return "\n\n".join(blocks(_kept(best))) if best else ""


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars."""

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([extract(p) for p in pages.to_pylist()], pa.string())

    rows = small_batches(df).select(df[id_col], df[url_col], run(df[html_col].cast("string")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
