"""Main text of web pages by composite text density.

A page becomes a tree; elements that never hold an article's text (by tag, role, or a name among their classes or as
id) are taken out. A name counts as a whole, or in a compound of such names and words for places and boxes; ids of
headings and paragraphs, and in an article of all but boxes, are made from text and do not count. Every node gets its composite density: characters a tag, lowered by the share of characters inside links.
The sum of its children's densities tells how much a node gathers; the subtree of the largest sum is chosen, whatever its
elements are called. From there the choice climbs towards the body as long as what a parent adds belongs to it: headings,
plain blocks, and boxes like the chosen one that are dense enough for the threshold, the least density on the path from
the first choice to the body. Outside an article or main element all that is added must belong, inside one three quarters.
Inside the choice only blocks that are mostly links fall away, and none that an article or main element holds.

A block is what one block-level element holds between others. Character references are decoded, white space inside a
block becomes one space, and blocks are joined by a line feed, in page order. A tag that the end of the page cuts off
is no text. A null or empty page has no text. Every row gives one row; other columns are not looked at; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import named, ready

#: A comment, declaration, tag, or a tag that the page's end cuts off.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)|</[^>]*(?:>|\Z)", re.S)
#: One attribute after the other: a name, and a value if there is one.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "acronym", "nobr", "ruby", "rt", "rp", "img", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that a new one of these closes, when they are open inside the given borders.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
BORDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Block elements that close an open paragraph.
CLOSE_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
OUT = {"head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "button", "select", "textarea", "iframe", "svg", "canvas", "object", "embed", "dialog", "input", "menu", "title", "noembed", "noframes", "audio", "video", "math"}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Names of a class or id that tell of what is no article.
OUT_NAMES = re.compile(r"^(ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|comment|comments|commentlist|disqus|respond|replies|sidebar|side|aside|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|header|masthead|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|widget|toolbar|copyright|legal|skip)$")
#: Words that may stand beside these in a compound name.
BESIDE = {"", "area", "bar", "bottom", "box", "btn", "button", "buttons", "container", "form", "global", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "posts", "primary", "right", "secondary", "site", "slot", "top", "unit", "wrap", "wrapper"}
#: Elements whose id counts in an article, where those of others are made from headings.
BOXES = {"div", "ul", "ol", "table"}
#: Blocks that hold text, not other parts of a page.
PLAIN = {"p", "ul", "ol", "dl", "pre", "blockquote", "table", "figure", "li", "dd", "dt", "tr", "td", "th", "tbody", "thead", "hr", "details", "summary", "figcaption", "caption"}


class Node:
    __slots__ = ("tag", "parent", "children", "look", "main", "inside", "chars", "tags", "link_chars", "link_tags", "heading_chars", "density", "gathered")

    def __init__(self, tag: str, parent: Node | None, look: str = "", main: bool = False, inside: bool = False):
        self.tag, self.parent, self.look, self.main, self.inside = tag, parent, look, main, inside
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = self.heading_chars = 0
        self.density = self.gathered = 0.0


def _told(attributes: str) -> dict[str, str]:
    told: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        told.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # of equal names the first counts
    return told


def is_out(tag: str, told: dict[str, str], in_article: bool, in_text: bool = False) -> bool:
    """Whether an element is taken out by its markup; what stands inline in a text, and paragraphs of an article, never by a name."""
    if tag in OUT or tag == "header" and not in_article:
        return True
    if "hidden" in told or told.get("aria-hidden") == "true" or "display:none" in told.get("style", "").replace(" ", ""):
        return True
    if told.get("role", "").lower() in OUT_ROLES:
        return True
    if tag in ("html", "body", "main", "article") or tag in INLINE and (in_article or in_text) or tag == "p" and in_article:
        return False
    names = told.get("class", "").lower().split()
    box = tag in BOXES and "section" not in names if in_article else tag not in HEADINGS and tag != "p"
    return any(names_out(n, in_article) for n in names + told.get("id", "").lower().split() * box)


def names_out(name: str, in_article: bool) -> bool:
    """Whether a class or id is one of OUT_NAMES or a compound of nothing but these and BESIDE."""
    rest = [w for w in re.split("[_-]", name) if w not in BESIDE]
    if in_article and rest == ["header"]:
        return False  # as the element of this name
    return bool(rest) and all(OUT_NAMES.match(w) for w in rest)


def parsed(page: str) -> Node:
    """The tree of a page, without what is no article by its markup."""
    root = Node("html", None)
    now = root
    skipped: list[str] = []  # open elements of a part that is taken out
    #: How many elements of a name are open, so that what is not open is not looked for.
    count, skipping = Counter[str](), Counter[str]()
    article = 0
    at = 0

    def close(node: Node) -> None:
        nonlocal now, article
        while True:
            article -= now.tag in ("article", "main")
            count[now.tag] -= 1
            last, now = now, now.parent
            if last is node:
                return

    def opened(tags: set[str], borders: set[str]) -> Node | None:
        if not any(count[t] for t in tags):
            return None
        node = now
        while node is not root and node.tag not in borders:
            if node.tag in tags:
                return node
            node = node.parent
        return None

    while True:
        m = MARKUP.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not skipped:
            now.children.append(text)
        if m is None:
            break
        at = m.end()
        slash, tag, attributes, end = (m[1], m[2], m[3], m[4]) if m[2] else (m[5], m[6], m[7], m[8])
        if not tag or not end:
            continue
        tag = tag.lower()
        if slash:
            if skipped:
                if skipping[tag]:
                    last = None
                    while last != tag:
                        last = skipped.pop()
                        skipping[last] -= 1
                elif tag in ("body", "html"):
                    skipped.clear()
                    skipping.clear()
                continue
            node = opened({tag}, {"article", "main"} - {tag} if tag in INLINE or tag == "p" else set())
            if node is not None:
                close(node)
            continue
        told = _told(attributes)
        raw = tag in RAW
        if raw:
            found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = found.end() if found else len(page)
        if tag in ("body", "article", "main") and skipped and skipped[0] in ("head", "html"):
            skipped.clear()
            skipping.clear()
        if skipped:
            if not raw and tag not in VOID and not attributes.rstrip().endswith("/"):
                if tag in CLOSES and skipped[-1] in CLOSES[tag]:
                    skipping[skipped.pop()] -= 1
                skipped.append(tag)
                skipping[tag] += 1
            continue
        if tag in ("html", "body") and tag != "body":
            continue
        if tag in CLOSE_P and (p := opened({"p"}, {"article", "main", "td", "th", "button"})) is not None:
            close(p)
        if tag in CLOSES and tag != "p" and (old := opened(CLOSES[tag], BORDERS.get(tag, set()))) is not None:
            close(old)
        if is_out(tag, told, article > 0, now.tag in PLAIN or now.tag in HEADINGS or now.tag in INLINE):
            if not raw and tag not in VOID:
                skipped.append(tag)
                skipping[tag] += 1
            elif tag not in INLINE:
                now.children.append(Node(tag, now))
            continue
        article_itself = tag in ("article", "main") or told.get("role") in ("main", "article")
        node = Node(tag, now, told.get("class", ""), tag == "main" or told.get("role") == "main", now.inside or article_itself)
        now.children.append(node)
        if not raw and tag not in VOID:
            article += tag in ("article", "main")
            count[tag] += 1
            now = node
    return root


def measure(root: Node) -> list[Node]:
    """Densities of all nodes, children first. Without recursion, as pages may be deep."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    order.reverse()
    for node in order:
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(" ".join(child.split()))
            else:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
                node.heading_chars += child.heading_chars
        if node.tag == "a":
            node.link_chars = node.chars
        if node.tag in HEADINGS:
            node.heading_chars = node.chars
    whole = max(1, root.chars)
    links = root.link_chars / whole
    for node in order:
        if not node.chars:
            continue
        tags, plain = max(1, node.tags), max(1, node.chars - node.link_chars)
        base = log(node.chars / plain * max(1, node.link_chars) + links * node.chars + 2.718281828459045)
        ratio = max(1.0, node.chars / max(1, node.link_chars) * (tags / max(1, node.link_tags)))
        node.density = node.chars / tags * max(0.0, log(ratio) / base)
    for node in order:
        node.gathered = sum(c.density for c in node.children if isinstance(c, Node)) or (node.density if any(isinstance(c, str) and c.strip() for c in node.children) else 0.0)
    return order


def belongs(added: Node | str, best: Node, threshold: float) -> bool:
    """Whether what a parent adds to the choice is of the same text."""
    if isinstance(added, str) or added.tag in HEADINGS or added.heading_chars == added.chars:
        return True
    if added.link_chars * 2 > added.chars:
        return False
    if added.tag in PLAIN or added.tag in INLINE:
        return True
    return (added.inside or (added.tag, added.look) == (best.tag, best.look)) and added.density >= threshold


def chosen(root: Node) -> Node:
    order = measure(root)
    best = node = max(reversed(order), key=lambda n: n.gathered)
    path = []
    while node is not None and node is not root:
        path.append(node.density)
        node = None if node.tag == "body" else node.parent
    threshold = min((d for d in path if d), default=0.0)
    while best.parent is not None and best.tag != "body" and not best.main:
        added = [c for c in best.parent.children if c is not best and (c.strip() if isinstance(c, str) else c.chars)]
        size = [len(c) if isinstance(c, str) else c.chars for c in added]
        other = sum(n for c, n in zip(added, size, strict=True) if not belongs(c, best, threshold))
        if other * 4 > (sum(size) + best.chars) * best.parent.inside:
            break
        best = best.parent
    return best


def blocks(top: Node) -> list[str]:
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        text = " ".join(references.unescape("".join(now)).split())
        if text:
            out.append(text)
        now.clear()

    todo: list[Node | str | None] = [top]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif x.tag in INLINE:
            todo += reversed(x.children)
        elif x is not top and not x.inside and x.tag in ("ul", "ol", "div", "table", "section") and x.link_chars * 2 > x.chars:
            end()
        else:
            end()
            todo.append(None)
            todo += reversed(x.children)
    end()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(chosen(parsed(page)))) if page else ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (empty if there is none) and n_chars (its code points)."""
    ready(pages.sparkSession)
    pages = named(pages, page_id=id_col, url=url_col, html=html_col)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.mapInArrow(_extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
