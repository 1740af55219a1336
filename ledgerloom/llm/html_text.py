"""Main text of web pages by composite text density.

A page becomes a DOM tree.  With the characters C, tags T, link characters LC and
link tags LT of a node's subtree, and the body's characters and link characters,
its composite density is

    C / T * log_b(C / LC * T / LT),   b = ln(C / (C - LC) * LC + LC_body / C_body * C + e)

where zero denominators count as 1 and b is 1.05 at least.  A node's density sum is that of its
children's densities.  Formatting elements count as tags of the block that holds them but are no
candidates of their own.  The node of the largest sum (of equal ones the first in post-order) gives the
threshold: the least density on its path to the body.  Its subtree is content, whole; so is, beside
the path, every block that reaches the threshold, and every heading and paragraph, unless most of it is links.
Where a page says which element is its article, that is the unit: a node within articles stands for the outermost of them, and
one that holds articles for the one with the largest sum, if that has a fifth of its text or more;
what is beside an article is no content.

Before densities are computed, elements that are no content are taken out: scripts, styles, menus, footers, asides, controls, and headers
outside an article.  Forms, and containers whose class, id or role *is* the name of a menu, a
sidebar or such, go only if they are side matter: one that holds an article or main element, or, on a page without these, more than half of the text
outside of links, stays, whatever it is called.  Adverts and notices stay if they hold an article or main element, and reader
comments in no case.  Without ``names`` only the elements tell.

Blocks are separated by block elements; white space within one becomes a space;
character references are decoded; blocks are joined by line feeds in page order.

Defined results: null or empty html gives an empty text; so does a page
without text outside what is taken out.  Unclosed, crossed or cut-off markup is read as browsers do
in the main.  Pages of any length are read whole, in time proportional to it.  Rows are independent, so that repeated
rows need no rule; an empty table gives an empty
result; columns other than those named are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices

# The elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style noscript template iframe object embed svg canvas math head title nav footer aside button select textarea input dialog menu audio video map noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = BLOCKS - frozenset("body html caption dd dt legend option optgroup tbody td tfoot th thead tr li summary".split()) | {"li", "dd", "dt"}
#: An opening element ends an open one of these, up to the nearest of the bounds.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
}
SCOPE = frozenset({"table", "td", "th", "caption", "button", "object", "html", "template"})
#: Names of class and id attributes, and roles, that mark side matter; a name counts as a whole.
ADVERTS = re.compile(r"ads?|adverts?|advertisements?|advertising|ad-?(?:box|slot|unit|banner|container|wrapper)|sponsor(?:ed)?|promos?|banner|cookies?|cookie-?(?:notice|banner|bar|consent)|consent|gdpr|notices?|popup|newsletter|signup|paywall", re.I)
NOISE = re.compile(
    r"nav|navbar|navigation|(?:main|top|site|side|foot|footer)-?(?:nav|menu)|menu|menubar|breadcrumbs?|pagination|pager|side-?bar|widgets?|(?:share|social)-?(?:buttons?|links?|bar|icons?)|related-?(?:posts?|articles?|links?)"
    r"|(?:site|page)?-?(?:header|footer)|masthead|copyright|modal|skip-?link|sr-only",
    re.I,
)
COMMENTS = re.compile(r"(?:post-|user-|reader-|article-|page-)?comments?(?:-?(?:list|area|section|thread|box|wrapper|container|form))?|disqus(?:[_-]thread)?|replies|respond|discussion", re.I)
#: Class words of one reader comment that is an article of its own.
ONE_COMMENT = frozenset("comment comment-body comment-content comment-item reply".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
ROOTS = frozenset({"html", "body", "main", "article"})
PROSE = frozenset({"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre"})

_MARKUP = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>=]+|=)*)(>|\Z)|/[^>a-zA-Z][^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_BLANK = re.compile(r"[ \t\n\r\f\v\xa0  -     　]+")


KEPT, SIDE, ADVERT, COMMENT, OUT = range(5)


class Node:
    __slots__ = ("tag", "parent", "kids", "kind", "noise", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, kind: int = KEPT):
        self.tag, self.parent, self.kind, self.noise = tag, parent, kind, kind != KEPT
        self.kids: list[Node | str] = []


def _kind(tag: str, attributes: str, is_open: Counter[str], names: bool) -> int:
    """What an element is by itself: content, side matter unless it holds the page's text, comments, or no content."""
    if tag in DROPPED:
        return OUT
    if tag == "header":
        return KEPT if is_open["article"] or is_open["main"] else OUT
    if tag == "form":
        return SIDE
    if not names or not attributes:
        return KEPT
    found = [(m[1].lower(), (m[2] or m[3] or m[4] or "").strip()) for m in _ATTRIBUTE.finditer(attributes)]
    if tag == "article":
        return COMMENT if any(name == "class" and not ONE_COMMENT.isdisjoint(value.lower().split()) for name, value in found) else KEPT
    if tag in ROOTS:
        return KEPT
    for name, value in found:
        if name in ("class", "id") and not (tag in ("h1", "h2", "h3") or tag in INLINE and tag not in ("span", "a")):
            words = value.split()
            if any(COMMENTS.fullmatch(w) for w in words):
                return COMMENT
            if any(ADVERTS.fullmatch(w) for w in words):
                return ADVERT
            if any(NOISE.fullmatch(w) for w in words):
                return SIDE
        if name == "role" and value.lower() in NOISE_ROLES or name == "aria-hidden" and value.lower() == "true":
            return SIDE
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return SIDE
    return SIDE if re.search(r"(?:^|\s)hidden(?:\s|/|$)", _ATTRIBUTE.sub(" ", attributes), re.I) else KEPT


def parse(text: str, names: bool = True) -> Node:
    """The tree of a page; texts are strings with their references decoded.  Without ``names``, classes, ids and roles tell nothing."""
    root = Node("#root", None)
    stack, at, n = [root], 0, len(text)
    is_open: Counter[str] = Counter()

    def close(k: int) -> None:
        for x in stack[k:]:
            is_open[x.tag] -= 1
        del stack[k:]

    while at < n:
        m = _MARKUP.search(text, at)
        if m is None:
            stack[-1].kids.append(html.unescape(text[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(html.unescape(text[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if not is_open[tag]:
                if tag == "p":
                    stack[-1].kids.append(Node("p", stack[-1]))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                # an end tag of an inline element doesn't end a block
                if tag in INLINE and stack[k].tag in BLOCKS or stack[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", stack[k].tag):
                    break
            continue
        if not m[4]:  # cut off within the tag
            break
        if tag in CLOSES_P and is_open["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag in ENDS and any(is_open[x] for x in ENDS[tag][0]):
            ended, bounds = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in ended:
                    close(k)
                    if tag != "tr":
                        break
        if tag in ("html", "body") and is_open[tag]:
            continue
        if tag == "body":
            for k in range(1, len(stack)):
                if stack[k].tag == "head":
                    close(k)
                    break
        node = Node(tag, stack[-1], _kind(tag, m[3], is_open, names))
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, at)
            node.kids.append(html.unescape(text[at : end.start() if end else n]) if tag in ("title", "textarea") else "")
            at = end.end() if end else n
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCKS and tag not in INLINE):
            stack.append(node)
            is_open[tag] += 1
    _settle(root)
    return root


def _settle(root: Node) -> None:
    """Side matter that holds an article or most of the page's text isn't side matter."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if not isinstance(k, str) and k.kind not in (OUT, COMMENT)]
    size: dict[int, tuple[int, bool]] = {}
    for node in reversed(order):
        chars, article = 0, node.tag in ("article", "main")
        for k in node.kids:
            if isinstance(k, str):
                chars += len(_BLANK.sub("", k))
            elif id(k) in size:
                chars += size[id(k)][0]
                article |= size[id(k)][1]
        size[id(node)] = (0 if node.tag == "a" else chars, article)
    most, marked = size[id(root)]
    for node in order:
        if node.kind in (SIDE, ADVERT):
            chars, article = size[id(node)]
            node.noise = not (article or node.kind == SIDE and not marked and 2 * chars > most)


def _post_order(root: Node) -> list[Node]:
    """All nodes that aren't noise, children before parents, without recursion."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in node.kids if not isinstance(k, str) and not k.noise]
    return out[::-1]


def content(root: Node) -> list[Node]:
    """The nodes whose subtrees are the main text, in page order."""
    nodes = _post_order(root)
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for k in node.kids:
            if isinstance(k, str):
                node.chars += len(_BLANK.sub("", k))
            elif not k.noise:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = next((x for x in nodes if x.tag == "body"), root)
    if not body.chars:
        body = root
    share = body.link_chars / body.chars if body.chars else 0
    for node in nodes:
        node.density = 0.0
        if node.chars:
            tags, links, link_tags = max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
            base = math.log(node.chars / max(1, node.chars - node.link_chars) * node.link_chars + share * node.chars + math.e)
            ratio = max(1.0, node.chars / links * tags / link_tags)
            node.density = node.chars / tags * max(math.log(ratio), 1e-9) / math.log(max(base, 1.05))
        node.total = sum(k.density for k in node.kids if not isinstance(k, str) and not k.noise and k.tag not in INLINE)
    if not body.chars:
        return []
    inside = _post_order(body)
    best = max(inside, key=lambda x: x.total)
    if best.total <= 0:
        return [body]
    best = _article_of(best, body)
    # the path includes the body itself
    threshold, node = best.density, best
    while node is not body:
        node = node.parent
        threshold = min(threshold, node.density)
    path = {id(body)}
    node = best
    while node is not body:
        path.add(id(node))
        node = node.parent
    found, todo = [], [best if best.tag == "article" else body]
    while todo:
        node = todo.pop()
        if node is best or id(node) not in path:
            found.append(node)
        else:
            todo += [k for k in reversed(node.kids) if not isinstance(k, str) and not k.noise and (id(k) in path or _beside(k, threshold))]
    return found


def _article_of(best: Node, body: Node) -> Node:
    """The article that ``best`` lies in, outermost, or that holds much of it; else itself."""
    inside, node = best if best.tag == "article" else None, best
    while node is not body:
        node = node.parent
        if node.tag == "article":
            inside = node
    if inside:
        return inside
    held, todo = [], [best]
    while todo:
        node = todo.pop()
        if node.tag == "article":
            held.append(node)
        else:
            todo += [k for k in reversed(node.kids) if not isinstance(k, str) and not k.noise]
    first = max(held, key=lambda x: x.total, default=best)
    return first if 5 * (first.chars - first.link_chars) >= best.chars - best.link_chars else best


def _beside(node: Node, threshold: float) -> bool:
    return bool(node.chars) and 2 * node.link_chars <= node.chars and (node.density >= threshold or node.tag in PROSE)


def blocks(nodes: list[Node]) -> list[str]:
    out, line = [], []

    def end() -> None:
        text = _BLANK.sub(" ", "".join(line)).strip(" ")
        if text:
            out.append(text)
        line.clear()

    for top in nodes:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                line.append(x)
            elif not x.noise:
                if x.tag == "br":
                    line.append(" ")
                elif x.tag in BLOCKS or x.tag == "#root":
                    end()
                    todo.append(None)
                todo += x.kids[::-1]
        end()
    return out


def main_text(page: str | None, names: bool = True) -> str:
    if not page:
        return ""
    return "\n".join(blocks(content(parse(page, names))))


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _, _ in slices(batches, "html"):
        texts = [main_text(x) for x in rows.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    own = bounded(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return own.mapInArrow(_extractor, "page_id long, url string, text string, n_chars long")
