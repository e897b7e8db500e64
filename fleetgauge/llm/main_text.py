"""Main text of web pages by composite text density.

A forgiving reader turns a page into a tree. What is never article by its element or role (menus, headers,
footers, asides, scripts, hidden parts) is taken out; what a word of its class or id calls an advert, notice,
comment and the like, and a form, is taken out too, unless it holds most of the page's text and little stands
outside: then it is a wrapper. Every other node gets its composite density: characters per tag, lowered by the share of characters and tags in links
(Sun, Song and Liao's measure). The node whose children's densities have the largest sum is the
core of the article. The smallest density on the way from there to the body is the threshold:
the core grows to each ancestor that has another child of text at or above it. A paragraph grows to
what holds it, and anything inside an element marked as the article to that.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without an end, with raw text, that start a block, and those
# that a start tag ends implicitly; those that hold paragraphs; those an end tag does not reach across.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("article main section div td body html".split())
STOPS = frozenset("ul ol dl table article section div body td th main blockquote nav header footer aside form".split())
#: What may stand in a head; anything else ends it.
HEAD = frozenset("title meta link script style base noscript template".split())
#: Elements, words of class or id, and roles that are not part of an article.
NEVER = frozenset("head script style noscript template iframe nav header footer aside button select textarea input menu svg canvas object audio video dialog title".split())
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice popup modal overlay comment comments disqus replies "
    "share sharing social related recommended newsletter subscribe subscription signup login pagination pager toolbar widget skip".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())

#: Of these words, those of reader comments, which can be longer than the article.
REPLIES = frozenset("comment comments disqus replies".split())
#: A part called beside by a word is a wrapper if it has more than half of the text and this many times the
#: text outside such parts; one that is called comments needs more.
WRAPS, WRAPS_REPLIES = 4, 20
NO, NEVER_ARTICLE, BY_WORD, BY_REPLY_WORD = range(4)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
#: A tag that ends itself; a slash at the end of an unquoted value is part of the value.
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")


class Node:
    __slots__ = ("beside", "children", "density", "link_chars", "link_tags", "parent", "tag", "tags", "chars")

    def __init__(self, tag: str, parent: Node | None, beside: int = NO):
        self.tag, self.parent, self.beside = tag, parent, beside
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def _beside(tag: str, raw: str) -> int:
    """Whether an element is never part of an article, or only by a word of its class or id."""
    if tag in NEVER:
        return NEVER_ARTICLE
    found = BY_WORD if tag == "form" else NO
    if not raw or raw.isspace():
        return found
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "role" and value in ROLES) or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return NEVER_ARTICLE
        if name in ("class", "id") and tag not in ("html", "body"):
            words = set(_WORD.findall(value))
            if not BESIDE.isdisjoint(words):
                found = max(found, BY_WORD if REPLIES.isdisjoint(words) else BY_REPLY_WORD)
    return found


def parse(page: str) -> Node:
    """The tree of a page, what is beside the article marked as such; every page gives a tree."""
    root = Node("html", None)
    here, at = root, 0
    scan = _TOKEN.scanner(page)
    while match := scan.search():
        if match.start() > at:
            here.children.append(page[at:match.start()])
        at = match.end()
        end, tag, raw = match.group(1), match.group(2), match.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            node = here
            while node is not root and node.tag != tag:
                if node.tag in STOPS and tag not in STOPS:  # a stray end inside a closed part
                    node = root
                    break
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        if here.tag == "head" and tag not in HEAD:  # its end tag may be left out
            here = here.parent
        if tag in ("html", "body"):
            continue
        if tag in BLOCK:  # a block ends an open paragraph
            node = here
            while node is not root and node.tag != "p" and node.tag not in STOPS:
                node = node.parent
            if node is not root and node.tag == "p":
                here = node.parent
        if tag in CLOSES:
            node = here
            while node is not root and node.tag not in CLOSES[tag] and node.tag not in ("ul", "ol", "dl", "table", "select"):
                node = node.parent
            if node is not root and node.tag in CLOSES[tag]:
                here = node.parent
        closed = tag in VOID or bool(_CLOSED.search(raw))
        if tag in RAW and not closed:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = close.end() if close else len(page)
            scan = _TOKEN.scanner(page, at)
            continue
        node = Node(tag, here, _beside(tag, raw))
        here.children.append(node)
        if not closed:
            here = node
    if at < len(page):
        here.children.append(page[at:])
    return article_only(root)


def article_only(root: Node) -> Node:
    """The tree without the parts beside the article.

    Parts that a word calls so are looked at from the outside in. One stays if it has more than half of the
    text outside links and at least `WRAPS` times as much as stands outside all such parts.
    """
    order, stack = [], [(root, False)]
    named = False
    while stack:
        node, linked = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or c.beside != NEVER_ARTICLE]
        linked = linked or node.tag == "a"
        named = named or node.beside != NO
        order.append((node, linked))
        stack.extend((c, linked) for c in node.children if isinstance(c, Node))
    if not named:
        return root
    # text outside links of each part, and of it what no word inside calls beside
    whole: dict[int, int] = {}
    plain: dict[int, int] = {}
    for node, linked in reversed(order):
        own = 0 if linked else sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        inner = [c for c in node.children if isinstance(c, Node)]
        whole[id(node)] = own + sum(whole[id(c)] for c in inner)
        plain[id(node)] = own + sum(plain[id(c)] for c in inner if c.beside == NO)
    outside = plain[id(root)]  # grows by the plain text of each wrapper that stays
    parts = [root]
    while parts:
        node, kept = parts.pop(), []
        for c in node.children:
            if isinstance(c, Node):
                if c.beside != NO:
                    times = WRAPS_REPLIES if c.beside == BY_REPLY_WORD else WRAPS
                    if not (2 * whole[id(c)] > whole[id(root)] and whole[id(c)] >= times * outside):
                        continue
                    outside += plain[id(c)]
                parts.append(c)
            kept.append(c)
        node.children = kept
    return root


def measure(root: Node) -> list[Node]:
    """Counts and densities of all nodes, children before parents; returned in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(" ".join(entities.unescape(c).split()))
            else:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.chars if c.tag == "a" else c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
    body_share = root.link_chars / max(root.chars, 1)
    for node in order:
        c, t = node.chars, max(node.tags, 1)
        lc, lt = max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + body_share * c + math.e)
            node.density = c / t * max(math.log(max(c / lc * t / lt, 1.0)) / base, 0.0) if base > 0 else 0.0
    return order


def core(root: Node) -> Node:
    """The subtree of the article."""
    order = measure(root)
    sums = [sum(c.density for c in node.children if isinstance(c, Node)) for node in order]
    best = max(range(len(order)), key=lambda i: (sums[i], -i))
    node = order[best] if sums[best] > 0 else root
    path, up = [], node
    while up is not None:
        path.append(up)
        up = up.parent
    threshold = min(p.density for p in path)
    top, held = node, node.tag in HOLDS
    for below, above in zip(path, path[1:], strict=False):
        # a paragraph is not an article by itself, and what is marked as one is one
        if not held or above.tag in ("article", "main"):
            top, held = above, above.tag in HOLDS
        # text of its own, or another child as dense as the way to the body
        elif any((c.strip() if isinstance(c, str) else c is not below and c.chars and c.density >= threshold) for c in above.children):
            top = above
    return top


def blocks(top: Node) -> list[str]:
    """Text of each block in page order: references decoded, white space one space, trimmed."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        line = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if line:
            out.append(line)

    stack: list[Node | str | None] = [top]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            held.append(item)
        elif item.tag in BLOCK:
            flush()
            stack.append(None)
            stack.extend(reversed(item.children))
        elif item.tag == "br":
            held.append(" ")
        else:
            stack.extend(reversed(item.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(blocks(core(parse(page)))) if page else ""


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page row: page_id, url, text and n_chars (code points).

    A null, empty or text-free page has an empty text. Every row of `pages` comes back, repeated
    rows too; ids and urls may be null; other columns are not read. Each page is read whole and
    by itself, so only one page at a time is held beside its batch.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
            .mapInArrow(read, "page_id long, url string, text string, n_chars long"))
