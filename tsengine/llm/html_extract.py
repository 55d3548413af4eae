"""HTML extraction by composite text density.

A page becomes a tree of nodes. Every node's density is its characters per tag, damped by the share
of link characters and link tags; a node's score is the sum of its children's densities. The node
with the highest score is the core of the article, and the least density on the path from the body to
the core is the threshold.

What is beside the article goes by the kind of its element (nav, aside, footer, form, ...), and
readers' comments that hold items or forms. Names (class, id) only lower the density of a node and of
what it holds; then density decides. Beside the path to the core, blocks go that are named so, or are
mostly links and below the threshold, or state a copyright. Inside the core (or the <article> or
<main> around it), a name never removes prose: blocks go that are mostly links and below the
threshold, or whose name says so and whose text is no paragraphs. All other blocks stay, short ones too.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

# Element names and class words by their meaning in pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NOISE = frozenset("head nav aside footer form button select input option dialog menu menuitem".split()) | RAW
CONTAINERS = frozenset("article main".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
OPEN_P = INLINE | VOID - {"hr"} | RAW  # these leave an open <p> open
SCOPES = frozenset("table td th ul ol dl article section main div body html blockquote aside nav form figure".split())
LAYOUT_WORD = re.compile(r"(?:no|not|has|with|without|is|hide|show|open|closed)[_-]")  # says how a page is laid out
#: Parts of names: of what lies beside an article, of what may as well be its topic, of any place in a page.
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
BESIDE = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertisements adsense breadcrumb breadcrumbs consent cookie cookies footer gdpr masthead menu modal nav navbar navigation newsletter "
    "overlay pager pagination popup promo promos promotion share sharing sidebar sponsor sponsored sponsors subscribe subscription teaser toolbar widget widgets".split()
)
TOPICS = frozenset("alert alerts banner header login notice notices recommended recommendations related search signup social".split())
PLACES = frozenset("area bar block bottom box button buttons col column container form global group icons inline inner item items left links list main outer page posts right section site slot top unit wrap wrapper".split())
WRAPPERS = frozenset("div section form span table tbody tr td".split())
PROSE = frozenset("p li dd dt td th h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption".split())
PARAGRAPH = 80  # least characters of a paragraph that speaks for a block in spite of its name
LOWERED = (1.0, 0.5, 0.1)  # density by how plainly a name says that a node is beside the article
FOOT = re.compile(r"\W*(?:©|\(c\)|copyright\b|all rights reserved\b)", re.I)
TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*(?:>|\Z))""", re.S)
INVISIBLE, HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden"), re.compile(r"(?:^|\s)hidden(?:\s|/|>|$)")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")


class Node:
    __slots__ = ("tag", "parent", "items", "noise", "named", "comments", "chars", "tags", "link_chars", "link_tags", "paragraphs", "density", "score", "weight")

    def __init__(self, tag, parent, noise=False, named=0, comments=False):
        self.tag, self.parent, self.items = tag, parent, []
        self.noise, self.named, self.comments = noise, named, comments
        self.chars = self.tags = self.link_chars = self.link_tags = self.paragraphs = 0
        self.density = self.score = 0.0
        self.weight = 1.0


@lru_cache(10_000)
def _name(words: str) -> tuple[int, bool]:
    """How plainly class or id words say that a node is beside the article (0 to 2), and of comments."""
    named, comments = 0, False
    for word in words.split():
        if LAYOUT_WORD.match(word):
            continue
        parts = {x.rstrip("0123456789") for x in re.split("[-_]+", re.sub("side[-_]bar", "sidebar", word))} - {""}
        beside, topics = parts & BESIDE, parts & TOPICS
        plain = parts <= BESIDE | TOPICS | PLACES and (beside or len(parts) > 1)
        if beside or topics:
            named = max(named, 2 if plain else 1)
            comments |= bool(plain and parts & COMMENTS)
    return named, comments


def _start(tag: str, attributes: str, parent: Node, in_article: bool) -> Node:
    """A new node: noise by its element or role, named by its class and id."""
    noise = tag in NOISE or (tag == "header" and not in_article)
    named, comments = 0, False
    if len(attributes) > 2 and not noise and tag not in ("html", "body", "main"):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                n, c = _name(value)
                named, comments = max(named, n), comments or c
            elif tag == "article":
                continue
            elif name == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"):
                noise = True
            elif (name == "aria-hidden" and value == "true") or (name == "style" and INVISIBLE.search(value)):
                noise = True
        noise = noise or bool(HIDDEN.search(ATTRIBUTE.sub("", attributes)))
    if comments and tag in ("article", "li"):
        noise = True  # one comment
    return Node(tag, parent, noise, named if tag != "article" or comments else 0, comments)


class _Open:
    """The open elements, with how many of each tag are open, in all and since the last scope (and its tag)."""

    def __init__(self, root: Node):
        self.stack, self.count, self.scopes = [root], Counter(), [(Counter(), "html")]

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.count[node.tag] += 1
        self.scopes[-1][0][node.tag] += 1
        if node.tag in SCOPES:
            self.scopes.append((Counter(), node.tag))

    def pop(self) -> Node:
        node = self.stack.pop()
        if node.tag in SCOPES:
            self.scopes.pop()
        self.count[node.tag] -= 1
        self.scopes[-1][0][node.tag] -= 1
        return node


def parse(page: str) -> Node:
    """A tree for any input, in time that grows with its length: unknown end tags are dropped, open
    elements end with their parent."""
    root = Node("html", None)
    open_, at, text = _Open(root), 0, page
    stack = open_.stack
    while at < len(text):
        m = TOKEN.search(text, at)
        end = m.start() if m else len(text)
        if end > at:
            stack[-1].items.append(html.unescape(text[at:end]))
        if not m:
            break
        at = m.end()
        if not (tag := m[2]):
            continue
        tag = tag.lower()
        if m[1]:
            if open_.count[tag]:
                while open_.pop().tag != tag:
                    pass
            elif tag == "p":
                stack[-1].items.append(Node("p", stack[-1]))
            continue
        if tag == "html":
            continue
        scope, owner = open_.scopes[-1]
        ends = CLOSES[tag] if tag in CLOSES else () if tag in OPEN_P else ("p",)
        for end in ends:
            if scope[end] or owner == end:
                while open_.pop().tag not in ends:
                    pass
                break
        if tag == "body" and open_.count["head"]:
            while open_.pop().tag != "head":
                pass
        node = _start(tag, m[3], stack[-1], bool(open_.count["article"] or open_.count["main"]))
        stack[-1].items.append(node)
        if tag in RAW and not m[0].endswith("/>"):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(text, at)
            at = close.end() if close else len(text)
        elif tag not in VOID and not (m[0].endswith("/>") and tag not in INLINE):
            open_.push(node)
    return root


def _nodes(root: Node, noise: bool = False) -> list[Node]:
    """Nodes in page order, parents before their children; with or without what is noise."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in reversed(node.items) if isinstance(x, Node) and (noise or not x.noise))
    return out


def settle(root: Node) -> None:
    """What only the whole page tells: comments that hold items or forms are noise; a form, or another
    element taken for noise, that wraps an article or most of the text is none."""
    nodes = _nodes(root, noise=True)
    text, holds, items = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), set()
    for n in reversed(nodes):
        if n.tag in RAW or n.tag == "head":
            continue
        text[n] += sum(len(x.strip()) for x in n.items if isinstance(x, str))
        if n.parent is not None:
            text[n.parent] += text[n]
            holds[n.parent] += holds[n] + (n.tag in CONTAINERS and not n.noise)
            if n.tag in ("article", "li", "form", "textarea") or n.comments or n in items:
                items.add(n.parent)
    for n in nodes:
        if n.tag in WRAPPERS and n.noise and (holds[n] or (n.tag == "form" and 2 * text[n] > text[root])):
            n.noise = False
        if n.comments and n in items and (not holds[n] or holds[n] < holds[root]):
            n.noise = True


def measure(root: Node) -> list[Node]:
    """Fill counts, densities and scores of all nodes outside noise; returns them in page order."""
    nodes = _nodes(root)
    linked = {root: False}
    for n in nodes[1:]:
        linked[n] = n.tag == "a" or linked[n.parent]
        n.weight = n.parent.weight * LOWERED[n.named]
    for n in reversed(nodes):
        own = sum(len(x.strip()) for x in n.items if isinstance(x, str))
        n.chars += own
        n.link_chars += own if linked[n] else 0
        if n.tag in ("p", "blockquote", "pre") and n.chars - n.link_chars >= PARAGRAPH:
            n.paragraphs += 1
        if n.parent is not None:
            p = n.parent
            p.chars, p.link_chars, p.paragraphs = p.chars + n.chars, p.link_chars + n.link_chars, p.paragraphs + n.paragraphs
            p.tags, p.link_tags = p.tags + n.tags + 1, p.link_tags + n.link_tags + (n.tag == "a")
    all_chars, all_links = max(root.chars, 1), root.link_chars
    for n in nodes:
        if n.chars:
            c, t, lc, lt = n.chars, max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
            plain = max(c - n.link_chars, 1)
            base = math.log(c / plain * n.link_chars + all_links / all_chars * c + math.e)
            n.density = n.weight * (c / t * max(math.log(c / lc * t / lt), 0.0) / max(math.log(base), 1.0) if n.link_chars < c else 0.0)
    for n in nodes[1:]:
        n.parent.score += n.density
    return nodes


def _first_text(n: Node) -> str:
    todo = [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                return x.strip()
        elif not x.noise:
            todo.extend(reversed(x.items))
    return ""


def _beside(n: Node, threshold: float) -> bool:
    """Does a block beside the path to the core go?"""
    if n.named == 2 or (n.named and n.density < threshold):
        return True
    return _links(n, threshold) or (n.chars < 200 and bool(FOOT.match(_first_text(n))))


def _links(n: Node, threshold: float) -> bool:
    return n.link_tags > 1 and 2 * n.link_chars > n.chars and n.density < threshold and n.tag not in PROSE


def _inside(n: Node, threshold: float) -> bool:
    """Does a block inside the article go?"""
    if _links(n, threshold):
        return True
    if n.named == 2:
        return n.paragraphs < 2 and n.density < threshold
    blocks = any(isinstance(x, Node) and x.tag in PROSE for x in n.items)
    return n.named == 1 and not blocks and not n.paragraphs and n.density < threshold and n.tag not in PROSE


def main_subtree(root: Node) -> tuple[Node, set[Node]]:
    """The node that holds the article, and the nodes in it that don't belong to it."""
    settle(root)
    nodes = measure(root)
    inner = nodes[1:] or nodes
    core = max(inner, key=lambda n: n.score)  # ties: the first in the page
    if core.score <= 0:
        core = max(inner, key=lambda n: n.density)
    path = [core]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    if not any(n.tag in CONTAINERS for n in path):  # the core may lie around the article's own element
        around = [n for n in nodes if n.tag in CONTAINERS and 2 * n.chars >= core.chars and core.chars]
        if around:
            core = max(around, key=lambda n: n.chars)
            path = [core]
            while path[-1].parent is not None:
                path.append(path[-1].parent)
    threshold = min((n.density for n in path if n.tag not in ("html", "head")), default=0.0)
    start = next((n for n in reversed(path) if n.tag in CONTAINERS), None) or next((n for n in path if n.tag == "body"), root)
    on, gone = set(path), set()
    todo = [(start, start.tag in CONTAINERS)]
    while todo:
        n, inside = todo.pop()
        inside = inside or (n is core and n.tag not in ("html", "body"))
        for k in n.items:
            if isinstance(k, Node) and not k.noise:
                if k not in on and (k.tag not in INLINE or k.tag == "span") and (_inside if inside else _beside)(k, threshold):
                    gone.add(k)
                else:
                    todo.append((k, inside))
    return start, gone


def extract(page: str) -> str:
    """The article's text: white space is one space inside blocks, and blocks are joined by one."""
    out: list[str] = []
    start, gone = main_subtree(parse(page))
    todo: list = [start]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.noise and x not in gone:
            gap = [] if x.tag in INLINE else [" "]
            todo.extend([*gap, *reversed(x.items), *gap])
    return " ".join("".join(out).split())


def extract_pages(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` with its ``html`` replaced by ``text`` and ``n_chars``, its code points.

    Null and empty pages, and pages without any text outside noise, have an empty text. A page that
    isn't valid HTML is read as browsers would, without failing. Very long and deeply nested pages are
    read whole, one at a time, in time that grows with their length. Rows are independent of each other:
    repeated rows give repeated results, other columns pass, columns named ``text`` or ``n_chars``
    are replaced. An empty table gives an empty result.
    """
    kept = [f for f in pages.schema if f.name != page and f.name.lower() not in ("text", "n_chars")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, page):
                texts = [extract(x or "") for x in part.column(page).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return pages.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{page}`").alias(page)).mapInArrow(run, schema)


def digest(pages: DataFrame) -> DataFrame:
    """Columns of the registered query."""
    return extract_pages(pages.select("page_id", "url", "html"))


#: The synthetic pages have one <article> of <h1>, <p>, <b> and <br>; for them SQL can tell its text.
ORACLE = r"""
WITH p AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS body FROM p),
u AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(body, '&#x27;', ''''), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS body FROM t),
v AS (SELECT page_id, url, trim(regexp_replace(body, '\s+', ' ', 'g')) AS text FROM u)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM v
"""
