"""Main text of web pages by composite text density.

A page is parsed once into a tree (raw text elements, implied end tags, attributes with or without quotes). Parts
whose tag, role, class or id says what they are (scripts, menus, headers, footers, sidebars, notices, adverts, forms,
comments) don't count. A class or id says so by a whole name (sidebar) or by one made of such words and words of layout
only (sidebar-left), but not of an article or main element, nor of one that holds most of the page's text, unless an
article or main element with text stands outside it. Each node's composite density is its characters for each tag, adjusted for the characters and
tags in links; its density sum is that of its children's densities. The subtree with the largest sum is the article;
the least density on the way from it up to the body is the threshold that parts beside it must reach to count too.

Edge cases: null and empty pages give the empty text; text without any tag is one block; a page cut off in the middle
is read to its end; references without a semicolon are decoded as browsers do; white space is what Unicode says it is,
no-break spaces too; a line break inside a block is white space; extra columns are ignored; repeated rows repeat.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp svg math template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
P_CLOSERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("article aside body button caption div footer header html main nav section table td th li".split())
NOISE_TAGS = frozenset(
    "script style noscript template head title nav menu footer aside form button select input textarea dialog iframe svg math object embed canvas audio video".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot banner sponsor sponsored sponsors promo promos promotion promoted
    nav navbar navigation navi menu menus topnav subnav sidenav breadcrumb breadcrumbs pagination pager header masthead topbar footer bottom foot
    sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall disclaimer
    comment comments comentarios commentaires kommentare disqus reply replies respond discussion responses share sharing social follow related recommended
    recommendations subscribe subscription newsletter signup login search toolbar tags taglist copyright legal""".split())
LAYOUT_WORDS = frozenset(
    """area bar block box btn button buttons col column container form group icon icons inner item items left link links list main module outer panel
    posts primary right row secondary section site slot top unit wrap wrapper zone""".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=\d)")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "children", "text", "noise", "chars", "tags", "link_chars", "link_tags", "density", "total", "suspect")

    def __init__(self, tag: str, parent: Node | None, noise: bool, suspect: bool = False) -> None:
        self.tag, self.parent, self.noise, self.suspect = tag, parent, noise, suspect
        self.children: list[Node | str] = []
        self.density = self.total = 0.0


def _is_noise(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NOISE_TAGS or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main") and not attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in NOISE_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _is_suspect(tag: str, attributes: str) -> bool:
    """Whether a class or id name consists of a noise word, or of such words and words of layout."""
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            for token in (m[2] or m[3] or m[4] or "").split():
                words = {w for w in SPLIT.split(CAMEL.sub(" ", token).lower()) if w and not w.isdigit()}
                if not NOISE_WORDS.isdisjoint(words) and words <= NOISE_WORDS | LAYOUT_WORDS:
                    return True
    return False


def _drop_suspects(root: Node) -> None:
    """Drops the subtrees that a class or id marks, except what holds most of the text and has no article beside it."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(c for c in n.children if isinstance(c, Node))
    if not any(n.suspect for n in order):
        return
    inside: dict[int, tuple[int, int]] = {}  # characters, and those of them in articles
    for n in reversed(order):
        chars = articles = 0
        for c in n.children:
            if isinstance(c, str):
                chars += len("".join(c.split()))
            else:
                chars += inside[id(c)][0]
                articles += inside[id(c)][1]
        inside[id(n)] = chars, chars if n.tag in ("article", "main") else articles
    chars, articles = inside[id(root)]
    within = {id(root): False}  # whether an article is around it
    for n in order:
        below = within[id(n)] or n.tag in ("article", "main")
        kept: list[Node | str] = []
        for c in n.children:
            if isinstance(c, str):
                kept.append(c)
                continue
            within[id(c)] = below
            mine, in_articles = inside[id(c)]
            if not c.suspect or 2 * mine > chars and (below or articles == in_articles):
                kept.append(c)
        n.children = kept


def parse(page: str) -> Node:
    """The tree of a page, its root a node html. Noise is marked; its text isn't kept."""
    root = Node("html", None, False)
    body = Node("body", root, False)
    root.children.append(body)
    at, stack, depth_noise, in_article = 0, [body], 0, 0

    def pop() -> None:
        nonlocal depth_noise, in_article
        gone = stack.pop()
        depth_noise -= gone.noise
        in_article -= gone.tag in ("article", "main")

    def text(raw: str) -> None:
        if raw and not depth_noise:
            stack[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    for m in iter(lambda: TOKEN.search(page, at), None):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in ("html", "body"):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        pop()
                    break
                if tag in INLINE and stack[i].tag not in INLINE or tag == "p" and stack[i].tag in SCOPE:
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag in P_CLOSERS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    while len(stack) > i:
                        pop()
                    break
                if stack[i].tag in SCOPE:
                    break
        if tag in IMPLIED:
            closes, stops = IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stops:
                    break
                if stack[i].tag in closes:
                    while len(stack) > i:
                        pop()
                    break
        if tag in ("svg", "math") and m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        node = Node(tag, stack[-1], _is_noise(tag, m[3], in_article > 0), _is_suspect(tag, m[3]))
        if not depth_noise and not node.noise:
            stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/") and tag == "path":
            continue
        stack.append(node)
        depth_noise += node.noise
        in_article += tag in ("article", "main")
    text(page[at:])
    _drop_suspects(root)
    return root


def _weigh(root: Node) -> None:
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(c for c in n.children if isinstance(c, Node))
    for n in reversed(order):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for c in n.children:
            if isinstance(c, str):
                n.chars += len("".join(c.split()))
            else:
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
    share = root.link_chars / root.chars if root.chars else 0.0
    for n in order:
        n.density = density(n.chars, n.tags, n.link_chars, n.link_tags, share)
    for n in order:
        # A run of text is a child like others: a leaf without tags or links.
        n.total = sum(c.density if isinstance(c, Node) else density(len("".join(c.split())), 0, 0, 0, share) for c in n.children)


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite density: characters a tag, by a logarithm that falls with the share of characters and tags in links.

    share is that of link characters in the whole page.
    """
    if not chars:
        return 0.0
    tags = max(1, tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    return chars / tags * math.log(max(math.e, chars / max(1, link_chars) * tags / max(1, link_tags))) / base


def _emit(n: Node, blocks: list[list[str]]) -> None:
    todo: list[tuple[Node | str, bool]] = [(n, False)]
    while todo:
        x, closing = todo.pop()
        if isinstance(x, str):
            blocks[-1].append(x)
        elif closing:
            blocks.append([])
        else:
            if x.tag == "br":
                blocks[-1].append(" ")
            elif x.tag not in INLINE:
                blocks.append([])
                todo.append((x, True))
            todo.extend((c, False) for c in reversed(x.children))


def extract(page: str | None) -> str:
    """The article's blocks in page order, one a line."""
    if not page:
        return ""
    root = parse(page)
    _weigh(root)
    body = root.children[0]
    assert isinstance(body, Node)
    best, todo = body, [body]
    while todo:
        n = todo.pop()
        if n.total > best.total and n.tag not in INLINE and n.tag != "p" and n.tag not in HEADINGS:
            best = n
        todo.extend(c for c in n.children if isinstance(c, Node))
    path = [best]
    while path[-1].tag not in ("article", "main") and path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    for n in path:  # an article element around the densest part is the article
        if n.tag == "article":
            best = n
    threshold, n = best.density, best
    above = set()
    while n is not body and n.parent is not None:
        n = n.parent
        above.add(id(n))
        threshold = min(threshold, n.density)
    blocks: list[list[str]] = [[]]

    if best is body:
        _emit(body, blocks)
    stack = [] if best is body else [body]
    while stack:
        n = stack.pop()
        if n is best:
            _emit(n, blocks)
        elif n is body or id(n) in above:
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))
        elif best.tag not in ("article", "main") and (n.tag in HEADINGS or n.density >= threshold) and n.tag not in INLINE:
            _emit(n, blocks)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        text = [extract(x) for x in b["html"]]
        yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(x) for x in text]})


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row a page."""
    slim = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = slim.mapInPandas(_texts, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(pages.schema[id_col].dataType))


def op2_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
