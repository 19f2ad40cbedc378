"""Main-text extraction by tree scoring.

A page becomes a light tree. Every paragraph gives points for its length and its commas to its parent, and half of
them to its grandparent; a container's points are discounted by its link density. The container with most points is the
start; while the element around it holds clearly more paragraph points, that one takes its place, up to an ``article``, ``main`` or the
body. The best is kept, with siblings that are text: headings, bare text, and blocks that aren't mostly links.
Scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms and comment sections are cut from the tree
first, by element and by the names in class, id and role. A name is judged by its last word (``post-footer`` is a footer), or by a first word that
qualifies it (``cookie-notice``); names of a state (``with-sidebar``, ``has-comments``) say nothing. Where the names of one element disagree it stays if it holds most of
the page's text, and a page that names alone would empty is read again without them.

One narrow pass: no shuffle, no state beyond a page.

Edge cases: null and empty pages, and pages without text, give an empty text; broken markup is closed much as
browsers do (a paragraph ends at the next block, a list item at the next one, ``<div/>`` opens a div); an unclosed script or comment ends with the page; repeated rows are handled each by itself; other input columns
are ignored. Nothing is capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import table, tune

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|object|select|math|title)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
ATTR = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag of the key ends an open element of the set.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"br", "body", "html"}
CUT = frozenset("nav header footer aside form button dialog menu head".split())
#: Last words of names of what is no part of an article.
CUT_HEADS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsors promo promos promotion banner menu menus nav navbar navi navigation breadcrumb breadcrumbs sidebar aside comment comments commentlist disqus reply replies respond footer foot header masthead cookie cookies consent notice notices alert alerts gdpr popup modal newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets pager pagination toolbar search outbrain taboola contentinfo complementary".split())
#: First words that say the same of whatever follows.
CUT_FIRSTS = frozenset("ad ads advert sponsored sponsor promo cookie cookies consent gdpr newsletter related recommended share social breadcrumb comment comments sidebar footer nav navigation menu popup modal subscribe signup login".split())
KEEP_HEADS = frozenset("article articles content contents entry main post story text body hentry articlebody".split())
#: Words that add nothing to the word before them, and those that begin the name of a state.
VAGUE = frozenset("wrapper wrap container box block section area list inner outer item items bar panel links top bottom left right".split())
STATES = frozenset("with has no is without not hide show".split())
NAME = re.compile(r"[a-z]+|[0-9]+", re.I)


def named(words: str) -> tuple[bool, bool]:
    """(names something to be cut, names something to be kept), of the names in class, id and role."""
    cut = keep = False
    for token in words.split():
        parts = [w.lower() for w in NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token))]
        if parts[-2:] == ["side", "bar"]:
            cut = True
            continue
        while len(parts) > 1 and (parts[-1] in VAGUE or parts[-1].isdigit()):
            parts.pop()
        if not parts or parts[0] in STATES:
            continue
        if parts[-1] in CUT_HEADS:
            cut = True
        elif parts[-1] in KEEP_HEADS and parts[0] not in CUT_FIRSTS:
            keep = True
        elif parts[0] in CUT_FIRSTS:
            cut = True
    return cut, keep


BASE = {"article": 25, "main": 15, "section": 5, "div": 5, "blockquote": 3, "pre": 3, "td": 3, "ul": -3, "ol": -3, "dl": -3, "form": -3, "th": -5}
LEAST = 25


class Node:
    __slots__ = ("tag", "parent", "kids", "cut", "kept", "torn", "points", "own", "total", "chars", "link")

    def __init__(self, tag, parent, attrs="", by_name=True):
        self.tag, self.parent, self.kids, self.points, self.own, self.total, self.chars, self.link = tag, parent, [], None, 0.0, 0.0, 0, 0
        self.cut, self.kept, self.torn = tag in CUT, False, False
        if attrs and not self.cut and tag not in ("html", "body"):
            cut, self.kept = named(" ".join(a or b or c for a, b, c in ATTR.findall(attrs)))
            cut = cut and by_name and tag not in ("article", "main")
            self.torn = cut and self.kept
            self.cut = bool(HIDDEN.search(attrs)) or cut and not self.kept


def tree(page: str, by_name: bool = True) -> Node:
    root = at = Node("html", None)
    last = 0
    for m in TOKEN.finditer(page):
        if m.start() > last:
            at.kids.append(page[last : m.start()])
        last = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if m[2]:
            up = at
            while up is not None and up.tag != name:
                up = up.parent
            if up is not None and up.parent is not None:
                at = up.parent
            elif name in BLOCK:
                at.kids.append(Node("br", at))
            continue
        if name in CLOSES_P or name in ENDS:
            up, ended = at, ENDS.get(name, ())
            while up.parent is not None and up.tag not in ("article", "section", "div", "table", "ul", "ol", "dl", "td", "body", "main", "nav", "footer", "header", "aside", "blockquote") or up.tag in ended:
                if up.tag == "p" and name in CLOSES_P or up.tag in ended:
                    at = up.parent
                    if up.tag == "p" or name != "tr":
                        break
                if up.parent is None:
                    break
                up = up.parent
        if name in ("html", "body") and name == "html":
            continue
        node = Node(name, at, m[4], by_name)
        at.kids.append(node)
        if name not in VOID:
            at = node
    if last < len(page):
        at.kids.append(page[last:])
    return root


def walk(root: Node) -> Iterator[Node]:
    """Uncut nodes, parents first."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(k for k in reversed(node.kids) if type(k) is Node and not k.cut)


def score(root: Node) -> list[Node]:
    """Fills chars and link of all nodes and the points of containers; returns the containers."""
    nodes, containers = list(walk(root)), []
    own = {}
    for node in reversed(nodes):  # children first
        text = "".join(k for k in node.kids if type(k) is str)
        n = len(text.strip())
        node.chars += n
        own[id(node)] = text
        if node.tag == "a":
            node.link = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link += node.link
    for node in nodes:
        # a paragraph: p, pre and the like, or any block with text of its own
        if node.tag not in BLOCK or node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            continue
        direct = len(own[id(node)].strip())
        inline = [k for k in node.kids if type(k) is Node and not k.cut and k.tag not in BLOCK]
        length = node.chars if node.tag in ("p", "pre", "blockquote") else direct + sum(k.chars for k in inline)
        if length < LEAST:
            continue
        commas = own[id(node)].count(",") + sum("".join(x for x in k.kids if type(x) is str).count(",") for k in inline)
        points = (1 + commas + min(length / 100, 3)) * (1 - min(1.0, node.link / max(1, node.chars)))
        up = [node.parent, node.parent.parent if node.parent else None] if node.tag in ("p", "pre", "blockquote", "li", "td", "dd") else [node, node.parent]
        for box, share in zip(up, (1.0, 0.5)):
            if box is not None:
                if box.points is None:
                    box.points = BASE.get(box.tag, 0) + 25 * box.kept
                    containers.append(box)
                box.points += points * share
        node.own = points
    for node in reversed(nodes):
        node.total += node.own
        if node.parent is not None:
            node.parent.total += node.total
    for box in containers:
        box.points *= 1 - min(1.0, box.link / max(1, box.chars))
    return containers


def blocks(node: Node, out: list[str]) -> None:
    """Appends the node's text, with blanks at the edges of blocks."""
    todo: list = [node]
    while todo:
        k = todo.pop()
        if type(k) is str:
            out.append(k)
        elif not k.cut:
            if k.tag in BLOCK:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(k.kids))


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: An element takes the place of its best child if it holds so many times the child's paragraph points.
CLIMB = 1.05
LINK_BLOCKS = frozenset("div section ul ol dl table center".split())


def belongs(k) -> bool:
    """Whether something beside the best container is text: bare text, a heading, or a block that isn't mostly links."""
    return type(k) is str or not k.cut and (k.tag in HEADINGS or k.link < 0.5 * max(1, k.chars))


def main_text(page: str | None) -> str:
    """The text of a page's best container and what belongs to it."""
    if not page:
        return ""
    return text_of(tree(page)) or text_of(tree(page, False))


def text_of(root: Node) -> str:
    containers = score(root)
    if torn := [n for n in walk(root) if n.torn and n.total < 0.5 * root.total]:
        for n in torn:
            n.cut = True
        for n in walk(root):
            n.points, n.own, n.total, n.chars, n.link = None, 0.0, 0.0, 0, 0
        containers = score(root)
    if containers:
        start = best = max(containers, key=lambda b: b.points)
        up = best
        while up.tag not in ("article", "main", "body") and up.parent is not None:
            up = up.parent
            if up.total >= CLIMB * best.total and up.tag not in ("body", "html"):
                best = up
        # blocks of links beside the start, on the way up, aren't text
        while start is not best:
            start = start.parent
            for k in start.kids if start.tag not in ("article", "main") else ():
                if type(k) is Node and k.tag in LINK_BLOCKS and not belongs(k):
                    k.cut = True
        if best.parent is None or best.tag in ("main", "body"):
            around = [best]
        elif best.tag == "article":
            least = max(10, 0.2 * (best.points or 0))
            around = [k for k in best.parent.kids if k is best or type(k) is Node and k.tag == "article" and not k.cut and (k.points or 0) >= least]
        else:
            around = [k for k in best.parent.kids if k is best or belongs(k)]
    else:
        around = [next((n for n in walk(root) if n.tag == t), None) for t in ("article", "main", "body")]
        around = [next((n for n in around if n is not None), root)]
    out: list[str] = []
    for k in around:
        blocks(k, out)
    return " ".join(unescape("".join(out)).split())


def extract(pages: DataFrame) -> DataFrame:
    tune(pages.sparkSession)
    df = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": pd.Series(map(len, text), index=b.index, dtype="int64")})

    return df.mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
