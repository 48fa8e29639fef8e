"""Main text of web pages, with site templates removed.

A page is parsed once, into elements with implied end tags. Elements that by their tag, role, name
or visibility are menus, headers, footers, side bars, notices, adverts, forms, scripts or reader
comments go. The article is the largest article element, else the main element, else an element
named as content, else the body. Every element of the page, also of those that go by the lists, has a hash of its subtree; Spark
counts beside how many different articles of its host each hash stands, and containers that
several have go as well. Plain paragraphs of an article are never taken for a template, nor is an
element that holds most of it.

Cases: an empty table gives no rows; repeated pages are each reported; a very long page is parsed
whole; of equally long articles the first counts; a null or empty page has no text; malformed markup is read as browsers do in the main
(unclosed elements end with their parent, a stray "<" is text); pages with the same article count
once. A url without a host is a host of its own, the empty one. Columns besides id, url and
html are left out, so their names cannot clash.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A subtree is a template if it stands beside at least so many different articles of a host.
LEAST_PAGES = 5

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed xmp noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
GONE = frozenset("nav footer aside form script style noscript iframe template svg math button select option textarea input label object embed canvas audio video head title dialog menu fieldset noembed noframes xmp datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
#: Names of elements that are not the article, and of elements that are it.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle banner banners breadcrumb breadcrumbs comment comments commentlist disqus respond replies reply cookie cookies consent gdpr footer menu menus nav navbar navigation newsletter notice notices notification pagination pager popup modal overlay promo promos promoted related recommended recommendations share sharing sharebar sidebar sidebars skip social socials sponsor sponsored sponsors subscribe subscription toolbar widget widgets masthead login signup search tags taboola outbrain".split()
)
CONTENT = frozenset("article content main post entry story articlebody".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dt", "dd"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre b i em strong a span u s small sub sup code q cite mark br td th tr tbody li dd dt figcaption".split())
ROOTS = frozenset("html body article main".split())


class Node:
    __slots__ = ("children", "drop", "length", "links", "names", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent, self.children, self.drop, self.names = tag, parent, [], False, frozenset()
        self.length = self.links = 0
        found = {a.lower(): b or c or d or "" for a, b, c, d in ATTRIBUTE.findall(attributes)} if attributes.strip(" /\n\t\r") else {}
        role = found.get("role", "").lower()
        if tag in GONE or role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            self.drop = True
        if found:
            self.names = frozenset(NAME.findall(" ".join((found.get("class", ""), found.get("id", ""), found.get("itemprop", ""))).lower()))
            if role == "main":
                self.names |= {"main"}
        if tag not in ROOTS and self.names & NAMES:
            self.drop = True
        if tag == "header" or tag not in ROOTS and "header" in self.names and not self.names & CONTENT:
            self.drop = True


def parse(page: str) -> Node:
    """The tree of a page: children are nodes and strings of raw text."""
    root = now = Node("#root", None)
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            now.children.append(page[at:])
            break
        if m.start() > at:
            now.children.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                now.children.append(m[0][9:-3])
            continue
        tag = tag.lower()
        if m[1]:
            node = now
            while node is not root and node.tag != tag:
                if node.tag in ("td", "th", "table", "article", "body") and tag not in ("table", "tr", "tbody", "article", "body", "html", "main", "div", "section"):
                    node = root  # an end tag does not reach out of a cell or an article
                    break
                node = node.parent
            if node is not root:
                now = node.parent
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in _path(now)):
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            scope, node = SCOPES.get(tag, ()), now
            ends = SIBLINGS.get(tag, ()) if tag in SIBLINGS else ("p",)
            top = None
            while node is not root and node.tag not in scope and (tag in SIBLINGS or node.tag not in BLOCKS or node.tag == "p"):
                if node.tag in ends:
                    top = node
                node = node.parent
            if top is not None:
                now = top.parent
        node = Node(tag, now, m[3])
        now.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
            stop = close.start() if close else end
            node.children.append(page[at:stop])
            at = close.end() if close else end
        elif tag not in VOID and not m[3].endswith("/"):
            now = node
    return root


def _path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if type(c) is not str)


def _measure(root: Node) -> list[Node]:
    """Text lengths, that of links too, without what goes; nodes in page order."""
    order = list(_walk(root))
    for node in reversed(order):
        for c in node.children:
            if type(c) is str:
                node.length += len(c)
            elif not c.drop:
                node.length += c.length
                node.links += c.links
        if node.tag == "a":
            node.links = node.length
    return order


def article(root: Node) -> Node:
    """The element that holds the article."""
    order = list(_walk(root))
    for node in order:  # what holds an article stays, whatever its name
        if node.tag in ("article", "main") and not any(n.drop for n in (node, *_path(node)) if n.tag in ("article", "main", "aside", "footer", "nav", "form")):
            for n in _path(node.parent):
                n.drop = n.drop and n.tag in GONE
    order = _measure(root)
    alive = [n for n in order if not any(p.drop for p in _path(n) if p.tag not in ("html", "body"))] if any(n.drop for n in order) else order
    for pick in (lambda n: n.tag == "article", lambda n: n.tag == "main" or "main" in n.names and n.tag != "body", lambda n: n.tag in ("div", "section", "td") and bool(n.names & CONTENT)):
        if found := [n for n in alive if pick(n) and n.length > n.links]:
            return max(found, key=lambda n: n.length)
    return next((n for n in alive if n.tag == "body"), root)


def _headings(node: Node) -> bool:
    return any(n.tag in ("h1", "h2", "h3") for n in _walk(node))


def _hashes(root: Node, top: Node, host: str) -> tuple[list[Node], list[int], int]:
    """All elements with text and the hashes of their subtrees within a host, and the article's own."""
    own: dict[int, bytes] = {}
    nodes: list[Node] = []
    for node in reversed(list(_walk(root))):
        parts = [own[id(c)] if type(c) is not str else " ".join(c.split()).encode("utf-8", "surrogatepass") for c in node.children]
        own[id(node)] = xxhash.xxh64_digest(b"\0".join((node.tag.encode(), *parts))) if any(parts) else b""
        if own[id(node)]:
            nodes.append(node)
    seed = xxhash.xxh32_intdigest(host)
    return nodes, [xxhash.xxh64_intdigest(own[id(n)] + host.encode(), seed) - (1 << 63) for n in nodes], xxhash.xxh64_intdigest(own[id(top)]) - (1 << 63)


def subtrees(page: str | None, host: str) -> tuple[list[int], int]:
    """The distinct hashes of a page's elements, and that of its article."""
    if not page:
        return [], 0
    root = parse(page)
    _, hashes, mark = _hashes(root, article(root), host)
    return sorted(set(hashes)), mark


def blocks(page: str | None, host: str = "", templates: np.ndarray | None = None) -> tuple[list[str]]:
    """The blocks of the article, without the containers whose hashes are among the (sorted) templates of all hosts."""
    if not page:
        return ([],)
    root = parse(page)
    top = article(root)
    marked = top.tag not in ("body", "#root")
    if templates is not None and len(templates):
        nodes, hashes, _ = _hashes(root, top, host)
        at = np.searchsorted(templates, hashes)
        at[at == len(templates)] = 0
        for k in np.flatnonzero(templates[at] == np.array(hashes, dtype=np.int64)).tolist():
            node = nodes[k]
            if node is not top and node.tag in BLOCKS - ROOTS and (not marked or node.tag not in PROSE and 2 * node.length < top.length):
                node.drop = True
    texts: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            texts.append(text)

    # Depth first, without recursion, as pages may nest deeply: (node, next child).
    stack = [(top, 0)]
    while stack:
        node, k = stack.pop()
        if k == 0 and node.tag in BLOCKS:
            flush()
        while k < len(node.children):
            c = node.children[k]
            k += 1
            if type(c) is str:
                held.append(c)
            elif c.tag == "br" or c.tag == "wbr":
                held.append(" " if c.tag == "br" else "")
            elif c.tag == "header" and marked and _headings(c) and c.drop and not c.names & NAMES:
                flush()
                for h in _walk(c):
                    if h.tag in ("h1", "h2", "h3"):
                        held.extend(x for n in _walk(h) for x in n.children if type(x) is str)
                        flush()
            elif not c.drop and (marked or c.tag not in ("ul", "ol", "div", "section", "table") or c.links <= 0.6 * max(1, c.length) or c.length == 0):
                stack.append((node, k))
                stack.append((c, 0))
                break
        else:
            if node.tag in BLOCKS:
                flush()
    flush()
    return (texts,)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url and text of every page."""
    spark = pages.sparkSession
    scratch = common.Scratch(spark, "html")
    kind = pages.schema[key].dataType.simpleString()
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    own = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).withColumn("host", host)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                made = [subtrees(p, h) for p, h in zip(part.column("html").to_pylist(), part.column("host").to_pylist(), strict=True)]
                size = [len(m[0]) for m in made]
                at = np.repeat(np.arange(len(made)), size)
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(at)), pa.array([h for m in made for h in m[0]], pa.int64()), pa.array(np.repeat(np.array([m[1] for m in made], dtype=np.int64), size))], names=["row", "hash", "article"])

    found = lambda df: df.select("row", "html", "host").mapInArrow(mark, "row long, hash long, article long")
    each = found(own.withColumn("row", F.lit(0).cast("long"))).select("hash", "article").distinct()
    template = scratch.table(each.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_PAGES).select("hash"), "template")
    few = template.count() <= common.BROADCAST_KEYS
    if few:
        sent = spark.sparkContext.broadcast(np.sort(template.toArrow().column("hash").to_numpy()))
        own = own.withColumn("lost", F.lit(None).cast("array<long>"))
    else:
        sent = None
        own = scratch.table(own.withColumn("row", F.monotonically_increasing_id()), "pages")
        own = own.join(found(own).join(template, "hash").groupBy("row").agg(F.collect_list("hash").alias("lost")), "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lost = [sent.value] * part.num_rows if few else [np.sort(np.array(x or [], dtype=np.int64)) for x in part.column("lost").to_pylist()]
                texts = ["\n".join(blocks(p, h, x)[0]) for p, h, x in zip(part.column("html").to_pylist(), part.column("host").to_pylist(), lost, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("url"), pa.array(texts, pa.string())], names=["key", "url", "text"])

    return own.select("key", "url", "html", "host", "lost").mapInArrow(run, f"key {kind}, url string, text string").withColumnRenamed("key", key)
