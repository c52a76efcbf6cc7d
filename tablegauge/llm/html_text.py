"""Main text of web pages with site templates removed.

Every element subtree of a page has a hash. Spark counts, for each host, beside how many different contents a subtree
occurs: copies of a page have the same rest and count once, so what recurs only within copies stays. Subtrees that recur
beside enough different contents of their host are template, however large the host is: they are deleted. Elements
that are never article text by their meaning (navigation, footers, scripts, forms, comments and so on) go as well, also
on hosts with a single page. Paragraphs, headings and other blocks of prose inside the article element of a page are what
readers came for; they stay however often a host repeats them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.shared import pick, staged

# A subtree is template when it is on at least this many pages of its host that differ in what else they show, and beside
# this many different rests of the main text.
LEAST_PAGES = 5
LEAST_TEXTS = 2
REMEMBERED = 500_000  # subtrees whose rests a task remembers, so as not to send them again
LEAST_LENGTH = 1  # characters of text, an image or link alone has none and leaves none

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
NEVER = frozenset("""script style template noscript iframe head title nav footer aside form button select option input
textarea label fieldset svg math canvas object embed audio video dialog menu datalist""".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary
table tbody td tfoot th thead tr ul caption""".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup"}
# Elements that end when a sibling of the named kinds begins, up to the container in the second place.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
            "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
# Words of class, id and role that name parts beside the article.
BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|sidebar\w*|side|footer|header|masthead|breadcrumbs?"
    r"|cookies?|consent|notice|notices|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social"
    r"|comments?|respond|disqus|related|recommend\w*|widget\w*|toolbar|pagination|pager|search|complementary|contentinfo"
    r"|navigation|alert|hidden|skip)(?:$|[\s_-])", re.I)
SPACE = re.compile(r"\s+")
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)"
                 r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


@dataclass
class Element:
    tag: str
    attributes: str = ""
    parent: "Element | None" = None
    children: list["Element | str"] = field(default_factory=list)
    digest: int = 0
    article: bool = False  # within the article of the page
    prose: bool = False  # within a block of prose of the article
    shown: bool = False  # neither it nor anything around it is beside the text by its meaning
    read: bool = False  # a part of what the main text is taken from
    said: bool = False  # has text of its own or below it
    whole: int = 0  # sum of the hashes of shown texts in it
    main: int = 0  # and of those of the main text

    def named(self) -> list[str]:
        return [(value or "").strip("\"'") for name, value in ATTRIBUTE.findall(self.attributes)
                if name.lower() in ("class", "id", "role")]

    def beside(self) -> bool:
        """Not article text by its own meaning."""
        if self.tag in NEVER or self.tag == "header" and not self.article:
            return True
        if not self.attributes or self.tag in ("html", "body", "article", "main"):
            return False
        low = self.attributes.lower()
        if "hidden" in low and (re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", low) or "aria-hidden=\"true\"" in low):
            return True
        return any(BESIDE.search(value) for value in self.named()) and self.tag not in PROSE - {"li"}


def parse(html: str) -> Element:
    """Tree of a page; missing end tags are implied, as browsers do. Character references stay in the text."""
    root = node = Element("#root")
    at, end = 0, len(html)
    while at < end:
        found = TAG.search(html, at)
        if found is None:
            node.children.append(html[at:])
            break
        if found.start() > at:
            node.children.append(html[at:found.start()])
        at = found.end()
        cdata, closing, opening, attributes = found.groups()
        if cdata:
            node.children.append(cdata.replace("&", "&amp;"))
        elif closing:
            tag, up = closing.lower(), node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
        elif opening:
            tag = opening.lower()
            if tag in CLOSES_P:
                up = node
                while up is not root and up.tag not in ("p", "button", "td", "th", "li", "div", "article", "section", "body"):
                    up = up.parent
                if up.tag == "p":
                    node = up.parent
            if tag in SIBLINGS:
                ends, stops = SIBLINGS[tag]
                up, last = node, None
                while up is not root and up.tag not in stops:
                    last = up if up.tag in ends else last
                    up = up.parent
                if last is not None:
                    node = last.parent
            child = Element(tag, attributes.rstrip("/"), node, article=node.article or tag in ("article", "main"),
                            prose=node.prose or node.article and node.tag in PROSE)
            node.children.append(child)
            if tag in RAW:
                close = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(html, at)
                child.children.append(html[at:close.start() if close else end])
                at = end if close is None else html.find(">", close.start()) + 1 or end
            elif tag not in VOID and not attributes.endswith("/"):
                node = child
    return root


def hashed(root: Element) -> list[Element]:
    """All elements, each with the hash of its tag, its classes and all below it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [child for child in node.children if isinstance(child, Element)]
    for node in reversed(order):
        parts = [node.tag, *node.named()] if node.attributes else [node.tag]
        parts += [f"\x01{child.digest}" if isinstance(child, Element) else SPACE.sub(" ", child) for child in node.children]
        node.digest = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - 2**63
    return order[1:]


def removable(node: Element) -> bool:
    """Whether recurrence may delete an element: not the page's frame; in an article only blocks that are not prose, hold
    none and are in none."""
    if node.tag in ("html", "body", "article", "main", "#root"):
        return False
    return not node.article or node.tag in BLOCK - PROSE and not node.prose and not any(
        isinstance(child, Element) and child.tag in PROSE for child in node.children)


def main_text(root: Element, template: frozenset[int]) -> str:
    """Blocks in page order, one a line; white space within a block is one space."""
    blocks: list[str] = []
    line: list[str] = []
    frame = root
    articles, stack = [], [root]
    while stack:  # the article is the page when there is one
        node = stack.pop()
        if node.tag in ("article", "main"):
            articles.append(node)
        elif not node.beside():
            stack += [child for child in reversed(node.children) if isinstance(child, Element)]

    def close() -> None:
        text = SPACE.sub(" ", unescape("".join(line))).strip()
        if text:
            blocks.append(text)
        line.clear()

    for frame in articles or [root]:
        work: list[Element | str | None] = [frame]
        while work:
            node = work.pop()
            if node is None:
                close()
            elif isinstance(node, str):
                line.append(node)
            elif node.tag == "br":
                line.append("\n")
            elif node is frame or not (node.beside() or node.digest in template and removable(node)):
                if node.tag in BLOCK:
                    close()
                    work.append(None)
                work += reversed(node.children)
        close()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), HOST, 1))


def weigh(root: Element, order: list[Element]) -> None:
    """Mark what a page shows and what its main text is read from, and sum up the hashes of the texts in every element."""
    articles, outside, inside, stack = [], [], [], [root]
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main"):
            articles.append(node)
        elif not node.beside():
            outside.append(node)
            stack += [child for child in node.children if isinstance(child, Element)]
    for article in articles:
        inside.append(article)
        stack = [child for child in article.children if isinstance(child, Element)]
        while stack:
            node = stack.pop()
            if not node.beside():
                inside.append(node)
                stack += [child for child in node.children if isinstance(child, Element)]
    for node in outside:
        node.shown, node.read = True, not articles
    for node in inside:
        node.shown = node.read = True
    for node in [*reversed(order), root]:
        for child in node.children:
            if isinstance(child, str) and (text := SPACE.sub(" ", child).strip()):
                node.said = True
                if node.shown:
                    weight = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
                    node.whole += weight
                    node.main += weight if node.read else 0
        if node.parent is not None:
            node.parent.said |= node.said
            node.parent.whole += node.whole
            node.parent.main += node.main


def signed(number: int) -> int:
    return number % 2**64 - 2**63


def key(host: str, digest: int) -> int:
    """One number for a subtree of a host."""
    return signed(xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass"), digest % 2**64))


def rests(host: str, html: str) -> list[tuple[int, int, int, bool]]:
    """For each distinct subtree of a page that recurrence may delete: its key, hashes of what else the page shows and of
    what else its main text has, and whether the main text is read from it. Subtrees without text have nothing to delete."""
    root = parse(html)
    order = hashed(root)
    weigh(root, order)
    found: dict[int, tuple[int, int, bool]] = {}
    for node in order:
        if node.said and node.tag not in NEVER and removable(node):
            whole, main, read = found.get(node.digest, (root.whole, root.main, False))
            found[node.digest] = whole - node.whole, main - node.main, read or node.read
    return [(key(host, digest), signed(whole), signed(main), read) for digest, (whole, main, read) in sorted(found.items())]


def subtrees(pages: DataFrame) -> DataFrame:
    """Stored rows of key, whole and main as in ``rests``; with the page where its main text is read from the subtree.

    The others only count: a task sends no more of them than can matter for a subtree.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, tuple[set[int], set[int]]] = {}
        for batch in batches:
            made: list[tuple[int, int, int, int | None]] = []
            for page, host, html in zip(*(column.to_pylist() for column in batch.columns)):
                if len(sent) > REMEMBERED:
                    sent.clear()
                for subtree, whole, main, read in rests(host, html or ""):
                    if read:
                        made.append((subtree, whole, main, page))
                        continue
                    wholes, mains = sent.setdefault(subtree, (set(), set()))
                    if len(wholes) < LEAST_PAGES and whole not in wholes or len(mains) < LEAST_TEXTS and main not in mains:
                        wholes.add(whole)
                        mains.add(main)
                        made.append((subtree, whole, main, None))
            columns = zip(*made) if made else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "whole", "main", "page"])

    return staged(pages.select("page", "host", "html").mapInArrow(run, "key long, whole long, main long, page long"), "subtrees")


def templates(found: DataFrame) -> DataFrame:
    """Keys of the subtrees that are template, by counts that do not depend on how many pages a host has."""
    each = found.groupBy("key", "whole").agg(F.min("main").alias("low"), F.max("main").alias("high"))
    counted = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return counted.where((F.col("n") >= LEAST_PAGES) & (F.col("low") != F.col("high"))).select("key")


def extract(pages: DataFrame, salts: int = 64) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text.

    NULL and empty html give an empty text. Pages without a host share the empty one. Repeated rows are pages of their
    own and get the same text; no rows give no rows. Other columns are ignored, whatever their names.
    """
    rows = pick(pages, "page_id", "url", "html").withColumn("host", host_of(F.col("url"))).withColumn(
        "page", F.xxhash64("page_id", "url", "html"))
    seen = subtrees(rows)
    # A menu may be on a third of all pages: its rows meet one of many copies of its key.
    spread = templates(seen).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    read = seen.where("page is not null").select("page", "key").withColumn("salt", F.pmod("page", F.lit(salts)).cast("int"))
    found = staged(read.join(spread, ["key", "salt"]).groupBy("page").agg(F.collect_set("key").alias("template")), "templates")
    page_kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, html, template in zip(*(column.to_pylist() for column in batch.columns[2:])):
                root = parse(html or "")
                deleted = set(template or ())
                texts.append(main_text(root, frozenset(node.digest for node in hashed(root) if key(host, node.digest) in deleted)
                                       if deleted else frozenset()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    if found.isEmpty():
        joined = rows.withColumn("template", F.lit(None).cast("array<long>"))
    else:
        joined = rows.join(found.hint("merge"), "page", "left")
    joined = joined.select("page_id", "url", "host", "html", "template")
    return joined.mapInArrow(run, f"page_id {page_kind}, url string, text string")
