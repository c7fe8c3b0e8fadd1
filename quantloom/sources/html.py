"""Links and articles from stored HTML pages, read from a parsed tree."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import text as tx
from quantloom.session import ship_package

c = F.col

MIN_BODY_CHARS = 80


# Elements without content, elements that end an open paragraph, parts that are no article text, classes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = frozenset("p div section article ul ol table form figure aside nav h1 h2 h3 h4 h5 h6 blockquote pre header footer main".split())
SKIPPED = frozenset("script style noscript iframe template".split())
ASIDES = frozenset("figure aside nav form".split())
BODY_CLASSES = ("article_content", "article-content", "story-content", "content_wrapper", "content")


class Node:
    """An element with its attributes and children (elements and texts)."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [x for x in reversed(node.children) if isinstance(x, Node)]

    def first(self, tag: str = "", classes: tuple[str, ...] = ()) -> Node | None:
        return next((n for n in self.walk() if (not tag or n.tag == tag) and (not classes or set(classes) & set(n.attrs.get("class", "").split()))), None)

    def text(self, without: frozenset[str] = frozenset()) -> str | None:
        """Text with one space between words; None when empty."""
        parts, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                parts.append(node)
            elif node is self or node.tag not in without:
                todo += reversed(node.children)
        return " ".join(" ".join(parts).split()) or None


class TreeBuilder(HTMLParser):
    """Builds the tree of a page; unclosed and stray tags are tolerated, entities decoded."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("", {})]
        self.skipping = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipping:
            return
        if tag in SKIPPED:
            self.skipping = tag
            return
        if tag in ENDS_PARAGRAPH and self.open[-1].tag == "p":
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            self.skipping = "" if tag == self.skipping else self.skipping
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                break

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.open[-1].children.append(data)


def page_tree(html: str | None) -> Node:
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    return builder.open[0]


@F.udtf(returnType="position int, href string, title string")
class PageLinks:
    """Rows (position, href, title) of a page's links, read from its tree: entities are decoded and nested markup is joined
    with blanks. A link without text is named by its ``title`` attribute; one without either counts, but gives no row."""

    def eval(self, html: str | None) -> Iterator[tuple[int, str, str]]:
        position = -1
        for node in page_tree(html).walk():
            if node.tag == "a" and node.attrs.get("href", "").strip():
                position += 1
                title = node.text() or " ".join(node.attrs.get("title", "").split())
                if title:
                    yield position, node.attrs["href"].strip(), title


def page_links(pages: DataFrame) -> DataFrame:
    """Every link with text of every page: (page_id, base_url, position, href, title), by a lateral join of pages and ``PageLinks``."""
    ship_package(pages.sparkSession)
    asked = pages.select("page_id", c("url").alias("base_url"), c("html").alias("_html"))
    return asked.lateralJoin(PageLinks(c("_html").outer())).drop("_html")


def article_candidates(pages: DataFrame, min_title: int = 12, per_page: int | None = None) -> DataFrame:
    """Probable article links per page (title of at least ``min_title`` characters)."""
    from quantloom.operators.news import candidate_links

    links = page_links(pages).where(F.length("title") >= min_title).withColumn(
        "link", tx.absolutize_url(c("base_url"), c("href")))
    wanted = links.where(tx.is_article_url(c("link"))).select(
        c("page_id").alias("page"), c("link").alias("url"), "position", "title")
    return candidate_links(wanted, per_page)


def headlines(pages: DataFrame) -> DataFrame:
    """Links that look like news headlines."""
    return page_links(pages).where(tx.is_headline_link(c("href"), c("title")))


def first_meta(metas: list[Node], *names: str) -> str | None:
    """Content of the first of the named meta tags that has one."""
    for name in names:
        for m in metas:
            if name in (m.attrs.get("property"), m.attrs.get("name"), m.attrs.get("itemprop")) and m.attrs.get("content", "").strip():
                return m.attrs["content"]
    return None


def body_of(root: Node) -> str | None:
    """Paragraphs of the article element or content box, else its text; at least MIN_BODY_CHARS characters."""
    for box in (root.first("article"), next((n for n in root.walk() if n.tag in ("div", "section") and set(BODY_CLASSES) & set(n.attrs.get("class", "").split())), None)):
        if box is None:
            continue
        asides = {id(x) for n in box.walk() if n.tag in ASIDES for x in n.walk()}
        paragraphs = [n.text(ASIDES) for n in box.walk() if n.tag == "p" and id(n) not in asides]
        for text in ("\n\n".join(p for p in paragraphs if p), box.text(ASIDES) or ""):
            if len(text) >= MIN_BODY_CHARS:
                return text
    return None


def article_of(html: str | None) -> dict[str, object]:
    """Fields of one page: meta tags first, then elements."""
    root = page_tree(html)
    metas = [n for n in root.walk() if n.tag == "meta"]

    def text(*places: Node | None) -> str | None:
        return next((t for t in (p.text() for p in places if p is not None) if t), None)

    time = next((n.attrs["datetime"] for n in root.walk() if n.tag == "time" and n.attrs.get("datetime")), None)
    return {
        "title": first_meta(metas, "og:title", "twitter:title") or text(root.first("h1")),
        "summary": first_meta(metas, "description", "og:description", "twitter:description") or text(root.first("h2")) or text(root.first("", ("summary", "article_summary"))),
        "author": first_meta(metas, "author", "article:author") or text(root.first("", ("author", "article_author"))),
        "published_at": time or first_meta(metas, "article:published_time", "publish-date", "publish_date", "date"),
        "tags": [m.attrs.get("content", "") for m in metas if m.attrs.get("property") == "article:tag"],
        "language": first_meta(metas, "og:locale", "language") or "en",
        "content": body_of(root),
    }


def extract_articles(pages: DataFrame) -> DataFrame:
    """Title, summary, author, date, tags, language and body per page, read from a parsed tree in Arrow batches."""
    kind = "title string, summary string, author string, published_at string, tags array<string>, language string, content string"
    fields = [f.split(" ")[0] for f in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [article_of(h) for h in batch.column("html").to_pylist()]
            cells = [pa.array([r[f] for r in rows], pa.list_(pa.string()) if f == "tags" else pa.string()) for f in fields]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *cells], ["page_id", "url", *fields])

    found = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, {kind}")
    return found.select(
        "page_id", "url", *[tx.clean_text(c(n)).alias(n) for n in ("title", "summary", "author", "published_at")],
        tx.distinct_tags(c("tags")).alias("tags"), "language", "content")
