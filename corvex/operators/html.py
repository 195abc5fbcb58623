"""HTML to clean markdown without third-party parsers, links, and clean-up of markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls as U
from ..functions.text import word_count
from ..sources.storage import small_batches

# Elements that are no content.
NOISE_TAGS = {"nav", "header", "footer", "aside", "starlight-menu-button"}
NOISE_CLASSES = {"sidebar", "navbar", "nav", "toc", "breadcrumb", "on-this-page", "pagination", "prev-next", "edit-page", "sl-sidebar", "sl-nav"}
NOISE_IDS = {"sidebar", "nav", "header", "footer"}
NOISE_ATTRS = {("role", "navigation"), ("role", "banner"), ("role", "contentinfo"), ("aria-label", "On this page")}
NOISE_FLAGS = {"data-pagefind-ignore"}
# Elements dropped within the content, and classes of content, best first.
DROPPED = {"script", "style", "svg", "button", "noscript"}
CONTENT_CLASSES = ["sl-markdown-content", "content-panel", "markdown-body", "prose"]

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "li", "table", "tr", "blockquote", "pre", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "body"}
CLOSES_P = BLOCKS - {"body"}


class Node:
    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        parts, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                todo += reversed(node.children)
        return "".join(parts)

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())


class Tree(HTMLParser):
    """A forgiving tree: unclosed paragraphs and list items end where their like or a block begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and self.at.tag == "p":
            self.at = self.at.parent
        if tag == "li" and self.at.tag == "li":
            self.at = self.at.parent
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _is_noise(n: Node) -> bool:
    return n.tag in NOISE_TAGS or bool(n.classes() & NOISE_CLASSES) or n.attrs.get("id") in NOISE_IDS or any(n.attrs.get(k) == v for k, v in NOISE_ATTRS) or any(k in n.attrs for k in NOISE_FLAGS)


def _prune(root: Node, unwanted) -> None:
    for node in root.walk():
        node.children = [c for c in node.children if isinstance(c, str) or not unwanted(c)]


def content_of(root: Node) -> Node:
    """The first kind of content element that there is; of articles the one with most text."""
    nodes = list(root.walk())
    wanted = [*(lambda n, c=c: c in n.classes() for c in CONTENT_CLASSES), lambda n: n.attrs.get("id") == "content", lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main"]
    for test in wanted:
        for n in nodes:
            if test(n):
                return n
    articles = [n for n in nodes if n.tag == "article"]
    if articles:
        return max(articles, key=lambda n: len(n.text()))
    return next((n for n in nodes if n.tag == "body"), root)


def _rendered(c: Node, inner: str, cells: list[str], depth: int) -> str:
    """A node as markdown, from that of its content, and of its cells if it is a row; depth: lists around its content."""
    t = c.tag
    if re.fullmatch("h[1-6]", t):
        return f"\n\n{'#' * int(t[1])} {inner.strip()}\n\n"
    if t == "a" and c.attrs.get("href") and inner.strip():
        return f"[{inner.strip()}]({c.attrs['href']})"
    if t in ("strong", "b") and inner.strip():
        return f"**{inner.strip()}**"
    if t in ("em", "i") and inner.strip():
        return f"*{inner.strip()}*"
    if t == "code" and c.parent.tag != "pre":
        return f"`{inner.strip()}`"
    if t == "pre":
        return f"\n\n```\n{c.text().strip()}\n```\n\n"
    if t == "br":
        return "  \n"
    if t == "hr":
        return "\n\n---\n\n"
    if t == "li":
        return f"{'  ' * max(0, depth - 1)}- {inner.strip()}\n"
    if t == "tr":
        return "| " + " | ".join(cells) + " |\n"
    if t == "blockquote":
        return "\n\n> " + inner.strip().replace("\n", "\n> ") + "\n\n"
    return f"\n\n{inner.strip()}\n\n" if t in BLOCKS else inner


def _markdown(root: Node) -> str:
    """The content of a node as markdown, without recursion: pages nest as deep as they like."""
    frames = [(root, 0, iter(root.children), [], [])]  # node, lists around its content, children to come, parts, cells
    while True:
        node, depth, children, out, cells = frames[-1]
        c = next(children, None)
        if c is None:
            frames.pop()
            inner = "".join(out)
            if not frames:
                return inner
            parent = frames[-1]
            if node.tag in ("td", "th") and parent[0].tag == "tr":
                parent[4].append(inner.strip())
            parent[3].append(_rendered(node, inner, cells, parent[1]))
        elif isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
        elif c.tag not in DROPPED and c.tag != "img":
            in_row = c.tag in ("td", "th") and node.tag == "tr"  # lists in a cell count from there
            frames.append((c, 0 if in_row else depth + (c.tag in ("ul", "ol")), iter(c.children), [], []))


# A line that is a link alone; a heading of a table of contents; a line that is a link, in the fallback.
LINK_LINE = r"^\s*\[([^\]]{1,80})\]\([^)]+\)\s*$"
CONTENTS_HEADING = r"(?i)^#+[\x09-\x0d\x1c-\x20\x{85}\p{Z}]*(on this page|table of contents|contents)"
SHORT_LINK_LINE = r"^\[.{1,40}\]\(.*\)$"
#: Words below which the content is taken to have been missed.
LEAST_WORDS = 30


def clean_markdown_of(html: str) -> str:
    root = parse(html)
    _prune(root, _is_noise)
    main = content_of(root)
    _prune(main, lambda n: n.tag in DROPPED)
    lines = [line.strip() if not line.strip() else line.rstrip() for line in _markdown(main).split("\n")]
    lines = [line for line in lines if not re.match(LINK_LINE, line.strip())]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def title_of(html: str) -> str:
    return next((n.text().strip() for n in parse(html).walk() if n.tag == "title"), "")


def _pages(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"title": [title_of(h) for h in html], "markdown": [clean_markdown_of(h) for h in html]})


#: struct<title, markdown> of a column of HTML.
extract_page = F.pandas_udf(_pages, T.StructType([T.StructField("title", T.StringType()), T.StructField("markdown", T.StringType())]))


def page_title(title: Column, path: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(path, F.lit("")), url)


def clean_fallback(md: Column) -> Column:
    """Markdown without link-only lines and without sections headed as a table of contents."""
    head = r"^#+[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
    lines = F.filter(F.split(md, "\n"), lambda s: ~F.trim(s).rlike(SHORT_LINK_LINE))
    zero = F.struct(F.array().cast("array<string>").alias("o"), F.lit(False).alias("skip"))

    def step(a, s):
        toc = s.rlike(CONTENTS_HEADING)
        skip = F.when(toc, True).when(s.rlike(head), False).otherwise(a["skip"])
        return F.struct(F.when(skip, a["o"]).otherwise(F.array_append(a["o"], s)).alias("o"), skip.alias("skip"))

    kept = F.array_join(F.aggregate(lines, zero, step, lambda a: a["o"]), "\n")
    return F.regexp_replace(F.btrim(kept, F.lit(" \n\t")), r"\n{3,}", "\n\n")


# Elements without text of the page; elements that end a line; entities, the ampersand last.
SILENT = ("script", "style", "noscript", "svg", "title", "head")
LINE_TAGS = ("p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "ul", "ol", "table", "tr", "blockquote", "pre", "h[1-6]", "br")
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def raw_markdown(html: Column) -> Column:
    """All text of a page, its navigation included, by built-in functions: headings, items, links and line
    ends are marked, other tags go. A page without tags is its text; null stays null."""
    md = html
    for tag in SILENT:
        md = F.regexp_replace(md, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    md = F.regexp_replace(F.regexp_replace(md, r"(?s)<!--.*?-->", " "), r"[\x09-\x0d\x20]+", " ")
    md = F.regexp_replace(md, r'(?i)<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', "[$2]($1)")
    for n in range(1, 7):
        md = F.regexp_replace(md, rf"(?i)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ")
    md = F.regexp_replace(md, r"(?i)<li\b[^>]*>", "\n- ")
    md = F.regexp_replace(md, rf"(?i)</?({'|'.join(LINE_TAGS)})\b[^>]*>", "\n")
    md = F.regexp_replace(md, "<[^>]*>", "")
    for name, char in ENTITIES.items():
        md = F.replace(md, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(F.regexp_replace(md, " *\n *", "\n"), "\n{3,}", "\n\n"), F.lit(" \n"))


def page_markdown(markdown: Column, html: Column) -> Column:
    """The markdown of a page's content; of fewer than LEAST_WORDS words, or null, all text of the page, cleaned, if there is any."""
    raw = F.coalesce(raw_markdown(html), F.lit(""))
    few = F.coalesce(word_count(markdown), F.lit(0)) < LEAST_WORDS
    return F.when(few & (raw != ""), clean_fallback(raw)).otherwise(F.coalesce(markdown, F.lit("")))


def extracted(pages: DataFrame, fallback: bool = True) -> DataFrame:
    """pages (url, html, others) with title and markdown in place of html; without fallback, of the page's content alone."""
    small_batches(pages.sparkSession)
    x = pages.withColumn("__x", extract_page("html"))
    markdown = page_markdown(F.col("__x.markdown"), F.col("html")) if fallback else F.col("__x.markdown")
    title = page_title(F.col("__x.title"), U.path(F.col("url")), F.col("url"))
    return x.withColumn("title", title).withColumn("markdown", markdown).drop("__x", "html")


def table_markdown(caption: Column, headers: Column, rows: Column) -> Column:
    """Caption as a heading, header row, separator, rows; what is missing is left out."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    none = F.array().cast("array<string>")
    parts = F.concat(
        F.when(F.coalesce(caption, F.lit("")) != "", F.array(F.concat(F.lit("\n### "), caption, F.lit("\n")))).otherwise(none),
        F.when(F.size(headers) > 0, F.array(line(headers), F.concat(F.lit("|"), F.array_join(F.transform(headers, lambda _: F.lit(" --- |")), "")))).otherwise(none),
        F.transform(rows, line),
    )
    return F.array_join(parts, "\n")


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*href="([^"]*)\""""), F.lit(1))
