"""Fields of article pages from a tree of their nodes, built by the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.constants import CONTENT_NODES, PAGE_AUTHOR, PARAGRAPH_NODES, VOID_TAGS

_FIELDS = T.StructType([T.StructField(n, T.StringType()) for n in ("body", "title", "summary", "content", "author", "published")])
_HIDDEN = ("script", "style", "template")


class Node:
    __slots__ = ("tag", "attrs", "parent", "items")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []

    def has(self, tag: str, name: str | None, value: str) -> bool:
        """Whether this is such a tag with such an id, or such a class among its classes."""
        if self.tag != tag:
            return False
        found = self.attrs.get(name) or "" if name else ""
        return not name or found == value or (name == "class" and value in found.split())

    def texts(self) -> list[str]:
        """Text nodes directly inside."""
        return [x for x in self.items if isinstance(x, str)]

    def walk(self):
        """All nodes below, in document order; without recursion, as pages nest as deep as they like."""
        todo = [x for x in reversed(self.items) if isinstance(x, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(x for x in reversed(node.items) if isinstance(x, Node))

    def visible(self) -> str:
        """Trimmed texts below, joined by spaces, white space collapsed. Scripts and styles are no text."""
        out, todo = [], list(reversed(self.items))
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                out.append(item)
            elif item.tag not in _HIDDEN:
                todo.extend(reversed(item.items))
        return " ".join(" ".join(out).split())


class _Builder(HTMLParser):
    """Builds the tree. An end tag closes the nearest open node of its name with all inside; others are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {}, None)
        self.pending: list[str] = []

    def _flush(self) -> None:
        if self.pending:
            self.open.items.append("".join(self.pending))
            self.pending = []

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_starttag(self, tag, attrs):
        self._flush()
        given: dict = {}
        for name, value in attrs:
            given[name] = value
        node = Node(tag, given, self.open)
        self.open.items.append(node)
        if tag not in VOID_TAGS:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.open = self.open.parent

    def handle_endtag(self, tag):
        self._flush()
        node = self.open
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.open = node.parent


def tree(html: str) -> Node | None:
    """The nodes of a page; None where the parser rejects it."""
    builder = _Builder()
    try:
        builder.feed(html)
        builder.close()
    except AssertionError:
        return None
    builder._flush()
    return builder.root


def _inside(node: Node, wanted) -> bool:
    node = node.parent
    while node is not None:
        if any(node.has(*w) for w in wanted):
            return True
        node = node.parent
    return False


def fields(html: str | None) -> tuple:
    """body, title, summary, content, author and published of a page; body is None where no content node is found."""
    root = None if html is None else tree(html)
    if root is None:
        return (None,) * 6
    nodes = list(root.walk())
    body = None
    for wanted in CONTENT_NODES:
        node = next((n for n in nodes if n.has(*wanted)), None)
        if node is not None:
            body = node.visible()
            break

    def meta(key: str, value: str) -> str:
        return next((n.attrs.get("content") or "" for n in nodes if n.tag == "meta" and n.attrs.get(key) == value and "content" in n.attrs), "")

    def first(found) -> str:
        return next((t for n in found for t in n.texts()), "")

    title = first(n for n in nodes if n.tag == "h1") or meta("property", "og:title")
    summary = meta("property", "og:description") or meta("name", "description")
    paragraphs = (t.strip() for n in nodes if n.tag == "p" and _inside(n, PARAGRAPH_NODES) for t in n.texts())
    author = meta("name", "author") or first(n for n in nodes if n.has("span", "class", "author-name")) or PAGE_AUTHOR
    return (body, title.strip(), summary.strip(), " ".join(p for p in paragraphs if p), author.strip(),
            meta("property", "article:published_time").strip())


@F.pandas_udf(_FIELDS)
def page_fields(html: pd.Series) -> pd.DataFrame:
    """Struct of fields() for each page; all null where the page is null or is no HTML."""
    return pd.DataFrame([fields(h) for h in html], columns=_FIELDS.names, dtype=object)


def extract_body(html, limit: int | None = 10000) -> Column:
    """Visible text of the preferred content node with all that is nested in it, else of the body.

    ``limit`` is the stored length of the column, None for whole texts.
    """
    text = page_fields(html)["body"]
    return text if limit is None else F.substring(text, 1, limit)
