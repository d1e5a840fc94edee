"""Web pages by a tree of nodes, to compare with: title, metadata, links, headings and text, by the standard library's parser in Arrow tasks.

The tree is what html.parser's events give: an unclosed tag stays open until a
parent closes, nothing is repaired.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.functions import constants as K

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self) -> list[str]:
        """Its text nodes, in the order of the page."""
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.children)
        return out

    def text(self) -> str:
        return "".join(self.strings())

    def matches(self, selector: str) -> bool:
        if selector[0] == "[":
            name, value = selector[1:-1].split("=")
            return self.attrs.get(name) == value
        tag, mark, name = re.fullmatch(r"(\w*)([.#]?)(.*)", selector).groups()
        if tag and not mark:
            return self.tag == selector
        return (not tag or self.tag == tag) and (name in self.attrs.get("class", "").split() if mark == "." else self.attrs.get("id") == name)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if self.at.children and isinstance(self.at.children[-1], str):  # a bare "<" comes by itself, but is part of the text around it
            self.at.children[-1] += data
        else:
            self.at.children.append(data)


def parsed(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def metadata(root: Node) -> dict[str, str | None]:
    found: dict[str, str | None] = dict.fromkeys(("title", "description", "keywords", "author", "og_title", "og_description", "og_image"))
    for node in root.walk():
        if node.tag == "title" and found["title"] is None:
            found["title"] = node.text().strip()
        elif node.tag == "meta":
            name = node.attrs.get("name") or node.attrs.get("property", "").replace(":", "_")
            if name in found and found[name] is None and name != "title":
                found[name] = node.attrs.get("content")
    return found


def prune(root: Node) -> None:
    for node in list(root.walk()):
        if node.parent and any(node.matches(s) for s in K.PRUNED):
            node.parent.children = [c for c in node.parent.children if c is not node]


def inline_math(root: Node) -> None:
    for node in list(root.walk()):
        if node.tag == "math" and node.parent:
            note = next((n for n in node.walk() if n.tag == "annotation"), None)
            tex = re.sub(r"\s+", " ", note.text() if note else node.attrs.get("alttext", "")).strip()
            if m := re.fullmatch(r"\{\\displaystyle (.*)\}", tex):
                tex = m[1].strip()
            if tex:
                node.children = [f" {tex} "]


def container(root: Node) -> Node:
    for selector in K.CONTAINERS:
        for node in root.walk():
            if node.parent and node.matches(selector):
                if node.text().strip():
                    return node
                break
    return next((n for n in root.walk() if n.tag == "body"), root)


def _flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def block_text(node: Node) -> str:
    """Leaf blocks line by line, table rows with their cells, headings marked; all text if blocks hold too little of it."""
    lines = []
    for block in node.walk():
        if block.tag not in K.BLOCKS or any(b.tag in K.BLOCKS for b in block.walk() if b is not block):
            continue
        if block.tag == "tr":
            text = " | ".join(filter(None, (_flat(c.text()) for c in block.walk() if c.tag in ("th", "td"))))
        else:
            text = _flat(block.text())
        if text and re.fullmatch("h[1-6]", block.tag):
            lines += ["", "#" * int(block.tag[1]) + " " + text, ""]
        elif text:
            lines.append(text)
    out = "\n".join(lines)
    whole = _flat(node.text())
    if len(_flat(out)) < K.COVERAGE * len(whole):
        pieces = node.strings()
        out = "\n".join(filter(None, map(_flat, pieces)))
    return out


def links(root: Node, url: str) -> list[dict]:
    host, out = urlparse(url or "").netloc, []
    for node in root.walk():
        href = node.attrs.get("href", "") if node.tag == "a" else ""
        if href and not href.startswith("#"):
            netloc = urlparse(href).netloc
            out.append({"href": href, "text": node.text().strip()[:100], "is_internal": not netloc or netloc == host})
    return out[:100]


_META = ("title", "description", "keywords", "author", "og_title", "og_description", "og_image")
SCHEMA = (
    "page_id long, url string, " + ", ".join(f"{m} string" for m in _META) + ", text string, headings array<struct<level: int, text: string, tag: string>>, "
    "links array<struct<href: string, text: string, is_internal: boolean>>"
)


def extracted(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with metadata, text before cleaning, headings and links; a null page has nulls and empty lists."""
    heading = pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string()), ("tag", pa.string())]))
    link = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string()), ("is_internal", pa.bool_())]))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), *((m, pa.string()) for m in _META), ("text", pa.string()), ("headings", heading), ("links", link)])

    def one(page: int, url: str, html: str | None) -> dict:
        root = parsed(html or "")
        row = {"page_id": page, "url": url, **metadata(root), "links": links(root, url)}
        prune(root)
        inline_math(root)
        row["headings"] = [{"level": int(n.tag[1]), "text": t, "tag": n.tag} for n in root.walk() if re.fullmatch("h[1-6]", n.tag) and (t := _flat(n.text()))]
        return row | {"text": None if html is None else block_text(container(root))}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(*r.values()) for r in batch.to_pylist()], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
