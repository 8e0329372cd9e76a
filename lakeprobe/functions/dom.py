"""Declarative extraction: a lenient tree of a page, a subset of CSS selectors, repeated cards.

Selectors: tag, .class, #id, [attr], [attr=v], [attr*=v], [attr^=v], [attr$=v], descendant,
child (>) and comma lists. Anything else is refused, rather than matching nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SIMPLE = re.compile(r"([\w-]+|\*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^$]?=)[\"']?([^\"'\]]*)[\"']?)?\]")


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    parent: Node | None = None
    children: list = field(default_factory=list)
    parts: list = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def text(self) -> str:
        return " ".join(" ".join("".join(n.parts) for n in self.walk() if n.tag not in ("script", "style")).split())

    def signature(self) -> str:
        return ".".join([self.tag, *sorted(self.attrs.get("class", "").split())])


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node and node.tag != tag:
            node = node.parent
        if node and node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def tree(html: str) -> Node:
    t = Tree()
    try:
        t.feed(html)
        t.close()
    except (ValueError, AssertionError):
        pass
    return t.root


def compile_selector(selector: str) -> list[list[tuple[str, list[tuple]]]]:
    """For each alternative the steps (combinator, tests); raises ValueError for what is not supported."""
    out = []
    for alternative in selector.split(","):
        steps, combinator = [], " "
        for token in re.findall(r">|[^\s>]+", alternative):
            if token == ">":
                combinator = ">"
                continue
            tests, at = [], 0
            for m in SIMPLE.finditer(token):
                if m.start() != at:
                    break
                tests.append(m.groups())
                at = m.end()
            if at != len(token) or not tests:
                raise ValueError(f"unsupported selector: {selector}")
            steps.append((combinator, tests))
            combinator = " "
        if not steps or combinator == ">":
            raise ValueError(f"unsupported selector: {selector}")
        out.append(steps)
    return out


def _fits(node: Node, tests: list[tuple]) -> bool:
    for tag, cls, ident, attr, op, value in tests:
        own = node.attrs.get(attr) if attr else None
        if tag and tag not in ("*", node.tag) or cls and cls not in node.attrs.get("class", "").split() or ident and ident != node.attrs.get("id"):
            return False
        if attr and (own is None or op and not {"=": own == value, "*=": value in own, "^=": own.startswith(value), "$=": own.endswith(value)}[op]):
            return False
    return True


def select(root: Node, compiled: list) -> list[Node]:
    """Nodes under root that a compiled selector matches, in document order."""

    def matches(node: Node, steps: list) -> bool:
        if not _fits(node, steps[-1][1]):
            return False
        if len(steps) == 1:
            return True
        up = node.parent
        while up is not None and up is not root.parent:
            if matches(up, steps[:-1]):
                return True
            if steps[-1][0] == ">":
                return False
            up = up.parent
        return False

    return [n for n in root.walk() if n is not root and any(matches(n, s) for s in compiled)]


@dataclass(frozen=True)
class Field:
    """take: text, html attribute name prefixed with @, or url (the address of href or src)."""

    name: str
    selector: str
    take: str = "text"


def _value(node: Node, take: str, base: str) -> str:
    if take == "text":
        return node.text()
    if take == "url":
        return urljoin(base, node.attrs.get("href") or node.attrs.get("src") or "")
    return node.attrs.get(take.removeprefix("@"), "")


def extract(pages: DataFrame, container: str, fields: list[Field]) -> DataFrame:
    """A row (page_id, nth, one column per field) for each container on each page; '' where a field is missing."""
    within = compile_selector(container)
    compiled = [(f, compile_selector(f.selector)) for f in fields]
    names = [f.name for f in fields]
    if len(set(names)) != len(names) or not all(names):
        raise ValueError("field names must be there and differ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, url, html in zip(b["page_id"], b["url"], b["html"], strict=True):
                for nth, node in enumerate(select(tree(html or ""), within)):
                    found = [next(iter(select(node, c)), None) for _, c in compiled]
                    rows.append((i, nth, *("" if n is None else _value(n, f.take, url or "") for n, (f, _) in zip(found, compiled, strict=True))))
            yield pd.DataFrame(rows, columns=["page_id", "nth", *names])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, nth int, " + ", ".join(f"`{n}` string" for n in names))


#: Fixed value: text of so many characters an item is as good as more.
FULL_TEXT = 200


def sanitized(pages: DataFrame) -> DataFrame:
    """Pages without active elements, event attributes and script addresses."""
    html = F.coalesce("html", F.lit(""))
    for pattern in (
        r"(?is)<(script|style|iframe|object|embed|noscript|template|base|form)\b.*?</\1\s*>", r"(?is)<(script|style|iframe|object|embed|noscript|template|base|form)\b[^>]*>",
        r"(?is)\s+on[a-z]+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", r"(?is)(href|src)\s*=\s*[\"']?\s*javascript:[^\"'\s>]*[\"']?",
    ):
        html = F.regexp_replace(html, pattern, "")
    return pages.select("page_id", html.alias("html"))
