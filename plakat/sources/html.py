"""Small HTML tree with CSS-like selection over the standard parser; tolerates unclosed tags."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that a new one of the same kind closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SKIPPED = {"script", "style", "noscript", "template"}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Descendants in document order; iterative, so depth doesn't matter."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self, sep: str = " ") -> str:
        """Visible text, white space squeezed."""
        parts: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                parts.append(c)
            elif c.tag not in SKIPPED:
                stack.extend(reversed(c.children))
        return re.sub(r"\s+", " ", sep.join(parts)).strip()

    def raw(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def select(self, selector: str) -> list[Node]:
        """Descendants that match any of the comma-separated selectors, in document order."""
        rules = _rules(selector)
        return [n for n in self.walk() if any(_matches(n, r) for r in rules)]

    def first(self, selector: str) -> Node | None:
        rules = _rules(selector)
        return next((n for n in self.walk() if any(_matches(n, r) for r in rules)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closing = CLOSES.get(tag, set())
        while self.at.tag in closing:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """Tree of a page; null and empty pages give an empty tree."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_ATTR = re.compile(r"\[\s*([\w:-]+)\s*(?:([*^$~]?=)\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]")


@lru_cache(maxsize=1000)
def _rules(selector: str) -> list[list[tuple]]:
    """Selectors as lists of (combinator, tag, id, classes, attribute tests)."""
    out = []
    for one in re.split(r",(?![^\[]*\])", selector):
        steps, comb = [], " "
        for part in re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", one.strip()):
            if part == ">":
                comb = ">"
                continue
            attrs = _ATTR.findall(part)
            bare = _ATTR.sub("", part)
            tag = re.match(r"[\w*-]*", bare)[0]
            ident = re.findall(r"#([\w-]+)", bare)
            steps.append((comb, "" if tag == "*" else tag, ident[0] if ident else "", frozenset(re.findall(r"\.([\w-]+)", bare)), tuple(attrs)))
            comb = " "
        out.append(steps)
    return out


def _simple(n: Node, step: tuple) -> bool:
    _, tag, ident, classes, attrs = step
    if tag and n.tag != tag or ident and n.attrs.get("id") != ident or classes and not classes <= set(n.attrs.get("class", "").split()):
        return False
    for name, op, value in attrs:
        have = n.attrs.get(name)
        if have is None:
            return False
        if op and not {"=": have == value, "*=": value in have, "^=": have.startswith(value), "$=": have.endswith(value), "~=": value in have.split()}[op]:
            return False
    return True


def _matches(n: Node, steps: list[tuple]) -> bool:
    if not _simple(n, steps[-1]):
        return False
    comb, at = steps[-1][0], n.parent
    for step in reversed(steps[:-1]):
        if comb == ">":
            if at is None or not _simple(at, step):
                return False
        else:
            while at is not None and not _simple(at, step):
                at = at.parent
            if at is None:
                return False
        comb, at = step[0], at.parent
    return True


def value(n: Node | None, attr: str) -> str | None:
    """Text or an attribute of a node; ``style-url`` takes url(...) out of its style."""
    if n is None:
        return None
    if attr == "text":
        return n.text()
    if attr == "style-url":
        m = re.search(r"url\(['\"]?(.*?)['\"]?\)", n.attrs.get("style", ""))
        return m[1] if m else None
    return n.attrs.get(attr)
