"""A page as a tree that passes may change, made from the rows of ``pages.tree`` and turned back into rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

TEXT, TOP = "#text", "#page"
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Node:
    """An element, or a text (tag ``#text``). Passes list what they look for before they change it."""

    __slots__ = ("tag", "attrs", "kids", "up", "data")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, data: str | None = None) -> None:
        self.tag, self.attrs, self.data = tag, attrs or {}, data
        self.kids: list[Node] = []
        self.up: Node | None = None

    # What it is

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def classes(self) -> list[str]:
        return self.get("class").split()

    def level(self) -> int | None:
        return int(self.tag[1]) if self.tag in HEADINGS else None

    # What is around it

    def every(self) -> Iterator[Node]:
        """All nodes inside, in document order."""
        stack = self.kids[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack += node.kids[::-1]

    def all(self, *tags: str, where: Callable[[Node], object] | None = None) -> list[Node]:
        """The elements inside with one of these tags (any if there is none) for which ``where`` holds."""
        return [n for n in self.every() if n.tag != TEXT and (not tags or n.tag in tags) and (where is None or where(n))]

    def has(self, *tags: str) -> bool:
        return any(n.tag in tags for n in self.every())

    def above(self) -> Iterator[Node]:
        """The node itself and what holds it."""
        node: Node | None = self
        while node:
            yield node
            node = node.up

    def inside(self, *tags: str) -> bool:
        return any(n.tag in tags for n in self.above())

    def elements(self) -> list[Node]:
        return [n for n in self.kids if n.tag != TEXT]

    def after(self) -> list[Node]:
        """The elements that follow under the same parent."""
        beside = self.up.kids if self.up else [self]
        return [n for n in beside[beside.index(self) + 1 :] if n.tag != TEXT]

    def previous(self) -> Node | None:
        beside = self.up.kids if self.up else [self]
        return next((n for n in beside[beside.index(self) - 1 :: -1] if n.tag != TEXT), None) if beside.index(self) else None

    def next(self) -> Node | None:
        return next(iter(self.after()), None)

    def text(self) -> str:
        return self.data or "" if self.tag == TEXT else "".join(n.data or "" for n in self.every() if n.tag == TEXT)

    def words(self) -> str:
        """The text with white space collapsed."""
        return " ".join(self.text().split())

    def blank(self) -> bool:
        return self.tag == TEXT and not (self.data or "").strip()

    # Changes

    def add(self, *nodes: Node) -> Node:
        for node in nodes:
            node.remove()
            node.up = self
            self.kids.append(node)
        return self

    def remove(self) -> None:
        if self.up:
            self.up.kids.remove(self)
            self.up = None

    def replace(self, *nodes: Node) -> None:
        """Puts nodes where this one is."""
        up = self.up
        if up is None:
            return
        for node in nodes:
            if node is not self:
                node.remove()
                node.up = up
        at = up.kids.index(self)
        up.kids[at : at + 1] = nodes
        if self not in nodes:
            self.up = None

    def unwrap(self) -> None:
        """Leaves what is inside in this node's place."""
        inner, self.kids = self.kids, []
        for node in inner:
            node.up = None
        self.replace(*inner)

    def html(self) -> str:
        """The markup of what is inside, for tests and reports."""
        from html import escape

        def of(n: Node) -> str:
            if n.tag == TEXT:
                return escape(n.data or "", quote=False)
            attrs = "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items())
            return f"<{n.tag}{attrs}>{''.join(map(of, n.kids))}" + ("" if not n.kids and n.tag in ("br", "hr", "img") else f"</{n.tag}>")

        return "".join(map(of, self.kids))


def text_before(top: Node, node: Node) -> int:
    """Characters of text before a node."""
    count = 0
    for n in top.every():
        if n is node:
            break
        count += len(n.data or "")
    return count


def grown(rows: list[list]) -> Node:
    """The tree of a page's rows, under a node of its own."""
    top, nodes = Node(TOP), []
    for _, _, parent, _, tag, attrs, text, _ in rows:
        node = Node(tag, dict(attrs), text)
        nodes.append(node)
        node.up = top if parent is None else nodes[parent]
        node.up.kids.append(node)
    return top


def collapsed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()
