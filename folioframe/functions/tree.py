"""A formula as nested nodes: groups and environments hold what stands in them.

Checks, row counts and the reading of recogniser output walk this one tree. Parsing never fails: what
opens without closing is kept as not closed, what closes nothing is a stray.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_TOKEN = re.compile(r"\\(?P<edge>begin|end)(?![a-zA-Z])\s*(?=\{)|\\[a-zA-Z]+|\\.|(?P<brace>[{}])|\s+|.", re.S)


@dataclass
class Node:
    kind: str  # root, group, env, token or stray
    text: str = ""
    start: int = 0
    end: int = 0
    children: list[Node] = field(default_factory=list)
    closed: bool = True
    columns: Node | None = None  # the group behind \begin{array}

    def walk(self, into: tuple[str, ...] = ("group", "env")) -> Iterator[Node]:
        """All nodes below, in order; ``into`` names the kinds that are entered."""
        for c in self.children:
            yield c
            if c.kind in into:
                yield from c.walk(into)

    def is_token(self, *texts: str) -> bool:
        return self.kind == "token" and self.text in texts

    def rows(self) -> list[list[Node]]:
        """The children between row ends."""
        out: list[list[Node]] = [[]]
        for c in self.children:
            if c.is_token("\\\\"):
                out.append([])
            else:
                out[-1].append(c)
        return out


def _name(text: str, at: int) -> tuple[str, int] | None:
    """(name, end) of the braced name at ``at``."""
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.S).finditer(text, at):
        depth += (m[0] == "{") - (m[0] == "}")
        if depth == 0:
            return "".join(text[at + 1:m.start()].split()), m.end()
    return None


def parse(latex: str) -> Node:
    root = Node("root", end=len(latex))
    path = [root]
    at = 0
    while at < len(latex):
        m = _TOKEN.match(latex, at)
        at = m.end()
        here = path[-1]
        if m["edge"]:
            named = _name(latex, at)
            if named is None:
                here.children.append(Node("stray", "\\" + m["edge"], m.start(), at))
                continue
            name, at = named
            if m["edge"] == "begin":
                node = Node("env", name, m.start(), len(latex), closed=False)
                here.children.append(node)
                path.append(node)
                continue
            owner = next((k for k in range(len(path) - 1, 0, -1) if path[k].kind == "env"), 0)
            if owner and path[owner].text == name:
                path[owner].closed, path[owner].end = True, at
                del path[owner:]
            else:
                here.children.append(Node("stray", "\\end", m.start(), at))
        elif m["brace"] == "{":
            node = Node("group", "{", m.start(), len(latex), closed=False)
            if here.kind == "env" and here.text in ("array", "alignedat") and here.columns is None and not here.children:
                here.columns = node
            else:
                here.children.append(node)
            path.append(node)
        elif m["brace"]:
            if here.kind == "group":
                here.closed, here.end = True, at
                path.pop()
            else:
                here.children.append(Node("stray", "}", m.start(), at))
        elif not m[0].isspace():
            here.children.append(Node("token", m[0], m.start(), at))
    return root
