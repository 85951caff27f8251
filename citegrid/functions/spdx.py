"""Licence expressions: reading them, and whether accepted licences meet them.

AND binds before OR; what WITH adds is left out. Names are compared without regard to case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9.+:-]+))")
#: Parentheses within one another; deeper ones are refused.
MOST_DEPTH = 32
WORDS = {"AND", "OR", "WITH", "(", ")"}
#: How names of one's own begin, which no public list has.
CUSTOM = ("licenseref-", "documentref-")

Node = tuple


def read(text: str | None) -> Node | None:
    """The expression as ('one', name), ('and', nodes) or ('or', nodes); None if it can't be read."""
    left: list[str] = []
    text = (text or "").rstrip()
    at = 0
    while at < len(text):
        if not (m := TOKEN.match(text, at)):
            return None
        left.append(m[1] or m[2])
        at = m.end()
    left.reverse()

    def several(word: str, part: Callable[[int], Node], depth: int) -> Node:
        found = [part(depth)]
        while left and left[-1] == word:
            left.pop()
            found.append(part(depth))
        return found[0] if len(found) == 1 else (word.lower(), found)

    def name() -> str:
        if not left or left[-1] in WORDS:
            raise ValueError
        return left.pop().lower()

    def one(depth: int) -> Node:
        if not left or left[-1] != "(":
            node = ("one", name())
            if left and left[-1] == "WITH":
                left.pop()
                name()
            return node
        left.pop()
        if depth == MOST_DEPTH:
            raise ValueError
        node = several("OR", every, depth + 1)
        if not left or left.pop() != ")":
            raise ValueError
        return node

    def every(depth: int) -> Node:
        return several("AND", one, depth)

    try:
        node = several("OR", every, 0)
    except ValueError:
        return None
    return None if left else node


def holds(node: Node, test: Callable[[str], bool]) -> bool:
    kind, of = node
    if kind == "one":
        return test(of)
    return (all if kind == "and" else any)(holds(x, test) for x in of)


def names(node: Node) -> set[str]:
    return {node[1]} if node[0] == "one" else set().union(*map(names, node[1]))


def accepted(text: str | None, allowed: Collection[str], layer: str | None = None, known: Collection[str] | None = None) -> bool:
    """Whether ``allowed`` licences meet an expression. One that can't be read is refused, as is one with a name that isn't among ``known``,
    where that is given, and isn't one of one's own. In the public layer names of one's own are refused, in expressions and among the allowed."""
    node = read(text)
    allowed = {x.lower() for x in allowed if x is not None}
    if node is None:
        return False
    own = {x for x in names(node) | allowed if x.startswith(CUSTOM)}
    if layer == "public" and own:
        return False
    if known is not None and names(node) - own - {x.lower() for x in known}:
        return False
    return holds(node, allowed.__contains__)


def accepts(expression: Column, allowed: Collection[str], layer: Column | None = None, known: Collection[str] | None = None) -> Column:
    """``accepted`` of each row, read once for each distinct expression of a batch; apply it to distinct expressions where there are few."""

    @F.arrow_udf("boolean")
    def judged(expressions: pa.Array, layers: pa.Array) -> pa.Array:
        pairs = list(zip(expressions.to_pylist(), layers.to_pylist(), strict=True))
        found = {p: accepted(p[0], allowed, p[1], known) for p in set(pairs)}
        return pa.array([found[p] for p in pairs], pa.bool_())

    return judged(expression, F.lit(None).cast("string") if layer is None else layer)
