"""Syntax trees of query options."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    """A literal; ``kind`` is one of string, int, int64, decimal, double, bool, null, date, datetime, time, guid, duration."""

    value: Any
    kind: str


@dataclass(frozen=True)
class Path:
    parts: tuple[str, ...]

    @property
    def name(self) -> str:
        return "/".join(self.parts)


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    """Comparison (eq ne gt ge lt le) or arithmetic (add sub mul div mod)."""

    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Logic:
    op: str  # and, or
    terms: tuple


@dataclass(frozen=True)
class Not:
    term: Any


@dataclass(frozen=True)
class In:
    term: Any
    items: tuple


@dataclass(frozen=True)
class Lambda:
    op: str  # any, all
    path: tuple[str, ...]
    var: str | None
    pred: Any


@dataclass(frozen=True)
class Order:
    expr: Any
    desc: bool = False


@dataclass(frozen=True)
class Term:
    """A search term; words and phrases alike."""

    text: str


@dataclass(frozen=True)
class Aggregate:
    expr: Any  # None counts rows
    method: str
    alias: str


@dataclass(frozen=True)
class Filter:
    pred: Any


@dataclass(frozen=True)
class GroupBy:
    keys: tuple[Path, ...]  # none for a global aggregate
    aggregates: tuple[Aggregate, ...]


@dataclass(frozen=True)
class OrderBy:
    orders: tuple[Order, ...]


@dataclass(frozen=True)
class Skip:
    n: int


@dataclass(frozen=True)
class Top:
    n: int


@dataclass(frozen=True)
class Concat:
    branches: tuple[tuple, ...]


@dataclass(frozen=True)
class Expand:
    path: tuple[str, ...]
    options: Options


@dataclass
class Options:
    """All options of a collection query."""

    filter: Any = None
    search: Any = None
    select: list[str] | None = None
    expand: list[Expand] = field(default_factory=list)
    compute: list[tuple[Any, str]] = field(default_factory=list)
    orderby: list[Order] = field(default_factory=list)
    apply: list | None = None
    top: int | None = None
    skip: int | None = None
    count: bool = False
    levels: int = 1
    skiptoken: str | None = None
    deltatoken: str | None = None
    format: str | None = None


def walk(node):
    """The node and all below it."""
    yield node
    below: tuple = ()
    if isinstance(node, Call):
        below = node.args
    elif isinstance(node, Binary):
        below = (node.left, node.right)
    elif isinstance(node, Logic):
        below = node.terms
    elif isinstance(node, Not):
        below = (node.term,)
    elif isinstance(node, In):
        below = (node.term, *node.items)
    elif isinstance(node, Lambda) and node.pred is not None:
        below = (node.pred,)
    for x in below:
        yield from walk(x)
