"""Plan nodes: what to compute, as immutable values. Lowering gives each a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.expr import Call, Expr, Item, Name, Star, col


@dataclass(frozen=True, kw_only=True)
class Node:
    #: Estimates carried for ``explain``; Catalyst has its own.
    rows: float = 0.0
    cost: float = 0.0


@dataclass(frozen=True)
class Scan(Node):
    table: str
    alias: str | None = None


@dataclass(frozen=True)
class IndexScan(Node):
    """A scan with a selective predicate, which file statistics and filters serve as an index would."""

    table: str
    predicate: Expr
    index: str = ""
    alias: str | None = None


@dataclass(frozen=True)
class Filter(Node):
    input: Node
    predicate: Expr


@dataclass(frozen=True)
class Project(Node):
    input: Node
    items: tuple[Item, ...]


@dataclass(frozen=True)
class Join(Node):
    """``strategy`` "hash" asks for a single equality of one column of each side; None takes any condition."""

    left: Node
    right: Node
    condition: Expr | None = None
    how: str = "inner"
    strategy: str | None = None


@dataclass(frozen=True)
class Aggregate(Node):
    input: Node
    keys: tuple[Expr, ...] = ()
    calls: tuple[Call, ...] = ()


@dataclass(frozen=True)
class Distinct(Node):
    input: Node


@dataclass(frozen=True)
class SortKey:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Sort(Node):
    """Nulls are last in either direction."""

    input: Node
    keys: tuple[SortKey, ...] = ()


@dataclass(frozen=True)
class Limit(Node):
    input: Node
    limit: int | None = None
    offset: int = 0


def _expr(x: Expr | str) -> Expr:
    return col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Query:
    """Builds a plan by method calls; ``plan`` is the tree so far."""

    plan: Node = field()

    def where(self, predicate: Expr) -> Query:
        return Query(Filter(self.plan, predicate))

    def select(self, *items: Expr | Item | str) -> Query:
        made = [Item(Star()) if x == "*" else x if isinstance(x, Item) else Item(_expr(x)) for x in items]
        return Query(Project(self.plan, tuple(made)))

    def join(self, other: Query, condition: Expr | None = None, how: str = "inner", strategy: str | None = None) -> Query:
        return Query(Join(self.plan, other.plan, condition, how, strategy))

    def group(self, *keys: Expr | str) -> Grouping:
        return Grouping(self.plan, tuple(map(_expr, keys)))

    def distinct(self) -> Query:
        return Query(Distinct(self.plan))

    def sort(self, *keys: SortKey | Expr | str) -> Query:
        return Query(Sort(self.plan, tuple(k if isinstance(k, SortKey) else SortKey(_expr(k)) for k in keys)))

    def limit(self, limit: int | None = None, offset: int = 0) -> Query:
        return Query(Limit(self.plan, limit, offset))


@dataclass(frozen=True)
class Grouping:
    input: Node
    keys: tuple[Expr, ...]

    def agg(self, *calls: Call) -> Query:
        return Query(Aggregate(self.input, self.keys, calls))


def scan(table: str, alias: str | None = None) -> Query:
    return Query(Scan(table, alias))


def index_scan(table: str, predicate: Expr, index: str = "", alias: str | None = None) -> Query:
    return Query(IndexScan(table, predicate, index, alias))


def desc(x: Expr | str) -> SortKey:
    return SortKey(_expr(x), True)


__all__ = [n for n in dir() if n[0] != "_" and n not in ("annotations", "dataclass", "field", "Name")]
