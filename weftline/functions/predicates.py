"""Predicates as values, and the Spark columns they stand for.

A predicate names columns through references; what a reference means (a source column, a
node's output) is decided when it is compiled, by a resolver. Semantics are SQL's: three
valued, bytewise string order, and LIKE without an escape character.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True, order=True)
class Ref:
    """A column of one table of a query."""

    table: str
    column: str


Resolver = Callable[[Ref], Column]


class Predicate:
    """Base of all predicates; ``&``, ``|`` and ``~`` combine them."""

    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)

    def refs(self) -> Iterator[Ref]:
        raise NotImplementedError

    def to_column(self, resolve: Resolver) -> Column:
        raise NotImplementedError

    def tables(self) -> set[str]:
        return {r.table for r in self.refs()}


COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class Compare(Predicate):
    """``ref op literal``."""

    op: str
    ref: Ref
    value: object

    def refs(self):
        yield self.ref

    def to_column(self, resolve):
        return COMPARE[self.op](resolve(self.ref), F.lit(self.value))


@dataclass(frozen=True)
class CompareColumns(Predicate):
    """``ref op ref``, within a table or across two."""

    op: str
    left: Ref
    right: Ref

    def refs(self):
        yield self.left
        yield self.right

    def to_column(self, resolve):
        return COMPARE[self.op](resolve(self.left), resolve(self.right))


def unused_escape(pattern: str) -> str:
    """A character that does not occur in the pattern, so that none of it is an escape."""
    return next(c for c in map(chr, range(0x21, 0x110000)) if c not in pattern and c not in "%_")


@dataclass(frozen=True)
class Like(Predicate):
    """``ref LIKE pattern``: ``%`` any run, ``_`` any character, all else (a backslash
    too) itself."""

    ref: Ref
    pattern: str

    def refs(self):
        yield self.ref

    def to_column(self, resolve):
        return F.like(resolve(self.ref), F.lit(self.pattern), F.lit(unused_escape(self.pattern)))


@dataclass(frozen=True)
class IsNull(Predicate):
    ref: Ref

    def refs(self):
        yield self.ref

    def to_column(self, resolve):
        return resolve(self.ref).isNull()


@dataclass(frozen=True)
class IsNotNull(Predicate):
    ref: Ref

    def refs(self):
        yield self.ref

    def to_column(self, resolve):
        return resolve(self.ref).isNotNull()


@dataclass(frozen=True)
class Between(Predicate):
    """Both bounds belong to the range."""

    ref: Ref
    low: object
    high: object

    def refs(self):
        yield self.ref

    def to_column(self, resolve):
        return resolve(self.ref).between(F.lit(self.low), F.lit(self.high))


@dataclass(frozen=True)
class In(Predicate):
    ref: Ref
    values: tuple

    def refs(self):
        yield self.ref

    def to_column(self, resolve):
        return resolve(self.ref).isin(list(self.values))


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]

    def refs(self):
        for p in self.parts:
            yield from p.refs()

    def to_column(self, resolve):
        return reduce(lambda a, b: a & b, (p.to_column(resolve) for p in self.parts))


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]

    def refs(self):
        for p in self.parts:
            yield from p.refs()

    def to_column(self, resolve):
        return reduce(lambda a, b: a | b, (p.to_column(resolve) for p in self.parts))


@dataclass(frozen=True)
class Not(Predicate):
    """SQL's: NULL stays NULL, so the row is dropped."""

    part: Predicate

    def refs(self):
        yield from self.part.refs()

    def to_column(self, resolve):
        return ~self.part.to_column(resolve)


def conjuncts(p: Predicate) -> list[Predicate]:
    """The parts of a top-level AND."""
    return [c for part in p.parts for c in conjuncts(part)] if isinstance(p, And) else [p]


def all_of(parts: list[Predicate]) -> Predicate | None:
    return None if not parts else parts[0] if len(parts) == 1 else And(tuple(parts))


def by_name(ref: Ref) -> Column:
    """Resolver for a single source: the column of that name."""
    return F.col(f"`{ref.column}`")
