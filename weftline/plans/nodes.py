"""Logical plans: a list of scan and join nodes over input DataFrames, addressed by position.

Outputs of a node are positions: of its input's columns for a scan, of ``left ++ right`` for
a join; they may leave out, reorder and repeat columns. Nodes may be shared.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from weftline.functions.predicates import Predicate


class PlanError(ValueError):
    """A plan that names what isn't there."""


@dataclass(frozen=True)
class Scan:
    """Rows of input ``source`` that satisfy ``where`` (by source column names)."""

    source: int
    outputs: tuple[int, ...]
    where: Predicate | None = None


@dataclass(frozen=True)
class Join:
    """Inner equi join of two nodes on pairs of positions. ``build_left``: which side the
    hash table is built from; None leaves it to the optimiser. ``many``: both sides may repeat
    a key, so that rows of keys are counted and a large product is dealt over tasks. Results
    depend on neither."""

    left: int
    right: int
    keys: tuple[tuple[int, int], ...]
    outputs: tuple[int, ...]
    build_left: bool | None = None
    many: bool = False


@dataclass
class Plan:
    inputs: list[DataFrame] = field(default_factory=list)
    nodes: list[Scan | Join] = field(default_factory=list)
    root: int | None = None

    def add_input(self, df: DataFrame) -> int:
        self.inputs.append(df)
        return len(self.inputs) - 1

    def scan(self, source: int, outputs: list[int] | None = None, where: Predicate | None = None) -> int:
        """A new scan node (all columns by default); returns its number and makes it the root."""
        if not 0 <= source < len(self.inputs):
            raise PlanError(f"no input {source}")
        return self._add(Scan(source, tuple(range(len(self.inputs[source].columns)) if outputs is None else outputs), where))

    def join(self, left: int, right: int, keys: list[tuple[int, int]] | tuple[int, int], outputs: list[int] | None = None, build_left: bool | None = None, many: bool = False) -> int:
        """A new join node; returns its number and makes it the root."""
        pairs = (keys,) if isinstance(keys, tuple) and isinstance(keys[0], int) else tuple(keys)
        whole = range(self.width(left) + self.width(right))
        return self._add(Join(left, right, pairs, tuple(whole if outputs is None else outputs), build_left, many))

    def _add(self, node: Scan | Join) -> int:
        self.nodes.append(node)
        self.root = len(self.nodes) - 1
        self.check(self.root)
        return self.root

    def width(self, node: int) -> int:
        if not 0 <= node < len(self.nodes):
            raise PlanError(f"no node {node}")
        return len(self.nodes[node].outputs)

    def check(self, number: int) -> None:
        """Raise PlanError unless all positions of a node exist and children come before it."""
        node = self.nodes[number]
        if isinstance(node, Scan):
            width = len(self.inputs[node.source].columns)
            columns = set(self.inputs[node.source].columns)
            if node.where is not None and (missing := {r.column for r in node.where.refs()} - columns):
                raise PlanError(f"node {number}: no column {', '.join(sorted(missing))}")
        else:
            if max(node.left, node.right) >= number:
                raise PlanError(f"node {number}: children come first")
            left, right = self.width(node.left), self.width(node.right)
            width = left + right
            if not node.keys:
                raise PlanError(f"node {number}: a join needs a key")
            if any(not (0 <= a < left and 0 <= b < right) for a, b in node.keys):
                raise PlanError(f"node {number}: key out of range")
        if any(not 0 <= i < width for i in node.outputs):
            raise PlanError(f"node {number}: output out of range")

    def tree(self, number: int | None = None, depth: int = 0) -> str:
        """The plan as indented text."""
        number = self.root if number is None else number
        if number is None:
            return "empty plan"
        node, pad = self.nodes[number], "  " * depth
        if isinstance(node, Scan):
            names = [self.inputs[node.source].columns[i] for i in node.outputs]
            return f"{pad}[{number}] scan input {node.source} -> {', '.join(names)}" + (f" where {node.where}" if node.where is not None else "")
        side = {None: "", True: " (build left)", False: " (build right)"}[node.build_left]
        keys = " and ".join(f"left.{a} = right.{b}" for a, b in node.keys)
        return "\n".join([f"{pad}[{number}] join{side} on {keys} -> {list(node.outputs)}", self.tree(node.left, depth + 1), self.tree(node.right, depth + 1)])
