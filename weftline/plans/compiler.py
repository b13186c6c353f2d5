"""From a plan to one lazy DataFrame.

Each output of scan n is named ``n{n}_c{i}``. A join passes its columns on as they are, so that
the optimiser may still order joins, and names anew only those that both sides have or that it
repeats; self-joins and repeated columns are never ambiguous. Catalyst does the rest: pruning,
pushdown, join order where there are statistics, join strategy, adaptive re-planning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.predicates import by_name
from weftline.operators.joins import build_hint, dealt_join, join_single, single_row
from weftline.plans.nodes import Join, Plan, PlanError, Scan


def compile_plan(plan: Plan, names: list[str] | None = None, hints: bool = True) -> DataFrame:
    """The rows of the plan's root. ``names``: names of its columns, repeats allowed;
    without, generated ones. ``hints=False`` leaves build sides and the dealing of large products
    to the optimiser."""
    if plan.root is None:
        raise PlanError("the plan has no node")
    done: dict[int, DataFrame] = {}

    def node(number: int) -> DataFrame:
        if number not in done:
            made = plan.nodes[number]
            done[number] = _join(plan, number, made) if isinstance(made, Join) else _scan(number, made)
        return done[number]

    def _scan(number: int, scan) -> DataFrame:
        source = plan.inputs[scan.source]
        rows = source if scan.where is None else source.where(scan.where.to_column(by_name))
        return rows.select(*[F.col(f"`{source.columns[c]}`").alias(f"n{number}_c{i}") for i, c in enumerate(scan.outputs)])

    def _join(plan: Plan, number: int, join: Join) -> DataFrame:
        left, right = node(join.left), node(join.right)
        if clash := set(left.columns) & set(right.columns):  # a node below both sides
            right = right.select(*[F.col(c).alias(f"j{number}_{i}" if c in clash else c) for i, c in enumerate(right.columns)])
        on = reduce(lambda a, b: a & b, (F.col(left.columns[a]) == F.col(right.columns[b]) for a, b in join.keys))
        both = [*left.columns, *right.columns]
        chosen = [both[c] for c in join.outputs]
        out = [F.col(c) if chosen.count(c) == 1 else F.col(c).alias(f"n{number}_c{i}") for i, c in enumerate(chosen)]
        for first, one, many in ((True, left, right), (False, right, left)):
            # A scan of a single row, on the build side or where none is given, needs no join.
            if hints and join.build_left in (first, None) and isinstance(plan.nodes[join.left if first else join.right], Scan) and (row := single_row(one)):
                keys = [(one.columns[a if first else b], many.columns[b if first else a]) for a, b in join.keys]
                return join_single(row, one.schema, many, keys, first).select(*out)
        if hints and join.many:
            pairs = [(left.columns[a], right.columns[b]) for a, b in join.keys]
            if (dealt := dealt_join(left, right, pairs, join.build_left)) is not None:
                return dealt.select(*out)
        if hints and join.build_left is not None:
            left, right = (build_hint(left), right) if join.build_left else (left, build_hint(right))
        return left.join(right, on, "inner").select(*out)

    out = node(plan.root)
    return out if names is None else out.toDF(*names)
