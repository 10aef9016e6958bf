"""Queries and plans -> DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Observation
from pyspark.sql import functions as F

from .algebra import Filter, Group, Optional, Query, Union
from .functions import condition
from .operators import distinct, inner_join, left_join, order, project, render, slice_rows
from .plans.cost import optional_method
from .plans.nodes import Leaf, Plan, leaves
from .plans.planjson import PlanProblem
from .sources.base import Federation, union
from .terms import Pattern, Rel


def scan(leaf: Leaf, sources: Federation) -> Rel:
    return sources.scan(leaf.patterns, leaf.sources)


def one_scan(plan: Plan, sources: Federation) -> Leaf | None:
    """A subtree that one scan of one source answers, whatever its joins: a star over one table."""
    found = leaves(plan)
    ids = {x.sources for x in found}
    if len(found) == 1 or len(ids) != 1 or len(found[0].sources) != 1:
        return None
    patterns = tuple(dict.fromkeys(p for x in found for p in x.patterns))
    source = sources.sources[found[0].sources[0]]
    return Leaf(patterns, plan.cardinality, found[0].sources, found[0].kinds) if source.joint(patterns) else None


def compile_plan(plan: Plan, sources: Federation, observe: list | None = None, fuse: bool = True) -> Rel:
    """The joins of a plan in its order.

    With `observe` each join counts its rows as it runs, in the order of
    joins(); otherwise a star over one table becomes one scan.
    """
    if isinstance(plan, Leaf):
        return scan(plan, sources)
    if fuse and observe is None and (star := one_scan(plan, sources)):
        return scan(star, sources)
    left = compile_plan(plan.left, sources, observe, fuse)
    right = compile_plan(plan.right, sources, observe, fuse)
    out = inner_join(left, right, plan.op)
    if observe is not None:
        o = Observation()
        observe.append(o)
        out = Rel(out.df.observe(o, F.count(F.lit(1)).alias("n")), out.types, out.certain, out.bound, [*out.observed, o])
    return out


def basic_groups(g: Group) -> list[tuple[Pattern, ...]]:
    """The patterns that are planned together, in the order in which Compiler.group() meets them."""
    out, waiting = [], []

    def flush() -> None:
        if waiting:
            out.append(tuple(dict.fromkeys(waiting)))
            waiting.clear()

    for e in g.elements:
        if isinstance(e, Pattern):
            waiting.append(e)
        elif not isinstance(e, Filter):
            flush()
            for inner in e.groups if isinstance(e, Union) else [e.group if isinstance(e, Optional) else e]:
                out += basic_groups(inner)
    flush()
    return out


class Compiler:
    """`plan` turns the patterns of a basic graph pattern into a plan.

    `given` has the trees of a plan that was edited or built by hand: each basic group takes the first that has its patterns.
    `observe` gathers an observation for each join, in the order of the groups.
    """

    def __init__(self, sources: Federation, plan: Callable[[tuple[Pattern, ...]], Plan], given: list[Plan] | None = None, observe: list | None = None):
        self.sources, self.plan, self.given, self.observe = sources, plan, None if given is None else list(given), observe

    def pattern(self, patterns: list[Pattern]) -> Rel:
        found = tuple(dict.fromkeys(patterns))
        return compile_plan(self.plan(found) if self.given is None else self.take(found), self.sources, self.observe)

    def take(self, patterns: tuple[Pattern, ...]) -> Plan:
        at = next((i for i, p in enumerate(self.given) if {x for leaf in leaves(p) for x in leaf.patterns} == set(patterns)), None)
        if at is None:
            raise PlanProblem(f"the plan has no tree for the patterns {' '.join(map(str, patterns))}")
        return self.given.pop(at)

    def group(self, g: Group) -> Rel:
        """Elements in order, filters over the whole group at its end."""
        rel, waiting, filters = None, [], []

        def join(other: Rel) -> None:
            nonlocal rel
            rel = other if rel is None else inner_join(rel, other)

        def flush() -> None:
            if waiting:
                join(self.pattern(waiting))
                waiting.clear()

        for e in g.elements:
            if isinstance(e, Pattern):
                waiting.append(e)
            elif isinstance(e, Filter):
                filters.append(e.expr)
            elif isinstance(e, Union):
                flush()
                join(union([self.group(x) for x in e.groups]))
            elif isinstance(e, Optional):
                flush()
                inner = tuple(x.expr for x in e.group.elements if isinstance(x, Filter))
                right = self.group(Group(tuple(x for x in e.group.elements if not isinstance(x, Filter))))
                rel = left_join(rel if rel is not None else self.unit(), right, inner, self.method(g, e))
            else:
                flush()
                join(self.group(e))
        flush()
        rel = rel if rel is not None else self.unit()
        for f in filters:
            rel = Rel(rel.df.where(condition(f, rel)), rel.types, rel.certain, rel.bound, rel.observed)
        return rel

    def unit(self) -> Rel:
        from pyspark.sql import SparkSession

        return Rel(SparkSession.getActiveSession().range(1).select(), {}, frozenset(), 1)

    def method(self, g: Group, e: Optional) -> str | None:
        left = tuple(x for x in g.elements if isinstance(x, Pattern))
        right = tuple(x for x in e.group.elements if isinstance(x, Pattern))
        if not left or len(right) != 1:
            return None
        return optional_method(self.plan(left), self.plan(right))

    def query(self, q: Query, form: str = "native"):
        rel = self.group(q.body)
        if self.given:
            raise PlanProblem("the plan has trees for patterns that the query has not")
        return finish(rel, q, form)


def finish(rel: Rel, q: Query, form: str = "native"):
    """Order, projection, DISTINCT and slice; SELECT * has all variables by name."""
    if q.order_by:
        rel = order(rel, q.order_by)
    rel = project(rel, sorted(rel.types) if q.select is None else [v.name for v in q.select])
    if q.distinct:
        rel = distinct(rel)
        if q.order_by:
            from .algebra import expr_vars

            keys = tuple((e, up) for e, up in q.order_by if expr_vars(e) <= set(rel.types))
            rel = order(rel, keys) if keys else rel
    if q.limit is not None or q.offset:
        rel = slice_rows(rel, q.limit, q.offset)
    return render(rel, form)
