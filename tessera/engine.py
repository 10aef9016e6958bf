"""The engine: sources, planners and execution behind one object."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .algebra import Filter, Query, simplify
from .compile import Compiler, basic_groups, compile_plan, finish
from .functions import condition
from .parser import parse
from .plans import get_planner
from .plans.federation import by_authority, colour, hybrid, leaf, merge, per_source, prune, relevant, statistics
from .plans.nodes import Plan
from .plans.planjson import PlanProblem, to_json, trees_from_json
from .sources import Federation, Source, VirtualSource
from .sources.base import union
from .terms import Pattern


class Engine:
    """Runs SELECT queries over sources.

    planner: a planner's name.  exact: count every pattern's answers before
    planning; otherwise estimates from row counts serve, which cost no pass
    over data.  pruning: fewer sources a pattern, at the risk of answers.
    decomposition: patterns that one source answers together become one
    request: `merge`, `colour`, or None.  selection: `ask`; `statistics`, which
    also drops sources whose hosts rule out a join; or `hybrid`, the same, but
    sources are asked only about patterns with constants besides the predicate.
    """

    def __init__(self, spark: SparkSession, sources: Federation | Source | str, *, planner: str = "left-deep", exact: bool = False, pruning: bool = False, decomposition: str | None = "merge", selection: str = "ask", **options):
        if isinstance(sources, str):
            sources = VirtualSource(spark, sources)
        self.spark, self.sources = spark, sources if isinstance(sources, Federation) else Federation.of(sources)
        self.planner, self.exact, self.pruning, self.decomposition, self.selection = get_planner(planner, **options), exact, pruning, decomposition, selection

    @cached_property
    def statistics(self) -> dict:
        return statistics(*self.sources.sources.values())

    def choice(self, patterns: tuple[Pattern, ...]) -> dict:
        """Sources and cardinalities by pattern."""
        if self.selection == "hybrid":
            found = hybrid(patterns, self.statistics, self.sources, self.exact)
        else:
            found = relevant(patterns, self.sources, self.exact)
        if self.selection != "ask":
            found = by_authority(found, self.statistics)
        return prune(found) if self.pruning else found

    def plan_patterns(self, patterns: tuple[Pattern, ...]) -> Plan:
        choice = self.choice(patterns)
        if self.decomposition:
            units = (merge if self.decomposition == "merge" else colour)(choice, self.sources, self.exact)
        else:
            units = [leaf((p,), s, self.sources, self.exact) for p, s in choice.items()]
        return self.planner.plan(units)

    def parse(self, query: str | Query) -> Query:
        return parse(query) if isinstance(query, str) else query

    def plan(self, query: str | Query) -> dict:
        """The join trees of a query's basic groups as JSON; filters, OPTIONAL, UNION and modifiers stay in the query."""
        return to_json(self.trees(query), sources=len(self.sources.sources) > 1)

    def trees(self, query: str | Query) -> list[Plan]:
        return [self.plan_patterns(p) for p in basic_groups(self.simple(query).body)]

    def simple(self, query: str | Query) -> Query:
        q = self.parse(query)
        return replace(q, body=simplify(q.body))

    def query(self, query: str | Query, form: str = "native") -> DataFrame:
        return Compiler(self.sources, self.plan_patterns).query(self.simple(query), form)

    def run_plan(self, plan: dict | Plan | list[Plan], query: str | Query, form: str = "native", observe: list | None = None) -> DataFrame:
        """A query by a plan, edited or built by hand: its trees join the patterns, all else is as the query says.

        Refused (PlanProblem) if the trees' patterns aren't those of the query's basic groups.
        """
        q = self.simple(query)
        given = trees_from_json(plan, self.sources, q.prefixes) if isinstance(plan, dict) else plan if isinstance(plan, list) else [plan]
        return Compiler(self.sources, self.plan_patterns, given, observe).query(q, form)

    def per_source(self, query: str | Query, form: str = "native") -> DataFrame:
        """A query of patterns and filters as the union of plans in which each star has one source; others are refused."""
        q = self.simple(query)
        if not all(isinstance(e, (Pattern, Filter)) for e in q.body.elements):
            raise PlanProblem("only patterns and filters can be planned by source")
        choice = self.choice(tuple(dict.fromkeys(q.patterns)))
        parts = []
        for pick in per_source(choice):
            units = merge({p: {i: choice[p].get(i, 0)} for p, i in pick.items()}, self.sources, self.exact)
            parts.append(compile_plan(self.planner.plan(units), self.sources))
        rel = union(parts)
        for e in q.body.elements:
            if isinstance(e, Filter):
                rel = replace(rel, df=rel.df.where(condition(e.expr, rel)))
        return finish(rel, q, form)

    def cardinality(self, pattern: Pattern) -> int:
        """Answers of one pattern over all sources, counted."""
        return sum(s.cardinality((pattern,), True) for s in self.sources.sources.values())
