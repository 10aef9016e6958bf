"""What a source can do, and several of them together."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..terms import Pattern, Rel

#: interface -> (bindings sent at once, answers on a page); the planners' costs are in requests of these sizes
INTERFACES = {"tpf": (1, 100), "brtpf": (30, 100), "sparql": (50, 10_000)}


class Source:
    """A graph behind an interface: `tpf` answers patterns, `brtpf` also takes bindings, `sparql` whole groups of patterns."""

    id: str
    kind: str

    def scan(self, patterns: tuple[Pattern, ...]) -> Rel:
        raise NotImplementedError

    def joint(self, patterns: tuple[Pattern, ...]) -> bool:
        """Whether one scan answers the patterns."""
        return len(patterns) == 1

    def cardinality(self, patterns: tuple[Pattern, ...], exact: bool = True) -> int:
        """The number of answers, counted once, or an estimate that only needs the tables' row counts."""
        if not hasattr(self, "_counts"):
            self._counts: dict = {}
        k = (frozenset(patterns), exact)
        if k not in self._counts:
            self._counts[k] = self.scan(patterns).df.count() if exact else self.estimate(patterns)
        return self._counts[k]

    def estimate(self, patterns: tuple[Pattern, ...]) -> int:
        return self.cardinality(patterns, True)

    def authorities(self) -> DataFrame:
        """(predicate, subjects, objects, n): hosts of subject and object IRIs, and triples, by predicate.

        Objects without a host count as the host "" if others have one.
        """
        raise NotImplementedError

    def __str__(self) -> str:
        return f"{self.kind}@{self.id}"


def join_types(rels: list[Rel]) -> list[Rel]:
    """The relations with one type for each variable that several have."""
    for v in {v for r in rels for v in r.types}:
        kinds = {(r.types[v], r.dt(v).simpleString()) for r in rels if v in r.types}
        if len(kinds) > 1:
            rels = [r.as_term(v) if v in r.types else r for r in rels]
    return rels


def union(rels: list[Rel]) -> Rel:
    """Bag union; a variable that a branch lacks is unbound there."""
    if len(rels) == 1:
        return rels[0]
    rels = join_types(rels)
    types = {v: t for r in rels for v, t in r.types.items()}
    kinds = {v: r.dt(v) for r in rels for v in r.types}
    padded = [r.df.select(*[F.col(f"`{v}`") if v in r.types else F.lit(None).cast(kinds[v]).alias(v) for v in types]) for r in rels]
    certain = frozenset.intersection(*[r.certain for r in rels])
    bounds = [r.bound for r in rels]
    return Rel(reduce(DataFrame.unionByName, padded), types, certain, None if None in bounds else sum(bounds), [o for r in rels for o in r.observed])


@dataclass
class Federation:
    """Sources by id; a pattern's answers are the bag union of those of its sources."""

    sources: dict[str, Source] = field(default_factory=dict)

    @classmethod
    def of(cls, *sources: Source) -> Federation:
        return cls({s.id: s for s in sources})

    def relevant(self, pattern: Pattern, exact: bool = True) -> dict[str, int]:
        """Sources with answers, and how many."""
        return {i: n for i, s in self.sources.items() if (n := s.cardinality((pattern,), exact))}

    def scan(self, patterns: tuple[Pattern, ...], ids: tuple[str, ...] | None = None) -> Rel:
        ids = tuple(self.sources) if ids is None else ids or tuple(self.sources)[:1]
        return union([self.sources[i].scan(patterns) for i in ids])
