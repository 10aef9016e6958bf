"""Plans as JSON, and hashes of plans and queries."""

from __future__ import annotations

import hashlib
import json

from ..algebra import Query, show
from ..parser import parse_patterns
from ..sources.base import Federation
from .nodes import NLJ, SHJ, Join, Leaf, Plan


class PlanProblem(ValueError):
    """Not a plan that can be run."""


def to_json(plan: Plan | list[Plan], produced: dict[int, int] | None = None, sources: bool = False) -> dict:
    """A plan's tree; `produced` has the rows of each join by its place in joins(), and with `sources` leaves name theirs.

    A query with OPTIONAL, UNION or nested groups has a tree for each of its basic groups, in order of the text: type Groups.
    """
    at = iter(range(10**9))

    def walk(p: Plan) -> dict:
        if isinstance(p, Leaf):
            return {"type": "Leaf", "tpf": " ".join(map(str, p.patterns)), "cardinality": str(p.cardinality)} | ({"sources": list(p.sources)} if sources and p.sources else {})
        left, right = walk(p.left), walk(p.right)
        i = next(at)
        return {"type": p.op, "left": left, "right": right, "estimated_tuples": p.cardinality, "produced_tuples": (produced or {}).get(i, 0)}

    if isinstance(plan, list):
        return walk(plan[0]) if len(plan) == 1 else {"type": "Groups", "groups": [walk(p) for p in plan]}
    return walk(plan)


def trees_from_json(document: dict, sources: Federation, prefixes: dict[str, str] | None = None) -> list[Plan]:
    """The trees of a plan, one for each basic group of its query."""
    if isinstance(document, dict) and document.get("type") == "Groups":
        return [from_json(t, sources, prefixes) for t in document["groups"]]
    return [from_json(document, sources, prefixes)]


def from_json(tree: dict, sources: Federation, prefixes: dict[str, str] | None = None) -> Plan:
    """An edited plan; a leaf is asked of the sources that it names, or of all if it names none."""

    def walk(t: dict) -> Plan:
        if not isinstance(t, dict) or "type" not in t:
            raise PlanProblem("a node needs a type")
        if t["type"] == "Leaf":
            ids = tuple(t.get("sources") or sources.sources)
            if unknown := [i for i in ids if i not in sources.sources]:
                raise PlanProblem(f"no source {', '.join(unknown)}")
            patterns = parse_patterns(t["tpf"], prefixes)
            if len(patterns) > 1 and any(not sources.sources[i].joint(patterns) for i in ids):
                raise PlanProblem("a leaf of several patterns needs a source that answers them together")
            return Leaf(patterns, int(t.get("cardinality", 0)), ids, tuple(sources.sources[i].kind for i in ids))
        if t["type"] not in (NLJ, SHJ):
            raise PlanProblem(f"unknown node {t['type']}")
        estimate = t.get("estimated_tuples", t.get("estimated_cardinality"))
        return Join(t["type"], walk(t["left"]), walk(t["right"]), None if estimate is None else int(estimate))

    plan = walk(tree)
    validate(plan)
    return plan


def validate(plan: Plan) -> None:
    """An NLJ needs a leaf to bind into."""
    if isinstance(plan, Join):
        if plan.op == NLJ and not isinstance(plan.left, Leaf) and not isinstance(plan.right, Leaf):
            raise PlanProblem("an NLJ of two joins can't be run")
        validate(plan.left)
        validate(plan.right)


def plan_hash(tree: dict) -> str:
    """Of what defines a plan: types, operands, patterns, their cardinalities and sources."""

    def core(t: dict) -> dict:
        whole = {k: core(v) if isinstance(v, dict) else str(v) for k, v in t.items() if k in ("type", "left", "right", "cardinality", "tpf", "sources")}
        return whole | ({"groups": [core(x) for x in t["groups"]]} if "groups" in t else {})

    return hashlib.sha256(json.dumps(core(tree), sort_keys=True).encode()).hexdigest()


def query_hash(q: Query) -> str:
    """Of a query's canonical text, its order and slice included."""
    return hashlib.sha256(show(q).encode()).hexdigest()
