"""Queries as trees."""

from __future__ import annotations

from dataclasses import dataclass, field

from .terms import Iri, Lit, Pattern, Var


@dataclass(frozen=True)
class Call:
    """An operator or function and its arguments."""

    name: str
    args: tuple


Expr = Var | Iri | Lit | Call


@dataclass(frozen=True)
class Filter:
    expr: Expr


@dataclass(frozen=True)
class Group:
    elements: tuple = ()

    @property
    def vars(self) -> frozenset[str]:
        return frozenset(v for e in self.elements for v in pattern_vars(e))


@dataclass(frozen=True)
class Optional:
    group: Group


@dataclass(frozen=True)
class Union:
    groups: tuple[Group, ...]


@dataclass(frozen=True)
class Query:
    body: Group
    select: tuple[Var, ...] | None = None  # None: *
    distinct: bool = False
    order_by: tuple[tuple[Expr, bool], ...] = ()  # (expression, ascending)
    limit: int | None = None
    offset: int = 0
    prefixes: dict[str, str] = field(default_factory=dict, compare=False, hash=False)

    @property
    def patterns(self) -> tuple[Pattern, ...]:
        """All triple patterns, in order of the text."""
        return tuple(patterns(self.body))

    @property
    def conjunctive(self) -> bool:
        return all(isinstance(e, Pattern) for e in self.body.elements)


def patterns(g: Group):
    for e in g.elements:
        if isinstance(e, Pattern):
            yield e
        elif isinstance(e, Group):
            yield from patterns(e)
        elif isinstance(e, Optional):
            yield from patterns(e.group)
        elif isinstance(e, Union):
            for x in e.groups:
                yield from patterns(x)


def pattern_vars(e) -> frozenset[str]:
    if isinstance(e, (Pattern, Group)):
        return e.vars
    if isinstance(e, Optional):
        return e.group.vars
    if isinstance(e, Union):
        return frozenset(v for g in e.groups for v in g.vars)
    return frozenset()


def expr_vars(e: Expr) -> frozenset[str]:
    if isinstance(e, Var):
        return frozenset([e.name])
    return frozenset(v for a in e.args for v in expr_vars(a)) if isinstance(e, Call) else frozenset()


def simplify(g: Group) -> Group:
    """The same group without unions of one branch and without nested groups that are only patterns."""
    out = []
    for e in g.elements:
        if isinstance(e, Union):
            branches = tuple(simplify(x) for x in e.groups)
            e = branches[0] if len(branches) == 1 else Union(branches)
        elif isinstance(e, Optional):
            e = Optional(simplify(e.group))
        if isinstance(e, Group):
            e = simplify(e)
            if all(isinstance(x, Pattern) for x in e.elements):
                out.extend(e.elements)
                continue
        out.append(e)
    return Group(tuple(out))


INFIX = {"||", "&&", "=", "!=", "<", ">", "<=", ">=", "+", "-", "*", "/"}


def show_expr(e: Expr) -> str:
    if not isinstance(e, Call):
        return str(e)
    if e.name in INFIX and len(e.args) == 2:
        return f"({show_expr(e.args[0])} {e.name} {show_expr(e.args[1])})"
    if e.name in ("!", "-", "+"):
        return f"({e.name} {show_expr(e.args[0])})"
    name = f"<{e.name}>" if ":" in e.name else e.name
    return f"{name}({', '.join(map(show_expr, e.args))})"


def show(q: Query | Group, depth: int = 0) -> str:
    """A query's text; parsing it gives the same tree."""
    if isinstance(q, Query):
        head = "SELECT " + ("DISTINCT " if q.distinct else "") + ("*" if q.select is None else " ".join(map(str, q.select)))
        tail = "".join(f" {'ASC' if up else 'DESC'}({show_expr(e)})" for e, up in q.order_by)
        return f"{head} WHERE {show(q.body)}" + (f"\nORDER BY{tail}" if tail else "") + (f"\nLIMIT {q.limit}" if q.limit is not None else "") + (f"\nOFFSET {q.offset}" if q.offset else "")
    pad = "  " * (depth + 1)
    lines = []
    for e in q.elements:
        if isinstance(e, Pattern):
            lines.append(str(e))
        elif isinstance(e, Filter):
            lines.append(f"FILTER ({show_expr(e.expr)})")
        elif isinstance(e, Optional):
            lines.append("OPTIONAL " + show(e.group, depth + 1))
        elif isinstance(e, Union):
            lines.append(" UNION ".join(show(g, depth + 1) for g in e.groups))
        else:
            lines.append(show(e, depth + 1))
    return "{\n" + "".join(f"{pad}{x}\n" for x in lines) + "  " * depth + "}"
