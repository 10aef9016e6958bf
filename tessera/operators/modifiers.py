"""Solution modifiers: projection, DISTINCT, ORDER BY, slices, and output forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..algebra import Expr
from ..functions import order_key
from ..terms import Rel, to_iri


def project(rel: Rel, names: list[str]) -> Rel:
    """The named variables; one that no pattern binds is null."""
    df = rel.df.select(*[F.col(f"`{v}`") if v in rel.types else F.lit(None).cast("string").alias(v) for v in names])
    return Rel(df, {v: t for v, t in rel.types.items() if v in names}, rel.certain & frozenset(names), rel.bound, rel.observed)


def distinct(rel: Rel) -> Rel:
    return Rel(rel.df.distinct(), rel.types, rel.certain, rel.bound, rel.observed)


def order(rel: Rel, keys: tuple[tuple[Expr, bool], ...]) -> Rel:
    """Unbound first when ascending, last when descending; values stay as they are."""
    cols = [c.asc_nulls_first() if up else c.desc_nulls_last() for e, up in keys for c in order_key(e, rel)]
    return Rel(rel.df.orderBy(*cols), rel.types, rel.certain, rel.bound, rel.observed)


def slice_rows(rel: Rel, limit: int | None, offset: int) -> Rel:
    df = rel.df.offset(offset) if offset else rel.df
    df = df if limit is None else df.limit(limit)
    return Rel(df, rel.types, rel.certain, limit if limit is not None else rel.bound, rel.observed)


def render(rel: Rel, form: str = "native"):
    """The solutions as a DataFrame.

    `native`: literals in their types, IRIs of mapped rows as their keys, other
    terms as text.  `iri`: the same, IRIs written out.  `compat`: all as text,
    unbound as the word null.  `term`: term structs.
    """
    cols = []
    for v in rel.df.columns:
        c, t = F.col(f"`{v}`"), rel.types.get(v)
        if t is None:
            cols.append((F.lit("null") if form == "compat" else c).alias(v))
            continue
        if form == "term":
            from ..terms import to_term

            cols.append(to_term(c, t, rel.dt(v)).alias(v))
            continue
        if t.cls in ("term", "lang"):
            c = c["lex"]
        elif t.cls == "key" and form in ("iri", "compat"):
            c = to_iri(c, t, rel.dt(v))
        if form == "compat":
            c = F.coalesce(c.cast("string"), F.lit("null"))
        cols.append(c.alias(v))
    return rel.df.select(*cols)
