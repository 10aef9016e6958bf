"""Joins of solutions on their common variables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..algebra import Expr
from ..functions import condition
from ..terms import Rel

#: A side is broadcast by hint only if its scan can't hold more bytes than this, whatever the query.
BROADCAST_BYTES = 64 << 20
#: A hash side is hinted up to this many bytes, above those of a broadcast; otherwise Spark decides.
HASH_BYTES = 4 << 30
#: A join that makes over so many rows for each that it reads, and more than a task should make, is spread over tasks by its rows; over so many at most.
FANS_OUT, TASK_ROWS, TASKS = 16, 1 << 24, 10_000


def reconcile(left: Rel, right: Rel) -> tuple[Rel, Rel, bool]:
    """Both sides with one type for each common variable; False if types alone rule out any match."""
    possible = True
    for v in left.types.keys() & right.types.keys():
        a, b = left.types[v], right.types[v]
        if a == b and left.dt(v) == right.dt(v):
            continue
        if a.cls == b.cls == "key" and a.of != b.of and v in left.certain and v in right.certain:
            possible = False
        left, right = left.as_term(v), right.as_term(v)
    return left, right, possible


def hinted(df: DataFrame, rel: Rel, method: str | None) -> DataFrame:
    """NLJ: the outer side's rows go to every task, if they are small for certain.  SHJ: a hash join, unless a side is small enough for that."""
    if method == "NLJ" and rel.size is not None and rel.size <= BROADCAST_BYTES:
        return F.broadcast(df)
    if method == "SHJ" and rel.size is not None and BROADCAST_BYTES < rel.size <= HASH_BYTES:
        return df.hint("shuffle_hash")
    return df


def matching(left: Rel, right: Rel) -> tuple[DataFrame, Column | None, list[str]]:
    """(right side with renamed columns, join condition, common variables)."""
    common = [v for v in left.types if v in right.types]
    renamed = right.df.select(*[F.col(f"`{v}`").alias(f"__r_{v}" if v in common else v) for v in right.types])
    parts = []
    for v in common:
        a, b = F.col(f"`{v}`"), F.col(f"`__r_{v}`")
        # unbound is compatible with anything
        loose = [] if v in left.certain else [a.isNull()]
        loose += [] if v in right.certain else [b.isNull()]
        parts.append(reduce(lambda x, y: x | y, loose, a == b))
    return renamed, reduce(lambda x, y: x & y, parts) if parts else None, common


def merged(df: DataFrame, left: Rel, right: Rel, common: list[str]) -> DataFrame:
    cols = [F.coalesce(F.col(f"`{v}`"), F.col(f"`__r_{v}`")).alias(v) if v in common and v not in left.certain else F.col(f"`{v}`") for v in left.types]
    return df.select(*cols, *[F.col(f"`{v}`") for v in right.types if v not in left.types])


def tasks(left: Rel, right: Rel, common: list[str]) -> int:
    """How many tasks a join of two scans needs by the rows that it makes, if its values are alike frequent; 0 where Spark's choice will do.

    Two tables that meet in a link to a third, small one make far more rows than they have: tasks by their bytes, or by the
    link's values, are then too few.
    """
    if not common or any(x.size is None or x.bound is None or x.values is None or x.df.isStreaming for x in (left, right)):
        return 0
    if left.bound * right.bound <= max(TASK_ROWS, FANS_OUT * (left.bound + right.bound)):
        return 0
    of = [n for v in common for x in (left, right) if (n := x.values(v)) is not None]
    rows = left.bound * right.bound // max(1, *of) if of else 0
    return min(TASKS, -(-rows // TASK_ROWS)) if rows > max(TASK_ROWS, FANS_OUT * (left.bound + right.bound)) else 0


def inner_join(left: Rel, right: Rel, method: str | None = None) -> Rel:
    """Bag join; without a common variable the product."""
    left, right, possible = reconcile(left, right)
    renamed, on, common = matching(left, right)
    if not possible:
        on = F.lit(False) if on is None else on & F.lit(False)
    small_left = left.size is not None and (right.size is None or left.size <= right.size)
    if method == "SHJ" and any(x.size is not None and x.size <= BROADCAST_BYTES for x in (left, right)):
        method = None
    small = left if small_left else right
    if possible and small.size is not None and small.size <= BROADCAST_BYTES and (n := tasks(left, right, common)):
        n = max(n, left.df.sparkSession.sparkContext.defaultParallelism)
        spread = lambda df: df.repartition(n, *df.columns)
        lhs, rhs = (F.broadcast(left.df), spread(renamed)) if small_left else (spread(left.df), F.broadcast(renamed))
    else:
        lhs = hinted(left.df, left, method) if small_left and on is not None else left.df
        rhs = hinted(renamed, right, method) if not small_left and on is not None else renamed
    df = lhs.crossJoin(rhs) if on is None else lhs.join(rhs, on)
    bound = left.bound * right.bound if on is None and left.bound is not None and right.bound is not None else None
    return Rel(merged(df, left, right, common), left.types | right.types, left.certain | right.certain, bound, left.observed + right.observed)


def left_join(left: Rel, right: Rel, filters: tuple[Expr, ...] = (), method: str | None = None) -> Rel:
    """OPTIONAL: rows of the left side stay; filters of the right group see both sides and are part of the match."""
    left, right, possible = reconcile(left, right)
    renamed, on, common = matching(left, right)
    on = F.lit(True) if on is None else on
    if not possible:
        on = on & F.lit(False)
    for f in filters:
        both = Rel(merged(left.df.crossJoin(renamed), left, right, common), left.types | right.types, left.certain)
        on = on & condition(f, both)
    df = left.df.join(hinted(renamed, right, method) if method else renamed, on, "left")
    return Rel(merged(df, left, right, common), left.types | right.types, left.certain, None, left.observed + right.observed)
