"""Expressions as Spark columns.  An error is null, and SQL's three-valued logic is then SPARQL's."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..algebra import Call, Expr
from ..terms import BLANK, DATATYPE, IRI, LITERAL, NUMERIC, XSD, Iri, Lit, Rel, Var, VarType, key_text, to_iri, to_term

NUM = ("integer", "double")


@dataclass
class Value:
    """A column and what it holds; `dt` is its Spark type where a key's parts matter."""

    col: Column
    type: VarType
    dt: T.DataType | None = None


def null(cls: str = "boolean") -> Value:
    return Value(F.lit(None).cast({"boolean": "boolean", "double": "double", "integer": "long"}.get(cls, "string")), VarType(cls))


def literal(x: Lit) -> Value:
    if x.lang:
        return Value(F.struct(F.lit(x.lex).alias("lex"), F.lit(x.lang).alias("lang")), VarType("lang"))
    try:
        if x.dt in NUMERIC:
            return Value(F.lit(int(x.lex)).cast("long") if NUMERIC[x.dt] == "integer" else F.lit(float(x.lex)), VarType(NUMERIC[x.dt]))
        if x.dt == XSD + "boolean" and x.lex in ("true", "false", "1", "0"):
            return Value(F.lit(x.lex in ("true", "1")), VarType("boolean"))
        if x.dt == XSD + "dateTime":
            return Value(F.lit(datetime.datetime.fromisoformat(x.lex).replace(tzinfo=None)).cast("timestamp_ntz"), VarType("time"))
        if x.dt == XSD + "date":
            return Value(F.lit(datetime.date.fromisoformat(x.lex)), VarType("date"))
    except ValueError:
        pass
    if x.dt == XSD + "string":
        return Value(F.lit(x.lex), VarType("string"))
    return Value(F.struct(F.lit(LITERAL).cast("byte").alias("kind"), F.lit(x.lex).alias("lex"), F.lit(x.dt).alias("dt"), F.lit("").alias("lang")), VarType("term"))


def as_term(v: Value) -> Column:
    return to_term(v.col, v.type, v.dt)


def text(v: Value) -> Column:
    """STR(): the lexical form or the IRI."""
    if v.type.cls == "term":
        return v.col["lex"]
    if v.type.cls == "lang":
        return v.col["lex"]
    if v.type.cls in ("key", "iri"):
        return to_iri(v.col, v.type, v.dt)
    return as_term(v)["lex"]


def strings(v: Value) -> Column:
    """The text of a string or language-tagged literal; null for anything else."""
    if v.type.cls == "string":
        return v.col
    if v.type.cls == "lang":
        return v.col["lex"]
    if v.type.cls == "term":
        return F.when((v.col["kind"] == LITERAL) & ((v.col["dt"] == XSD + "string") | (v.col["lang"] != "")), v.col["lex"])
    return F.lit(None).cast("string")


def number(v: Value) -> Column:
    if v.type.cls in NUM:
        return v.col
    if v.type.cls == "term":
        return F.when((v.col["kind"] == LITERAL) & v.col["dt"].isin(*NUMERIC), v.col["lex"].try_cast("double"))
    return F.lit(None).cast("double")


def truth(v: Value) -> Column:
    """The effective boolean value."""
    if v.type.cls == "boolean":
        return v.col
    if v.type.cls in NUM:
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    if v.type.cls in ("string", "lang"):
        return F.length(strings(v)) > 0
    if v.type.cls == "term":
        return F.when(v.col["kind"] != LITERAL, F.lit(None)).when(v.col["dt"] == XSD + "boolean", v.col["lex"].isin("true", "1")).when(v.col["dt"].isin(*NUMERIC), F.coalesce(number(v) != 0, F.lit(False))).when((v.col["dt"] == XSD + "string") | (v.col["lang"] != ""), F.length(v.col["lex"]) > 0)
    return F.lit(None).cast("boolean")


def equal(a: Value, b: Value) -> Column:
    """`=`: by value where both are numbers, texts, booleans or times; by term for IRIs; an error for literals of different classes."""
    x, y = a.type.cls, b.type.cls
    if x in NUM and y in NUM:
        return a.col == b.col
    iris = ("key", "iri")
    if x in iris and y in iris:
        if x == y == "key":
            if a.type.of != b.type.of:
                return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
            return a.col == b.col
        return to_iri(a.col, a.type, a.dt) == to_iri(b.col, b.type, b.dt)
    if "term" in (x, y):
        p, q = as_term(a), as_term(b)
        both = p["dt"].isin(*NUMERIC) & q["dt"].isin(*NUMERIC)
        m, n = number(Value(p, VarType("term"))), number(Value(q, VarType("term")))
        known = [XSD + "string", XSD + "boolean", *NUMERIC]
        differ = (p["kind"] == LITERAL) & (q["kind"] == LITERAL) & (p["dt"] != q["dt"])
        return F.when(both, m == n).when(p == q, F.lit(True)).when(differ & (p["lang"] == "") & (q["lang"] == "") & p["dt"].isin(*known) | differ & (p["lang"] == "") & (q["lang"] == ""), F.lit(None)).when(p.isNotNull() & q.isNotNull(), F.lit(False))
    if x == y == "lang":
        return (a.col["lex"] == b.col["lex"]) & (F.lower(a.col["lang"]) == F.lower(b.col["lang"]))
    if x == y:
        return a.col == b.col
    if x in iris or y in iris or "lang" in (x, y):
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    return F.lit(None).cast("boolean")


def compare(op: str, a: Value, b: Value) -> Column:
    if op == "=":
        return equal(a, b)
    if op == "!=":
        return ~equal(a, b)
    f = {"<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[op]
    x, y = a.type.cls, b.type.cls
    if x in NUM and y in NUM or x == y and x in ("string", "boolean", "time", "date"):
        return f(a.col, b.col)
    if {x, y} == {"time", "date"}:
        return F.lit(None).cast("boolean")
    if "term" in (x, y):
        return F.coalesce(f(number(a), number(b)), f(strings(a), strings(b)))
    return F.lit(None).cast("boolean")


CASTS = {XSD + k: v for k, v in {"string": "string", "boolean": "boolean", "dateTime": "time", "date": "date"}.items()} | NUMERIC
RANGES = {XSD + k: v for k, v in {"int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "unsignedLong": (0, None), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255)}.items()}


def cast(to: str, v: Value) -> Value:
    cls = CASTS[to]
    if v.type.cls in ("key", "iri") and cls != "string":
        return null(cls)
    s = text(v)
    if cls == "string":
        return Value(s, VarType("string"))
    if cls == "boolean":
        if v.type.cls in NUM:
            return Value(v.col != 0, VarType("boolean"))
        return Value(F.when(s.isin("true", "1"), F.lit(True)).when(s.isin("false", "0"), F.lit(False)), VarType("boolean"))
    if cls == "time":
        return Value(v.col if v.type.cls == "time" else s.try_cast("timestamp_ntz"), VarType("time"))
    if cls == "date":
        return Value(v.col.cast("date") if v.type.cls == "time" else s.try_cast("date"), VarType("date"))
    if cls == "double":
        return Value((v.col.cast("double") if v.type.cls in (*NUM, "boolean") else s.try_cast("double")), VarType("double"))
    if v.type.cls in (*NUM, "boolean"):
        n = v.col.try_cast("long") if v.type.cls != "boolean" else v.col.cast("long")
    else:
        n = F.when(F.trim(s).rlike(r"^[+-]?\d+$"), F.trim(s)).try_cast("long")
    low, high = RANGES.get(to, (None, None))
    if low is not None:
        n = F.when(n >= low, n)
    if high is not None:
        n = F.when(n <= high, n)
    return Value(n, VarType("integer"))


def evaluate(e: Expr, rel: Rel) -> Value:
    if isinstance(e, Var):
        if e.name not in rel.types:
            return Value(F.lit(None).cast("string"), VarType("string"))
        return Value(F.col(f"`{e.name}`"), rel.types[e.name], rel.dt(e.name))
    if isinstance(e, Iri):
        return Value(F.lit(e.value), VarType("iri"))
    if isinstance(e, Lit):
        return literal(e)
    op, args = e.name, e.args
    if op == "BOUND":
        return Value(evaluate(args[0], rel).col.isNotNull(), VarType("boolean"))
    v = [evaluate(a, rel) for a in args]
    # a constant IRI beside a native key: compare keys, so that the scan can filter
    if op in ("=", "!="):
        for i in (0, 1):
            if v[i].type.cls == "key" and isinstance(args[1 - i], Iri):
                v[1 - i] = key_of(args[1 - i].value, v[i])
    boolean = lambda c: Value(c, VarType("boolean"))
    if op == "&&":
        return boolean(truth(v[0]) & truth(v[1]))
    if op == "||":
        return boolean(truth(v[0]) | truth(v[1]))
    if op == "!":
        return boolean(~truth(v[0]))
    if op in ("=", "!=", "<", ">", "<=", ">="):
        return boolean(compare(op, v[0], v[1]))
    if op in ("+", "-", "*", "/"):
        n = [number(x) for x in v]
        whole = all(x.type.cls == "integer" for x in v)
        if len(n) == 1:
            return Value(-n[0] if op == "-" else n[0], v[0].type if whole else VarType("double"))
        if op == "/":
            return Value(F.try_divide(n[0].cast("double"), n[1].cast("double")), VarType("double"))
        f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
        return Value(f(n[0], n[1]), VarType("integer" if whole else "double"))
    x = v[0] if v else None
    cls = x.type.cls if x else ""
    if op == "ISIRI":
        return boolean(F.when(x.col.isNotNull(), x.col["kind"] == IRI if cls == "term" else F.lit(cls in ("key", "iri"))))
    if op == "ISBLANK":
        return boolean(F.when(x.col.isNotNull(), x.col["kind"] == BLANK if cls == "term" else F.lit(False)))
    if op == "ISLITERAL":
        return boolean(F.when(x.col.isNotNull(), x.col["kind"] == LITERAL if cls == "term" else F.lit(cls not in ("key", "iri"))))
    if op == "STR":
        return Value(text(x), VarType("string"))
    if op == "LANG":
        c = x.col["lang"] if cls == "lang" else F.when(x.col["kind"] == LITERAL, x.col["lang"]) if cls == "term" else F.lit(None).cast("string") if cls in ("key", "iri") else F.when(x.col.isNotNull(), F.lit(""))
        return Value(c, VarType("string"))
    if op == "LANGMATCHES":
        tag, wanted = F.lower(strings(x)), F.lower(strings(v[1]))
        return boolean(F.when(wanted == "*", tag != "").otherwise((tag == wanted) | tag.startswith(F.concat(wanted, F.lit("-")))))
    if op == "DATATYPE":
        if cls in ("key", "iri"):
            return Value(F.lit(None).cast("string"), VarType("iri"))
        c = F.when(x.col["kind"] == LITERAL, x.col["dt"]) if cls == "term" else as_term(x)["dt"]
        return Value(c, VarType("iri"))
    if op in ("UCASE", "LCASE"):
        f = F.upper if op == "UCASE" else F.lower
        if cls == "lang":
            return Value(F.when(x.col.isNotNull(), F.struct(f(x.col["lex"]).alias("lex"), x.col["lang"].alias("lang"))), x.type)
        return Value(f(strings(x)), VarType("string"))
    if op == "CONTAINS":
        return boolean(F.contains(strings(x), strings(v[1])))
    if op == "REGEX":
        flags = args[2].lex if len(args) > 2 and isinstance(args[2], Lit) else ""
        prefix = "".join(f"(?{c})" for c in flags if c in "ismx")
        if isinstance(args[1], Lit):
            return boolean(strings(x).rlike(prefix + args[1].lex))
        return boolean(F.rlike(strings(x), F.concat(F.lit(prefix), strings(v[1]))))
    if op == "SAMETERM":
        return boolean(as_term(x) == as_term(v[1]))
    if op in CASTS:
        return cast(op, x)
    raise ValueError(f"unknown function {op}")


def key_of(iri: str, like: Value) -> Value:
    """A constant IRI as a native key of the other's template, or an IRI if it hasn't that form."""
    rest = iri.removeprefix(like.type.of)
    if iri.startswith(like.type.of) and isinstance(like.dt, (T.LongType, T.IntegerType)) and rest.isdigit() and str(int(rest)) == rest and int(rest) < 2**63:
        return Value(F.lit(int(rest)).cast("long"), like.type, like.dt)
    return Value(F.lit(iri), VarType("iri"))


def condition(e: Expr, rel: Rel) -> Column:
    """A filter's condition: rows where it is false or an error go."""
    return truth(evaluate(e, rel))


def order_key(e: Expr, rel: Rel) -> list[Column]:
    """Sort columns: unbound, blank nodes, IRIs, literals; numbers among themselves by value."""
    v = evaluate(e, rel)
    if v.type.cls == "term":
        rank = F.when(v.col["kind"] == BLANK, 1).when(v.col["kind"] == IRI, 2).when(v.col["kind"] == LITERAL, 3).otherwise(0)
        return [rank, number(v), v.col["lex"], v.col["dt"], v.col["lang"]]
    return [v.col["lex"], v.col["lang"]] if v.type.cls == "lang" else [v.col]


__all__ = ["DATATYPE", "condition", "evaluate", "key_text", "order_key"]
