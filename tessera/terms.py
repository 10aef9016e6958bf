"""RDF terms, static types of variables, and the solution relation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
IRI, LITERAL, BLANK = 0, 1, 2
TERM = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("lex", T.StringType()), T.StructField("dt", T.StringType()), T.StructField("lang", T.StringType())])
LANG = T.StructType([T.StructField("lex", T.StringType()), T.StructField("lang", T.StringType())])

#: XSD type -> class it is computed in
NUMERIC = {f"{XSD}{x}": "integer" for x in "integer int short long byte nonPositiveInteger nonNegativeInteger positiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte".split()} | {f"{XSD}{x}": "double" for x in ("decimal", "float", "double")}


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class Iri:
    value: str

    def __str__(self) -> str:
        return f"<{self.value}>"


@dataclass(frozen=True)
class Lit:
    lex: str
    dt: str = XSD + "string"
    lang: str = ""

    def __str__(self) -> str:
        text = '"' + self.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
        return text + (f"@{self.lang}" if self.lang else "" if self.dt == XSD + "string" else f"^^<{self.dt}>")


Node = Var | Iri | Lit


@dataclass(frozen=True)
class Pattern:
    """A triple pattern."""

    s: Node
    p: Node
    o: Node

    @property
    def vars(self) -> frozenset[str]:
        return frozenset(x.name for x in (self.s, self.p, self.o) if isinstance(x, Var))

    @property
    def mask(self) -> int:
        """Which places hold variables: s 4, p 2, o 1."""
        return sum(b for x, b in ((self.s, 4), (self.p, 2), (self.o, 1)) if isinstance(x, Var))

    def __str__(self) -> str:
        return f"{self.s} {self.p} {self.o} ."


@dataclass(frozen=True)
class VarType:
    """What a variable's column holds.

    cls: `key` (an IRI as its native key, template in `of`), `iri` (text),
    `integer`, `double`, `string`, `boolean`, `time`, `date`, `lang` (text and
    language) or `term` (any term, kind and all).
    """

    cls: str
    of: str = ""


def vartype(dt: T.DataType) -> VarType:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return VarType("integer")
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return VarType("double")
    if isinstance(dt, T.BooleanType):
        return VarType("boolean")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return VarType("time")
    if isinstance(dt, T.DateType):
        return VarType("date")
    return VarType("string")


DATATYPE = {"integer": XSD + "integer", "double": XSD + "double", "string": XSD + "string", "boolean": XSD + "boolean", "time": XSD + "dateTime", "date": XSD + "date"}


def key_text(col: Column, dt: T.DataType | None = None) -> Column:
    """A native key as the last part of its IRI."""
    if isinstance(dt, T.StructType):
        return F.concat_ws("-", *[col[f.name].cast("string") for f in dt.fields])
    return col.cast("string")


def to_iri(col: Column, t: VarType, dt: T.DataType) -> Column:
    return F.when(col.isNotNull(), F.concat(F.lit(t.of), key_text(col, dt))) if t.cls == "key" else col


def to_term(col: Column, t: VarType, dt: T.DataType) -> Column:
    """Any typed column as a term struct; null stays null."""
    if t.cls == "term":
        return col
    if t.cls in ("key", "iri"):
        parts = (IRI, to_iri(col, t, dt), F.lit(""), F.lit(""))
    elif t.cls == "lang":
        parts = (LITERAL, col["lex"], F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"), col["lang"])
    else:
        text = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss") if t.cls == "time" else col.cast("string")
        parts = (LITERAL, text, F.lit(DATATYPE[t.cls]), F.lit(""))
    return F.when(col.isNotNull(), F.struct(F.lit(parts[0]).cast("byte").alias("kind"), parts[1].alias("lex"), parts[2].alias("dt"), parts[3].alias("lang")))


@dataclass
class Rel:
    """Solutions: a column for each variable, its type, and the variables that are bound in every row."""

    df: DataFrame
    types: dict[str, VarType]
    certain: frozenset[str]
    #: rows at most, where known without running anything
    bound: int | None = None
    observed: list = field(default_factory=list)
    #: bytes at most in memory, where known from the files; lost by whatever changes the rows' width
    size: int | None = None
    #: of a scan: how many values a variable that is a key or link has at most, or None
    values: Callable[[str], int | None] | None = None

    def dt(self, v: str) -> T.DataType:
        return self.df.schema[v].dataType

    def as_term(self, v: str) -> Rel:
        if self.types[v].cls == "term":
            return self
        return Rel(self.df.withColumn(v, to_term(F.col(f"`{v}`"), self.types[v], self.dt(v))), self.types | {v: VarType("term")}, self.certain, self.bound, self.observed)
