"""Mapped tables as a graph, without triples: patterns become selections of columns."""

from __future__ import annotations

import datetime
from functools import reduce
from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..mapping import TABLES, TableMap
from ..terms import LANG, NUMERIC, RDF_TYPE, TERM, XSD, Iri, Lit, Pattern, Rel, Var, VarType, key_text, to_term, vartype
from .base import Source, union


#: Bytes in memory for one in a file, at most.
UNPACKED = 8


def literal_equals(col: Column, dt: T.DataType, lit: Lit) -> Column:
    """Equality with a constant that the scan can push down; false where the types rule it out."""
    cls, never = vartype(dt).cls, F.lit(False)
    if lit.lang:
        return never
    if cls == "string" and isinstance(dt, T.StringType):
        return col == lit.lex if lit.dt == XSD + "string" else never
    try:
        if cls in ("integer", "double") and lit.dt in NUMERIC:
            x = float(lit.lex)
            return col == F.lit(int(x)) if cls == "integer" and x == int(x) else col == F.lit(x) if cls == "double" else never
        if cls == "boolean" and lit.dt == XSD + "boolean":
            return col == F.lit(lit.lex in ("true", "1"))
        if cls == "time" and lit.dt == XSD + "dateTime":
            return col == F.lit(datetime.datetime.fromisoformat(lit.lex)).cast(dt)
        if cls == "date" and lit.dt == XSD + "date":
            return col == F.lit(datetime.date.fromisoformat(lit.lex))
    except ValueError:
        pass
    return never


class VirtualSource(Source):
    """Parquet tables `{dir}/{table}.parquet` seen through a mapping."""

    def __init__(self, spark: SparkSession, sf_dir: str, id: str = "graph", kind: str = "sparql", tables: dict[str, TableMap] | None = None, where: dict[str, str] | None = None, frames: dict[str, DataFrame] | None = None):
        self.spark, self.dir, self.id, self.kind = spark, sf_dir, id, kind
        self.tables, self.where = tables or TABLES, where or {}
        self._frames = dict(frames or {})
        self._rows: dict[str, int] = {}
        self.classes = {t.cls: t for t in self.tables.values()}
        self.by_base = {t.name: t for t in self.tables.values()}

    def frame(self, t: TableMap) -> DataFrame:
        if t.name not in self._frames:
            df = self.spark.read.parquet(f"{self.dir}/{t.name}.parquet")
            self._frames[t.name] = df.where(self.where[t.name]) if t.name in self.where else df
        return self._frames[t.name]

    def rows(self, t: TableMap) -> int:
        """Rows of the table; Parquet answers from its footers."""
        if t.name not in self._rows:
            self._rows[t.name] = self.frame(t).count()
        return self._rows[t.name]

    # -- which table and column a predicate is

    def predicate(self, p: Iri) -> tuple[TableMap, str] | None:
        name, _, column = p.value.removeprefix("http://ex.org/").partition("#")
        t = self.tables.get(name) if p.value.startswith("http://ex.org/") else None
        if t and (column in t.links or column in self.frame(t).columns and column not in t.hidden):
            return t, column
        return None

    def table_of(self, pattern: Pattern) -> TableMap | None:
        """The one table that can answer the pattern, if its predicate says so."""
        if isinstance(pattern.p, Iri):
            if pattern.p.value == RDF_TYPE:
                return self.classes.get(pattern.o.value) if isinstance(pattern.o, Iri) else None
            found = self.predicate(pattern.p)
            return found[0] if found else None
        return None

    def joint(self, patterns: tuple[Pattern, ...]) -> bool:
        if len(patterns) == 1:
            return True
        tables = {t.name if (t := self.table_of(p)) else None for p in patterns}
        return len({p.s for p in patterns}) == 1 and len(tables) == 1 and None not in tables

    # -- scans

    def key(self, t: TableMap, columns: tuple[str, ...]) -> Column:
        return F.col(columns[0]) if len(columns) == 1 else F.struct(*[F.col(c) for c in columns])

    def key_equals(self, df: DataFrame, t: TableMap, columns: tuple[str, ...], iri: str) -> Column:
        if not iri.startswith(t.template):
            return F.lit(False)
        text = iri[len(t.template) :]
        if len(columns) == 1:
            dt = df.schema[columns[0]].dataType
            if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType)):
                return F.col(columns[0]) == F.lit(int(text)) if text.isdigit() and str(int(text)) == text else F.lit(False)
            return F.col(columns[0]).cast("string") == text
        return key_text(self.key(t, columns), T.StructType([df.schema[c] for c in columns])) == text

    def scan(self, patterns: tuple[Pattern, ...]) -> Rel:
        if len(patterns) > 1 and not self.joint(patterns):
            raise ValueError("these patterns need a join")
        if any(isinstance(p.s, Lit) or isinstance(p.p, Lit) for p in patterns):
            return self.empty(patterns)
        if isinstance(patterns[0].p, Var):
            return self.any_predicate(patterns[0])
        if patterns[0].p.value == RDF_TYPE and isinstance(patterns[0].o, Var):
            found = [self.star((Pattern(patterns[0].s, patterns[0].p, Iri(c)),)) for c in self.classes]
            return union([Rel(r.df.withColumn(patterns[0].o.name, F.lit(c)), r.types | {patterns[0].o.name: VarType("iri")}, r.certain | {patterns[0].o.name}, r.bound) for r, c in zip(found, self.classes)])
        return self.star(patterns) if self.table_of(patterns[0]) else self.empty(patterns)

    def empty(self, patterns: tuple[Pattern, ...]) -> Rel:
        names = sorted({v for p in patterns for v in p.vars})
        df = self.spark.range(0).select(*[F.lit(None).cast(TERM).alias(v) for v in names])
        return Rel(df, {v: VarType("term") for v in names}, frozenset(names), 0)

    def star(self, patterns: tuple[Pattern, ...]) -> Rel:
        """Patterns about one subject in one table: one scan of the columns they name."""
        t = self.table_of(patterns[0])
        df, s = self.frame(t), patterns[0].s
        conditions: list[Column] = []
        columns: dict[str, tuple[Column, VarType]] = {}

        def bind(v: str, col: Column, kind: VarType) -> None:
            if v in columns:
                other, seen = columns[v]
                conditions.append(other == col if seen == kind else F.lit(False))
            else:
                columns[v] = (col, kind)

        if isinstance(s, Var):
            bind(s.name, self.key(t, t.key), VarType("key", t.template))
        else:
            conditions.append(self.key_equals(df, t, t.key, s.value))
        for p in patterns:
            if p.p.value == RDF_TYPE:
                continue
            column = self.predicate(p.p)[1]
            if column in t.links:
                col, target = t.links[column]
                target = TABLES.get(target) or self.tables[target]
                conditions.append(F.col(col).isNotNull())
                if isinstance(p.o, Var):
                    # widened as keys are: equal keys of different widths must join
                    c = F.col(col).cast("long") if isinstance(df.schema[col].dataType, (T.IntegerType, T.ShortType)) else F.col(col)
                    bind(p.o.name, c, VarType("key", target.template))
                else:
                    conditions.append(self.key_equals(df, target, (col,), p.o.value) if isinstance(p.o, Iri) else F.lit(False))
                continue
            dt = df.schema[column].dataType
            kind, col = vartype(dt), F.col(column)
            conditions.append(col.isNotNull())
            if column in t.langs:
                lang = F.coalesce(F.col(t.langs[column]), F.lit(""))
                if isinstance(p.o, Var):
                    bind(p.o.name, F.struct(col.alias("lex"), lang.alias("lang")).cast(LANG), VarType("lang"))
                else:
                    conditions.append((col == p.o.lex) & (F.lower(lang) == p.o.lang.lower()) if isinstance(p.o, Lit) else F.lit(False))
            elif isinstance(p.o, Var):
                c = col.cast("long") if kind.cls == "integer" else col.cast("double") if kind.cls == "double" else col if kind.cls != "string" or isinstance(dt, T.StringType) else F.to_json(F.struct(col))
                bind(p.o.name, c, kind)
            else:
                conditions.append(literal_equals(col, dt, p.o) if isinstance(p.o, Lit) else F.lit(False))
        if isinstance(s, Var) and len(t.key) == 1 and isinstance(df.schema[t.key[0]].dataType, (T.IntegerType, T.ShortType)):
            columns[s.name] = (F.col(t.key[0]).cast("long"), columns[s.name][1])
        for c in conditions:
            df = df.where(c)
        out = df.select(*[c.alias(v) for v, (c, _) in columns.items()]) if columns else df.select()
        return Rel(out, {v: k for v, (_, k) in columns.items()}, frozenset(columns), self.rows(t), size=self.width(t, out.schema), values=lambda v: self.values(t, columns[v][1]))

    def values(self, t: TableMap, kind: VarType) -> int | None:
        """Different keys at most in a column of a table: a row of their own table for each, as the mapping says."""
        of = next((x for x in [*self.tables.values(), *TABLES.values()] if x.template == kind.of), None) if kind.cls == "key" else None
        try:
            return min(self.rows(t), self.rows(of)) if of else None
        except AnalysisException:  # there is no such table
            return None

    def width(self, t: TableMap, schema: T.StructType) -> int:
        """Bytes at most of a scan's rows in memory: columns of fixed size by their rows, others by the table's files, unpacked."""
        fixed = [f for f in schema if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))]
        whole = 0 if len(fixed) == len(schema) else UNPACKED * int(self.frame(t)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return self.rows(t) * 16 * (1 + len(fixed)) + whole

    def object_term(self, t: TableMap, column: str) -> Column:
        """What a column or link holds as a term; null where it is."""
        col = t.links[column][0] if column in t.links else column
        dt, kind, c = self.frame(t).schema[col].dataType, None, F.col(col)
        if column in t.links:
            target = t.links[column][1]
            kind = VarType("key", (TABLES.get(target) or self.tables[target]).template)
        elif column in t.langs:
            kind, c = VarType("lang"), F.struct(c.alias("lex"), F.coalesce(F.col(t.langs[column]), F.lit("")).alias("lang")).cast(LANG)
        else:
            kind = vartype(dt)
            c = c.cast("long") if kind.cls == "integer" else c.cast("double") if kind.cls == "double" else c if kind.cls != "string" or isinstance(dt, T.StringType) else F.to_json(F.struct(c))
        return F.when(F.col(col).isNotNull(), to_term(c, kind, dt))

    def every_predicate(self, t: TableMap, s: Var | Iri) -> DataFrame:
        """(s, p, o) of a table in one scan, s only if it is a variable."""
        df = self.frame(t)
        if isinstance(s, Iri):
            df = df.where(self.key_equals(df, t, t.key, s.value))
        iri = lambda x: to_term(F.lit(x), VarType("iri"), T.StringType())
        names = [c for c in df.columns if c not in t.hidden] + list(t.links)
        each = [F.struct(iri(RDF_TYPE).alias("p"), iri(t.cls).alias("o")), *[F.struct(iri(t.predicate(c)).alias("p"), self.object_term(t, c).alias("o")) for c in names]]
        key = self.key(t, t.key)
        dt = df.schema[t.key[0]].dataType if len(t.key) == 1 else T.StructType([df.schema[c] for c in t.key])
        subject = [to_term(key, VarType("key", t.template), dt).alias("s")] if isinstance(s, Var) else []
        return df.select(*subject, F.explode(F.array(*each)).alias("x")).where("x.o is not null").select(*["s"] * len(subject), "x.p", "x.o")

    def any_predicate(self, p: Pattern) -> Rel:
        """A variable predicate: all that a table has, objects as terms.  With a variable object each table is read once."""
        same_so, same_sp, same_po = p.s == p.o, p.s == p.p, p.p == p.o
        branches = []
        for t in self.tables.values():
            if isinstance(p.s, Iri) and not p.s.value.startswith(t.template):
                continue
            if isinstance(p.o, Var):
                branches.append(self.every_predicate(t, p.s))
                continue
            df = self.frame(t)
            names = [c for c in df.columns if c not in t.hidden] + list(t.links)
            s = Var("s") if isinstance(p.s, Var) else p.s
            for n in [RDF_TYPE, *[t.predicate(c) for c in names]]:
                o = Iri(t.cls) if n == RDF_TYPE else Var("o")
                if n == RDF_TYPE and not isinstance(p.o, Var) and p.o != o:
                    continue
                r = self.star((Pattern(s, Iri(n), o if n == RDF_TYPE or isinstance(p.o, Var) else p.o),))
                cols = []
                if isinstance(p.s, Var):
                    cols.append(to_term(F.col("s"), r.types["s"], r.dt("s")).alias("s"))
                cols.append(to_term(F.lit(n), VarType("iri"), T.StringType()).alias("p"))
                if isinstance(p.o, Var):
                    cols.append((to_term(F.lit(t.cls), VarType("iri"), T.StringType()) if n == RDF_TYPE else to_term(F.col("o"), r.types["o"], r.dt("o"))).alias("o"))
                branches.append(r.df.select(*cols))
        if not branches:
            return self.empty((p,))
        df = reduce(DataFrame.unionAll, branches)
        for yes, a, b in ((same_so, "s", "o"), (same_sp, "s", "p"), (same_po, "p", "o")):
            if yes:
                df = df.where(F.col(a) == F.col(b))
        places = {x.name: c for x, c in ((p.s, "s"), (p.p, "p"), (p.o, "o")) if isinstance(x, Var)}
        return Rel(df.select(*[F.col(c).alias(v) for v, c in places.items()]), {v: VarType("term") for v in places}, frozenset(places))

    # -- statistics

    def estimate(self, patterns: tuple[Pattern, ...]) -> int:
        """Rows of the table, less for constants: one row for a subject, a tenth of the rows for each object."""
        if any(isinstance(p.s, Lit) or isinstance(p.p, Lit) for p in patterns):
            return 0
        t = self.table_of(patterns[0])
        if t is None:
            p = patterns[0]
            if isinstance(p.p, Iri) and p.p.value != RDF_TYPE:
                return 0
            if isinstance(p.p, Iri) and isinstance(p.o, (Iri, Lit)):
                return 0
            return sum(self.rows(t) * (1 if isinstance(p.p, Iri) else len(self.frame(t).columns)) for t in self.tables.values() if not isinstance(p.s, Iri) or p.s.value.startswith(t.template))
        n = self.rows(t)
        if isinstance(patterns[0].s, Iri):
            return min(n, 1) if patterns[0].s.value.startswith(t.template) else 0
        for p in patterns:
            if isinstance(p.o, Lit) or isinstance(p.o, Iri) and p.p.value != RDF_TYPE:
                n = -(-n // 10)
        return n

    def predicate_counts(self) -> DataFrame:
        """(predicate, cnt): triples of each column, one pass over each table."""
        out = []
        for t in self.tables.values():
            names = [c for c in self.frame(t).columns if c not in t.hidden]
            row = self.frame(t).agg(*[F.count(c).alias(c) for c in names])
            out.append(row.select(F.explode(F.array(*[F.struct(F.lit(f"{t.name}#{c}").alias("predicate"), F.col(c).alias("cnt")) for c in names])).alias("x")).select("x.*"))
        return reduce(DataFrame.unionAll, out)

    def authorities(self) -> DataFrame:
        """Hosts as the mapping's templates have them; a column that holds nothing but nulls, or a link that does, has none."""
        host = lambda iri: [h] if (h := urlsplit(iri).netloc) else []
        out = []
        for t in self.tables.values():
            columns = [c for c in self.frame(t).columns if c not in t.hidden] + [col for col, _ in t.links.values()]
            n = self.frame(t).agg(F.count("*").alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
            of = {c: n[f"n{i}"] for i, c in enumerate(columns)}
            out += [(t.predicate(c), host(t.template), [], of[c]) for c in self.frame(t).columns if c not in t.hidden and of[c]]
            out += [(t.predicate(c), host(t.template), host((TABLES.get(target) or self.tables[target]).template), of[col]) for c, (col, target) in t.links.items() if of[col]]
            out += [(RDF_TYPE, host(t.template), host(t.cls), n["rows"])] if n["rows"] else []
        df = self.spark.createDataFrame(out, "predicate string, subjects array<string>, objects array<string>, n long")
        return df.groupBy("predicate").agg(F.array_distinct(F.flatten(F.collect_list("subjects"))).alias("subjects"), F.array_distinct(F.flatten(F.collect_list("objects"))).alias("objects"), F.sum("n").alias("n"))

    def triples(self, tables: list[str] | None = None) -> DataFrame:
        """(s, p, o, g) of the mapped tables, for comparison and export."""
        part = VirtualSource(self.spark, self.dir, self.id, self.kind, {n: self.tables[n] for n in tables or self.tables}, self.where, self._frames)
        r = part.any_predicate(Pattern(Var("s"), Var("p"), Var("o")))
        return r.df.select(F.col("s.lex").alias("s"), F.col("p.lex").alias("p"), "o", F.lit(self.id).alias("g"))
