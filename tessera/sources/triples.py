"""Materialised triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..terms import BLANK, IRI, LITERAL, NUMERIC, Iri, Lit, Pattern, Rel, Var, VarType
from .base import Source


class TripleSource(Source):
    """A table (s string, p string, o term); kept in this layout, it serves any pattern, one scan each."""

    def __init__(self, triples: DataFrame, id: str = "triples", kind: str = "tpf"):
        self.df, self.id, self.kind = triples, id, kind

    def scan(self, patterns: tuple[Pattern, ...]) -> Rel:
        if len(patterns) != 1:
            raise ValueError("a triple table answers one pattern a scan")
        p = patterns[0]
        df, columns = self.df, {}
        iri = lambda c: F.when(c.isNotNull(), F.struct(F.when(c.startswith("_:"), BLANK).otherwise(IRI).cast("byte").alias("kind"), c.alias("lex"), F.lit("").alias("dt"), F.lit("").alias("lang")))
        for node, name in ((p.s, "s"), (p.p, "p"), (p.o, "o")):
            col = F.col(name)
            if isinstance(node, Var):
                term = col if name == "o" else iri(col)
                if node.name in columns:
                    df = df.where(columns[node.name] == term)
                else:
                    columns[node.name] = term
            elif isinstance(node, Iri):
                df = df.where((col["kind"] == IRI) & (col["lex"] == node.value) if name == "o" else col == node.value)
            elif name != "o":
                df = df.where("false")
            elif isinstance(node, Lit):
                same = col["lex"] == node.lex
                if node.dt in NUMERIC:
                    same = F.expr("try_cast(o.lex as double)") == float(node.lex)
                    df = df.where((col["kind"] == LITERAL) & col["dt"].isin(*NUMERIC) & same)
                elif node.lang:
                    df = df.where((col["kind"] == LITERAL) & same & (F.lower(col["lang"]) == node.lang.lower()))
                else:
                    df = df.where((col["kind"] == LITERAL) & same & (col["lang"] == "") & (col["dt"] == node.dt))
        return Rel(df.select(*[c.alias(v) for v, c in columns.items()]), {v: VarType("term") for v in columns}, frozenset(columns))

    def authorities(self) -> DataFrame:
        host = lambda c: F.try_parse_url(c, F.lit("HOST"))
        return self.df.groupBy(F.col("p").alias("predicate")).agg(F.collect_set(host(F.col("s"))).alias("subjects"), F.collect_set(host(F.when(F.col("o.kind") == IRI, F.col("o.lex")))).alias("hosts"), F.bool_or(F.col("o.kind") != IRI).alias("others"), F.count("*").alias("n")).select("predicate", "subjects", F.when((F.size("hosts") > 0) & F.col("others"), F.array_append("hosts", F.lit(""))).otherwise(F.col("hosts")).alias("objects"), "n")
