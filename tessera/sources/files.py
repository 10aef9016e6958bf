"""Readers of graph files and statistics."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..parser import Parser
from ..terms import BLANK, IRI, LITERAL, XSD, Iri

_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'


ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescaped(c: Column) -> Column:
    """Text without its escapes, each read once, from left to right: what an escape stands for isn't read again."""
    parts = F.regexp_extract_all(c, F.lit(r"(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), 1)

    def one(x: Column) -> Column:
        kind = F.substring(x, 2, 1)
        named = F.create_map(*[F.lit(y) for pair in ESCAPES.items() for y in pair])
        # a code point's UTF-32 bytes
        point = F.decode(F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0")), "UTF-32")
        return F.when(~x.startswith("\\"), x).when(kind.isin("u", "U") & (F.length(x) > 2), point).otherwise(F.coalesce(named[kind], kind))

    return F.when(c.contains("\\"), F.array_join(F.transform(parts, one), "")).otherwise(c)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o term) of N-Triples lines; others (comments, blank lines) are skipped."""
    line = spark.read.text(path).select(F.col("value").alias("x")).where(F.col("x").rlike(_LINE))
    part = lambda i: F.regexp_extract("x", _LINE, i)
    o = part(3)
    bare = lambda c: F.when(c.startswith("<"), unescaped(F.regexp_replace(c, "^<|>$", ""))).otherwise(c)
    text = unescaped(F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1))
    dt, lang = F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1), F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1)
    kind = F.when(o.startswith("<"), IRI).when(o.startswith("_:"), BLANK).otherwise(LITERAL)
    is_lit = o.startswith('"')
    term = F.struct(kind.cast("byte").alias("kind"), F.when(is_lit, text).otherwise(bare(o)).alias("lex"), F.when(~is_lit, "").when(dt != "", dt).otherwise(XSD + "string").alias("dt"), F.when(is_lit, lang).otherwise("").alias("lang"))
    return line.select(bare(part(1)).alias("s"), unescaped(part(2)).alias("p"), term.alias("o"))


#: Strings, IRIs and comments, in which nothing is to be replaced; or a blank node.
_BLANKS = re.compile(r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|<[^<>\s]*>|\#[^\n]*)|(_:[\w.-]*\w)""")


def turtle(text: str) -> Iterator[tuple[str, str, int, str, str, str]]:
    """(s, p, kind, lex, dt, lang) of a Turtle document: prefixes, `a`, lists with ; and , and blank nodes with labels."""
    p = Parser(_BLANKS.sub(lambda m: m[1] or f"<{m[2]}>", text))
    while p.at < len(p.tokens):
        if p.tokens[p.at][1].lower() in ("@prefix", "prefix") and p.kind() in ("lang", "word"):
            dotted = p.next().startswith("@")
            name = p.next().rstrip(":")
            p.prefixes[name] = p.next()[1:-1]
            if dotted:
                p.expect(".")
            continue
        for t in p.triples():
            o = t.o
            if isinstance(o, Iri):
                yield t.s.value, t.p.value, BLANK if o.value.startswith("_:") else IRI, o.value, "", ""
            else:
                yield t.s.value, t.p.value, LITERAL, o.lex, o.dt, o.lang
        p.expect(".")


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o term) of Turtle files, each read by one task as a whole; collections and unlabelled blank nodes are refused."""
    names = ["s", "p", "kind", "lex", "dt", "lang"]

    def run(batches):
        for b in batches:
            for text in b.column(0).to_pylist():
                rows = list(zip(*turtle(text)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int8() if n == "kind" else pa.string()) for n, c in zip(names, rows)], names=names)

    raw = spark.read.text(path, wholetext=True).mapInArrow(run, "s string, p string, kind tinyint, lex string, dt string, lang string")
    return raw.select("s", "p", F.struct("kind", "lex", "dt", "lang").alias("o"))


def read_sparql_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a binding of SPARQL results in JSON: a term struct for each variable that any of the files names."""
    text = spark.read.text(path, wholetext=True)
    heads = text.select(F.get_json_object("value", "$.head.vars").alias("h")).distinct().collect()
    names = list(dict.fromkeys(n for h in heads for n in json.loads(h["h"] or "[]")))
    cell = "struct<value string, type string, datatype string, `xml:lang` string>"
    rows = text.select(F.explode(F.from_json(F.get_json_object("value", "$.results.bindings"), f"array<struct<{', '.join(f'`{n}` {cell}' for n in names)}>>")).alias("b"))

    def term(n: str):
        c = F.col(f"b.`{n}`")
        kind = F.when(c["type"] == "uri", IRI).when(c["type"] == "bnode", BLANK).otherwise(LITERAL)
        return F.when(c["value"].isNotNull(), F.struct(kind.cast("byte").alias("kind"), c["value"].alias("lex"), F.when(kind == LITERAL, F.coalesce(c["datatype"], F.lit(XSD + "string"))).otherwise("").alias("dt"), F.coalesce(c["xml:lang"], F.lit("")).alias("lang"))).alias(n)

    return rows.select(*[term(n) for n in names])


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(predicate, subjects, objects, n) from tab-separated lines, authorities separated by semicolons."""
    raw = spark.read.csv(path, sep="\t", schema="predicate string, subjects string, objects string, n long")
    hosts = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: x != "")
    return raw.select("predicate", hosts("subjects").alias("subjects"), hosts("objects").alias("objects"), "n")
