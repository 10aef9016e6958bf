"""Semantics on a small graph, in every planner and layout."""

import random

import pytest

from tessera.compile import compile_plan, finish
from tessera.engine import Engine
from tessera.parser import parse
from tessera.plans import get_planner
from tessera.plans.nodes import NLJ, SHJ, Join, Leaf, ordered, shared
from tessera.plans.planjson import PlanProblem, to_json
from tessera.runs import Runs, bounds, decode_args, diefficiency, encode_args, to_sparql_json
from tessera.sources import Federation, TripleSource, VirtualSource, read_ntriples, read_sparql_json, read_statistics, read_turtle
from tessera.streaming import stream_query

PRE = "PREFIX v: <http://m.org/> "
XSDS = "http://www.w3.org/2001/XMLSchema#"


@pytest.fixture(scope="module")
def micro(spark, tmp_path_factory):
    lines = [f"<http://m.org/c/{i}> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://m.org/Cust> .\n<http://m.org/c/{i}> <http://m.org/nation> <http://m.org/n/{i % 4}> ." for i in range(20)]
    lines += [f'<http://m.org/o/{j}> <http://m.org/cust> <http://m.org/c/{j % 15}> .\n<http://m.org/o/{j}> <http://m.org/status> "{"FPO"[j % 3]}" .' for j in range(60)]
    lines += [f'<http://m.org/n/{k}> <http://m.org/name> "N{k}" .' for k in range(4)]
    path = tmp_path_factory.mktemp("nt") / "g.nt"
    path.write_text("# micro graph\n" + "\n".join(lines) + "\n")
    df = read_ntriples(spark, str(path)).cache()
    assert df.count() == 20 * 2 + 60 * 2 + 4
    return df


CASES = [
    ("SELECT * { ?c a v:Cust }", 20),
    ("SELECT * { ?o v:cust ?c . ?o v:status ?s }", 60),
    ('SELECT * { ?o v:cust ?c . ?o v:status "F" . ?c v:nation ?n . ?n v:name ?nn }', 20),
    ("SELECT DISTINCT ?n { ?o v:cust ?c . ?c v:nation ?n }", 4),
    ('SELECT * { { ?o v:status "F" } UNION { ?o v:status "P" . ?o v:cust ?c } }', 40),
    ('SELECT * { ?o v:status ?s . ?o v:cust ?c FILTER(?s = "F") }', 20),
    ('SELECT * { ?o v:status ?s . ?o v:cust ?c FILTER(?s = "F") FILTER(?s = "none") }', 0),
    ("SELECT * { ?c a v:Cust . ?c v:nation ?n OPTIONAL { ?o v:cust ?c } }", 65),
    ("SELECT * { ?c a v:Cust OPTIONAL { ?o v:cust ?c } }", 65),
    ("SELECT * { ?c a v:Cust OPTIONAL { ?o v:cust ?c } OPTIONAL { ?c v:nation ?n } }", 65),
    ('SELECT * { ?c a v:Cust . ?c v:nation ?n FILTER(STR(?n) = "none") OPTIONAL { ?o v:cust ?c } }', 0),
    ("SELECT * { ?c a v:Cust . ?c v:nation ?n OPTIONAL { ?o v:cust ?c } OPTIONAL { ?n v:name ?nn } }", 65),
    ('SELECT * { ?o v:status ?s . ?o v:cust ?c FILTER(!(?s = "F")) }', 40),
    ('SELECT * { ?o v:status ?s . ?o v:cust ?c FILTER(REGEX(?s, "f", "i")) }', 20),
    ("SELECT * { ?c a v:Cust . ?n v:name ?nn }", 80),
    ("SELECT * { ?o v:cust ?c } OFFSET 50", 10),
    ('SELECT * { ?o v:status "F" } ORDER BY ?o LIMIT 3 OFFSET 2', 3),
    ('SELECT * { "x" v:status ?s }', 0),
    ("SELECT * { ?x ?p ?x }", 0),
    ("SELECT * { ?c a v:Cust . ?c v:nation ?n FILTER(?n = <http://m.org/n/1>) }", 5),
    ("SELECT * { ?c a v:Cust FILTER(?unbound = 1) }", 0),
    ("SELECT * { ?c a v:Cust FILTER(!BOUND(?unbound) && ISIRI(?c)) }", 20),
]


@pytest.mark.parametrize("text,n", CASES)
@pytest.mark.parametrize("planner", ["left-deep", "idp"])
def test_micro(spark, micro, text, n, planner):
    assert Engine(spark, TripleSource(micro), planner=planner, exact=False).query(PRE + text).count() == n


def test_star_bushy_and_random(spark, micro):
    for planner in ("star-bushy", "random"):
        e = Engine(spark, TripleSource(micro), planner=planner, exact=True)
        for text, n in (CASES[2], CASES[11], CASES[14]):
            assert e.query(PRE + text).count() == n


def test_optionals_associate_to_the_left(spark, micro):
    df = Engine(spark, TripleSource(micro)).query(PRE + CASES[11][0])
    assert df.where("nn is null").count() == 0 and df.where("o is null").count() == 5


def test_two_ids_answer_twice(spark, micro):
    e = Engine(spark, Federation.of(TripleSource(micro, "a"), TripleSource(micro, "b")))
    assert e.query(PRE + CASES[0][0]).count() == 40


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def random_tree(found, rng, op):
    parts = list(found)
    while len(parts) > 1:
        a, b = rng.sample(parts, 2)
        parts = [p for p in parts if p is not a and p is not b] + [ordered(op if shared(a, b) and (isinstance(a, Leaf) or isinstance(b, Leaf)) else SHJ, a, b)]
    return parts[0]


def test_any_plan_gives_the_same_bag(spark, sf):
    q = parse('PREFIX o: <http://ex.org/orders#> PREFIX c: <http://ex.org/customer#> PREFIX n: <http://ex.org/nation#> SELECT ?o ?c ?rn { ?o o:o_orderstatus "F" . ?o o:customer ?c . ?c c:nation ?n . ?n n:n_name ?rn }')
    source = Federation.of(VirtualSource(spark, sf))
    units = [Leaf((p,), source.sources["graph"].cardinality((p,)), ("graph",), ("sparql",)) for p in q.patterns]
    want = None
    rng = random.Random(4)
    trees = [get_planner(n).plan(units) for n in ("left-deep", "star-bushy", "idp", "random")] + [get_planner("given", op=op).plan(units) for op in (NLJ, SHJ)] + [random_tree(units, rng, op) for op in (NLJ, SHJ, NLJ)]
    for t in trees:
        for fuse in (True, False):
            got = rows(finish(compile_plan(t, source, fuse=fuse), q))
            want = want or got
            assert got == want and got


@pytest.mark.parametrize(
    "text",
    [
        'SELECT ?o ?seg { ?o o:o_orderstatus "F" . ?o o:customer ?c . ?c c:c_mktsegment ?seg }',
        "SELECT ?c ?t { ?o o:customer ?c OPTIONAL { ?o o:o_totalprice ?t FILTER(?t > 300000) } }",
        'SELECT ?x { { ?x o:o_orderstatus "P" } UNION { ?x c:c_mktsegment "BUILDING" } }',
        "SELECT ?d { ?o o:o_orderkey ?d FILTER(?d < 20 || ?d = 30) }",
    ],
)
def test_tables_and_triples_agree(spark, sf, text):
    mapped = VirtualSource(spark, sf)
    triples = TripleSource(mapped.triples(["orders", "customer"]))
    text = "PREFIX o: <http://ex.org/orders#> PREFIX c: <http://ex.org/customer#> " + text
    assert rows(Engine(spark, mapped).query(text, form="compat")) == rows(Engine(spark, triples).query(text, form="compat"))


def test_pushdown_and_pruning(spark, sf):
    df = Engine(spark, sf).query('PREFIX o: <http://ex.org/orders#> SELECT ?o ?t { ?o o:o_orderstatus "F" ; o:o_totalprice ?t FILTER(?t > 1000) }')
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan and "Join" not in plan


def test_mixed_types_join_as_terms(spark, sf):
    e = Engine(spark, sf)
    pre = "PREFIX o: <http://ex.org/orders#> PREFIX c: <http://ex.org/customer#> "
    assert e.query(pre + "SELECT * { ?x o:o_orderstatus ?s . ?x c:c_name ?n }").count() == 0  # templates differ
    both = e.query(pre + "SELECT ?x ?n { { ?x o:customer <http://ex.org/customer/7> } UNION { ?x c:c_name ?m } ?x c:c_name ?n }")
    assert both.count() == spark.read.parquet(f"{sf}/customer.parquet").count()


def test_runs(spark, sf, tmp_path):
    e = Engine(spark, sf, decomposition=None, exact=True)
    q = 'PREFIX o: <http://ex.org/orders#> PREFIX c: <http://ex.org/customer#> SELECT ?o ?seg { ?o o:o_orderstatus "F" . ?o o:customer ?c . ?c c:c_mktsegment ?seg }'
    plan = e.plan(q)
    runs = Runs(e, str(tmp_path))
    a = runs.submit(plan, q, "First run")
    b = runs.submit(plan, q, "second")
    done = runs.get(a)
    assert done["status"] == "done" and done["result_count"] == runs.answers(a).count() > 0
    import json

    assert json.loads(done["plan"])["produced_tuples"] == done["result_count"]
    assert [r["run_id"] for r in runs.recent().collect()] == [b, a] and runs.search("FIRST").count() == 1 and runs.other_plans(q).first()["run_id"] == b
    assert done["requests"] == 3
    assert runs.summary().first()["runs"] == 2
    slow = "SELECT ?a ?b { ?a <http://ex.org/lineitem#l_tax> ?x . ?b <http://ex.org/lineitem#l_tax> ?y . ?z <http://ex.org/orders#o_orderkey> ?k }"
    assert runs.get(runs.submit(e.plan(slow), slow, cap=0.5))["status"] == "timeout"
    assert runs.table.count() == 3


def test_traces(spark):
    t = spark.createDataFrame([("a", 0.0, 1), ("a", 1.0, 2), ("a", 3.0, 3), ("b", 2.0, 1)], "g string, t double, n int")
    assert {r["g"]: r["dief"] for r in diefficiency(t, ["g"], "t").collect()} == {"a": 1 * 1 + 2 * 2, "b": 0}
    top = bounds(t.where("g = 'a'"), t.where("g = 'b'"), "t").first()
    assert (top["max_time"], top["max_count"]) == (3.0, 3)
    j = to_sparql_json(t.where("g = 'b'").select("g", "t"), "t")
    assert j["head"]["vars"] == ["g"] and j["results"]["bindings"][0]["_trace_"] == {"value": "2.0", "type": "Literal", "count": "1"}
    assert decode_args(encode_args("SELECT", ["tpf@x"], "idp")) == ("SELECT", ["tpf@x"], "idp")


def test_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"head": {"vars": ["a", "b"]}, "results": {"bindings": [{"a": {"type": "uri", "value": "http://x"}, "b": {"type": "literal", "value": "5", "datatype": "%sinteger"}}, {"a": {"type": "literal", "value": "t", "xml:lang": "en"}}]}}' % XSDS)
    got = read_sparql_json(spark, str(tmp_path / "r.json")).collect()
    assert got[0]["a"]["kind"] == 0 and got[0]["b"]["dt"] == XSDS + "integer" and got[1]["a"]["lang"] == "en" and got[1]["b"] is None
    (tmp_path / "s.tsv").write_text("http://x/p\ta.org;b.org\t\t7\n")
    s = read_statistics(spark, str(tmp_path / "s.tsv")).first()
    assert s["subjects"] == ["a.org", "b.org"] and s["objects"] == [] and s["n"] == 7


def test_authorities_and_selection(spark, sf, micro):
    a = {r["predicate"]: r for r in TripleSource(micro).authorities().collect()}
    assert a["http://m.org/nation"]["objects"] == ["m.org"] and a["http://m.org/name"]["objects"] == []
    e = Engine(spark, Federation.of(VirtualSource(spark, sf, "t"), TripleSource(micro, "m")), selection="statistics", exact=True)
    assert e.query(PRE + CASES[2][0]).count() == 20
    assert Engine(spark, TripleSource(micro)).per_source(PRE + CASES[2][0]).count() == 20


def test_stream(spark, sf, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = "PREFIX e: <http://ex.org/events#> PREFIX c: <http://ex.org/customer#> SELECT ?e ?seg { ?e e:customer ?c . ?c c:c_mktsegment ?seg }"
    out = stream_query(spark, sf, "events", stream, q).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path)).start()
    out.processAllAvailable()
    out.stop()
    assert spark.table("streamed").count() == Engine(spark, sf).query(q).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_expressions(spark):
    from tessera.functions import condition
    from tessera.terms import Rel, vartype

    df = spark.createDataFrame([(5, 5.0, "10", True), (0, 2.5, "9", False), (None, None, "", None)], "i long, d double, s string, b boolean")
    rel = Rel(df, {c: vartype(df.schema[c].dataType) for c in df.columns}, frozenset())

    def count(text):
        return df.where(condition(parse(f"SELECT * {{ ?x ?y ?z FILTER({text}) }}").body.elements[1].expr, rel)).count()

    for text, n in {
        "?i = ?d": 1, "?s < \"9\"": 2, "?i > \"1\"": 0, "?i != \"5\"": 0, "?s != 9": 0, "?i": 1, "!?b": 1, "?s": 2, "?i / 0 > 1": 0, "?i / ?i = 1": 1, "-?i < 0": 1,
        "xsd:integer(?s) > 8": 2, "xsd:positiveInteger(?i) = 5": 1, "xsd:double(?s) = 10": 1, "xsd:boolean(?i)": 1, "xsd:dateTime(\"2020-01-02T00:00:00\") > xsd:dateTime(\"2020-01-01T00:00:00\")": 3,
        "DATATYPE(?i) = xsd:integer": 2, "LANG(?s) = \"\"": 3, "LANGMATCHES(\"en-GB\", \"en\")": 3, "LANGMATCHES(\"\", \"*\")": 0, "SAMETERM(?i, 5)": 1, "SAMETERM(?d, 5)": 0, "ISLITERAL(?i)": 2, "ISBLANK(?s)": 0, "CONTAINS(UCASE(?s), \"1\")": 1, "STR(?b) = \"true\"": 1, "?i = ?nothing || ?i = 5": 1,
    }.items():
        assert count(text) == n, text


def test_order_of_kinds(spark):
    e = Engine(spark, TripleSource(spark.createDataFrame([("http://x/1", "http://x/p", (1, "10", XSDS + "integer", "")), ("http://x/1", "http://x/p", (1, "9", XSDS + "integer", "")), ("http://x/1", "http://x/p", (0, "http://z", "", "")), ("http://x/1", "http://x/p", (2, "_:b", "", ""))], "s string, p string, o struct<kind:tinyint,lex:string,dt:string,lang:string>")))
    assert [r["o"] for r in e.query("SELECT ?o { ?s ?p ?o } ORDER BY ?o").collect()] == ["_:b", "http://z", "9", "10"]


def test_plans_answer_their_queries(spark, sf):
    """Every catalogue text by its own plan gives what the query gives: filters, OPTIONAL, UNION, modifiers, sources."""
    from tessera import catalogue

    e = Engine(spark, sf)
    assert len(catalogue.SPARQL) > 40
    for name, text in catalogue.SPARQL.items():
        text = catalogue.P + text
        want, got = e.query(text), e.run_plan(e.plan(text), text)
        assert got.schema == want.schema, name
        if "LIMIT" not in text.upper():
            assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0, name


def test_edited_plans(spark, sf, tmp_path):
    e = Engine(spark, sf)
    pre = "PREFIX o: <http://ex.org/orders#> PREFIX c: <http://ex.org/customer#> "
    q = pre + 'SELECT ?o ?n { ?o o:customer ?c ; o:o_totalprice ?t FILTER(?t > 300000) OPTIONAL { ?c c:c_name ?n } }'
    plan = e.plan(q)
    assert plan["type"] == "Groups" and len(plan["groups"]) == 2
    with pytest.raises(PlanProblem):
        e.run_plan(plan["groups"][0], q)
    with pytest.raises(PlanProblem):
        e.run_plan(plan, pre + "SELECT * { ?o o:customer ?c }")
    runs = Runs(e, str(tmp_path))
    done = runs.get(runs.submit(plan, q))
    assert done["status"] == "done" and done["error"] is None and done["result_count"] == e.query(q).count()
    last = runs.trace(done["run_id"]).orderBy("seconds").collect()[-1]
    assert last["n"] == done["result_count"] and 0 <= last["seconds"] <= done["t_delta"] + 1
    failed = runs.get(runs.submit(plan["groups"][0], q))
    assert failed["status"] == "failed" and "PlanProblem" in failed["error"]


def test_federated_plans_name_their_sources(spark, sf):
    e = Engine(spark, Federation.of(VirtualSource(spark, sf, "a"), VirtualSource(spark, sf, "b", tables={"customer": VirtualSource(spark, sf).tables["customer"]})))
    q = "PREFIX o: <http://ex.org/orders#> PREFIX c: <http://ex.org/customer#> SELECT DISTINCT ?o ?n { ?o o:customer ?c . ?c c:c_name ?n FILTER(CONTAINS(?n, \"7\")) } ORDER BY ?o LIMIT 9"
    want = e.query(q).collect()
    assert e.run_plan(e.plan(q), q).collect() == want == e.per_source(q).collect() and len(want) == 9
    with pytest.raises(PlanProblem):
        e.run_plan({"type": "Leaf", "tpf": "?o <http://ex.org/orders#customer> ?c .", "sources": ["z"]}, "SELECT * { ?o <http://ex.org/orders#customer> ?c }")
    hybrid = Engine(spark, e.sources, selection="hybrid")
    assert hybrid.query(q).collect() == want


def test_graph_files_read_escapes_once(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<http://x/1> <http://x/p> "a\\\\nb" .\n<http://x/2> <http://x/p> "\\u00e9\\t\\"\\U0001F600"@en .\n<http://x/3> <http://x/p> _:b .\n')
    got = {r["s"]: r["o"] for r in read_ntriples(spark, str(tmp_path / "a.nt")).collect()}
    assert got["http://x/1"]["lex"] == "a\\nb" and (got["http://x/2"]["lex"], got["http://x/2"]["lang"]) == ('é\t"\U0001f600', "en") and got["http://x/3"]["kind"] == 2
    (tmp_path / "a.ttl").write_text('@prefix x: <http://x/> .\n# a comment with _:no\nx:1 a x:T ; x:p "a _:b", 5 , _:b .\nPREFIX y: <http://y/>\n_:b y:q "d"@en .\n')
    rows = sorted((r["s"], r["p"].rsplit("/", 1)[1], r["o"]["kind"], r["o"]["lex"], r["o"]["lang"]) for r in read_turtle(spark, str(tmp_path / "a.ttl")).collect())
    assert rows == sorted([("http://x/1", "22-rdf-syntax-ns#type", 0, "http://x/T", ""), ("http://x/1", "p", 1, "a _:b", ""), ("http://x/1", "p", 1, "5", ""), ("http://x/1", "p", 2, "_:b", ""), ("_:b", "q", 1, "d", "en")])


def test_only_small_scans_are_broadcast_by_hint(spark, sf, monkeypatch):
    from tessera import catalogue
    from tessera.operators import joins as J

    text = catalogue.P + catalogue.SPARQL["path_join_4_bushy"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tree = Engine(spark, sf, planner="given", op=NLJ, decomposition=None).query(text)
        assert "BroadcastHashJoin" in tree._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(J, "BROADCAST_BYTES", 100)
        large = Engine(spark, sf, planner="given", op=NLJ, decomposition=None).query(text)
        assert "BroadcastHashJoin" not in large._jdf.queryExecution().executedPlan().toString()
        assert large.exceptAll(tree).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # texts count by their bytes, not by rows
    docs = VirtualSource(spark, sf)
    scan = docs.scan((parse("SELECT * { ?d <http://ex.org/documents#text> ?t }").patterns[0],))
    assert scan.size > sum(len(r["text"].encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r["text"])


@pytest.mark.parametrize("name", ["object_object_join", "filter_var_var"])
def test_joins_that_fan_out_are_spread_by_rows(spark, sf, duck, monkeypatch, name):
    from tessera import catalogue
    from tessera.operators import joins as J

    monkeypatch.setattr(J, "TASK_ROWS", 50)
    monkeypatch.setattr(J, "FANS_OUT", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = catalogue.QUERIES[name](spark, sf)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # 150 customers and 10 suppliers in 25 nations: no fewer tasks than cores, and not by nation
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "REPARTITION_BY_NUM" in plan
        assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        assert sorted(map(tuple, got.collect())) == sorted(duck.sql(catalogue.SQL[name]).fetchall())
        monkeypatch.setattr(J, "TASK_ROWS", 10)
        assert catalogue.QUERIES[name](spark, sf).rdd.getNumPartitions() == 150 * 10 // 25 // 10
        # a link to a key makes no more rows than it has
        monkeypatch.setattr(J, "FANS_OUT", 1)
        path = catalogue.QUERIES["path_join_2"](spark, sf)
        assert "REPARTITION_BY_NUM" not in path._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(J, "FANS_OUT", 0)
        monkeypatch.setattr(J, "BROADCAST_BYTES", 100)
        assert "REPARTITION_BY_NUM" not in catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
