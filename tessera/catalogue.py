"""The catalogue: graph queries over the test tables, and the SQL that says the same."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .parser import parse_pattern
from .runs import answer_trace, latest
from .sources import Federation, VirtualSource

P = "".join(f"PREFIX {t}: <http://ex.org/{t}#>\n" for t in "region nation customer supplier part orders lineitem events documents labels pages conversations".split()) + "PREFIX row: <http://ex.org/>\n"

#: name -> query text
SPARQL = {
    "scan_pattern": "SELECT ?n ?name { ?n nation:n_name ?name }",
    "scan_constant_object": 'SELECT ?o { ?o orders:o_orderstatus "F" }',
    "scan_constant_subject": "SELECT ?name { <http://ex.org/customer/7> customer:c_name ?name }",
    "scan_typed_literal": "SELECT ?p { ?p part:p_size 15 }",
    "scan_class": "SELECT ?c { ?c a row:Customer }",
    "scan_variable_predicate": "SELECT ?p ?v { <http://ex.org/region/1> ?p ?v }",
    "star_join": "SELECT ?o ?s ?t ?p { ?o orders:o_orderstatus ?s ; orders:o_totalprice ?t ; orders:o_orderpriority ?p }",
    "path_join_2": "SELECT ?o ?c ?seg { ?o orders:customer ?c . ?c customer:c_mktsegment ?seg }",
    "path_join_4_bushy": 'SELECT ?o ?c ?n ?r ?rn { ?o orders:o_orderstatus "F" . ?o orders:customer ?c . ?c customer:nation ?n . ?n nation:region ?r . ?r region:r_name ?rn }',
    "object_object_join": "SELECT ?c ?s ?n { ?c customer:nation ?n . ?s supplier:nation ?n }",
    "bag_duplicates": "SELECT ?seg { ?c customer:c_mktsegment ?seg }",
    "bind_join_small_outer": 'SELECT ?p ?q { ?p part:p_brand "Brand#2" . ?l lineitem:part ?p . ?l lineitem:l_quantity ?q }',
    "lineitem_star_multi": 'SELECT ?o ?s { ?l lineitem:orders ?o ; lineitem:supplier ?s ; lineitem:l_returnflag "R" }',
    "cartesian_bgp": "SELECT ?r ?rn ?s ?sn { ?r region:r_name ?rn . ?s supplier:s_name ?sn }",
    "star_shared_object": "SELECT ?x { ?o orders:o_orderkey ?x . ?o orders:o_custkey ?x }",
    "filter_numeric": "SELECT ?o ?t { ?o orders:o_totalprice ?t FILTER(?t > 300000) }",
    "filter_not_equal": 'SELECT ?o ?s { ?o orders:o_orderstatus ?s FILTER(?s != "F") }',
    "filter_datetime": 'SELECT ?o ?d { ?o orders:o_orderdate ?d FILTER(?d >= "1998-01-01T00:00:00"^^xsd:dateTime) }',
    "filter_and_or_not": 'SELECT ?o { ?o orders:o_orderstatus ?s ; orders:o_totalprice ?t FILTER((?s = "F" || ?s = "P") && !(?t < 100000)) }',
    "filter_arithmetic": "SELECT ?o ?e ?d { ?l lineitem:orders ?o ; lineitem:l_extendedprice ?e ; lineitem:l_discount ?d FILTER(?e * (1 - ?d) > 80000) }",
    "filter_two_filters": 'SELECT ?p { ?p part:p_size ?z ; part:p_brand ?b FILTER(?z > 40) FILTER(?b = "Brand#4") }',
    "filter_var_var": "SELECT ?c ?s { ?c customer:nation ?n ; customer:c_acctbal ?ab . ?s supplier:nation ?n ; supplier:s_acctbal ?sb FILTER(?ab > ?sb) }",
    "filter_iri_equality": "SELECT ?o { ?o orders:customer ?c FILTER(?c = <http://ex.org/customer/7>) }",
    "fn_regex": 'SELECT ?p ?n { ?p part:p_name ?n FILTER(REGEX(?n, "^small", "i")) }',
    "fn_contains": 'SELECT ?p ?n { ?p part:p_name ?n FILTER(CONTAINS(?n, "ring")) }',
    "fn_ucase_lcase": 'SELECT ?p { ?p part:p_type ?t FILTER(LCASE(?t) = "promo") }',
    "fn_str_cast": "SELECT ?p ?z { ?p part:p_size ?z FILTER(xsd:integer(STR(?z)) >= 45) }",
    "fn_lang": 'SELECT ?d { ?d documents:text ?t FILTER(LANG(?t) = "fr") }',
    "optional_basic": "SELECT ?d ?s ?q { ?d documents:source ?s OPTIONAL { ?l labels:document ?d . ?l labels:quality ?q } }",
    "optional_two": "SELECT ?d ?q ?x { ?d documents:source ?s OPTIONAL { ?l labels:document ?d . ?l labels:quality ?q } OPTIONAL { ?m labels:document ?d . ?m labels:toxic ?x FILTER(?x = 1) } }",
    "optional_with_filter": "SELECT ?d ?q { ?d documents:source ?s OPTIONAL { ?l labels:document ?d . ?l labels:quality ?q FILTER(?q = 1) } }",
    "optional_not_bound": "SELECT ?o { ?o orders:o_orderstatus ?s OPTIONAL { ?l lineitem:orders ?o } FILTER(!BOUND(?l)) }",
    "optional_large_right": 'SELECT ?o ?q { ?o orders:o_orderpriority "1-URGENT" OPTIONAL { ?l lineitem:orders ?o . ?l lineitem:l_quantity ?q } }',
    "union_same_vars": 'SELECT ?o { { ?o orders:o_orderstatus "F" } UNION { ?o orders:o_orderstatus "P" } }',
    "union_diff_vars": "SELECT ?c ?cb ?s ?sb { { ?c customer:c_acctbal ?cb } UNION { ?s supplier:s_acctbal ?sb } }",
    "union_join": 'SELECT ?o ?c { { ?o orders:o_orderstatus "F" } UNION { ?o orders:o_totalprice ?t FILTER(?t > 300000) } ?o orders:customer ?c }',
    "distinct_projection": "SELECT DISTINCT ?n ?seg { ?c customer:nation ?n ; customer:c_mktsegment ?seg }",
    "distinct_star": "SELECT DISTINCT ?c ?p { ?o orders:customer ?c ; orders:o_orderpriority ?p }",
    "order_by_limit": "SELECT ?o ?t { ?o orders:o_totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 10",
    "order_offset_limit": "SELECT ?o { ?o a row:Orders } ORDER BY ?o LIMIT 20 OFFSET 40",
    "order_nonprojected": "SELECT ?o { ?o orders:o_totalprice ?t } ORDER BY ?t ?o LIMIT 5",
    "offset_only": "SELECT ?c { ?c a row:Customer } ORDER BY ?c OFFSET 1490",
    "order_by_expr": "SELECT ?p ?n { ?p part:p_name ?n } ORDER BY LCASE(?n) ?p LIMIT 7",
    "select_star": 'SELECT * { ?o orders:o_orderstatus "P" ; orders:customer ?c }',
    "fn_isiri": "SELECT ?o { ?o orders:customer ?c ; orders:o_totalprice ?t FILTER(ISIRI(?c) && !ISIRI(?t)) }",
    "fn_isblank": "SELECT ?o { ?o orders:customer ?c FILTER(!ISBLANK(?c)) }",
    "fn_isliteral": "SELECT ?n ?name { ?n nation:n_name ?name ; nation:region ?r FILTER(ISLITERAL(?name) && !ISLITERAL(?r)) }",
    "fn_datatype": "SELECT ?p ?z { ?p part:p_size ?z ; part:p_retailprice ?x FILTER(DATATYPE(?z) = xsd:integer && DATATYPE(?x) = xsd:double) }",
    "fn_sameterm": 'SELECT ?p { ?p part:p_size ?z ; part:p_brand ?b FILTER(SAMETERM(?z, 15) || SAMETERM(?b, "Brand#4")) }',
    "fn_langmatches": 'SELECT ?d { ?d documents:text ?t FILTER(LANGMATCHES(LANG(?t), "EN") || LANG(?t) = "de") }',
    "filter_plus_divide": "SELECT ?o ?q { ?l lineitem:orders ?o ; lineitem:l_quantity ?q ; lineitem:l_extendedprice ?e ; lineitem:l_tax ?x FILTER(?e / ?q + ?x > 1900 && -?q < -10) }",
    "optional_nested": "SELECT ?c ?o ?q { ?c customer:c_mktsegment \"BUILDING\" OPTIONAL { ?o orders:customer ?c ; orders:o_orderstatus \"F\" OPTIONAL { ?l lineitem:orders ?o ; lineitem:l_returnflag \"R\" ; lineitem:l_quantity ?q } } }",
    "conversation_star": 'SELECT ?c ?t { ?x conversations:role "user" ; conversations:conv_id ?c ; conversations:turn ?t }',
}


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    return Engine(spark, sf_dir, **options)


def from_text(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).query(P + SPARQL[name])

    run.__name__ = name
    run.__doc__ = SPARQL[name]
    return run


def scan_count_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cardinality of one pattern, as a row."""
    n = engine(spark, sf_dir).cardinality(parse_pattern('?o <http://ex.org/orders#o_orderstatus> "F"'))
    return spark.createDataFrame([(n,)], "cardinality long")


def iri_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys written out as IRIs."""
    return engine(spark, sf_dir).query(P + "SELECT ?c ?name { ?c customer:c_name ?name }", form="iri")


def federated_dup_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graph under two ids answers twice."""
    both = Federation.of(VirtualSource(spark, sf_dir, "a"), VirtualSource(spark, sf_dir, "b"))
    return Engine(spark, both).query("SELECT ?c { ?c a ex:Customer }")


def federated_disjoint_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two graphs that hold the orders between them."""
    both = Federation.of(VirtualSource(spark, sf_dir, "f", where={"orders": "o_orderstatus = 'F'"}), VirtualSource(spark, sf_dir, "rest", where={"orders": "o_orderstatus <> 'F'"}))
    return Engine(spark, both).query(P + "SELECT ?o ?s { ?o orders:o_orderstatus ?s }")


def halves(spark: SparkSession, sf_dir: str, first: str = "sparql", second: str = "sparql") -> Federation:
    """Orders in one graph, customers in another."""
    all_ = VirtualSource(spark, sf_dir).tables
    return Federation.of(VirtualSource(spark, sf_dir, "sales", first, {"orders": all_["orders"]}), VirtualSource(spark, sf_dir, "people", second, {"customer": all_["customer"]}))


def federated_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan with one source for each pattern."""
    return Engine(spark, halves(spark, sf_dir), pruning=True).query(P + "SELECT ?o ?c ?name { ?o orders:customer ?c . ?c customer:c_name ?name }")


def federated_decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star of one source in one request, joined with a pattern of another."""
    return Engine(spark, halves(spark, sf_dir, "sparql", "tpf"), decomposition="colour").query(P + "SELECT ?o ?t ?s ?name { ?o orders:o_totalprice ?t ; orders:o_orderstatus ?s ; orders:customer ?c . ?c customer:c_name ?name }")


def planned(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, planner=name).query(P + SPARQL["path_join_4_bushy"].replace("?o ?c ?n ?r ?rn", "?o ?rn", 1))

    run.__doc__ = f"A path of four joins, planned by {name}."
    return run


def planned_filter(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, planner=name).query(P + PLANNED_FILTER)

    run.__doc__ = f"A path with filters before and after a join, planned by {name}."
    return run


PLANNED_FILTER = 'SELECT ?o ?name { ?o orders:customer ?c ; orders:o_totalprice ?t . ?c customer:c_acctbal ?ab ; customer:nation ?n . ?n nation:n_name ?name FILTER(?t > 200000) FILTER(?ab < ?t / 100) }'


def replayed(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query by its own plan, sent through JSON."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, planner="idp")
        return e.run_plan(json.loads(json.dumps(e.plan(P + text))), P + text)

    run.__doc__ = text
    return run


def run_plan_federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A federated query by its own plan, whose leaves name their sources."""
    e, text = Engine(spark, halves(spark, sf_dir)), P + FEDERATED
    return e.run_plan(json.loads(json.dumps(e.plan(text))), text)


def per_source_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DISTINCT, filter, order and slice over the union of plans by source."""
    return Engine(spark, halves(spark, sf_dir)).per_source(P + FEDERATED)


def hybrid_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by statistics, and by asking where patterns have constants."""
    return Engine(spark, halves(spark, sf_dir), selection="hybrid").query(P + FEDERATED)


FEDERATED = 'SELECT DISTINCT ?seg ?s { ?o orders:o_orderstatus ?s ; orders:customer ?c . ?c customer:c_mktsegment ?seg FILTER(?s != "F") } ORDER BY ?seg ?s LIMIT 6'


def predicate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of two predicates."""
    source = VirtualSource(spark, sf_dir)
    two = VirtualSource(spark, sf_dir, tables={n: source.tables[n] for n in ("orders", "customer")})
    return two.predicate_counts().where(F.col("predicate").isin("orders#o_orderstatus", "customer#c_name"))


def subject_authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different hosts of page URLs."""
    pages = engine(spark, sf_dir).query(P + "SELECT ?u { ?p pages:url ?u }")
    return pages.select(F.coalesce(F.try_parse_url("u", F.lit("HOST")), F.lit("")).alias("authority")).distinct()


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running count of each user's events."""
    events = engine(spark, sf_dir).query(P + "SELECT ?e ?u ?ts { ?e events:user_id ?u ; events:ts ?ts }")
    return answer_trace(events, ["u"], ["ts", "e"]).select("e", "u", "n")


def latest_run_per_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event of each type."""
    events = engine(spark, sf_dir).query(P + "SELECT ?e ?u ?k ?ts { ?e events:user_id ?u ; events:event_type ?k ; events:ts ?ts }")
    return latest(events, ["u", "k"], ["ts", "e"]).select("u", "k", "e")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: from_text(n) for n in SPARQL} | {
    "scan_count_metadata": scan_count_metadata,
    "iri_rendering": iri_rendering,
    "federated_dup_source": federated_dup_source,
    "federated_disjoint_sources": federated_disjoint_sources,
    "federated_pruned": federated_pruned,
    "federated_decomposed": federated_decomposed,
    "planner_leftdeep": planned("left-deep"),
    "planner_starbushy": planned("star-bushy"),
    "planner_idp": planned("idp"),
    "planner_random": planned("random"),
    "planner_filter_leftdeep": planned_filter("left-deep"),
    "planner_filter_starbushy": planned_filter("star-bushy"),
    "planner_filter_idp": planned_filter("idp"),
    "planner_filter_random": planned_filter("random"),
    "run_plan_filter": replayed(SPARQL["filter_and_or_not"]),
    "run_plan_optional": replayed(SPARQL["optional_two"]),
    "run_plan_union": replayed(SPARQL["union_join"]),
    "run_plan_federated": run_plan_federated,
    "per_source_modifiers": per_source_modifiers,
    "hybrid_selection": hybrid_selection,
    "predicate_stats": predicate_stats,
    "subject_authorities": subject_authorities,
    "answer_trace": trace,
    "latest_run_per_plan": latest_run_per_plan,
}

SQL: dict[str, str] = {
    "scan_pattern": "select n_nationkey as n, n_name as name from nation",
    "scan_constant_object": "select o_orderkey as o from orders where o_orderstatus = 'F'",
    "scan_constant_subject": "select c_name as name from customer where c_custkey = 7",
    "scan_typed_literal": "select p_partkey as p from part where p_size = 15",
    "scan_class": "select c_custkey as c from customer",
    "scan_count_metadata": "select count(*) as cardinality from orders where o_orderstatus = 'F'",
    "scan_variable_predicate": "select 'http://ex.org/region#r_regionkey' as p, cast(r_regionkey as varchar) as v from region where r_regionkey=1 union all select 'http://ex.org/region#r_name', r_name from region where r_regionkey=1 union all select 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://ex.org/Region' from region where r_regionkey=1",
    "iri_rendering": "select concat('http://ex.org/customer/', cast(c_custkey as varchar)) as c, c_name as name from customer",
    "star_join": "select o_orderkey as o, o_orderstatus as s, o_totalprice as t, o_orderpriority as p from orders",
    "path_join_2": "select o_orderkey as o, c_custkey as c, c_mktsegment as seg from orders join customer on o_custkey = c_custkey",
    "path_join_4_bushy": "select o_orderkey as o, c_custkey as c, n_nationkey as n, r_regionkey as r, r_name as rn from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey where o_orderstatus='F'",
    "object_object_join": "select c_custkey as c, s_suppkey as s, n_nationkey as n from customer join nation on c_nationkey=n_nationkey join supplier on s_nationkey=n_nationkey",
    "bag_duplicates": "select c_mktsegment as seg from customer",
    "bind_join_small_outer": "select p_partkey as p, l_quantity as q from part join lineitem on l_partkey=p_partkey where p_brand='Brand#2'",
    "lineitem_star_multi": "select l_orderkey as o, l_suppkey as s from lineitem where l_returnflag='R'",
    "cartesian_bgp": "select r_regionkey as r, r_name as rn, s_suppkey as s, s_name as sn from region cross join supplier",
    "star_shared_object": "select o_orderkey as x from orders where o_orderkey = o_custkey",
    "filter_numeric": "select o_orderkey as o, o_totalprice as t from orders where o_totalprice > 300000",
    "filter_not_equal": "select o_orderkey as o, o_orderstatus as s from orders where o_orderstatus <> 'F'",
    "filter_datetime": "select o_orderkey as o, o_orderdate as d from orders where o_orderdate >= timestamp '1998-01-01 00:00:00'",
    "filter_and_or_not": "select o_orderkey as o from orders where (o_orderstatus='F' or o_orderstatus='P') and not (o_totalprice < 100000)",
    "filter_arithmetic": "select l_orderkey as o, l_extendedprice as e, l_discount as d from lineitem where l_extendedprice * (1 - l_discount) > 80000",
    "filter_two_filters": "select p_partkey as p from part where p_size > 40 and p_brand = 'Brand#4'",
    "filter_var_var": "select c_custkey as c, s_suppkey as s from customer join supplier on c_nationkey=s_nationkey where c_acctbal > s_acctbal",
    "filter_iri_equality": "select o_orderkey as o from orders where o_custkey = 7",
    "fn_regex": "select p_partkey as p, p_name as n from part where regexp_matches(p_name, '^small', 'i')",
    "fn_contains": "select p_partkey as p, p_name as n from part where contains(p_name, 'ring')",
    "fn_ucase_lcase": "select p_partkey as p from part where lower(p_type) = 'promo'",
    "fn_str_cast": "select p_partkey as p, p_size as z from part where try_cast(cast(p_size as varchar) as bigint) >= 45",
    "fn_lang": "select doc_id as d from documents where lang = 'fr'",
    "optional_basic": "select d.doc_id as d, source as s, quality as q from documents d left join labels l on l.doc_id=d.doc_id",
    "optional_two": "select d.doc_id as d, a.quality as q, b.toxic as x from documents d left join labels a on a.doc_id=d.doc_id left join labels b on b.doc_id=d.doc_id and b.toxic=1",
    "optional_with_filter": "select d.doc_id as d, quality as q from documents d left join labels l on l.doc_id=d.doc_id and quality=1",
    "optional_not_bound": "select o_orderkey as o from orders left join lineitem on l_orderkey=o_orderkey where l_orderkey is null",
    "optional_large_right": "select o_orderkey as o, l_quantity as q from orders left join lineitem on l_orderkey=o_orderkey where o_orderpriority='1-URGENT'",
    "union_same_vars": "select o_orderkey as o from orders where o_orderstatus='F' union all select o_orderkey from orders where o_orderstatus='P'",
    "union_diff_vars": "select c_custkey as c, c_acctbal as cb, cast(null as bigint) as s, cast(null as double) as sb from customer union all select null, null, s_suppkey, s_acctbal from supplier",
    "union_join": "select o_orderkey as o, o_custkey as c from orders where o_orderstatus='F' union all select o_orderkey, o_custkey from orders where o_totalprice > 300000",
    "distinct_projection": "select distinct c_nationkey as n, c_mktsegment as seg from customer",
    "distinct_star": "select distinct o_custkey as c, o_orderpriority as p from orders",
    "order_by_limit": "select o_orderkey as o, o_totalprice as t from orders order by o_totalprice desc, o_orderkey limit 10",
    "order_offset_limit": "select o_orderkey as o from orders order by o_orderkey limit 20 offset 40",
    "order_nonprojected": "select o_orderkey as o from orders order by o_totalprice, o_orderkey limit 5",
    "offset_only": "select c_custkey as c from customer order by c_custkey offset 1490",
    "order_by_expr": "select p_partkey as p, p_name as n from part order by lower(p_name), p_partkey limit 7",
    "federated_dup_source": "select c_custkey as c from customer union all select c_custkey from customer",
    "federated_disjoint_sources": "select o_orderkey as o, o_orderstatus as s from orders",
    "federated_pruned": "select o_orderkey as o, c_custkey as c, c_name as name from orders join customer on o_custkey=c_custkey",
    "federated_decomposed": "select o_orderkey as o, o_totalprice as t, o_orderstatus as s, c_name as name from orders join customer on o_custkey=c_custkey",
    "planner_leftdeep": "select o_orderkey as o, r_name as rn from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey where o_orderstatus='F'",
    "predicate_stats": "select 'orders#o_orderstatus' as predicate, count(*) as cnt from orders union all select 'customer#c_name', count(*) from customer",
    "subject_authorities": "select distinct regexp_extract(url, '^https?://([^/:?#]+)', 1) as authority from pages",
    "answer_trace": "select event_id as e, user_id as u, row_number() over (partition by user_id order by ts, event_id) as n from events",
    "latest_run_per_plan": "select user_id as u, event_type as k, event_id as e from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) rn from events) where rn = 1",
    "conversation_star": "select conv_id as c, turn as t from conversations where role='user'",
}
SQL |= {
    "select_star": "select o_orderkey as o, o_custkey as c from orders where o_orderstatus = 'P'",
    "fn_isiri": "select o_orderkey as o from orders where o_custkey is not null and o_totalprice is not null",
    "fn_isblank": "select o_orderkey as o from orders where o_custkey is not null",
    "fn_isliteral": "select n_nationkey as n, n_name as name from nation",
    "fn_datatype": "select p_partkey as p, p_size as z from part where p_retailprice is not null",
    "fn_sameterm": "select p_partkey as p from part where p_size = 15 or p_brand = 'Brand#4'",
    "fn_langmatches": "select doc_id as d from documents where text is not null and lang in ('en', 'de')",
    "filter_plus_divide": "select l_orderkey as o, l_quantity as q from lineitem where l_extendedprice / l_quantity + l_tax > 1900 and -l_quantity < -10",
    "optional_nested": "select c_custkey as c, o_orderkey as o, q from customer left join (select o.o_orderkey, o.o_custkey from orders o where o_orderstatus = 'F') o on o_custkey = c_custkey left join (select l_orderkey, l_quantity as q from lineitem where l_returnflag = 'R') l on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING'",
    "planner_filter_leftdeep": "select o_orderkey as o, n_name as name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 200000 and c_acctbal < o_totalprice / 100",
    "run_plan_filter": SQL["filter_and_or_not"],
    "run_plan_optional": SQL["optional_two"],
    "run_plan_union": SQL["union_join"],
    "run_plan_federated": "select distinct c_mktsegment as seg, o_orderstatus as s from orders join customer on o_custkey = c_custkey where o_orderstatus <> 'F' order by 1, 2 limit 6",
}
SQL |= dict.fromkeys(("planner_filter_starbushy", "planner_filter_idp", "planner_filter_random"), SQL["planner_filter_leftdeep"])
SQL |= dict.fromkeys(("per_source_modifiers", "hybrid_selection"), SQL["run_plan_federated"])
SQL |= dict.fromkeys(("planner_starbushy", "planner_idp", "planner_random"), SQL["planner_leftdeep"])
