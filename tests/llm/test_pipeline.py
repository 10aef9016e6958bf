"""The pipeline's stages, and the queries against their SQL."""

import sys
from pathlib import Path

import pytest

import corpus_pipeline
from tessera.llm import debruijn, metric_join, queries, simhash


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf), duck.sql(queries.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.dtypes, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema) if name != "byte-level BPE" else stage(spark, docs, sf)
        seen[name] = docs
        assert name == "byte-level BPE" or docs.dtypes == columns
    raw, clean = spark.read.parquet(f"{sf}/documents.parquet"), seen["toxicity"]
    toxic = {r["doc_id"] for r in queries.QUERIES["op9_toxic_segments"](spark, sf).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in raw.collect()} - toxic
    gone = {r["doc_id"] for r in simhash.near_duplicates(clean).collect()}
    unique = seen["simhash near-dedup"]
    assert {r["doc_id"] for r in unique.collect()} == {r["doc_id"] for r in clean.collect()} - gone
    assert debruijn.repeated_spans(seen["substring dedup"]).count() == 0
    last = seen["byte-level BPE"].collect()
    assert len(last) == seen["mixing"].count() > 0 and all(r["round_trip"] for r in last)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:2] == ["doc_id", "token_ids"] and out.count() > 0 and out.where("not round_trip").count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_awkward_tables(spark, tmp_path, empty):
    """Nulls anywhere, empty and very long texts, repeated rows, one id with two texts, extra columns of any name, no rows."""
    sys.path.insert(0, str(Path(__file__).parent))
    from test_operators import awkward, labels

    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = awkward(spark, empty)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / name))
        assert name == "byte-level BPE" or docs.columns == columns
        assert empty or docs.where("doc_id = 7").count() > 0 or name == "mixing"
    assert empty == (docs.count() == 0)


def test_links_equal_sql(spark, sf, duck):
    """op1_metric_range_join at a cosine of 0.45, where the tables hold links."""
    got = metric_join.range_links(spark.read.parquet(f"{sf}/embeddings.parquet"), min_cosine=0.45).toDF("vec_id", "class_id", "n_links")
    want = duck.sql(queries.SQL["op1_metric_range_join"].replace("0.96", "0.45"))
    assert want.columns == got.columns
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(want.fetchall()) and any(c < i and n > 0 for i, c, n in rows)
