"""Connected components of a graph given by edges, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) for each vertex of edges (a, b): root is the least vertex of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until
    nothing changes; each step is one shuffle, and its table is written, so
    that lineage stays short.  Self loops and repeated edges do no harm.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        # large star: all neighbours above a vertex go to the least of it and its neighbours
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        w = W.partitionBy("a")
        large = both.withColumn("m", F.least(F.min("b").over(w), F.col("a"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a vertex and its lesser neighbours go to the least of them
        small = large.withColumn("m", F.min("b").over(w))
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        after = scratch.save(small)
        settled = same_rows(now, after)
        scratch.drop(now)
        now = after
        if settled:
            break
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def same_rows(x: DataFrame, y: DataFrame) -> bool:
    """Whether two tables without repeated rows are equal, by their count and the sum of two hashes."""

    def sign(t: DataFrame):
        return t.agg(F.count("*"), *[F.sum(F.xxhash64("a", "b", F.lit(i)).cast("decimal(38,0)")) for i in (1, 2)]).first()

    return tuple(sign(x)) == tuple(sign(y))
