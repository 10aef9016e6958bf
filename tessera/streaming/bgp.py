"""A query of which one table arrives as a stream, joined with tables at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine
from ..sources import VirtualSource


class StreamSource(VirtualSource):
    """A mapped source whose `stream` table is a streaming DataFrame; its size isn't asked."""

    def __init__(self, spark: SparkSession, sf_dir: str, stream: dict[str, DataFrame], **options):
        super().__init__(spark, sf_dir, frames=stream, **options)
        self.streams = set(stream)

    def rows(self, t) -> int:
        return 1 << 40 if t.name in self.streams else super().rows(t)


def stream_query(spark: SparkSession, sf_dir: str, table: str, stream: DataFrame, query: str) -> DataFrame:
    """A streaming DataFrame of the query's answers: stream-static joins, filters and projection, in append mode.

    ORDER BY, LIMIT and joins of the stream with itself need state that grows
    without end, and are refused by Spark.
    """
    return Engine(spark, StreamSource(spark, sf_dir, {table: stream})).query(query)
