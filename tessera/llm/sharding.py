"""Minimax contiguous sharding: the smallest shard capacity that S shards can hold."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

SHARDS = 64
#: Groups in a block.  The driver keeps a total per block, and fetches the blocks in which cuts fall.
BLOCK = 4096


class Blocks:
    """Sizes of ordered groups, of which the driver holds only block totals and the blocks it asked for."""

    def __init__(self, totals: np.ndarray, counts: np.ndarray, fetch: Callable[[list[int]], dict[int, np.ndarray]], keep: int = 4096):
        self.ends, self.starts = np.cumsum(totals), np.cumsum(totals) - totals
        self.counts, self.fetch, self.keep, self.have = counts, fetch, keep, {}
        self.total = int(self.ends[-1]) if len(totals) else 0

    def need(self, blocks: list[int]) -> None:
        missing = sorted({b for b in blocks if 0 <= b < len(self.ends) and b not in self.have})
        if missing:
            if len(self.have) + len(missing) > self.keep:
                self.have = {b: self.have[b] for b in blocks if b in self.have}
            self.have.update({b: np.cumsum(s) for b, s in self.fetch(missing).items()})

    def reach(self, limit: int, ahead: Callable[[int], list[int]]) -> tuple[int, int]:
        """The last group end (prefix sum) that is at most `limit`: (block, prefix sum)."""
        if limit >= self.total:
            return len(self.ends), self.total
        b = int(np.searchsorted(self.ends, limit, side="right"))
        if b not in self.have:
            self.need([b, *ahead(b)])
        inside = self.have[b]
        k = int(np.searchsorted(inside, limit - self.starts[b], side="right"))
        return b, int(self.starts[b]) + (int(inside[k - 1]) if k else 0)


def greedy(blocks: Blocks, capacity: int, shards: int) -> list[int] | None:
    """Prefix sums at which shards of `capacity` end, filled in order; None if more than `shards` are needed."""
    cuts, at = [], 0
    while at < blocks.total:
        if len(cuts) == shards:
            return None

        def ahead(_: int, at: int = at, done: int = len(cuts)) -> list[int]:
            # Where the next cuts will fall if shards come out full: fetched together, in one job.
            guess = [at + capacity * j for j in range(1, shards - done + 1)]
            return [int(x) for x in np.searchsorted(blocks.ends, [g for g in guess if g < blocks.total], side="right")]

        _, nxt = blocks.reach(at + capacity, ahead)
        if nxt == at:
            return None
        cuts.append(at := nxt)
    return cuts


def smallest_capacity(blocks: Blocks, largest: int, shards: int) -> tuple[int, list[int]]:
    """Binary search between the bounds ceil(total / shards) and the same plus the largest group."""
    lo = max(largest, -(-blocks.total // shards))
    hi = max(lo, blocks.total // shards + largest)
    best = greedy(blocks, hi, shards)
    while lo < hi:
        mid = (lo + hi) // 2
        cuts = greedy(blocks, mid, shards)
        if cuts is None:
            lo = mid + 1
        else:
            hi, best = mid, cuts
    return hi, best or []


def shard(docs: DataFrame, *, key: str = "doc_id", size: str = "text", shards: int = SHARDS) -> DataFrame:
    """(key, size, shard): each group of rows with one key, in key order, and its shard.

    A group is all rows with equal keys and is never split; null is a key,
    ordered first.  Its size is the UTF-8 bytes of column `size` if that is
    text, else the column's sum; nulls count 0.  Shards are contiguous in key
    order, at most `shards` of them, and their largest total is the smallest
    possible.  Among the partitions of that capacity it is the one that fills
    shards greedily from the first.  A group of size 0 joins the shard that
    ends before it, or the first.  Negative sizes are refused.  An empty table
    gives no rows.

    Only keys and sizes are shuffled.  The driver holds one total per block of
    groups (the block grows with the square root of the number of groups) and
    the blocks in which cuts of a probed capacity fall.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    kind = docs.schema[size].dataType.simpleString()
    n = F.octet_length(F.col(size)) if kind in ("string", "binary") else F.col(size)
    groups = docs.select(F.col(key).alias("k"), F.coalesce(n, F.lit(0)).cast("long").alias("n")).groupBy("k").agg(F.sum("n").alias("n"))
    # Sorted by key, partitions in order: the part number is the partition's place.
    ranged = scratch.save(groups.repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first()).withColumn("part", F.spark_partition_id()))
    head = ranged.agg(F.count("*").alias("c"), F.max("n").alias("most"), F.min("n").alias("least")).first()
    kt, out_schema = ranged.schema["k"].dataType.simpleString(), None
    if not head["c"]:
        return ranged.select(F.col("k").alias(key), F.col("n").alias("size"), F.lit(0).alias("shard"))
    if head["least"] < 0:
        raise ValueError("sizes can't be negative")
    block = max(BLOCK, int(math.sqrt(head["c"])))
    within = W.partitionBy("part").orderBy(F.col("k").asc_nulls_first())
    blocked = scratch.save(
        ranged.withColumn("b", F.floor((F.row_number().over(within) - 1) / F.lit(block)))
        .groupBy("part", "b")
        .agg(F.sum("n").alias("total"), F.count("*").alias("c"), F.sort_array(F.collect_list(F.struct(F.col("k").isNotNull().alias("set"), F.col("k").alias("k"), F.col("n").alias("n")))).alias("g"))
    )
    index = blocked.select("part", "b", "total", "c").orderBy("part", "b").toPandas()
    scratch.drop(ranged)
    names = list(zip(index["part"].tolist(), index["b"].tolist()))

    def fetch(ids: list[int]) -> dict[int, np.ndarray]:
        want = spark.createDataFrame([(*map(int, names[i]), i) for i in ids], "part int, b long, i int")
        got = blocked.join(F.broadcast(want), ["part", "b"]).select("i", F.col("g.n").alias("n")).toPandas()
        return {int(i): np.asarray(s, dtype=np.int64) for i, s in zip(got["i"], got["n"])}

    sizes = Blocks(index["total"].to_numpy(np.int64), index["c"].to_numpy(np.int64), fetch)
    _, cuts = smallest_capacity(sizes, int(head["most"]), shards)
    starts = spark.createDataFrame([(*map(int, nm), int(s)) for nm, s in zip(names, sizes.starts)], "part int, b long, at long")
    ends = np.asarray(cuts[:-1] if cuts else [], dtype=np.int64)

    def assign(batches):
        for batch in batches:
            for at, g in zip(batch.column(0).to_pylist(), batch.column(1)):
                g = g.values
                n = np.asarray(g.field("n"))
                # a group is in shard j if its end is beyond the first j cuts
                yield pa.RecordBatch.from_arrays([g.field("k"), pa.array(n), pa.array(np.searchsorted(ends, at + np.cumsum(n), side="left").astype(np.int32))], names=[key, "size", "shard"])

    # one row per block on the right: as small as the driver's index
    placed = blocked.join(F.broadcast(starts), ["part", "b"]).select("at", "g")
    return placed.mapInArrow(assign, f"`{key}` {kt}, size long, shard int")
