"""URL filters: exact membership by a cascade of Bloom filters."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix

#: Keys of the universe in a shard, for which one task builds a cascade.
SHARD_KEYS = 500_000
#: A cascade of at most this many bytes is sent to all workers; rows are brought to the shards of a larger one.
BROADCAST_BYTES = 64 << 20


def url_key(url: Column) -> Column:
    """A URL without case, scheme, www. or m., query, fragment and final slashes."""
    key = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://(www\.|m\.)?", "")
    return F.regexp_replace(F.regexp_replace(key, r"(?s)[?#].*$", ""), "/+$", "")


class Bloom:
    def __init__(self, level: int, m: int, k: int, bits: np.ndarray):
        self.level, self.m, self.k, self.bits = level, m, k, bits

    @classmethod
    def of(cls, level: int, keys: np.ndarray, rate: float) -> Bloom:
        n = max(1, len(keys))
        m = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        f = cls(level, m, max(1, round(m / n * math.log(2))), np.zeros((m + 7) // 8, np.uint8))
        for at in f.places(keys):
            np.bitwise_or.at(f.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return f

    def places(self, keys: np.ndarray):
        salt = np.uint64((self.level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        a, b = mix(keys[:, 0].view(np.uint64) + salt), mix(keys[:, 1].view(np.uint64) ^ salt) | np.uint64(1)
        for j in range(self.k):
            yield ((a + np.uint64(j) * b) % np.uint64(self.m)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(keys):
            out &= (self.bits[at >> 3] >> (at & 7) & 1).astype(bool)
        return out


def build(listed: np.ndarray, others: np.ndarray) -> list[Bloom]:
    """Levels over two-word keys: the even ones hold listed keys, the odd ones others that the level before takes for listed.

    Each level holds what the one before gets wrong, until nothing is; on the
    two sets together, lookup() is then exact.
    """
    levels: list[Bloom] = []
    inside, outside = listed, others
    rate = min(0.5, max(1e-4, len(listed) * math.sqrt(0.5) / max(1, len(others))))
    while len(inside):
        f = Bloom.of(len(levels), inside, rate)
        levels.append(f)
        inside, outside = outside[f.has(outside)], inside
        rate = 0.5
        if len(levels) > 200:
            raise ValueError("a listed and an unlisted key have the same hashes")
    return levels


def lookup(levels: list[Bloom], keys: np.ndarray) -> np.ndarray:
    """Whether keys are listed: the first level without a key decides, an odd one for listed."""
    verdict, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
    for f in levels:
        hit = f.has(keys[open_])
        verdict[open_[~hit]] = f.level % 2 == 1
        open_ = open_[hit]
    verdict[open_] = len(levels) % 2 == 1
    return verdict


class Cascade:
    """Filters for a universe of keys, in shards by hash; a table (shard, level, m, k, bits)."""

    def __init__(self, table: DataFrame, shards: int, n_bytes: int):
        self.table, self.shards, self.n_bytes = table, shards, n_bytes

    @staticmethod
    def hashes(key: Column) -> list[Column]:
        return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def cascade(universe: DataFrame, listed: DataFrame, *, shard_keys: int = SHARD_KEYS) -> Cascade:
    """A cascade for one-column tables of keys: all that will be asked for, and those that are listed.

    Listed keys outside the universe are added to it.  Nulls are ignored and
    repeated keys count once; either table may be empty.
    """
    scratch = Scratch(universe.sparkSession, "cascade")
    flag = lambda t, x: t.select(*Cascade.hashes(F.col(t.columns[0])), F.lit(x).alias("listed")).where(F.col(f"`{t.columns[0]}`").isNotNull())
    keys = scratch.save(flag(universe, False).unionByName(flag(listed, True)).groupBy("h1", "h2").agg(F.max("listed").alias("listed")))
    shards = max(1, math.ceil(keys.count() / shard_keys))

    def make(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        shard, is_listed = np.asarray(t.column(0)), np.asarray(t.column(3))
        key = np.stack([np.asarray(t.column(1)), np.asarray(t.column(2))], axis=1)
        for s in np.unique(shard):
            own = shard == s
            for f in build(key[own & is_listed], key[own & ~is_listed]):
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([f.level], pa.int32()), pa.array([f.m]), pa.array([f.k], pa.int32()), pa.array([f.bits.tobytes()], pa.binary())], names=["shard", "level", "m", "k", "bits"])

    sharded = keys.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1", "h2", "listed").repartition(shards, "shard")
    table = scratch.save(sharded.mapInArrow(make, "shard int, level int, m long, k int, bits binary"))
    scratch.drop(keys)
    return Cascade(table, shards, table.agg(F.sum(F.octet_length("bits"))).first()[0] or 0)


def flag(rows: DataFrame, c: Cascade, key: Column, name: str = "listed", *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`rows` and a column that says whether the key is listed; a null key isn't.

    Exact for keys of the cascade's universe.  Without a join: each row is
    looked up where it is, or, if the filters are too large to send to every
    worker, where its shard's filters are, as a stream behind them; rows with
    a null key stay where they are.  Repeated rows are flagged alike; an empty
    table stays empty.  A column of `rows` named `name`, in any case, is
    replaced.
    """
    names = [x for x in rows.columns if x.lower() != name.lower()]
    packed = rows.select(*Cascade.hashes(key), key.isNull().alias("none"), F.struct(*[F.col(f"`{x}`") for x in names]).alias("row"))
    packed = packed.withColumn("shard", F.pmod("h1", F.lit(c.shards)).cast("int"))
    out_schema = packed.withColumn("listed", F.lit(True)).select("row", "listed").schema

    def levels(records) -> dict[int, list[Bloom]]:
        found: dict[int, list[Bloom]] = {}
        for s, level, m, k, bits in sorted(records, key=lambda r: r[:2]):
            found.setdefault(s, []).append(Bloom(level, m, k, np.frombuffer(bits, np.uint8)))
        return found

    def look(t, filters: dict[int, list[Bloom]]) -> np.ndarray:
        keys = np.stack([np.asarray(t.column("h1")), np.asarray(t.column("h2"))], axis=1) if t.num_rows else np.zeros((0, 2), np.int64)
        shard, out = np.asarray(t.column("shard")), np.zeros(t.num_rows, bool)
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            out[own] = lookup(filters.get(int(s), []), keys[own])
        return out & ~np.asarray(t.column("none"))

    if c.n_bytes <= broadcast_bytes:
        sent = rows.sparkSession.sparkContext.broadcast([(r["shard"], r["level"], r["m"], r["k"], bytes(r["bits"])) for r in c.table.collect()])

        def here(batches):
            filters = levels(sent.value)
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(look(b, filters))], names=["row", "listed"])

        done = packed.mapInArrow(here, out_schema)
    else:

        # a shard's filters come first, then its rows, however many
        blank = lambda c, t: F.lit(None).cast(t).alias(c)
        row_type, filter_types = packed.schema["row"].dataType, [(f.name, f.dataType) for f in c.table.schema if f.name != "shard"]
        first = c.table.select("shard", F.lit(0).alias("kind"), *[F.col(x) for x, _ in filter_types], blank("h1", "long"), blank("h2", "long"), blank("none", "boolean"), blank("row", row_type))
        then = packed.where("not none").select("shard", F.lit(1).alias("kind"), *[blank(x, t) for x, t in filter_types], "h1", "h2", "none", "row")

        def there(batches):
            at, records, filters = None, [], {}
            for b in batches:
                shard, kind = np.asarray(b.column("shard")), np.asarray(b.column("kind"))
                new = np.flatnonzero(np.diff(shard.astype(np.int64) * 2 + kind, prepend=-1))
                for s, e in zip(new, [*new[1:], b.num_rows]):
                    part = b.slice(s, e - s)
                    if shard[s] != at:
                        at, records = shard[s], []
                    if not kind[s]:
                        records += zip(*[part.column(x).to_pylist() for x in ("shard", "level", "m", "k", "bits")])
                        filters = levels(records)
                    else:
                        yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(look(part, filters if records else {}))], names=["row", "listed"])

        sorted_ = first.unionByName(then).repartition(c.shards, "shard").sortWithinPartitions("shard", "kind")
        done = sorted_.mapInArrow(there, out_schema).unionByName(packed.where("none").select("row", F.lit(False).alias("listed")))
    return done.select("row.*", F.col("listed").alias(name))
