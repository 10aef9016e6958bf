"""Near duplicates by SimHash and an LSH forest."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, chunks, same
from .components import components

BITS = 128
#: Fingerprints at most this far apart are near duplicates: 128-bit prints of unrelated texts differ in about 57 bits.
RADIUS = 22
#: Share of pairs at the full radius that some try must find; nearer pairs are found more surely.
RECALL = 0.95
#: A try's node is split no further once it holds this many fingerprints.
LEAF = 64
SEED = 20


class Signs:
    """word -> row of its 128 bits as +1 or -1."""

    def __init__(self, limit: int = 150_000):
        self.limit, self.rows, self.at, self.raw = limit, {}, np.zeros((4096, BITS), np.int16), b""

    def of(self, words: list[str]) -> np.ndarray:
        new = {w for w in words if w not in self.rows}
        if len(self.rows) + len(new) > self.limit:
            self.rows, new = {}, set(words)
        if new:
            new = sorted(new)
            base = len(self.rows)
            if base + len(new) > len(self.at):
                grown = np.zeros((max(2 * len(self.at), base + len(new)), BITS), np.int16)
                grown[:base] = self.at[:base]
                self.at = grown
            raw = b"".join(xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")) for w in new)
            self.at[base : base + len(new)] = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, BITS).astype(np.int16) * 2 - 1
            self.rows.update(zip(new, range(base, base + len(new))))
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))


def fingerprints(texts: list[str | None], signs: Signs) -> np.ndarray:
    """(n, 2) int64: the majority sign of each bit over a text's different words; a tie is 0."""
    out = np.zeros((len(texts), 2), np.int64)
    at = 0
    while at < len(texts):  # about 40,000 words at a time; a long text is summed by itself, in parts
        group, size = [], 0
        while at < len(texts) and (not group or size < 40_000):
            words = sorted(set(texts[at].split())) if texts[at] else []
            if words:
                group.append((at, words))
                size += len(words)
            at += 1
        if not group:
            continue
        if len(group) == 1 and size > 30_000:
            words, total = group[0][1], np.zeros(BITS, np.int64)
            for i in range(0, size, 30_000):
                part = signs.of(words[i : i + 30_000])
                total += signs.at[part].sum(axis=0, dtype=np.int64)
            sums = total[None, :]
        else:
            rows = signs.of([w for _, ws in group for w in ws])
            starts = np.cumsum([0, *[len(ws) for _, ws in group[:-1]]])
            dtype = np.int64 if max(len(ws) for _, ws in group) > 32_000 else np.int16
            sums = np.add.reduceat(signs.at[rows], starts, axis=0, dtype=dtype)
        out[[i for i, _ in group]] = np.packbits(sums > 0, axis=1).view(">i8").astype(np.int64)
    return out


def with_fingerprints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, h, f1, f2): h tells rows with one id but different texts apart.  Texts without words are left out."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        signs = Signs()
        for part, texts in chunks(batches, 2):
            prints = fingerprints(texts, signs)
            has = pa.array([bool(t and not t.isspace()) for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(prints[:, 0]), pa.array(prints[:, 1])], names=["doc_id", "h", "f1", "f2"]).filter(has)

    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, h long, f1 long, f2 long")


def forest(n: int, radius: int, recall: float, bits: int = BITS, leaf: int = LEAF) -> tuple[int, int, int]:
    """(least depth, depth, tries) for n fingerprints.

    At `depth`, evenly spread fingerprints would come to `leaf` a node.  Two
    that differ in `radius` bits share a random prefix of that length with
    probability p, so log(1 - recall) / log(1 - p) tries are needed.  Where
    they are sparse, a search may climb up to `least` bits of prefix.
    """
    depth = min(max(0, math.ceil(math.log2(max(n, 1) / leaf))), 48)
    p = 1.0
    for i in range(depth):
        p *= max(0, bits - radius - i) / (bits - i)
    if p <= 0:
        raise ValueError("the radius is too large for prefixes of this depth")
    return max(0, depth - 4), depth, 1 if p == 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def orders(tries: int, depth: int, seed: int = SEED) -> np.ndarray:
    """The first `depth` places of a random permutation of the bits, for each try."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(BITS)[:depth] for _ in range(tries)]).astype(np.int64).reshape(tries, depth)


def prefix(f: np.ndarray, order: np.ndarray) -> np.ndarray:
    key = np.zeros(len(f), np.int64)
    for b in order:
        key = key << 1 | (f[:, b >> 6] >> (63 - (b & 63))) & 1
    return key


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def link(f: np.ndarray, node: np.ndarray, radius: int, dense: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what pairs within `radius` in one node connect.  `node` is sorted.

    Nodes of up to `dense` members: all pairs are verified.  Above that, a
    member takes all that are within its radius as a star, which needs no pairs
    among them; each of the rest is then compared with all members taken.  So
    every pair that could connect two stars is verified, at any node size.
    """
    n = len(f)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.diff(node, prepend=node[0] - 1))
    sizes = np.diff(starts, append=n)
    end = np.repeat(starts + sizes, sizes)
    small = np.repeat(sizes <= dense, sizes)
    left, right = [], []
    rows = np.flatnonzero(small)
    for shift in range(1, dense):
        rows = rows[rows + shift < end[rows]]
        if not len(rows):
            break
        for part in np.array_split(rows, len(rows) // 500_000 + 1):
            near = part[distance(f[part], f[part + shift]) <= radius]
            left.append(near)
            right.append(near + shift)
    for s, size in zip(starts[sizes > dense].tolist(), sizes[sizes > dense].tolist()):
        rest = np.arange(s, s + size)
        while len(rest):
            star, others = rest[0], rest[1:]
            near = distance(f[others], f[star][None, :]) <= radius
            members, rest = others[near], others[~near]
            left.append(np.full(len(members), star))
            right.append(members)
            if len(members):
                step = max(1, 2_000_000 // len(members))
                for i in range(0, len(rest), step):
                    part = rest[i : i + step]
                    hit = (distance(f[part][:, None, :], f[members][None, :, :]) <= radius).any(axis=1)
                    left.append(np.full(int(hit.sum()), star))
                    right.append(part[hit])
    return np.concatenate(left) if left else np.zeros(0, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64)


def thin(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of n vertices as one star for each component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    v = np.unique(np.concatenate([a, b]))
    v = v[root[v] != v]
    return v, root[v]


def nodes(keys: np.ndarray, least: int, depth: int, leaf: int = LEAF) -> np.ndarray:
    """For each of the sorted keys (of one try and one prefix of `least` bits or several), the node it is searched in.

    A key's search starts at its own full prefix and climbs while the recall
    target isn't met, that is to `depth` everywhere, and above it for as long
    as the node stays within `leaf`: where fingerprints are sparse.
    """
    bits = depth - least
    out = keys << 8  # the node's prefix, and how many bits of it count
    done = np.zeros(len(keys), bool)
    for up in range(bits, -1, -1):
        p = keys >> up
        starts = np.flatnonzero(np.diff(p, prepend=p[0] - 1)) if len(p) else np.zeros(0, np.int64)
        sizes = np.diff(starts, append=len(p))
        ok = ~done & (np.repeat(sizes, sizes) <= leaf) if up else ~done
        out[ok] = (p[ok] << up) << 8 | up
        done |= ok
    return out


def near_pairs(prints: DataFrame, scratch: Scratch, radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """Edges (a, b) between different fingerprints, structs (f1, f2), that connect near duplicates."""
    n = prints.count()
    least, depth, tries = forest(n, radius, recall)
    order = orders(tries, depth)

    def plant(batches):
        for b in batches:
            f = np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))], axis=1) if b.num_rows else np.zeros((0, 2), np.int64)
            for t in range(tries):
                key = prefix(f, order[t]) >> (depth - least)
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(t) << 48) + key), b.column(0), b.column(1)], names=["bucket", "f1", "f2"])

    def search(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        bucket, f = np.asarray(t.column(0)), np.stack([np.asarray(t.column(1)), np.asarray(t.column(2))], axis=1)
        del got, t
        order_b = np.argsort(bucket, kind="stable")
        tree = bucket[order_b] >> 48
        for s, e in zip(np.flatnonzero(np.diff(tree, prepend=-1)), [*np.flatnonzero(np.diff(tree)) + 1, len(tree)]):
            own = f[order_b[s:e]]
            key = prefix(own, order[tree[s]])
            k = np.argsort(key, kind="stable")
            own, key = own[k], key[k]
            node = nodes(key, least, depth)
            v, r = thin(len(own), *link(own, node, radius))
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array(own[v, 0]), pa.array(own[v, 1]), pa.array(own[r, 0]), pa.array(own[r, 1])], names=["a1", "a2", "b1", "b2"])

    # about 400,000 fingerprints of all tries in a partition
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * tries // 400_000 + 1)
    edges = prints.mapInArrow(plant, "bucket long, f1 long, f2 long").repartition(parts, "bucket").mapInArrow(search, "a1 long, a2 long, b1 long, b2 long")
    return edges.select(F.struct(F.col("a1").alias("f1"), F.col("a2").alias("f2")).alias("a"), F.struct(F.col("b1").alias("f1"), F.col("b2").alias("f2")).alias("b"))


def grouped(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """(doc_id, h, f1, f2, g1, g2, kept, size) of rows in groups of two or more; `kept` is the group's least (doc_id, h)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(with_fingerprints(docs, doc_id, text))
    prints = scratch.save(rows.select("f1", "f2").distinct())
    labels = components(near_pairs(prints, scratch, radius, recall), scratch)
    labels = labels.select(F.col("v.f1").alias("f1"), F.col("v.f2").alias("f2"), F.col("root.f1").alias("g1"), F.col("root.f2").alias("g2"))
    all_rows = rows.join(labels, ["f1", "f2"], "left").withColumn("g1", F.coalesce("g1", "f1")).withColumn("g2", F.coalesce("g2", "f2"))
    w = W.partitionBy("g1", "g2")
    # a null id comes last: it is kept only if all ids are null
    return all_rows.withColumn("size", F.count("*").over(w)).where("size > 1").withColumn("kept", F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).over(w))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """(doc_id, duplicate_of, group_size) of every document but one of each group of near duplicates.

    A text's fingerprint has 128 bits: each the majority over its different
    white-space separated words' hashes.  Texts are near duplicates if their
    fingerprints differ in at most `radius` bits, and groups are the connected
    components of that.  duplicate_of is the group's least doc_id, which has no
    row of its own.  Equal fingerprints are always found; others with at
    least the target recall.  Texts that are null or have no words have no
    fingerprint and are in no group.  Rows with a null id can't be named: they
    count for the group's size, but have no row.  Repeated rows (one id, one
    text) are one document.  An empty table gives no rows.
    """
    g = grouped(docs, doc_id=doc_id, text=text, radius=radius, recall=recall)
    out = g.where("doc_id is not null and doc_id <> kept.doc_id")
    return out.select("doc_id", F.col("kept.doc_id").alias("duplicate_of"), F.col("size").alias("group_size")).distinct()


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """`docs` with one row of each group: that of the least doc_id, one if it is repeated.

    Rows are told apart by id and text, so that an id that occurs with
    another text, too, doesn't take that one with it.  Rows without a
    fingerprint stay.  Columns pass through, whatever their names.
    """
    g = grouped(docs, doc_id=doc_id, text=text, radius=radius, recall=recall)
    marks = g.select(F.col("doc_id").alias("k"), F.col("h").alias("kh"), ((F.col("kept.h") == F.col("h")) & same(F.col("kept.doc_id"), F.col("doc_id"))).alias("stays")).groupBy("k", "kh").agg(F.max("stays").alias("stays"))
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = rows.join(marks, same(F.col("id"), F.col("k")) & (F.col("h") == F.col("kh")), "left")
    # of repeated rows of a kept document, one stays: only groups' rows are numbered
    alone = marked.where("stays is null").select("row")
    one = marked.where("stays").withColumn("n", F.row_number().over(W.partitionBy("id", "h").orderBy("h"))).where("n = 1").select("row")
    return alone.unionByName(one).select("row.*")
