"""Slices of a table that ask shards of a key space, and get answers, in packed messages.

A slice is one value that holds a few megabytes of rows as arrays; a message is one value that holds all that a slice asks of
a shard.  So a shuffle moves few large values where it would move a row for each token, and both sides work on arrays.  Slices
and answers are written tables, so a lost executor costs its tasks and no more.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release, tidy

MESSAGE = "slice long, shard int, payload binary"
#: (slice, shard or -1, payload): a slice's own state has shard -1.
Message = tuple[int, int, bytes]


def record(x: Message) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0]], pa.int64()), pa.array([x[1]], pa.int32()), pa.array([x[2]], pa.binary())], names=["slice", "shard", "payload"])


def messages(batches: Iterable[pa.RecordBatch]) -> Iterator[Message]:
    for b in batches:
        yield from zip(*[b.column(c).to_pylist() for c in ("slice", "shard", "payload")])
    release()


def ask(slices: DataFrame, scratch: Scratch, shards: int, question: Callable[[bytes], Iterable[tuple[int, bytes]]], answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Answers (slice, shard, payload).  `question` gives a slice's messages by shard; `answer` has all of a shard, and answers each in turn."""

    def send(batches):
        for s, _, state in messages(batches):
            for h, p in question(state):
                yield record((s, h, p))

    def reply(batches):
        asked = list(messages(batches))
        if asked:
            for (s, h, _), p in zip(asked, answer([p for _, _, p in asked])):
                yield record((s, h, p))

    out = scratch.save(slices.mapInArrow(send, MESSAGE).repartitionById(shards, F.col("shard")).mapInArrow(reply, MESSAGE))
    tidy(slices.sparkSession)
    return out


def deliver(slices: DataFrame, answers: DataFrame, n_slices: int, receive: Callable[[bytes, dict[int, bytes]], Iterable], schema: str = MESSAGE) -> DataFrame:
    """What `receive` makes of each slice and its answers by shard: a new state (bytes) by default, or batches of `schema`."""

    def run(batches):
        of: dict[int, tuple[list, dict]] = {}
        for s, h, p in messages(batches):
            own, got = of.setdefault(s, ([], {}))
            own.append(p) if h < 0 else got.__setitem__(h, p)
        while of:
            s, (own, got) = of.popitem()
            for p in own:
                for out in receive(p, got):
                    yield record((s, -1, out)) if schema == MESSAGE else out

    return slices.unionByName(answers).repartition(max(1, math.ceil(n_slices / 2)), "slice").mapInArrow(run, schema)
