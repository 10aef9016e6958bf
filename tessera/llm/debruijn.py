"""Repeated substrings by compaction of a de Bruijn graph of token k-mers."""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, WordHash, chunks, cut, hash_words, mix, pack, small, split_words, tidy, unpack
from .components import components
from .exchange import MESSAGE, ask, deliver, messages, record

#: Tokens in an edge, and so the shortest span that counts as repeated.
K = 50
BASE = 0x9E3779B97F4A7C15 | 1
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Marks of texts are broadcast up to this many bytes.
BROADCAST_BYTES = 64 << 20
#: Characters of text in a slice, and tokens of the corpus for each shard.
CHARS, TOKENS = 4_000_000, 4_000_000


class Slice:
    """Tokens of several texts, end to end."""

    def __init__(self, texts: list[str | None], cache: WordHash):
        words = [t.split() if t else [] for t in texts]
        self._set(np.array([len(w) for w in words], dtype=np.int64), hash_words([w for ws in words for w in ws], cache))

    @classmethod
    def of(cls, n: np.ndarray, x: np.ndarray) -> Slice:
        """From the tokens of each text and the tokens' hashes."""
        s = cls.__new__(cls)
        s._set(n, x)
        return s

    def _set(self, n: np.ndarray, x: np.ndarray) -> None:
        size = len(x)
        self.n, self.size, self.mask = n, size, NONE
        self.first = np.cumsum(self.n) - self.n
        self.left = np.repeat(self.first + self.n, self.n) - np.arange(size)  # tokens from here to its text's end
        base = np.full(size + 1, BASE, np.uint64)
        base[0] = 1
        back = np.full(size + 1, pow(BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * np.cumprod(base)[:-1])])

    def grams(self, k: int) -> np.ndarray:
        """A hash of the k tokens from each place on; NONE where the text ends before."""
        out = np.full(self.size, NONE)
        m = self.size - k + 1
        if m > 0:
            h = mix((self.sums[k:] - self.sums[:m]) * self.back[:m]) & self.mask
            out[:m] = np.where((self.left[:m] >= k) & (h != NONE), h, np.where(self.left[:m] >= k, np.uint64(0), NONE))
        return out

    def minimizers(self, k: int) -> np.ndarray:
        """Which places hold the least of the k//2-gram hashes in some window of k tokens.

        Equal hashes all count, so a window's choice depends on its tokens
        alone: two equal windows agree, and each chooses at least one.
        """
        g = self.grams(k // 2)
        w = k - k // 2 + 1
        least = np.where(self.left >= k, slide(g, w, np.minimum, NONE), np.uint64(0))
        # of all windows around a place, the one with the largest minimum
        best = slide(least[::-1], w, np.maximum, np.uint64(0))[::-1]
        return (best == g) & (g != NONE) & (best != 0)

    def windows(self, marked: np.ndarray, k: int) -> np.ndarray:
        """Starts of the k-token windows whose least k//2-gram hash is at a marked place."""
        g, w = self.grams(k // 2), k - k // 2 + 1
        least = slide(np.where(marked, g, NONE), w, np.minimum, NONE)
        return np.flatnonzero((self.left >= k) & (least == slide(g, w, np.minimum, NONE)))


def slide(x: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over x[i : i + w] at each i, in log w steps."""
    out, have = x.copy(), 1

    def ahead(y: np.ndarray, by: int) -> np.ndarray:
        r = np.full(len(y), fill)
        if by < len(y):
            r[: len(y) - by] = y[by:]
        return r

    while have * 2 <= w:
        out, have = op(out, ahead(out, have)), have * 2
    return op(out, ahead(out, w - have)) if have < w else out


class State:
    """A slice's texts, each once, or the stretches of them that may still be repeated.

    `t` are 16-byte digests of whole texts; `text`, `offset` and `n` say which text a stretch is of, its first token's place
    there, and its tokens.  The tokens themselves are kept, so that any stretch can be read again at its coordinates.  `win`
    are the starts of windows that are looked at, counted over all stretches.
    """

    def __init__(self, mask: int, words: list[bytes], x: np.ndarray, t: np.ndarray, text: np.ndarray, offset: np.ndarray, n: np.ndarray, win: np.ndarray, **more: np.ndarray):
        self.mask, self.words, self.x, self.t, self.text, self.offset, self.n, self.win, self.more = mask, words, x, t, text, offset, n, win, more

    def save(self) -> bytes:
        arrays = {"words": np.frombuffer(b"\n".join(self.words), np.uint8), "x": small(self.x), "t": self.t, "text": small(self.text), "offset": small(self.offset), "n": small(self.n), "win": small(np.diff(self.win, prepend=0))}
        return pack(mask=np.array([self.mask], np.uint64), **arrays, **{f"more_{k}": v for k, v in self.more.items()})

    @classmethod
    def load(cls, data: bytes) -> State:
        a = unpack(data)
        more = {k[5:]: v for k, v in a.items() if k.startswith("more_")}
        return cls(int(a["mask"][0]), a["words"].tobytes().split(b"\n"), a["x"].astype(np.int64), a["t"], a["text"].astype(np.int64), a["offset"].astype(np.int64), a["n"].astype(np.int64), np.cumsum(a["win"], dtype=np.int64), **more)

    @property
    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))

    def slice(self) -> Slice:
        s = Slice.of(self.n, self.hashes[self.x] if len(self.x) else np.zeros(0, np.uint64))
        s.mask = np.uint64(self.mask)
        return s

    def where(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in it) of tokens."""
        ends = np.cumsum(self.n)
        i = np.searchsorted(ends, at, side="right")
        return self.text[i], at - (ends - self.n)[i] + self.offset[i]

    def tokens(self, a: int, b: int) -> bytes:
        return b" ".join([self.words[i] for i in self.x[a:b].tolist()])

    def only(self, at: np.ndarray, k: int) -> State:
        """The stretches that the windows of k tokens at `at` cover."""
        hit = np.zeros(len(self.x) + 1, np.int64)
        np.add.at(hit, at, 1)
        np.add.at(hit, at + k, -1)
        keep = np.cumsum(hit)[:-1] > 0
        stretch = np.repeat(np.arange(len(self.n)), self.n)
        tokens = np.flatnonzero(keep)
        new = np.ones(len(tokens), bool)
        new[1:] = (np.diff(tokens) > 1) | (np.diff(stretch[tokens]) > 0)
        first = tokens[new]
        used, x = np.unique(self.x[tokens], return_inverse=True)
        n = np.diff(np.flatnonzero(new), append=len(tokens))
        text, offset = self.where(first) if len(first) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return State(self.mask, [self.words[i] for i in used.tolist()], x, self.t, text, offset, n, np.searchsorted(tokens, at), **self.more)


def blobs(key: np.ndarray, shards: int, order: np.ndarray, **columns: np.ndarray):
    """(shard, rows of it in `order`, its columns): rows by the shard that their key's hash gives."""
    shard = (mix(key[order]) % np.uint64(shards)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[by], np.arange(shards + 1))
    for h, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            rows = order[by[a:b]]
            yield h, rows, {c: v[rows] for c, v in columns.items()}


def with_texts(t: np.ndarray, part: dict) -> bytes:
    """A message whose column `ti` points into the digests that it needs."""
    some, ti = np.unique(part["ti"], return_inverse=True)
    return pack(t=t[some], **part | {"ti": small(ti)})


def gathered(payloads: list[bytes]) -> tuple[list[dict], dict[str, np.ndarray], np.ndarray]:
    """(messages, their columns end to end, all digests in order): `rank` is a row's text among those."""
    parts = [unpack(p) for p in payloads]
    every, inv = np.unique(np.concatenate([a["t"] for a in parts]), return_inverse=True)
    base = np.cumsum([0, *[len(a["t"]) for a in parts]])
    columns = {c: np.concatenate([a[c] for a in parts]) for c in parts[0] if c not in ("t", "ti")}
    columns["rank"] = np.concatenate([inv[b + a["ti"].astype(np.int64)] for a, b in zip(parts, base)])
    return parts, columns, every


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


class Seeds:
    """Do a window's minimizers occur in two places?  If not, the window doesn't."""

    @staticmethod
    def of(state: State, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        s = state.slice()
        at = np.flatnonzero(s.minimizers(k))
        h = s.grams(k // 2)[at]
        text, pos = state.where(at)
        order = np.lexsort((pos, np.argsort(np.argsort(state.t))[text], h))
        # of each hash, the least place and the greatest are enough
        new = runs(h[order]) if len(order) else np.zeros(0, bool)
        some = new | np.append(new[1:], True) if len(order) else new
        return at, h, text, pos, order[some]

    @staticmethod
    def question(data: bytes, k: int, shards: int):
        state = State.load(data)
        _, h, text, pos, rows = Seeds.of(state, k)
        for shard, _, part in blobs(h, shards, rows, h=h, ti=text, pos=pos):
            yield shard, with_texts(state.t, part | {"pos": small(part["pos"])})

    @staticmethod
    def answer(payloads: list[bytes]) -> list[bytes]:
        parts, c, _ = gathered(payloads)
        h, place = c["h"], c["rank"] << 32 | c["pos"].astype(np.int64)
        _, inv = np.unique(h, return_inverse=True)
        lo, hi = np.full(inv.max() + 1, np.iinfo(np.int64).max), np.full(inv.max() + 1, -1)
        np.minimum.at(lo, inv, place)
        np.maximum.at(hi, inv, place)
        twice = (lo != hi)[inv]
        return [pack(twice=np.packbits(x)) for x in np.split(twice, np.cumsum([len(a["h"]) for a in parts])[:-1])]

    @staticmethod
    def receive(data: bytes, answers: dict[int, bytes], k: int, shards: int):
        state = State.load(data)
        at, h, _, _, rows = Seeds.of(state, k)
        found = [h[r][np.unpackbits(unpack(answers[s])["twice"], count=len(r)).astype(bool)] for s, r, _ in blobs(h, shards, rows)]
        twice = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        marked = np.zeros(len(state.x), bool)
        marked[at[np.isin(h, twice)]] = True
        yield state.only(state.slice().windows(marked, k), k).save()


class Edges:
    """Which windows are repeated, where each occurs first, and does another repeated one leave its first node?"""

    @staticmethod
    def of(state: State, k: int):
        """(node, tag of the edge, text, place) by window, and the order of windows in which equal edges meet, the least place first."""
        g = state.slice().grams(k - 1)
        u, tag = g[state.win], (g[state.win + 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        text, pos = state.where(state.win)
        rank = np.argsort(np.argsort(state.t))[text]
        return u, tag, text, pos, np.lexsort((pos, rank, tag, u))

    @staticmethod
    def rows(u, tag, order):
        """(first window of each edge, which edge each window is, whether the slice has it in two places)."""
        new = runs(u[order], tag[order]) if len(order) else np.zeros(0, bool)
        edge = np.empty(len(order), np.int64)
        edge[order] = np.cumsum(new) - 1
        return order[new], edge, np.bincount(edge, minlength=int(new.sum())) > 1

    @staticmethod
    def question(data: bytes, k: int, shards: int):
        state = State.load(data)
        u, tag, text, pos, order = Edges.of(state, k)
        rows, edge, several = Edges.rows(u, tag, order)
        many = np.zeros(len(u), bool)
        many[rows] = several
        for shard, _, part in blobs(u, shards, rows, u=u, tag=tag, ti=text, pos=pos, many=many):
            yield shard, with_texts(state.t, part | {"pos": small(part["pos"])})

    @staticmethod
    def answer(payloads: list[bytes]) -> list[bytes]:
        parts, c, every = gathered(payloads)
        place = c["rank"] << 32 | c["pos"].astype(np.int64)
        order = np.lexsort((place, c["tag"], c["u"]))
        new = runs(c["u"][order], c["tag"][order])
        edge = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        first, last = place[order[starts]], place[order[np.append(starts[1:], len(order)) - 1]]
        twice = (first != last) | np.logical_or.reduceat(c["many"][order], starts)
        node = np.cumsum(runs(c["u"][order[starts]])) - 1
        fork = (np.bincount(node, twice) > 1)[node]
        back = np.empty(len(order), np.int64)
        back[order] = edge
        out, at = [], 0
        for a in parts:
            e = back[at : at + len(a["u"])]
            at += len(e)
            on = twice[e]
            rank = first[e][on] >> 32
            some, ci = np.unique(rank, return_inverse=True)
            out.append(pack(twice=np.packbits(on), fork=np.packbits(fork[e]), t=every[some], ci=small(ci), cpos=small(first[e][on] & 0xFFFFFFFF)))
        return out

    @staticmethod
    def receive(data: bytes, answers: dict[int, bytes], k: int, shards: int):
        state = State.load(data)
        u, tag, _, _, order = Edges.of(state, k)
        rows, edge, _ = Edges.rows(u, tag, order)
        n = len(rows)
        row_of = np.empty(len(u), np.int64)
        row_of[rows] = np.arange(n)
        twice, fork, ci, cpos, texts, base = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
        for shard, r, _ in blobs(u, shards, rows):
            a, r = unpack(answers[shard]), row_of[r]
            on = np.unpackbits(a["twice"], count=len(r)).astype(bool)
            twice[r], fork[r] = on, np.unpackbits(a["fork"], count=len(r)).astype(bool)
            ci[r[on]], cpos[r[on]] = a["ci"].astype(np.int64) + base, a["cpos"]
            texts.append(a["t"])
            base += len(a["t"])
        digests, inv = np.unique(np.concatenate(texts), return_inverse=True) if texts else (np.zeros(0, "S16"), np.zeros(0, np.int64))
        on = twice[edge]
        out, e = state.only(state.win[on], k), edge[on]
        out.more = {"fork": fork[e], "ci": small(inv[ci[e]] if len(e) else e), "cpos": small(cpos[e]), "ct": digests}
        yield out.save()


def firsts(state: State) -> np.ndarray:
    """Which windows are their edges' first occurrences."""
    text, pos = state.where(state.win)
    return (state.t[text] == state.more["ct"][state.more["ci"]]) & (pos == state.more["cpos"]) if len(text) else np.zeros(0, bool)


class Meets:
    """Does another repeated edge enter the last node of an edge?  Asked where edges occur first."""

    @staticmethod
    def question(data: bytes, k: int, shards: int):
        state = State.load(data)
        g, at = state.slice().grams(k - 1), state.win[firsts(state)]
        v, tag = g[at + 1], (g[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for shard, _, part in blobs(v, shards, np.argsort(v, kind="stable"), v=v, tag=tag):
            yield shard, pack(**part)

    @staticmethod
    def answer(payloads: list[bytes]) -> list[bytes]:
        parts = [unpack(p) for p in payloads]
        v, tag = (np.concatenate([a[c] for a in parts]) for c in ("v", "tag"))
        _, inv = np.unique(v, return_inverse=True)
        lo, hi = np.full(inv.max() + 1, 0xFFFFFFFF, np.uint32), np.zeros(inv.max() + 1, np.uint32)
        np.minimum.at(lo, inv, tag)
        np.maximum.at(hi, inv, tag)
        return [pack(meet=np.packbits(x)) for x in np.split((lo != hi)[inv], np.cumsum([len(a["v"]) for a in parts])[:-1])]

    @staticmethod
    def receive(data: bytes, answers: dict[int, bytes], k: int, shards: int):
        state = State.load(data)
        first = np.flatnonzero(firsts(state))
        v = state.slice().grams(k - 1)[state.win[first] + 1]
        meet = np.zeros(len(state.win), bool)
        for shard, rows, _ in blobs(v, shards, np.argsort(v, kind="stable")):
            meet[first[rows]] = np.unpackbits(unpack(answers[shard])["meet"], count=len(rows)).astype(bool)
        state.more["meet"] = meet
        yield state.save()


PIECES = "slice long, t binary, start int, end int, head long, tail long, fork boolean, meet boolean, ct binary, cstart int, digest binary"


def digests(t: np.ndarray) -> pa.Array:
    """Digests as Arrow values of 16 bytes, which numpy shortens where they end in zeros."""
    return pa.array([x.ljust(16, b"\0") for x in t.tolist()], pa.binary())


def pieces(state: State, number: int, k: int) -> pa.RecordBatch | None:
    """Rows of PIECES: windows that follow each other, [start, end) by the first and past the last.

    Edges that occur here first are one piece as long as no other edge leaves or enters between; the others (ct not null) are
    one as long as their first occurrences, from `cstart` of `ct` on, follow each other, too, and have a digest of their tokens.
    """
    if not len(state.win):
        return None
    g = state.slice().grams(k - 1)
    text, pos = state.where(state.win)
    first, fork, meet, ci, cpos = firsts(state), state.more["fork"], state.more["meet"], state.more["ci"].astype(np.int64), state.more["cpos"].astype(np.int64)
    new = runs(text, pos - np.arange(len(pos)), first)
    new[1:] |= np.where(first[1:], meet[:-1] | fork[1:], (ci[1:] != ci[:-1]) | (np.diff(cpos) != 1))
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(new)) - 1
    later = ~first[a]
    digest = [hashlib.blake2b(state.tokens(int(x), int(y)), digest_size=16).digest() if on else None for x, y, on in zip(state.win[a], state.win[b] + k, later)]
    signed = lambda x: pa.array(x.view(np.int64))
    null = pa.array(~later)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), number)), digests(state.t[text[a]]), pa.array(pos[a].astype(np.int32)), pa.array((pos[b] + 1).astype(np.int32)), signed(g[state.win[a]]), signed(g[state.win[b] + 1]), pa.array(fork[a]), pa.array(meet[b])]
        + [pa.compute.if_else(null, pa.nulls(len(a), x.type), x) for x in (digests(state.more["ct"][ci[a]]), pa.array(cpos[a].astype(np.int32)))]
        + [pa.array(digest, pa.binary())],
        names=[c.split()[0] for c in PIECES.split(", ")],
    )


def same_tokens(state: State, checks: dict[str, np.ndarray], k: int) -> np.ndarray:
    """Whether the windows from `cstart` to `cend` of the texts `ct` have the tokens of `digest`, read where they stand."""
    rank = {t: i for i, t in enumerate(state.t.tolist())}
    out, ends = np.zeros(len(checks["ct"]), bool), np.cumsum(state.n)
    order = np.lexsort((state.offset, state.text))
    key = (state.text << 32 | state.offset)[order]
    for i, (t, a, b, want) in enumerate(zip(*[checks[c].tolist() for c in ("ct", "cstart", "cend", "digest")])):
        text = rank.get(t)
        if text is None:
            continue
        j = int(np.searchsorted(key, text << 32 | a, side="right")) - 1
        if j >= 0 and state.text[s := order[j]] == text and b - 1 + k <= state.offset[s] + state.n[s]:
            at = int(ends[s] - state.n[s] + a - state.offset[s])
            out[i] = hashlib.blake2b(state.tokens(at, at + b - 1 + k - a), digest_size=16).digest().rstrip(b"\0") == want
    return out


@dataclass
class Repeats:
    """Scratch tables.  texts: (id, t, n) of each row whose text has k tokens or more.  found: (path, t, start, end, later), the
    verified occurrences of compacted paths, by windows; `later` are all but each path's first."""

    texts: DataFrame
    found: DataFrame


def repeats(docs: DataFrame, scratch: Scratch, k: int, mask: int = 0xFFFFFFFFFFFFFFFF) -> Repeats:
    """`docs` is (id, t, text)."""
    spark, kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()

    def tokenise(batches):
        task, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            for part in cut(b, 2, CHARS):
                words, x, n = split_words(part.column(2))
                t = part.column(1).to_pylist()
                own = np.flatnonzero(n >= k)
                own = own[np.unique([t[i] for i in own], return_index=True)[1]] if len(own) else own
                keep = np.zeros(len(n), bool)
                keep[own] = True
                used, xs = np.unique(x[np.repeat(keep, n)], return_inverse=True)
                own = np.flatnonzero(keep)
                state = State(mask, [words[i] for i in used.tolist()], xs, np.array([t[i] for i in own], "S16"), np.arange(len(own)), np.zeros(len(own), np.int64), n[own], np.zeros(0, np.int64))
                long_ = pa.array(np.flatnonzero(n >= k))
                rows = [part.column(0).take(long_), part.column(1).take(long_), pa.array(n[n >= k])]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(long_)], pa.int32()), c) for c in rows]
                yield pa.RecordBatch.from_arrays([pa.array([task << 24 | seq]), pa.array([-1], pa.int32()), pa.array([state.save()], pa.binary()), *lists], names=["slice", "shard", "payload", "ids", "ts", "ns"])
                seq += 1

    base = scratch.save(docs.where("text is not null").select("id", "t", "text").mapInArrow(tokenise, f"{MESSAGE}, ids array<{kind}>, ts array<binary>, ns array<long>"))
    texts = base.select(F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("ts").alias("t"), F.col("ns").alias("n"))).alias("x")).select("x.*")
    slices, size = base.select(F.count("*"), F.coalesce(F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TOKENS))
    state = base.select("slice", "shard", "payload")
    for step in (Seeds, Edges, Meets):
        question, receive = (lambda data, f=step.question: f(data, k, shards)), (lambda data, got, f=step.receive: f(data, got, k, shards))
        answers = ask(state, scratch, shards, question, step.answer)
        after = scratch.save(deliver(state, answers, slices, receive))
        scratch.drop(answers, *([state] if step is not Seeds else []))
        state = after
        tidy(spark)

    def cut_up(batches):
        for s, _, data in messages(batches):
            out = pieces(State.load(data), s, k)
            if out is not None:
                yield out

    found = scratch.save(state.mapInArrow(cut_up, PIECES))
    first = found.where("ct is null").groupBy("t", "start", "end").agg(F.min("slice").alias("slice"), *[F.first(c).alias(c) for c in ("head", "tail", "fork", "meet")])
    first = scratch.save(first)
    cend = (F.col("cstart") + F.col("end") - F.col("start")).alias("cend")
    later = found.where("ct is not null").select("t", "start", "end", "ct", "cstart", cend, "digest").distinct()
    # each stretch of a text that others repeat is read again there, once for all that say the same
    checks = later.select("ct", "cstart", "cend", "digest").distinct().join(first.groupBy(F.col("t").alias("ct")).agg(F.min("slice").alias("slice")), "ct")

    def bundle(batches):
        for s, t in by_slice(batches):
            yield record((s, 0, pickle.dumps({c: t[c].to_numpy(zero_copy_only=False) for c in ("ct", "cstart", "cend", "digest")})))

    def by_slice(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got).sort_by("slice").combine_chunks()
            s = t["slice"].to_numpy()
            at = np.flatnonzero(runs(s))
            for a, b in zip(at, np.append(at[1:], len(s))):
                yield int(s[a]), t.slice(a, b - a)

    def verify(data, got):
        if 0 in got:
            c = pickle.loads(got[0])
            as_is = [pa.array(c["ct"], pa.binary()), pa.array(c["cstart"]), pa.array(c["cend"]), pa.array(c["digest"], pa.binary())]
            c = {x: np.array([v.rstrip(b"\0") for v in y], object) if x in ("ct", "digest") else y for x, y in c.items()}
            yield pa.RecordBatch.from_arrays(as_is, names=["ct", "cstart", "cend", "digest"]).filter(pa.array(same_tokens(State.load(data), c, k)))

    sent = checks.repartition("slice").mapInArrow(bundle, MESSAGE)
    same = scratch.save(deliver(state, sent, slices, verify, "ct binary, cstart int, cend int, digest binary"))
    path = scratch.save(paths(first, scratch))
    # occurrences are cut where paths end: every part is one path's, and so is the part of the first occurrence that it repeats
    verified = later.join(same, ["ct", "cstart", "cend", "digest"])
    on = verified.join(path.select(F.col("t").alias("ct"), F.col("start").alias("ps"), F.col("end").alias("pe"), "path"), "ct").where("ps < cend and pe > cstart")
    a, b = F.greatest("ps", "cstart"), F.least("pe", "cend")
    shift = F.col("start") - F.col("cstart")
    parts = on.select("path", "t", (a + shift).alias("start"), (b + shift).alias("end"), F.lit(True).alias("later"), "ct", a.alias("a"), b.alias("b"))
    parts = scratch.save(parts)
    occurrences = scratch.save(parts.select("path", "t", "start", "end", "later").unionByName(parts.select("path", F.col("ct").alias("t"), F.col("a").alias("start"), F.col("b").alias("end"), F.lit(False).alias("later")).distinct()))
    scratch.drop(state, found, same, parts)
    return Repeats(texts, occurrences)


def paths(first: DataFrame, scratch: Scratch) -> DataFrame:
    """(t, start, end, path): first occurrences of edges in one text, and the nonbranching path that each belongs to.

    What goes on in another text is joined at its node, and the chains of such stretches are found as components.  A path's
    name is its least stretch.
    """
    name = F.struct("t", "start")
    links = first.where("not meet").select(name.alias("a"), F.col("tail").alias("node")).join(first.where("not fork").select(name.alias("b"), F.col("head").alias("node")), "node").select("a", "b")
    roots = components(links, scratch).withColumnRenamed("v", "s")
    return first.select("t", "start", "end", name.alias("s")).join(roots, "s", "left").select("t", "start", "end", F.coalesce("root", "s").alias("path"))


def spans(found: DataFrame, k: int) -> DataFrame:
    """(t, start, end, n_paths, cuts): maximal stretches of tokens that occurrences of paths cover, and what of each is a later one."""
    by_text = W.partitionBy("t").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    # stretches are one where windows touch: [start, start + k) and the next
    apart = lambda on: (F.coalesce(F.col("start") - F.max(F.when(on, F.col("end"))).over(by_text), F.lit(k)) >= k).cast("int")
    up_to = by_text.rowsBetween(W.unboundedPreceding, W.currentRow)
    each = found.withColumn("new", apart(F.lit(True))).withColumn("new_cut", F.when(F.col("later"), apart(F.col("later"))))
    each = each.withColumn("span", F.sum("new").over(up_to)).withColumn("cut", F.when(F.col("later"), F.sum("new_cut").over(up_to)))
    parts = each.groupBy("t", "span", "cut").agg(F.min("start").alias("a"), F.max("end").alias("b"), F.collect_set("path").alias("paths"))
    cut = F.when(F.col("cut").isNotNull(), F.struct(F.col("a").alias("start"), (F.col("b") - 1 + k).alias("end")))
    return parts.groupBy("t", "span").agg(F.min("a").alias("start"), (F.max("b") - 1 + k).alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("paths")))).cast("long").alias("n_paths"), F.sort_array(F.collect_list(cut)).alias("cuts")).drop("span")


def digest(text: str) -> Column:
    """16 bytes of a text's SHA-256: texts with one digest are taken as equal."""
    return F.unhex(F.substring(F.sha2(F.col(text), 256), 1, 32))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), digest(text).alias("t"), F.col(text).alias("text"))


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, mask: int = 0xFFFFFFFFFFFFFFFF) -> DataFrame:
    """(doc_id, start, end, copy_of, n_paths, cuts): the maximal spans of tokens covered by windows of k that occur twice.

    Tokens are separated by white space; [start, end) counts them.  Windows of k tokens are the edges of a de Bruijn graph of
    which only repeated ones are built; its nonbranching paths are compacted, and spans and cuts are what verified occurrences
    of paths cover.  A span is maximal: windows that overlap or touch are one span.  n_paths counts the paths in the span.
    `cuts` are the [start, end) that isn't the first occurrence, in order of text digest and place; removing all cuts leaves
    each repeated passage once.

    Hashes of 64 bits only propose.  An occurrence counts if its tokens, read again at its source coordinates and at those of
    the first occurrence, are the same (by a digest of 128 bits); where a collision joined two that differ, neither is cut.
    `mask` keeps fewer bits of the hashes, to test that.

    Documents with equal texts of k tokens or more (by 128 bits of SHA-256) are one span each: all but that of the least id
    (copy_of null) are cut whole, with that id as copy_of.  A window repeated within one text counts.  Null, empty and shorter
    texts have no spans; rows with a null id have none either, but count as occurrences.  Repeated rows (one id, one text) are
    one document.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "debruijn")
    r = repeats(keyed(docs, doc_id, text), scratch, k, mask)
    own = scratch.save(spans(r.found, k))
    known = F.struct(F.col("id").isNull().alias("null"), "id")
    shared = r.texts.groupBy("t").agg(F.min("id").alias("first"), (F.min(known) != F.max(known)).alias("several"))
    rows = scratch.save(r.texts.where("id is not null").distinct().join(shared, "t").join(own, "t", "left"))
    none = F.lit(None).cast(docs.schema[doc_id].dataType)
    whole = F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end"))
    counted = F.sum(F.coalesce("n_paths", F.lit(1))).cast("long").alias("n_paths")
    later = rows.where("several and id <> first").groupBy("id", "n", "first").agg(counted).select("id", F.lit(0).alias("start"), F.col("n").cast("int").alias("end"), F.col("first").alias("copy_of"), "n_paths", F.array(whole).alias("cuts"))
    kept = rows.where("several and id = first").groupBy("id", "t", "n").agg(counted, F.flatten(F.sort_array(F.collect_list("cuts"))).alias("cuts"))
    kept = kept.select("id", F.lit(0).alias("start"), F.col("n").cast("int").alias("end"), none.alias("copy_of"), "n_paths", "cuts")
    alone = rows.where("not several and start is not null").select("id", "start", "end", none.alias("copy_of"), "n_paths", "cuts")
    out = alone.unionByName(kept).unionByName(later)
    return out.select(F.col("id").alias("doc_id"), F.col("start").cast("int"), F.col("end").cast("int"), "copy_of", "n_paths", "cuts")


TOKEN = re.compile(r"\S+")


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the tokens of the cuts and the white space behind them."""
    starts = [m.start() for m in TOKEN.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in sorted(cuts):
        a, b = starts[min(a, len(starts) - 1)], starts[min(b, len(starts) - 1)]
        out.append(text[at:max(a, at)])
        at = max(at, b)
    return "".join([*out, text[at:]])


def drop_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars", k: int = K, mask: int = 0xFFFFFFFFFFFFFFFF) -> DataFrame:
    """`docs` without the later occurrences of repeated paths, as repeated_spans() finds and verifies them.

    Of equal texts of k tokens or more one row stays, that of the least id (null last); from each text its cuts are removed.
    A row of which no token is left goes.  `length`, if there is such a column, becomes the characters of a text that was cut.
    Other rows and columns, nulls included, pass through unchanged, whatever their names; a name may even be repeated, except
    those of the id, the text and the length.  An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "debruijn")
    names = docs.columns
    # by place, since names may be repeated
    places = [str(i) for i in range(len(names))]
    flat = docs.toDF(*places)
    id_at, text_at = names.index(doc_id), names.index(text)
    length_at = names.index(length) if length in names else None
    r = repeats(keyed(flat, str(id_at), str(text_at)), scratch, k, mask)
    cuts = spans(r.found, k).where(F.size("cuts") > 0).groupBy("t").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    known = F.struct(F.col("id").isNull().alias("null"), "id")
    copied = r.texts.groupBy("t").agg(F.count("*").alias("c"), F.min(known).alias("keep")).where("c > 1")
    marks = scratch.save(cuts.join(copied, "t", "full").select(F.col("t").alias("mark"), "cuts", F.col("keep")))
    # where they are small, marks go to the texts; else each text goes to its mark
    size = marks.agg(F.coalesce(F.sum(128 + 16 * F.coalesce(F.size("cuts"), F.lit(0))), F.lit(0))).first()[0]
    marks = F.broadcast(marks) if size <= BROADCAST_BYTES else marks
    rows = flat.select(digest(str(text_at)).alias("t"), F.struct(F.col(f"`{id_at}`").isNull().alias("null"), F.col(f"`{id_at}`").alias("id")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in places]).alias("row"))
    marked = rows.join(marks, F.col("t") == F.col("mark"), "left").where("keep is null or key = keep")
    # of rows with one id and one text the first stays: only those are numbered
    one = marked.where("keep is not null").withColumn("r", F.row_number().over(W.partitionBy("t").orderBy("t"))).where("r = 1").select("cuts", "row")
    kept = marked.where("keep is null").select("cuts", "row").unionByName(one)

    def run(batches):
        for part, texts in chunks(batches, text_at + 1):
            which = part.column(0)
            new = [x if not c else without(x, [(y["start"], y["end"]) for y in c]) for x, c in zip(texts, which.to_pylist())]
            cols, was = list(part.columns), which.is_valid()
            cols[text_at + 1] = pa.array(new, cols[text_at + 1].type)
            if length_at is not None:
                sizes = pa.array([len(x) if x is not None else None for x in new], pa.int64()).cast(cols[length_at + 1].type)
                cols[length_at + 1] = pa.compute.if_else(was, sizes, cols[length_at + 1])
            stays = pa.array([not c or bool(x.strip()) for x, c in zip(new, was.to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays(cols[1:], names=places).filter(stays)

    whole = kept.where("cuts is null").select("row.*")
    return whole.unionByName(kept.where("cuts is not null").select("cuts", "row.*").mapInArrow(run, flat.schema)).toDF(*names)
