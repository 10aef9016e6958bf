"""LM scoring by a probabilistic suffix tree over words, of whatever size the corpus supports."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Scratch, cut, mix, release, small, tidy, worker_store

#: A context is kept if it occurs this often and its next words diverge from those of its longest kept suffix: G2 = 2 N KL
#: at least critical() of their number and this, and KL (nats a word) at least MIN_KL.
MIN_COUNT, MIN_G2, MIN_KL = 50, 61.1, 0.002
#: Weight, in counts, of the suffix's distribution in a context's own.
PRIOR = 10.0
BASE = np.uint64(0x9E3779B97F4A7C15)
#: No token holds a space, so no token is one of these.
BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(w)) for w in (b" begin", b" end"))
#: Characters of text in a slice, no more than in a batch (common.BATCH); words that a task of the counting side gets; occurrences beyond which a context has several tasks.
CHARS, WORDS, SPREAD = 8_000_000, 3_000_000, 1 << 20
#: Bytes of slices for each task that gets their answers.
STATE = 6_000_000
#: Depths that are settled one by one; after that, blocks go up to four times as deep as before, by as many as half the words.
SINGLE = 4
#: Slices get their answers in up to so many rounds, a power of 2: only a round's share of them is shuffled, or there twice, at a time.
ROUNDS = 4
REPLY = "slice long, shard int, payload binary, context long, total long, different long, nlogn double, nq double, asked array<long>"


def codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """Made once in a process: messages are many and small where slices and shards are many."""
    kept = worker_store("codec")
    if not kept:
        kept["both"] = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    return kept["both"]


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, in which the lowest bytes of all values of an array come first, then the next, and so on: high bytes repeat and so compress."""
    planes = [a.tobytes() if a.itemsize == 1 else np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays.values()]
    return pickle.dumps(([(k, a.dtype.str, len(a)) for k, a in arrays.items()], codec()[0].compress(b"".join(planes))))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    heads, z = pickle.loads(data)
    body, at, found = codec()[1].decompress(z), 0, {}
    for k, t, n in heads:
        t = np.dtype(t)
        a = np.frombuffer(body, np.uint8, n * t.itemsize, at)
        found[k] = a.view(t) if t.itemsize == 1 else np.ascontiguousarray(a.reshape(t.itemsize, -1).T).view(t).ravel()
        at += n * t.itemsize
    return found


def tokens(text: str) -> list[str]:
    """What single spaces separate; a newline is a token too.  Nothing of the text is lost."""
    return text.replace("\n", " \n ").split(" ") if text else []


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the different words in order, each token's place among them, tokens of each text) as tokens() has them."""
    n, some = np.zeros(len(texts), np.int64), np.asarray(pa.compute.fill_null(pa.compute.greater(pa.compute.binary_length(texts), 0), False))
    lists = pa.compute.split_pattern(pa.compute.replace_substring(texts.filter(pa.array(some)), "\n", " \n "), " ")
    n[some] = np.asarray(pa.compute.list_value_length(lists))
    flat = lists.flatten().dictionary_encode()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(flat.dictionary))
    words, _, at = distinct(h)
    return words, at[np.asarray(flat.indices)], n


def gram(context: np.ndarray, d: int, x: np.ndarray) -> np.ndarray:
    """The hash of a context of d words and the next."""
    return context + np.uint64(pow(int(BASE), int(d), 1 << 64)) * x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, kept between tasks."""
    kept = worker_store("powers")
    if len(kept.get("both", [[]])[0]) < n:
        both = np.full(n, BASE, np.uint64), np.full(n, pow(int(BASE), -1, 1 << 64), np.uint64)
        both[0][0] = both[1][0] = 1
        kept["both"] = [np.cumprod(x) for x in both]
    power, back = kept["both"]
    return power[:n], back[:n]


def critical(df: np.ndarray) -> np.ndarray:
    """The 0.1 % point of chi-square (Wilson and Hilferty), MIN_G2 at least."""
    return np.maximum(MIN_G2, df * (1 - 2 / (9 * df) + 3.0902 * np.sqrt(2 / (9 * df))) ** 3)


def diverges(total: Column, different: Column, nlogn: Column, nq: Column) -> Column:
    """keep() of sums over next words: n, 1, n ln n, and n ln q."""
    g2 = 2 * (nlogn - total * F.log(total) - nq)
    df = F.greatest(different - 1, F.lit(1)).cast("double")
    chi = F.greatest(F.lit(MIN_G2), df * F.pow(1 - 2 / (9 * df) + 3.0902 * F.sqrt(2 / (9 * df)), F.lit(3)))
    return (total >= MIN_COUNT) & (g2 >= chi) & (g2 >= 2 * total * MIN_KL)


class Slice:
    """Texts end to end, each from BEGIN to END, and how far their words are scored.

    `live` are the places whose contexts may still grow, with `q`, ln P by the longest kept suffix so far, and `k`, how many
    tasks share their next context; `rare` are those whose context fell below MIN_COUNT; `done` is each text's ln P of all
    others.  A context's hash is sum(x_j BASE^j), so that longer ones follow by arithmetic.
    """

    def __init__(self, n: np.ndarray, words: np.ndarray, x: np.ndarray, which: np.ndarray | None = None):
        self.n, self.words, self.x = np.asarray(n, np.int64), words, x
        self.which = np.arange(len(self.n)) if which is None else which
        self.first = np.cumsum(self.n) - self.n
        self.text = np.repeat(np.arange(len(self.n)), self.n)
        self.place = np.arange(len(x)) - self.first[self.text]

    @cached_property
    def spread(self) -> np.ndarray:
        """Words are hashes at first and numbers later; the numbers are spread again."""
        return mix(self.words.astype(np.uint64))

    @cached_property
    def sums(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.spread[self.x] * powers(len(self.x) + 1)[0][:-1])])

    def context(self, i: np.ndarray, d) -> np.ndarray:
        """Hashes of the d words before each place."""
        if np.ndim(d) == 0 and d == 1:
            return self.spread[self.x[i - 1]]
        return (self.sums[i] - self.sums[i - d]) * powers(len(self.x) + 1)[1][i - d]

    @classmethod
    def of(cls, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words in each text with its ends, or 0 for a null; hashes of the different words, in order; each word's place among them)."""
        words, at, n = hashed(texts)
        words, where = np.unique(np.concatenate([words, np.array([BEGIN, END], np.uint64)]), return_inverse=True)
        has = np.asarray(texts.is_valid())
        n = np.where(has, n + 2, 0)
        first = (np.cumsum(n) - n)[has]
        x, inner = np.zeros(n.sum(), np.int32), np.ones(n.sum(), bool)
        x[first], x[first + n[has] - 1] = where[-2], where[-1]
        inner[first] = inner[first + n[has] - 1] = False
        x[inner] = where[at]
        return n, words, x

    @classmethod
    def load(cls, n, state: bytes, spread: int = SPREAD) -> Slice:
        a = unpack(state)
        x = a["x"].astype(np.int64)
        if "counts" in a:
            s = cls(n, np.cumsum(a["words"], dtype=np.int64), x)
            s.begin(a["counts"], float(a["norm"][0]), spread)
        else:
            s = cls(a["n"], np.cumsum(a["words"], dtype=np.int64), x, a["which"].astype(np.int64))
            s.live, s.q, s.k, s.done = np.cumsum(a["live"], dtype=np.int64), a["q"].astype(float), a["k"].astype(np.int64), a["done"]
            s.rare = np.unpackbits(a["rare"], count=len(s.x)).astype(bool)
        return s

    def save(self, d: int) -> bytes:
        """Without what no live place needs, d being the depth that is settled.

        A place that is rare has a context of d + 1 words or fewer that is below MIN_COUNT, and so is any that holds it.  So no
        context of a later place goes back further than d words before the last rare place; what stays are stretches of texts.
        """
        rare, start = np.flatnonzero(self.rare), self.live - self.place[self.live]
        before = np.searchsorted(rare, self.live) - 1
        start = np.maximum(start, np.where(before >= 0, rare[before] - d, 0)) if len(rare) else start
        size = len(self.x)
        keep = np.cumsum(np.bincount(start, minlength=size + 1) - np.bincount(self.live + 1, minlength=size + 1))[:size] > 0
        first = keep & (self.place == 0)
        first[1:] |= keep[1:] & ~keep[:-1]
        at = np.cumsum(keep) - 1
        x, used = self.x[keep], np.zeros(len(self.words), bool)
        used[x] = True
        begins = at[first]
        return pack(which=small(self.which[self.text[first]]), n=small(np.diff(begins, append=len(x))), words=small(np.diff(self.words[used], prepend=0)), x=small((np.cumsum(used) - 1)[x]), live=small(np.diff(at[self.live], prepend=0)), q=self.q.astype(np.float32), k=small(self.k), done=self.done, rare=np.packbits(self.rare[keep]))

    def begin(self, counts: np.ndarray, norm: float, spread: int) -> None:
        """From the counts of `words` in the corpus: depth 0 is scored, and words that are frequent are contexts."""
        counts = counts.astype(np.int64)
        q, often = np.log((counts + 0.5) / norm), np.zeros(len(self.x), bool)
        often[1:] = (counts >= MIN_COUNT)[self.x[:-1]]
        scored = self.place > 0
        self.live = np.flatnonzero(scored & often)
        self.rare = scored & ~often
        self.q, self.k = q[self.x[self.live]], (1 + counts // spread)[self.x[self.live - 1]]
        self.done = np.bincount(self.text[self.rare], q[self.x[self.rare]], len(self.n)).astype(float)
        self.counts, self.norm = counts, norm

    def places(self, d0: int, d1: int, shards: int):
        """(which of `live`, depth, row) of every place and depth that is asked for, depths of a place one after another; and of
        all rows the shard and the first that asks.  Rows are in order of shards, and in them of words, or, in a block of several depths, of places.

        All contexts that extend one of depth d0 + 1 go to one shard, unless that is shared by several.
        """
        one, n_live = d1 == d0 + 1, len(self.live)
        if one:  # every live place has a longer context
            j, d, i = np.arange(n_live), np.full(n_live, d1), self.live
            c = self.context(i, d1)
        else:
            depths = np.minimum(self.place[self.live], d1) - d0
            j = np.repeat(np.arange(n_live), depths)
            d = np.arange(len(j)) - np.repeat(np.cumsum(depths) - depths, depths) + d0 + 1
            i = self.live[j]
            c = self.context(i, d)
        base = powers(d1 + 1)[0]
        # the word whose number is 0 adds nothing to a hash, so that depths must be told apart
        _, first, row = distinct(c + base[d1] * self.spread[self.x[i]] if one else c + base[d] * self.spread[self.x[i]] + mix(d.astype(np.uint64)))
        near = self.live[j[first]]
        piece = mix(self.words.astype(np.uint64)[self.x[near]]) % self.k[j[first]].astype(np.uint64) if one else np.uint64(0)
        shard = mix(self.context(near, d0 + 1) + piece * BASE) % np.uint64(shards)
        # in a block, rows of a place follow each other, so that the words before it compress
        then, bits = (self.x[near], len(self.words).bit_length()) if one else (first, len(j).bit_length())
        by = ordered(shard << np.uint64(bits) | then.astype(np.uint64), bits + shards.bit_length())
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        return j, d, c, rank[row], shard[by].astype(np.int64), first[by]

    def names(self, d0: int, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """What tells apart the contexts of d0 + 1 words before places, whose hashes are c: numbers of their words if they are one or two."""
        return c if d0 > 1 else (self.x[i - 1] << 32 | self.x[i - 1 - d0]).astype(np.uint64)

    def requests(self, d0: int, d1: int, shards: int) -> Iterator[tuple[int, dict]]:
        """What to ask for the depths d0 < d <= d1: (shard, message)."""
        if not len(self.live):
            return
        one = d1 == d0 + 1
        j, d, c, row, shard, first = self.places(d0, d1, shards)
        n = np.bincount(row)
        # a row's suffix is the row of the same place at the depth before
        suffix, d, c, j = row[first - 1], d[first], c[first], j[first]
        i = self.live[j]
        x, q, k, left, names = self.x[i], self.q[j], self.k[j], self.x[i - d], self.names(d0, c, i) if one else None
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a == b:
                continue
            if one:
                contexts, at, ci = distinct(names[a:b])
                parts = {"ci": small(ci), "k": small(k[a:b][at])}
                ends, words = [contexts >> np.uint64(32), contexts & np.uint64(0xFFFFFFFF)], x[a:b][runs(x[a:b])]
                if d0 == 1:
                    words = distinct(np.concatenate([words.astype(np.uint64), *ends]))[0].astype(np.int64)
                    parts |= {"near": small(np.diff(np.searchsorted(words, ends[0]), prepend=0)), "left": small(np.searchsorted(words, ends[1]))}
                else:
                    parts["context"] = contexts if d0 else small(np.diff(self.words[ends[0].astype(np.int64)], prepend=0))
                parts["xi"] = small(np.diff(np.searchsorted(words, x[a:b]), prepend=-1))
            else:
                # but for the first depth, a context is its suffix and a word before it
                words, xi = np.unique(np.concatenate([x[a:b], left[a:b]]), return_inverse=True)
                top = d[a:b] == d0 + 1
                parts = {"context": c[a:b][top], "d": small(d[a:b] - d0), "suffix": small((np.arange(a, b) - suffix[a:b])[~top]), "xi": small(xi[: b - a]), "left": small(xi[b - a :][~top])}
            parts |= {"word": small(np.diff(self.words[words], prepend=0)), "n": small(n[a:b])}
            # at depth 0 a word's q follows from its count
            yield s, parts | ({"counts": small(self.counts[words])} if not d0 else {"q": q[a:b][d[a:b] == d0 + 1].astype(np.float32)})

    def apply(self, d0: int, d1: int, shards: int, replies: dict[int, bytes], shared: list, spread: int) -> None:
        """Scores the depths d0 < d <= d1 by the replies to requests(), and those about shared contexts."""
        if not len(self.live):
            return
        j, d, context, row, shard, first = self.places(d0, d1, shards)
        n, total, flag = (np.zeros(len(shard), t) for t in (np.int64, np.int64, np.uint8))
        names = self.names(d0, context[first], self.live[j[first]]) if d1 == d0 + 1 else None
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                reply = unpack(replies[s])
                of = slice(None) if names is None else distinct(names[a:b])[2]
                n[a:b], total[a:b], flag[a:b] = reply["n"], reply["total"].astype(np.int64)[of], reply["flag"][of]
        if (flag & 4).any():  # decided elsewhere
            known, totals, kept = (np.array([x[k] for x in shared], np.int64) for k in ("context", "total", "kept"))
            order, r = np.argsort(known), np.flatnonzero(flag & 4)
            asked = context[first[r]].view(np.int64)
            at = order[np.minimum(np.searchsorted(known, asked, sorter=order), len(known) - 1)]
            assert (known[at] == asked).all()
            total[r], flag[r] = totals[at], 2 | kept[at]
        kept, grows = flag & 1 > 0, flag & 2 > 0
        open_ = np.ones(len(self.live), bool)
        start = j if d1 == d0 + 1 else np.flatnonzero(runs(j))
        j = np.arange(len(self.live))
        for at in range(d1 - d0):
            # the places that are still looked at at this depth, in order
            i, r = self.live[j], row[start[j] + at]
            m, t = n[r], total[r]
            if d1 == d0 + 1:  # all places of a row have the same
                q = self.q[first]
                self.q = np.where(kept, np.log((n + PRIOR * np.exp(q)) / (total + PRIOR)), q)[row]
            else:
                self.q[j] = np.where(kept[r], np.log((m + PRIOR * np.exp(self.q[j])) / (t + PRIOR)), self.q[j])
            # the context of one word more is what the place before asked for, if it did
            near = np.zeros(len(i), bool)
            near[1:] = np.diff(i) == 1
            before = np.concatenate([np.zeros(1, np.int64), m[:-1]])
            seldom = near & (before < MIN_COUNT) | self.rare[i - 1]
            self.rare[i[seldom | (t < MIN_COUNT)]] = True
            self.k[j] = np.where(near, 1 + before // spread, self.k[j])
            goes_on = grows[r] & ~seldom & (self.place[i] > d0 + 1 + at)
            open_[j[~goes_on]] = False
            j = j[goes_on]
            if not len(j):
                break
        shut = ~open_
        self.done = self.done + np.bincount(self.which[self.text[self.live[shut]]], self.q[shut], len(self.done))
        self.live, self.q, self.k = self.live[open_], self.q[open_], self.k[open_]


def batch(schema: list[str], **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c] for c in schema], names=schema)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different values in order, a place of each, which of them each is)."""
    order = ordered(x)
    new = runs(x[order])
    inv = np.empty(len(x), np.int64)
    inv[order] = np.cumsum(new) - 1
    return x[order[new]], order[new], inv


def grouped(x: np.ndarray, n: int) -> list[np.ndarray]:
    """The places of each of 0 ... n - 1, in order."""
    return np.split(order := np.argsort(x, kind="stable"), np.searchsorted(x[order], np.arange(1, n)))


def ordered(x: np.ndarray, bits: int = 64) -> np.ndarray:
    """A stable argsort of uint64 below 2 ** bits.

    Values are sorted with their places in their low bits, at a quarter of argsort()'s time.  Should the bits that this takes from
    them be needed to tell two apart, they are sorted as they are.
    """
    own = max(1, len(x).bit_length())
    lost = max(0, bits + own - 64)
    order = np.sort((x >> np.uint64(lost)) << np.uint64(own) | np.arange(len(x), dtype=np.uint64)) & np.uint64((1 << own) - 1)
    order = order.astype(np.int64)
    if lost and ((y := x[order])[1:] < y[:-1]).any():
        return np.argsort(x, kind="stable")
    return order


def most(n: np.ndarray, logs: np.ndarray, ctx: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A bound on the G2 of all longer contexts, from the counts of a context's next words and ln q, what it gives them.

    A longer context has some n'(x) <= n(x), MIN_COUNT in sum at least, and G2 = 2 sum(n' ln(n' / (N' q))).  That is at most
    2 sum(n (-ln q)).  It is convex, so its maximum is where all n' but one are 0 or n, and that one is neither only if the sum
    is MIN_COUNT.  If all but the most frequent word, A, are fewer than MIN_COUNT, R, then A must be in it: whole, with N' >=
    n(A); or in part, with what is best for the rest, none or all of it.
    """
    size, low = len(total), math.log(MIN_COUNT)
    bound = np.bincount(ctx, -n * logs, size)
    top, at = np.zeros(size, np.int64), np.full(size, len(n))
    np.maximum.at(top, ctx, n)
    is_top = np.flatnonzero(n == top[ctx])
    np.minimum.at(at, ctx[is_top], is_top)
    rest_of, lr = np.ones(len(n), bool), np.log(np.maximum(n, 1)) - logs
    rest_of[at] = False
    top, rest = np.maximum(top, 1).astype(float), total - top
    whole = top * (lr[at] - np.log(top)) + np.bincount(ctx, np.where(rest_of, n * np.maximum(0, lr - np.log(top)[ctx]), 0), size)
    best = np.full(size, -np.inf)
    np.maximum.at(best, ctx[rest_of], lr[rest_of])
    some = np.maximum(MIN_COUNT - rest, 1e-9)
    part = np.where(rest > 0, rest * (np.where(rest > 0, best, 0) - low), 0) + some * (np.log(some) - low - logs[at])
    tight = np.maximum(np.maximum(whole, part), MIN_COUNT * -logs[at])
    return 2 * np.where(rest < MIN_COUNT, np.minimum(bound, tight), bound)


def settle(batches: Iterator[pa.RecordBatch], d0: int, d1: int, norm: float) -> Iterator[pa.RecordBatch]:
    """Replies to all messages of a shard: each row's count in the corpus; each context's total, and flags: 1 kept, 2 may grow, 4 shared.

    Where no longer context can have a G2 of MIN_G2, by most(), none is looked at, which loses nothing.
    """
    asked = [(s, h, unpack(p)) for b in batches for s, h, p in zip(*[b.column(c).to_pylist() for c in ("slice", "shard", "payload")])]
    if not asked:
        return
    parts, one = [a for _, _, a in asked], d1 == d0 + 1
    for a in parts:
        a["word"] = mix(np.cumsum(a["word"], dtype=np.uint64))
        a["rows"] = len(a["n"])
        if one:
            a["xi"] = np.cumsum(a["xi"], dtype=np.int64) - 1
        if not d0:
            a["context"] = mix(np.cumsum(a["context"], dtype=np.uint64))
            a["q"] = np.log((a["counts"].astype(np.int64) + 0.5) / norm)[a["xi"]]
        elif d1 == 2:
            a["context"] = a["word"][a["left"]] + BASE * a["word"][np.cumsum(a["near"], dtype=np.int64)]
    join = lambda f: np.concatenate([f(a) for a in parts])
    ends = np.cumsum([a["rows"] for a in parts])
    x, n_all = join(lambda a: a["word"][a["xi"]]), join(lambda a: a["n"].astype(np.int64))
    depth = np.full(len(x), d1) if one else join(lambda a: a["d"].astype(np.int64) + d0)
    top = depth == d0 + 1
    c, q_all = np.zeros(len(x), np.uint64), np.full(len(x), np.nan)
    c[top] = join(lambda a: a["context"][a["ci"]] if one else a["context"])
    q_all[top] = join(lambda a: a["q"])
    suffix, left = np.zeros(len(x), np.int64), np.zeros(len(x), np.uint64)
    if not one:
        deep = np.flatnonzero(~top)
        suffix[deep] = deep - join(lambda a: a["suffix"].astype(np.int64))
        left[deep] = join(lambda a: a["word"][a["left"]])
    counts, all_total, all_flag = (np.zeros(len(c), t) for t in (np.int64, np.int64, np.uint8))
    shared_sums = []
    many = join(lambda a: a["context"][a["k"] > 1]) if one else np.zeros(0, np.uint64)
    resolved, by_depth = None if one else np.zeros(len(c)), np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[by_depth], np.arange(d0 + 1, d1 + 2))
    for d, a, b in zip(range(d0 + 1, d1 + 1), cuts, cuts[1:]):
        if a == b:
            break
        mine = m = by_depth[a:b]
        if d > d0 + 1:
            c[m] = left[m] + BASE * c[suffix[m]]
        g, at, inv = distinct(gram(c[m], d, x[m]))
        n = np.bincount(inv, n_all[m], len(g)).astype(np.int64)
        counts[m] = n[inv]
        m = m[at]
        some, _, ctx = distinct(c[m])
        total, different = np.bincount(ctx, n, len(some)), np.bincount(ctx, n > 0, len(some))
        q = q_all[m]
        if d > d0 + 1:
            q = resolved[suffix[m]]
        log_n = np.log(np.maximum(n, 1))
        nlogn, nq = np.bincount(ctx, n * log_n, len(some)), np.bincount(ctx, n * q, len(some))
        g2 = 2 * (nlogn - total * np.log(np.maximum(total, 1)) - nq)
        kept = (total >= MIN_COUNT) & (g2 >= critical(np.maximum(different - 1, 1))) & (g2 >= 2 * total * MIN_KL)
        logs = np.where(kept[ctx], np.log((n + PRIOR * np.exp(q)) / (total[ctx] + PRIOR)), q)
        if not one:
            resolved[mine] = logs[inv]
        grows = (total >= MIN_COUNT) & (most(n, logs, ctx, total) >= MIN_G2)
        shared = np.isin(some, many)
        of = ctx[inv]
        all_total[mine], all_flag[mine] = total[of], np.where(shared, 4, kept | grows * 2)[of]
        shared_sums.append((some[shared], total[shared], different[shared], nlogn[shared], nq[shared]))
    schema = [x.split()[0] for x in REPLY.split(", ")]
    nothing = {f: pa.nulls(1, t) for f, t in (("context", pa.int64()), ("total", pa.int64()), ("different", pa.int64()), ("nlogn", pa.float64()), ("nq", pa.float64()), ("asked", pa.list_(pa.int64())))}
    for (s, h, a), end in zip(asked, ends):
        own = slice(end - a["rows"], end)
        if one:
            at = np.zeros(len(a["context"]), np.int64)
            at[a["ci"]] = np.arange(own.start, end)
            reply = pack(n=small(counts[own]), total=small(all_total[at]), flag=all_flag[at])
        else:
            reply = pack(n=small(counts[own]), total=small(all_total[own]), flag=all_flag[own])
        yield batch(schema, slice=pa.array([s]), shard=pa.array([h], pa.int32()), payload=pa.array([reply], pa.binary()), **nothing)
    for context, total_, different_, nlogn_, nq_ in zip(*[np.concatenate(y) for y in zip(*shared_sums)]):
        who = [s for s, _, a in asked if (a["context"] == context).any()]
        yield batch(schema, slice=pa.nulls(1, pa.int64()), shard=pa.nulls(1, pa.int32()), payload=pa.nulls(1, pa.binary()), context=pa.array([int(context.view(np.int64))]), total=pa.array([int(total_)]), different=pa.array([int(different_)]), nlogn=pa.array([float(nlogn_)]), nq=pa.array([float(nq_)]), asked=pa.array([who], pa.list_(pa.int64())))
    release()


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth 0: replies with the corpus's counts of words and numbers for them, the frequent first, and a row with their number and sum."""
    asked = [(s, h, unpack(p)) for b in batches for s, h, p in zip(*[b.column(c).to_pylist() for c in ("slice", "shard", "payload")])]
    if not asked:
        return
    words, inv = np.unique(np.concatenate([np.cumsum(a["word"], dtype=np.uint64) for _, _, a in asked]), return_inverse=True)
    n = np.bincount(inv, np.concatenate([a["n"].astype(np.int64) for _, _, a in asked])).astype(np.int64)
    schema = [x.split()[0] for x in REPLY.split(", ")]
    rest = {"context": pa.nulls(1, pa.int64()), "nlogn": pa.nulls(1, pa.float64()), "nq": pa.nulls(1, pa.float64()), "asked": pa.nulls(1, pa.list_(pa.int64()))}
    number = np.empty(len(n), np.int64)
    number[np.lexsort((words, -n))] = np.arange(len(n))
    at = 0
    for s, h, a in asked:
        i = inv[at : at + len(a["word"])]
        reply = pack(n=small(n[i]), number=small(number[i]))
        at += len(a["word"])
        yield batch(schema, slice=pa.array([s]), shard=pa.array([h], pa.int32()), payload=pa.array([reply], pa.binary()), total=pa.nulls(1, pa.int64()), different=pa.nulls(1, pa.int64()), **rest)
    ok = (words != BEGIN) & (n > 0)
    yield batch(schema, slice=pa.nulls(1, pa.int64()), shard=pa.nulls(1, pa.int32()), payload=pa.nulls(1, pa.binary()), total=pa.array([int(n[ok].sum())]), different=pa.array([int(ok.sum())]), **rest)
    release()


def round_of(rounds: int) -> Column:
    """The round of a slice; what one of fewer rounds has, if they divide these, is whole rounds of these."""
    return F.pmod(F.xxhash64("slice"), F.lit(rounds)).cast("int")


def score_corpus(docs: DataFrame, *, train_on: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", chars: int = CHARS, spread: int = SPREAD) -> DataFrame:
    """(doc_id, n_symbols, log_prob, perplexity), one row for each row of `docs`, under the tree of all texts of `train_on` (default: `docs`).

    Words, depth and the number of contexts have no bound: a context is kept if it occurs MIN_COUNT times and its next words
    diverge from those of its longest kept suffix, by a test with a degree of freedom less than it has different next words.
    Its P(next) = (n + PRIOR q) / (N + PRIOR), q being the suffix's; at depth 0, (n + 0.5) / (sum + 0.5 (words + 1)).

    log_prob is the sum of ln P(token | longest kept suffix before it), the text's end included, so an empty text has one
    symbol; perplexity is exp(-log_prob / n_symbols).  Null texts have nulls.  Repeated rows count each, and score alike.
    Ids may be null or repeated, other columns are ignored.  An empty table gives no rows; with an empty `train_on` all words
    are unknown.

    The tree is never in one place.  Texts are cut into slices; for each depth (or block of depths, beyond SINGLE) slices send
    what follows what in them to the shards of a hash of the context, shards count, test and smooth, and answer the slices that
    asked.  So memory is that of a slice or shard, at any size of corpus.  A context that occurs over `spread` times is shared by
    several shards, and their sums decide.  Words are counted, and slices get their answers, in rounds, after each of which
    what it no longer needs is deleted.
    """
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    scratch, columns = Scratch(spark, "tree"), f"slice long, ids array<{kind}>, n array<long>, counted boolean, out boolean, live long, state binary"
    names = [c.split()[0] for c in columns.split(", ")]

    def tokenise(batches):
        task, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            for part in cut(b, 1, chars):
                n, words, x = Slice.of(part.column(1))
                one = lambda a, t: pa.array([a], t)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield batch(names, slice=one(task << 24 | seq, pa.int64()), ids=ids, n=one(n, pa.list_(pa.int64())), counted=part.column(2).slice(0, 1), out=part.column(3).slice(0, 1), live=one(len(x), pa.int64()), state=one(pack(words=np.diff(words, prepend=np.uint64(0)), x=small(x)), pa.binary()))
                seq += 1
        release()

    used = lambda d, counted, out: d.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.lit(counted).alias("counted"), F.lit(out).alias("out"))
    if train_on is None:
        state = used(docs, True, True).mapInArrow(tokenise, columns)
    else:
        # ids of the other table are of no use here
        other = used(train_on.withColumn(doc_id, F.lit(None).cast(kind)), True, False)
        state = used(docs, False, True).mapInArrow(tokenise, columns).unionByName(other.mapInArrow(tokenise, columns).withColumn("slice", -1 - F.col("slice")))
    state, path = state.withColumn("part", round_of(ROUNDS)), scratch.path()
    scratch.write(state, path, "part")
    state = scratch.read(path, state.schema)
    slices, size = state.agg(F.count("*"), F.coalesce(F.sum("live"), F.lit(0))).first()
    least = spark.sparkContext.defaultParallelism
    # a slice has far fewer different words than words
    shards, homes, parts = max(least, math.ceil(size / WORDS)), max(2 * least, math.ceil(size / WORDS / 4)), max(1, slices)

    def rounds() -> int:
        """As many as leave each of them enough tasks."""
        return min(ROUNDS, 1 << max(0, (parts // least).bit_length() - 1))

    def exchange(ask, answer, n: int, times: int = 1) -> DataFrame:
        """The answers; ask(batches, i) is to ask, in round i, the shards that are i modulo the number of rounds."""
        path = scratch.path()
        for i in range(times):
            shard = F.floor(F.col("shard") / times).cast("int")
            out = state.mapInArrow(lambda batches, i=i: ask(batches, i), "slice long, shard int, payload binary").repartitionById(math.ceil(n / times), shard).mapInArrow(answer, REPLY)
            scratch.write(out, f"{path}/part={i}")
            del out  # else its shuffle files stay
            tidy(spark)
        return scratch.read(path, f"{REPLY}, part int")

    def rows(batches):
        for b in batches:
            yield from b.to_pylist()
        release()

    def message(slice_: int, shard: int, payload: bytes) -> pa.RecordBatch:
        return batch(["slice", "shard", "payload"], slice=pa.array([slice_]), shard=pa.array([shard], pa.int32()), payload=pa.array([payload], pa.binary()))

    def replied(replies: DataFrame, shared: DataFrame | None, apply, first=lambda df: df) -> DataFrame:
        """Slices after `first`, and `apply` to each and what it was sent, (shard, payload) and what was decided on shared contexts.

        A round's slices are deleted as soon as the new ones are written.
        """
        known = "array<struct<context:bigint,total:bigint,kept:int>>"
        blank = lambda df, *missing: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in missing])
        fields = [(c, state.schema[c].dataType) for c in names] + [("shard", "int"), ("payload", "binary"), ("known", known)]
        times, path = rounds(), scratch.path()

        def run(batches):
            of: dict[int, list] = {}
            for r in rows(batches):
                mine = of.setdefault(r["slice"], [None, {}, []])
                if r["state"] is not None:
                    mine[0] = r
                elif r["payload"] is not None:
                    mine[1][r["shard"]] = r["payload"]
                else:
                    mine[2] = r["known"]
            while of:
                _, (r, payloads, known_) = of.popitem()
                r["state"], r["live"] = apply(r, payloads, known_)
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in names}], schema=to_arrow)

        for i in range(times):
            all_ = blank(first(state.where(F.col("part") % times == i)), *fields)
            for sent in (replies.where("slice is not null").select("slice", "shard", "payload"), shared):
                if sent is not None:
                    all_ = all_.unionByName(blank(sent.where(round_of(times) == i), *fields))
            scratch.write(all_.repartition(math.ceil(parts / times), "slice").mapInArrow(run, columns), f"{path}/part={i}")
            for part in range(i, ROUNDS, times):
                scratch.drop_part(state, f"part={part}")
            del all_
            tidy(spark)
        scratch.drop(state, replies, *([] if shared is None else [shared]))
        return scratch.read(path, f"{columns}, part int")

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_ids = pa.list_(to_arrow_type(docs.schema[doc_id].dataType))
    to_arrow = pa.schema([("slice", pa.int64()), ("ids", arrow_ids), ("n", pa.list_(pa.int64())), ("counted", pa.bool_()), ("out", pa.bool_()), ("live", pa.int64()), ("state", pa.binary())])
    home = lambda words: (mix(words) % np.uint64(homes)).astype(np.int64)

    times = math.ceil(rounds() / 2)  # each reads all slices

    def ask_words(batches, i):
        for r in rows(batches):
            a, n = unpack(r["state"]), np.array(r["n"], np.int64)
            words, x, first = np.cumsum(a["words"], dtype=np.uint64), a["x"], (np.cumsum(n) - n)[n > 0]
            count = np.bincount(x, minlength=len(words)) * r["counted"]
            assert (words[x[first]] == BEGIN).all()
            for h, at in enumerate(grouped(home(words), homes)):
                if h % times == i and len(at):
                    yield message(r["slice"], h, pack(word=np.diff(words[at], prepend=np.uint64(0)), n=small(count[at])))

    counted = exchange(ask_words, tally, homes, times)
    different, total = counted.where("slice is null").agg(F.coalesce(F.sum("different"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    norm = float(total + 0.5 * (different + 1))  # one more for what was never seen

    def strip(batches):
        for r in rows(batches):
            a = unpack(r["state"])
            # the order of the hashes and their shards are all that the answers need
            r["state"] = pack(home=small(home(np.cumsum(a["words"], dtype=np.uint64))), x=a["x"])
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in names}], schema=to_arrow)

    def begin(r, payloads, _):
        a = unpack(r["state"])
        shard = a["home"].astype(np.int64)
        counts, numbers, of = np.zeros(len(shard), np.int64), np.zeros(len(shard), np.int64), grouped(shard, homes)
        for h, p in payloads.items():
            got = unpack(p)
            counts[of[h]], numbers[of[h]] = got["n"], got["number"].astype(np.int64) * homes + h
        order = np.argsort(numbers)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return pack(words=small(np.diff(numbers[order], prepend=0)), x=small(back[a["x"]]), counts=small(counts[order]), norm=np.array([norm])), max(1, len(a["x"]))

    state = replied(counted, None, begin, lambda df: df.mapInArrow(strip, columns))
    d0, d1 = 0, 1
    live = size
    while live:

        # as many tasks as what is still open asks for
        some = min(shards, max(least, math.ceil(2 * live * (d1 - d0) / WORDS)))

        def ask(batches, _, d0=d0, d1=d1, some=some):
            for r in rows(batches):
                if r["live"]:
                    for h, a in Slice.load(r["n"], r["state"], spread).requests(d0, d1, some):
                        if not r["counted"]:
                            a["n"] = np.zeros_like(a["n"])
                        yield message(r["slice"], h, pack(**a))

        def apply(r, payloads, known, d0=d0, d1=d1, some=some):
            if not r["live"]:
                return r["state"], 0
            s = Slice.load(r["n"], r["state"], spread)
            s.apply(d0, d1, some, payloads, known, spread)
            return s.save(d1), len(s.live)

        replies = exchange(ask, lambda batches, d0=d0, d1=d1: settle(batches, d0, d1, norm), some)
        shared = replies.where("slice is null")
        decided = None
        if shared.limit(1).count():
            sums = shared.groupBy("context").agg(*[F.sum(c).alias(c) for c in ("total", "different", "nlogn", "nq")])
            sums = sums.select("context", "total", diverges(*[F.col(c) for c in ("total", "different", "nlogn", "nq")]).cast("int").alias("kept"))
            asking = shared.select("context", F.explode("asked").alias("slice")).distinct()
            decided = scratch.save(asking.join(sums, "context").groupBy("slice").agg(F.collect_list(F.struct("context", "total", "kept")).alias("known")))
        state = replied(replies, decided, apply)
        live, n_bytes = state.agg(F.sum("live"), F.sum(F.octet_length("state"))).first()
        parts = min(parts, max(least, math.ceil(n_bytes / STATE)))
        d0, d1 = d1, d1 + 1 if d1 < SINGLE else d1 + max(1, min(3 * d1, size // (2 * max(1, live))))

    def scores(batches):
        for r in rows(batches):
            n, total = np.maximum(np.array(r["n"], np.int64) - 1, 0), unpack(r["state"])["done"]
            missing = n == 0
            yield pa.RecordBatch.from_arrays([pa.array(r["ids"], arrow_ids.value_type), pa.array(n, mask=missing), pa.array(total, mask=missing), pa.array(np.exp(-total / np.maximum(n, 1)), mask=missing)], names=["doc_id", "n_symbols", "log_prob", "perplexity"])

    return state.where("out").mapInArrow(scores, f"doc_id {kind}, n_symbols long, log_prob double, perplexity double")
