"""Byte-level BPE with a hierarchical-bitmap queue of merge ranks."""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, worker_store

#: Where the vocabulary is; a rank file of lines "base64-token rank".
VOCABULARY = os.environ.get("TESSERA_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that are encoded at once, which bounds what a slice adds to what is remembered; a longer text is not cut.
CHARS = 1_000_000
#: Pre-tokens up to this many characters are remembered, in two generations of this many each.
REMEMBER_CHARS, REMEMBER = 48, 400_000
#: A space with white space behind it, as str.isspace() has it.
BLANKS = r" [\t-\r\x1c-\x20\x{85}\pZ]"
#: Ids of what isn't a token: the end of a pre-token, and a position merged into the one before it.
SEPARATOR, GONE = 1 << 30, -1


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets per merge rank, found through a bitmap of three levels of 64-bit words.

    A set bit of a level says that the word below it isn't zero, so the lowest
    rank with a bucket takes three find-first-sets, whatever the text's length.
    """

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0
        self.buckets: list[list[int] | None] = [None] * ranks

    def push(self, rank: int, pos: int) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            self.buckets[rank] = [pos]
            w = rank >> 6
            if not self.low[w]:
                m = w >> 6
                if not self.mid[m]:
                    self.top |= 1 << m
                self.mid[m] |= 1 << (w & 63)
            self.low[w] |= 1 << (rank & 63)
        else:
            bucket.append(pos)

    def put(self, rank: int, positions: list[int]) -> None:
        """Queues several positions at once."""
        self.push(rank, positions[0])
        self.buckets[rank].extend(positions[1:])

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions; the queue must not be empty."""
        m = (self.top & -self.top).bit_length() - 1
        mid = self.mid[m]
        w = (m << 6) + (mid & -mid).bit_length() - 1
        low = self.low[w]
        bit = low & -low
        rank = (w << 6) + bit.bit_length() - 1
        self.low[w] = low = low ^ bit
        if not low:
            self.mid[m] = mid = mid ^ (1 << (w & 63))
            if not mid:
                self.top ^= 1 << m
        bucket, self.buckets[rank] = self.buckets[rank], None
        return rank, bucket


class Memory:
    """What was met lately: two generations, of which the older is forgotten when the newer is full."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def has(self, key: str) -> bool:
        if key in self.new:
            return True
        got = self.old.get(key)
        if got is None:
            return False
        self.new[key] = got
        return True

    def turn(self) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.byte_pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], dtype=np.int64)
        # left id << 32 | right id -> rank: what merging two neighbours gives, learnt as pairs are met.
        self.pairs: dict[int, int] = {}
        self.queue = RankQueue(len(self.tokens))
        self.find = regex.compile(pattern).findall
        self.split = regex.compile(r" (?=\S)").split
        self.blanks = re.compile(r" \s").search
        self.plain = pattern == PATTERN
        self.words, self.pieces, self.table = Memory(REMEMBER), Memory(REMEMBER // 2), None

    def pair(self, a: int, b: int) -> int:
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        r = self.pairs[a << 32 | b] = -1 if a == SEPARATOR or b == SEPARATOR else self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return r

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as int32 bytes: always its lowest rank next, leftmost first.

        All of them lie in one linked list, with a separator after each that no
        merge crosses, and share one queue: a rank is found once for all
        positions that wait for it, however many or long the pre-tokens are.
        """
        raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64)
        last = np.cumsum([len(p) + 1 for p in pieces]) - 1
        first = self.byte_id[raw]
        first[last] = SEPARATOR
        start = np.full(len(raw), -1, dtype=np.int64)
        start[:-1] = self.byte_pairs[raw[:-1] << 8 | raw[1:]]
        start[last] = -1
        start[last[last > 0] - 1] = -1
        order = np.argsort(start, kind="stable")
        order = order[start[order] >= 0]
        q, push, pairs, pair = self.queue, self.queue.push, self.pairs.get, self.pair
        heads = np.flatnonzero(np.diff(start[order], prepend=-1))
        for r, at in zip(start[order[heads]].tolist(), np.split(order, heads[1:]) if len(heads) else []):
            q.put(r, at.tolist())
        # due: the rank at which a position's pair is queued; a queued entry of another rank is stale
        n, ids, due = len(raw), first.tolist(), start.tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        while q.top:
            rank, at = q.pop()
            if len(at) > 1:
                at.sort()
            for done, i in enumerate(at, 1):
                if due[i] != rank:
                    continue
                j = nxt[i]
                k = nxt[j]  # a separator at the latest
                ids[i], ids[j] = rank, GONE
                nxt[i], prv[k] = k, i
                due[j] = -1
                c = rank << 32 | ids[k]
                r = pairs(c)
                if r is None:
                    r = pair(rank, ids[k])
                due[i] = lower = r
                if r >= 0:
                    push(r, i)
                h = prv[i]
                if h >= 0:
                    c = ids[h] << 32 | rank
                    r2 = pairs(c)
                    if r2 is None:
                        r2 = pair(ids[h], rank)
                    due[h] = r2
                    if r2 >= 0:
                        push(r2, h)
                        if r2 < rank:
                            lower = r2
                if 0 <= lower < rank and done < len(at):
                    q.put(rank, at[done:])  # a lower rank has come up: it goes first
                    break
        out = np.array(ids, dtype=np.int64)
        kept = out != GONE
        ends = np.cumsum(kept)[last]
        flat = out[kept].astype(np.int32).tobytes()
        return [flat[4 * a : 4 * b - 4] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def learn(self, words: set[str]) -> None:
        """Puts the ids of the words, which begin and end between pre-tokens, into memory."""
        find, has = self.find, self.pieces.has
        # letters of ASCII are one pre-token, with or without a space before them
        found = {w: [w] if self.plain and w.isascii() and w[w[:1] == " " :].isalpha() else find(w) for w in words}
        fresh = {p: p.encode("utf-8", "surrogatepass") for f in found.values() for p in f if not has(p)}
        ranks = self.ranks
        known = {p: ranks[b].to_bytes(4, "little") for p, b in fresh.items() if b in ranks}
        if len(known) < len(fresh):
            rest = {p: b for p, b in fresh.items() if p not in known}
            known.update(zip(rest, self.merge(list(rest.values()))))
        get = self.pieces.new.get
        for w, f in found.items():
            self.words.new[w] = b"".join([known.get(p) or get(p) for p in f])
        for p, ids in known.items():
            if len(p) <= REMEMBER_CHARS:
                self.pieces.new[p] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as int32 bytes.

        A pre-token can't extend over a space that has a non-space behind it,
        except that it may begin there; so texts split at such spaces, and
        each different part is encoded once for as long as it is remembered.
        """
        parts = []
        for t in texts:
            p = self.split(t) if self.blanks(t) else t.split(" ")
            parts.append([p[0], *map(" ".__add__, p[1:])])
        new = {w for p in parts for w in p}
        self.learn({w for w in new if not self.words.has(w)})
        get = self.words.new.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        for w in new:
            if len(w) > REMEMBER_CHARS:
                del self.words.new[w]
        self.words.turn()
        self.pieces.turn()
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each has); there are no nulls.  As encode(), with each different part looked up once."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        odd = np.asarray(pa.compute.match_substring_regex(texts, BLANKS))
        if odd.any():
            # a space before white space: those texts go one by one
            coded = self.encode(texts.filter(pa.array(odd)).to_pylist())
            flat, n = self.encode_column(texts.filter(pa.array(~odd)))
            ends = np.cumsum(n)
            regular, of, parts, total = iter(zip(ends - n, ends)), iter(coded), [], np.zeros(len(texts), np.int64)
            for i, x in enumerate(odd):
                part = np.frombuffer(next(of), np.int32) if x else flat[slice(*next(regular))]
                total[i] = len(part)
                parts.append(part)
            return np.concatenate(parts), total
        lists = pa.compute.split_pattern(texts, " ")
        starts, flat = np.asarray(lists.offsets), lists.flatten().dictionary_encode()
        key = np.asarray(flat.indices).astype(np.int64) * 2 + 1
        key[starts[:-1]] -= 1  # all but a text's first part begin with the space before them
        seen = np.zeros(2 * len(flat.dictionary), bool)
        seen[key] = True
        words = flat.dictionary.to_pylist()
        parts = [" " + words[k >> 1] if k & 1 else words[k >> 1] for k in np.flatnonzero(seen).tolist()]
        self.learn({w for w in parts if not self.words.has(w)})
        ids = pa.array(map(self.words.new.__getitem__, parts), pa.large_binary())
        for w in parts:
            if len(w) > REMEMBER_CHARS:
                del self.words.new[w]
        self.words.turn()
        self.pieces.turn()
        out = ids.take(pa.array((np.cumsum(seen) - 1)[key]))
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.asarray(pa.compute.binary_length(out)) // 4)])
        return np.frombuffer(joined(out), np.int32), np.diff(ends[starts])

    def decode_column(self, flat: np.ndarray, n: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all texts end to end, how many each has)."""
        if self.table is None:
            self.table = pa.array(self.tokens, pa.large_binary())
        out = self.table.take(pa.array(flat))
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.asarray(pa.compute.binary_length(out)))])
        return joined(out), np.diff(ends[np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def joined(values: pa.Array) -> memoryview | bytes:
    """The bytes of large binary or string values, end to end."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return memoryview(data)[at[0] : at[-1]] if data is not None and len(values) else b""


def codec(path: str = VOCABULARY, pattern: str = PATTERN) -> Codec:
    store = worker_store("bpe")
    if (path, pattern) not in store:
        store[path, pattern] = Codec(read_ranks(path), pattern)
    return store[path, pattern]


def encode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, token_ids, n_tokens, n_bytes, round_trip), one row for each row of `docs`.

    Whole texts are encoded and decoded again; round_trip says that the bytes
    came back.  An empty text has no tokens and comes back.  A null text has
    null in all columns but doc_id.  Null, equal or clashing ids pass through.
    `vocabulary` is a rank file that every worker can read; the merges are
    those of its ranks, ties leftmost first.  Nothing is shuffled.  An empty
    table gives no rows; extra columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        c = codec(vocabulary, pattern)
        for part in (p for b in batches for p in cut(b, 1, CHARS)):
            has = np.asarray(part.column(1).is_valid())
            texts = part.column(1).drop_null()
            flat, some = c.encode_column(texts)
            back, sizes = c.decode_column(flat, some)
            size, raw = np.asarray(pa.compute.binary_length(texts)).astype(np.int64), joined(texts.cast(pa.large_string()))
            same = sizes == size
            if not same.all() or bytes(back) != bytes(raw):
                a, b = np.cumsum(sizes), np.cumsum(size)
                same = np.array([back[x - n : x] == raw[y - m : y] for x, n, y, m in zip(a, sizes, b, size)], bool)
            n, n_bytes, ok = np.zeros(len(has), np.int64), np.zeros(len(has), np.int64), np.zeros(len(has), bool)
            n[has], n_bytes[has], ok[has] = some, size, same
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n.cumsum()]).astype(np.int32)), pa.array(flat), mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(n.astype(np.int32), mask=~has), pa.array(n_bytes, mask=~has), pa.array(ok, mask=~has)], names=["doc_id", "token_ids", "n_tokens", "n_bytes", "round_trip"])
        release()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, token_ids array<int>, n_tokens int, n_bytes long, round_trip boolean")


def decode(encoded: DataFrame, *, doc_id: str = "doc_id", ids: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from token ids.

    Null ids give a null text, an empty list an empty one.  Bytes that aren't
    UTF-8 (ids that don't come from whole texts) become U+FFFD; an id outside
    the vocabulary, or null, is an error.
    """
    kind = encoded.schema[doc_id].dataType.simpleString()

    def run(batches):
        c = codec(vocabulary)
        for b in batches:
            texts = [None if x is None else c.decode(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
