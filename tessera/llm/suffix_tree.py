"""LM scoring by a probabilistic suffix tree over characters."""

from __future__ import annotations

import unicodedata
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, worker_store

#: Symbols, and the longest context.  Tables of contexts are bounded by these, not by the corpus.
SYMBOLS, DEPTH = 32, 4
#: A context is kept if it occurs this often and its next symbols diverge from those of its
#: longest kept suffix: G2 = 2 N KL beyond the 0.1 % point of chi-square with 31 degrees of
#: freedom, and KL (nats a symbol) at least this.
MIN_COUNT, MIN_G2, MIN_KL = 50, 61.1, 0.002
#: Weight, in counts, of the suffix's distribution in a context's own.
PRIOR = 10.0


def _alphabet() -> np.ndarray:
    """Code point -> symbol: 0 a text's ends, 1-26 letters without accents, 27 white space, 28 digits, 29 sentence ends, 30 other marks, 31 other letters."""
    t = np.zeros(0x3000, np.uint8)
    for c in range(len(t)):
        x = chr(c)
        base = unicodedata.normalize("NFD", x.lower())[:1]
        base = "s" if x == "ß" else base
        if "a" <= base <= "z":
            t[c] = ord(base) - 96
        elif x.isspace():
            t[c] = 27
        elif x.isdigit():
            t[c] = 28
        elif x in ".!?":
            t[c] = 29
        else:
            t[c] = 31 if x.isalpha() else 30
    return t


class Coder:
    """Texts -> codes of (context of DEPTH symbols, next symbol), five bits each; a text ends with symbol 0."""

    def __init__(self):
        self.table = _alphabet()

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all texts in turn, their number by text)."""
        pad = "\0" * DEPTH
        raw = np.frombuffer("".join([pad + t + "\0" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.table[np.minimum(raw, len(self.table) - 1)].astype(np.int32)
        n = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        first = np.cumsum(n + DEPTH) - n - DEPTH
        for i in range(DEPTH):
            sym[first + i] = 0
        sym[first + n + DEPTH - 1] = 0
        code = sym[DEPTH:].copy() if len(sym) else sym
        for back in range(1, DEPTH + 1):
            code |= sym[DEPTH - back : len(sym) - back] << (5 * back)
        # a text's first DEPTH places are its pad: no symbol to score
        keep = np.ones(len(code), bool)
        for i in range(DEPTH):
            at = first[1:] + i - DEPTH
            keep[at] = False
        return code[keep], n


@dataclass
class Tree:
    """log P of the next symbol for contexts of DEPTH - 1 or less, resolved, and the kept contexts of DEPTH."""

    short: np.ndarray  # float32 [SYMBOLS ** DEPTH], by code
    contexts: np.ndarray  # int32, kept contexts of DEPTH
    totals: np.ndarray  # their counts
    codes: np.ndarray  # int32, observed codes in them
    logs: np.ndarray  # float32, their log P
    kept: dict[int, int] = field(default_factory=dict)  # depth -> contexts
    key: str = ""

    def table(self) -> np.ndarray:
        """log P by code: the longest kept suffix of the context decides."""
        store = worker_store("pst")
        if store.get("key") != self.key:
            t = np.tile(self.short, SYMBOLS).reshape(-1, SYMBOLS)
            t[self.contexts] += np.log(PRIOR / (self.totals + PRIOR))[:, None].astype(np.float32)
            t = t.ravel()
            t[self.codes] = self.logs
            store.clear()
            store.update(key=self.key, table=t)
        return store["table"]


def build(codes: np.ndarray, counts: np.ndarray) -> Tree:
    """A tree from the counts of codes."""
    codes, counts = codes.astype(np.int64), counts.astype(np.float64)
    base = np.bincount(codes % SYMBOLS, counts, SYMBOLS)
    p = (base + 0.5) / (base.sum() + 0.5 * SYMBOLS)
    resolved = p[None, :]  # P by context of depth d, each from its longest kept suffix
    kept = {0: 1}
    for d in range(1, DEPTH):
        n = np.bincount(codes % SYMBOLS ** (d + 1), counts, SYMBOLS ** (d + 1)).reshape(-1, SYMBOLS)
        parent = np.tile(resolved, (SYMBOLS, 1))
        total = n.sum(axis=1)
        ok = keep(n, parent, total)
        own = (n[ok] + PRIOR * parent[ok]) / (total[ok] + PRIOR)[:, None]
        resolved = parent
        resolved[ok] = own
        kept[d] = int(ok.sum())
    # the deepest level only where it was observed
    context, at = np.unique(codes // SYMBOLS, return_inverse=True)
    total = np.bincount(at, counts, len(context))
    parent = resolved.ravel()[codes % SYMBOLS**DEPTH]
    g2 = 2 * np.bincount(at, counts * np.log(counts / total[at] / parent), len(context))
    ok = (total >= MIN_COUNT) & (g2 >= MIN_G2) & (g2 >= 2 * total * MIN_KL)
    kept[DEPTH] = int(ok.sum())
    mine = ok[at]
    logs = np.log((counts[mine] + PRIOR * parent[mine]) / (total[at[mine]] + PRIOR)).astype(np.float32)
    return Tree(np.log(resolved).astype(np.float32).ravel(), context[ok].astype(np.int32), total[ok], codes[mine].astype(np.int32), logs, kept, uuid.uuid4().hex)


def keep(n: np.ndarray, parent: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The divergence test, by context."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * np.where(n > 0, n * np.log(n / np.maximum(total, 1)[:, None] / parent), 0).sum(axis=1)
    return (total >= MIN_COUNT) & (g2 >= MIN_G2) & (g2 >= 2 * total * MIN_KL)


def code_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n): how often each context of DEPTH and next symbol occurs, over all texts whole."""

    def count(batches):
        coder, codes, counts = Coder(), np.zeros(0, np.int32), np.zeros(0, np.int64)
        for _, texts in chunks(batches, 0):
            got, _ = coder.codes([t for t in texts if t is not None])
            got.sort()
            at = np.flatnonzero(np.diff(got, prepend=-1))
            both, n = np.concatenate([codes, got[at]]), np.concatenate([counts, np.diff(at, append=len(got))])
            order = np.argsort(both, kind="stable")
            both, n = both[order], n[order]
            at = np.flatnonzero(np.diff(both, prepend=-1))
            codes, counts = both[at], np.add.reduceat(n, at) if len(at) else n
        for i in range(0, len(codes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + 100_000]), pa.array(counts[i : i + 100_000])], names=["code", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, *, text: str = "text") -> Tree:
    """A tree from all texts.  What reaches the driver is one row a code that occurs: 32^5 at most, whatever the corpus."""
    t = code_counts(docs, text).toPandas()
    return build(t["code"].to_numpy(np.int64), t["n"].to_numpy(np.int64))


def score(docs: DataFrame, tree: Tree, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_symbols, log_prob, perplexity), one row for each row of `docs`.

    log_prob is the sum of ln P(symbol | longest kept suffix before it), the
    text's end included, so an empty text has one symbol; perplexity is
    exp(-log_prob / n_symbols).  Null texts have nulls.  Repeated rows score
    alike.  The tree goes to all workers; its size is bounded by the alphabet.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        coder, table = Coder(), sent.value.table()
        for part, texts in chunks(batches, 1):
            some = [i for i, t in enumerate(texts) if t is not None]
            n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if some:
                codes, each = coder.codes([texts[i] for i in some])
                n[some] = each
                total[some] = np.add.reduceat(table[codes], np.cumsum(each) - each, dtype=np.float64)
            missing = n == 0
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, mask=missing), pa.array(total, mask=missing), pa.array(np.exp(-total / np.maximum(n, 1)), mask=missing)], names=["doc_id", "n_symbols", "log_prob", "perplexity"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_symbols long, log_prob double, perplexity double")


def score_corpus(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's score under the tree that all texts together give."""
    return score(docs, train(docs, text=text), doc_id=doc_id, text=text)
