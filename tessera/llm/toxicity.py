"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Labelled documents taken for training, of each class, in the order of a hash of their ids.
TRAIN_PER_CLASS = 4000
#: Least likelihood ratio G2 and least log-odds for a token, or else its prefix, to count by itself.
MIN_G2, MIN_LOG_ODDS = 20.0, 2.5
#: Weight of the word-level Dirichlet prior against a class's tokens, and pseudo-count of a prefix.
PRIOR_SHARE, PREFIX_PRIOR = 0.1, 0.5
PREFIX = 4
#: Weight, in texts with a hit, of the theory's lambda = 1 in the calibration.
LAMBDA_PRIOR = 10.0
#: A document is rejected, and a passage reported, at most at this p-value.
ALPHA = 0.001

WORDS = re.compile(r"\w+").findall


@dataclass(frozen=True)
class Model:
    """Scores (natural log-odds, toxic over clean) of words and prefixes; all else scores `other`; K and lambda calibrate."""

    words: dict[str, float]
    prefixes: dict[str, float]
    other: float
    k: float
    rate: float = 1.0


def fit(counts: list[tuple[str, float, float]]) -> Model:
    """From (word, toxic texts that have it, clean texts that have it).

    A text counts a word once, so a text that repeats itself weighs no more.

    A class's word distribution has a Dirichlet prior with the mean
    P(prefix | class) P(word | prefix), so a word that training never saw has
    the odds of its prefix, whose own distribution has a uniform Dirichlet
    prior.  Only words or prefixes with strong evidence keep their score.  The
    rest is pooled in one class, so that a language or a topic that toxic texts
    happen to favour doesn't add up over a long text.
    """
    if not counts:
        return Model({}, {}, -1.0, 1.0)
    words = [w for w, _, _ in counts]
    t, c = np.array([x for _, x, _ in counts], float), np.array([x for _, _, x in counts], float)
    nt, nc = t.sum(), c.sum()
    if not nt or not nc:
        return Model({}, {}, -1.0, 1.0)
    names, at = np.unique(np.array([w[:PREFIX] for w in words]), return_inverse=True)
    pt, pc = np.bincount(at, t), np.bincount(at, c)
    v = len(names)
    ft, fc = (pt + PREFIX_PRIOR) / (nt + PREFIX_PRIOR * v), (pc + PREFIX_PRIOR) / (nc + PREFIX_PRIOR * v)
    given = (t + c) / (pt + pc)[at]
    at_, ac = PRIOR_SHARE * nt, PRIOR_SHARE * nc
    qt, qc = (t + at_ * ft[at] * given) / (nt + at_), (c + ac * fc[at] * given) / (nc + ac)

    def g2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = (a + b) / (nt + nc)
        return 2 * sum(np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / (n * p)), 0) for x, n in ((a, nt), (b, nc)))

    ws, ps = np.log(qt / qc), np.log(ft / fc)
    prefix_ok = (g2(pt, pc) >= MIN_G2) & (ps >= MIN_LOG_ODDS)
    word_ok = (g2(t, c) >= MIN_G2) & (ws >= MIN_LOG_ODDS)
    # the odds of all that is pooled
    single = word_ok | prefix_ok[at]
    qo, po = 1 - (qt[single].sum()), 1 - (qc[single].sum())
    other = min(-1e-4, math.log(max(qo, 1e-9) / max(po, 1e-9)))
    return Model({words[i]: float(ws[i]) for i in np.flatnonzero(word_ok)}, {str(names[i]): float(ps[i]) for i in np.flatnonzero(prefix_ok)}, other, 1.0)


def token_scores(text: str, model: Model) -> tuple[int, list[tuple[int, float]]]:
    """(number of tokens, (position, score) of the tokens that don't score `other`)."""
    words = WORDS(text.lower())
    own, prefixes, hits = model.words, model.prefixes, []
    for i, w in enumerate(words):
        if w in own:
            hits.append((i, own[w]))
        elif w[:PREFIX] in prefixes:
            hits.append((i, prefixes[w[:PREFIX]]))
    return len(words), hits


def segments(scores) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) in linear time (Ruzzo and Tompa, 1999).

    `scores` are (start, end, score) of runs in order; a run is taken whole.
    Ties: a segment isn't extended by parts that add nothing.
    """
    # (start, end, sum before, sum after, candidate before it with a lower sum before)
    stack: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for start, end, s in scores:
        if s <= 0:
            total += s
            continue
        before, total = total, total + s
        a, left, b = start, before, end
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((a, b, left, total, j))
                break
            a, left, parent = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = parent
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def runs(n: int, hits: list[tuple[int, float]], other: float):
    """The text as runs: each hit, and each stretch between hits at `other` a token."""
    at = 0
    for i, s in hits:
        if i > at:
            yield at, i, (i - at) * other
        yield i, i + 1, s
        at = i + 1
    if n > at:
        yield at, n, (n - at) * other


def calibrate(model: Model, best: list[tuple[int, float]]) -> Model:
    """K and lambda from clean texts: (tokens, best segment's score, 0 if there is none).

    By maximum likelihood of P(best <= s) = exp(-K n e^(-lambda s)); a best
    score below the least that counts is known only to be below.  Lambda has a
    Gamma prior about 1, its value for exact log-odds, and K a text with a hit
    more than was seen, so that few hits don't make p-values too small.
    """
    if not (model.words or model.prefixes) or not any(n for n, _ in best):
        return model
    n, s = np.array([(n, s) for n, s in best if n > 0], float).T
    hit, m = s >= MIN_LOG_ODDS, np.maximum(s, MIN_LOG_ODDS)
    r = hit.sum()
    rates = np.linspace(0.2, 2, 181)
    mass = np.array([(n * np.exp(-x * m)).sum() for x in rates])
    fit = (r + LAMBDA_PRIOR) * np.log(rates) - rates * (s[hit].sum() + LAMBDA_PRIOR) - (r + 1) * np.log(mass)
    at = int(fit.argmax())
    return replace(model, k=min(1.0, float((r + 1) / mass[at])), rate=float(rates[at]))


@functools.cache
def sum_tail(r: int) -> tuple[np.ndarray, np.ndarray]:
    """(t, ln P(T >= t)) for the sum T of the r best scores, each less its rate, of a clean text.

    Those are -ln of the first r arrivals of a Poisson process of rate 1.  Given the r-th, g, the others are uniform below it, so
    T = -r ln g + a Gamma variable of shape r - 1, and g has one of shape r: an integral over ln g.
    """
    t = np.arange(0.0, 401.0)
    u = np.linspace(-(t[-1] + 60) / r, math.log(r + 12 * math.sqrt(r) + 40), 1500)
    weight = r * u - np.exp(u) - math.lgamma(r) + math.log(u[1] - u[0])
    out = np.empty(len(t))
    for i, at in enumerate(t):
        x = np.maximum(at + r * u, 0)
        log_x = np.log(np.maximum(x, 1e-300))
        term = total = -x
        for k in range(1, r - 1):
            term = term + log_x - math.log(k)
            total = np.logaddexp(total, term)
        v = weight + np.minimum(total, 0)
        out[i] = min(0.0, float(v.max() + np.log(np.exp(v - v.max()).sum())))
    return t, out


def log_tail(r: int, t: float) -> float:
    if r == 1:
        return math.log(-math.expm1(-math.exp(-t))) if t < 30 else -t
    at, known = sum_tail(r)
    if t >= at[-1]:
        return float(known[-1]) - (t - at[-1]) + (r - 1) * math.log(t / at[-1])
    return float(np.interp(t, at, known))


def p_value(best: list[float], n: int, k: float, rate: float = 1.0) -> float:
    """Of a text of n tokens, from its segments' scores in falling order.

    The scores of a clean text exceed s about K n e^(-lambda s) times, with the rate lambda.  So one that is expected more than
    once (lambda s <= ln K n) is no evidence, nor are those after it.  Of the others the best one, two, ... are tested together
    by their sum, up to 12, and then each time a third more; the i-th test weighs 2^-i.
    """
    if not best or n <= 0:
        return 1.0
    least, t, log_kn, tests, due = 0.0, 0.0, math.log(k * n), 0, 1
    for r, s in enumerate(best, 1):
        more = rate * s - log_kn
        if more <= 0:
            break
        t += more
        if r == due:
            tests, due = tests + 1, r + 1 if r < 12 else r + r // 3
            least = min(least, log_tail(r, t) + tests * math.log(2))
    return math.exp(least)


def judge(text: str, model: Model, alpha: float) -> tuple[int, float, list[tuple[int, int, float]]]:
    """(tokens, p-value, significant segments)."""
    n, hits = token_scores(text, model)
    if not hits:
        return n, 1.0, []
    found = segments(runs(n, hits, model.other))
    p = p_value(sorted((s for _, _, s in found), reverse=True), n, model.k, model.rate)
    return n, p, [x for x in found if p_value([x[2]], n, model.k, model.rate) <= alpha]


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", per_class: int = TRAIN_PER_CLASS) -> Model:
    """A model from at most `per_class` labelled texts of each class, the first by a hash of their ids.

    Labels other than 0 and 1, null ids and ids that are labelled both ways
    are left out.  Without texts of both classes the model rejects nothing.
    Equal texts count once.  K and lambda are fitted to the sample's clean
    texts, each scored by a model of the half of the sample that it isn't in.
    """
    ids = labels.select(F.col(doc_id).alias("k"), F.col(toxic).alias("y")).where("k is not null and y in (0, 1)").groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("k", "y")
    ids = ids.select("k", "y", F.xxhash64("k").alias("h"))
    sample = ids.where("y = 1").orderBy("h", "k").limit(per_class).unionByName(ids.where("y = 0").orderBy("h", "k").limit(per_class)).select("k", "y")
    chosen = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(sample), "k").select("y", "t").dropDuplicates(["y", "t"])  # at most 2 per_class rows

    chosen = chosen.select("y", "t", (F.xxhash64("t") % 2 != 0).cast("int").alias("half"))

    def count(batches):
        from collections import Counter

        seen = {(y, h): Counter() for y in (0, 1) for h in (0, 1)}
        for b in batches:
            for y, t, h in zip(*[b.column(i).to_pylist() for i in range(3)]):
                seen[y, h].update(set(WORDS(t.lower())))
        for (y, h), c in seen.items():
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([2 * y + h] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["w", "c", "n"])

    sums = [F.sum(F.when(F.col("c") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(4)]
    table = chosen.mapInArrow(count, "w string, c int, n long").groupBy("w").agg(*sums)
    counts = table.toPandas()  # as bounded as the sample
    w, n = list(counts["w"]), [counts[f"n{i}"].to_numpy() for i in range(4)]
    of = lambda t, c: fit([x for x in zip(w, t, c) if x[1] or x[2]])
    model, halves = of(n[2] + n[3], n[0] + n[1]), (of(n[2], n[0]), of(n[3], n[1]))

    def best(batches):
        for b in batches:
            rows = []
            for t, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                other = halves[1 - h]
                size, hits = token_scores(t, other)
                if other.words or other.prefixes:
                    rows.append((size, max((s for _, _, s in segments(runs(size, hits, other.other))), default=0.0)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.float64())], names=["n", "s"])

    return calibrate(model, [tuple(r) for r in chosen.where("y = 0").mapInArrow(best, "n int, s double").collect()])


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA, keep: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Rows that the model rejects, with their passages; with `keep`, instead the other rows of `docs`, unchanged."""
    if keep:
        schema, names = docs.schema, docs.columns
        at = names.index(text)

        def passed(batches):
            for part, texts in chunks(batches, at):
                yield part.filter(pa.array([t is None or judge(t, model, alpha)[1] > alpha for t in texts], pa.bool_()))

        return docs.mapInArrow(passed, schema)
    kind = docs.schema[doc_id].dataType.simpleString()

    def rejected(batches):
        for part, texts in chunks(batches, 1):
            rows = []
            for i, t in enumerate(texts):
                if t is not None:
                    n, p, found = judge(t, model, alpha)
                    if p <= alpha:
                        rows.append((i, n, p, [{"start": a, "end": b, "score": s} for a, b, s in found]))
            passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], passage)], names=["doc_id", "n_tokens", "p_value", "passages"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rejected, f"doc_id {kind}, n_tokens int, p_value double, passages array<struct<start:int,end:int,score:double>>")


def toxic_documents(docs: DataFrame, labels: DataFrame, *, per_class: int = TRAIN_PER_CLASS, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_tokens, p_value, passages) of each document that is rejected as toxic.

    Tokens are runs of word characters in lower case; passages are [start, end)
    in tokens, each significant by itself (several weak ones may reject a
    document together, which then has none listed).  Null and empty texts are
    never rejected; repeated rows are judged alike, each by itself.  Whole
    texts are scored, in one pass without a shuffle.  Of segments with equal
    scores all count, in whatever order.  An empty table of documents gives no
    rows; without labels of both classes nothing is rejected.
    """
    return score(docs, train(docs, labels, per_class=per_class), alpha=alpha)


def clean_documents(docs: DataFrame, labels: DataFrame, *, train_on: DataFrame | None = None, per_class: int = TRAIN_PER_CLASS, alpha: float = ALPHA) -> DataFrame:
    """The rows of `docs` that aren't rejected, unchanged; null texts stay."""
    return score(docs, train(docs if train_on is None else train_on, labels, per_class=per_class), alpha=alpha, keep=True)
