"""Quality rules: lines labelled content or boilerplate by a linear-chain CRF."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Labelled documents taken for training, of each class, in the order of a hash of their ids.
TRAIN_PER_CLASS = 1500
#: A document stays if at least this share of its words is in content lines.
MIN_SHARE = 0.5
#: Seed-free gradient ascent: steps, and the weight of the Gaussian prior.
STEPS, L2 = 150, 1.0

SYMBOL, DIGIT, LETTERS = re.compile(r"[^\w\s.,;:!?'\"()-]").findall, re.compile(r"\d").findall, re.compile(r"[^\W\d_]").findall
NOTICE = re.compile(r"licen[sc]e|copyright|all rights reserved|cookie|subscribe|sign in|click here|terms of|privacy policy", re.I).search
#: Upper bounds of each feature's classes; one class more lies above the last.
BINS = {
    "words": (1, 2, 4, 8, 16, 32, 64, 128),
    "different": (0.1, 0.2, 0.35, 0.5, 0.65, 0.75, 0.85, 0.95),
    "symbols": (0.0, 0.05, 0.15, 0.3, 0.6, 1.0, 2.0),
    "shouts": (0.0, 0.05, 0.15, 0.3, 0.6, 0.9),
    "capitals": (0.05, 0.15, 0.25, 0.4, 0.6, 0.9),
    "digits": (0.0, 0.02, 0.05, 0.1, 0.2, 0.5),
    "length": (1.5, 3.0, 4.0, 5.0, 6.5, 8.0, 10.0, 15.0),
    "marks": (0.0, 0.03, 0.08, 0.15, 0.3, 0.6, 1.0),
}
FLAGS = ("ends", "repeated", "notice", "first", "last")
OFFSETS = {k: sum(len(b) + 1 for b in list(BINS.values())[:i]) for i, k in enumerate(BINS)}
FEATURES = sum(len(b) + 1 for b in BINS.values()) + 2 * len(FLAGS) + 1
CONTENT, BOILERPLATE = 0, 1


def lines(text: str) -> list[str]:
    """The lines that aren't blank."""
    return [x for x in text.split("\n") if x and not x.isspace()]


def features(text_lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(classes, words) of one text's lines: for each line the index of each of its features that holds."""
    raw, flags, seen = [], [], set()
    for i, x in enumerate(text_lines):
        ws = x.split()
        n = len(ws)
        marks = x.count(".") + x.count(",") + x.count("!") + x.count("?") + x.count(";") + x.count(":")
        raw.append((n, len(set(ws)) / n, len(SYMBOL(x)) / n, sum(map(str.isupper, ws)) / n, sum(map(str.istitle, ws)) / n, len(DIGIT(x)) / n, len(x) / n - 1, marks / n))
        flags.append((x.rstrip()[-1] in ".!?\"'", x in seen, NOTICE(x) is not None, i == 0, i == len(text_lines) - 1))
        seen.add(x)
    m = np.array(raw, dtype=np.float64).reshape(-1, len(BINS))
    cols = [OFFSETS[k] + np.searchsorted(b, m[:, i], side="left") for i, (k, b) in enumerate(BINS.items())]
    f = np.array(flags, dtype=np.int64).reshape(-1, len(FLAGS))
    base = FEATURES - 1 - 2 * len(FLAGS)
    cols += [base + 2 * i + f[:, i] for i in range(len(FLAGS))]
    cols.append(np.full(len(m), FEATURES - 1))
    return np.stack(cols, axis=1), m[:, 0]


@dataclass(frozen=True)
class Model:
    """Weights of content and boilerplate by feature, and of each pair of neighbouring labels."""

    emit: np.ndarray  # [FEATURES, 2]
    move: np.ndarray  # [2, 2]


def viterbi(scores: np.ndarray, move: np.ndarray) -> list[int]:
    """The best labels of one sequence, from its lines' scores [n, 2]; ties go to content."""
    m00, m01, m10, m11 = move.ravel().tolist()
    a = b = 0.0
    back = []
    for i, (s0, s1) in enumerate(scores.tolist()):
        if i:
            x, y = (a + m00, 0) if a + m00 >= b + m10 else (b + m10, 1), (a + m01, 0) if a + m01 >= b + m11 else (b + m11, 1)
            back.append((x[1], y[1]))
            a, b = x[0] + s0, y[0] + s1
        else:
            a, b = s0, s1
    at = 0 if a >= b else 1
    out = [at]
    for p in reversed(back):
        at = p[at]
        out.append(at)
    return out[::-1] if len(scores) else []


def label(text: str, model: Model) -> tuple[list[int], np.ndarray]:
    """(labels, words) of the lines that aren't blank."""
    ls = lines(text)
    if not ls:
        return [], np.zeros(0)
    at, words = features(ls)
    return viterbi(model.emit[at].sum(axis=1), model.move), words


def gradient(model: Model, batch: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of labelled sequences and its gradient, by forward-backward over sequences of one padded length."""
    n, longest = len(batch), max(len(y) for _, y in batch)
    size = np.array([len(y) for _, y in batch])
    s, gold = np.zeros((n, longest, 2)), np.zeros((n, longest), np.int64)
    for i, (x, y) in enumerate(batch):
        s[i, : len(y)] = model.emit[x].sum(axis=1)
        gold[i, : len(y)] = y
    inside = np.arange(longest)[None, :] < size[:, None]

    def total(z: np.ndarray, axis: int) -> np.ndarray:
        m = z.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(z - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    fwd, bwd = np.zeros_like(s), np.zeros_like(s)
    fwd[:, 0] = s[:, 0]
    for t in range(1, longest):
        fwd[:, t] = np.where(inside[:, t, None], total(fwd[:, t - 1, :, None] + model.move, 1) + s[:, t], fwd[:, t - 1])
    for t in range(longest - 2, -1, -1):
        bwd[:, t] = np.where(inside[:, t + 1, None], total(model.move + (s[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), 0)
    z = total(fwd[:, -1], 1)
    p = np.exp(fwd + bwd - z[:, None, None]) * inside[..., None]
    pair = np.exp(fwd[:, :-1, :, None] + model.move + (s + bwd)[:, 1:, None, :] - z[:, None, None, None]) * inside[:, 1:, None, None]
    hot = np.eye(2)[gold] * inside[..., None]
    seen = hot[:, :-1, :, None] * hot[:, 1:, None, :]
    ll = (s * hot).sum() + (seen * model.move).sum() - z.sum()
    emit = np.zeros_like(model.emit)
    diff = hot - p
    for i, (x, y) in enumerate(batch):
        np.add.at(emit, x.ravel(), np.repeat(diff[i, : len(y)], x.shape[1], axis=0))
    return float(ll), emit, (seen - pair).sum(axis=(0, 1))


def steps_matrix() -> np.ndarray:
    """Weights as sums of steps from class to class of a feature, so that a class learns from its neighbours."""
    c = np.eye(FEATURES)
    for k, b in BINS.items():
        at, n = OFFSETS[k], len(b) + 1
        c[at : at + n, at : at + n] = np.tril(np.ones((n, n)))
    return c


def fit_sequences(data: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS) -> Model:
    """Penalised maximum likelihood by Adam, over whole sequences in batches of like length."""
    data = sorted(data, key=lambda d: len(d[1]))
    batches = [data[i : i + 128] for i in range(0, len(data), 128)]
    c, w = steps_matrix(), [np.zeros((FEATURES, 2)), np.zeros((2, 2))]
    m, v = [0 * x for x in w], [0 * x for x in w]
    n = sum(len(y) for _, y in data)
    for step in range(1, steps + 1):
        g, model = [-L2 * x for x in w], Model(c @ w[0], w[1])
        for b in batches:
            _, ge, gm = gradient(model, b)
            g[0] += c.T @ ge
            g[1] += gm
        for i in range(2):
            m[i] = 0.9 * m[i] + 0.1 * g[i] / n
            v[i] = 0.999 * v[i] + 0.001 * (g[i] / n) ** 2
            w[i] = w[i] + 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(c @ w[0], w[1])


def fit(texts: list[tuple[str, int]]) -> Model:
    """A model from (text, quality) with quality 1 for good and 0 for bad texts.

    Only whole texts are labelled.  A bad text's lines start as boilerplate and
    a good one's as content, and lines are then fitted one by one; a line of a
    bad text that looks like content is content from then on, and a line of a
    good text that is surely boilerplate (0.95) is that.  The chain is fitted
    to these sequences.  Without texts of both kinds all lines are content.
    """
    return fit_features([(features(ls)[0], 0 if q else 1) for t, q in texts if (ls := lines(t))])


def fit_features(data: list[tuple[np.ndarray, int]]) -> Model:
    """As fit(), from each text's features and whether it is bad."""
    if len({y for _, y in data}) < 2:
        emit = np.zeros((FEATURES, 2))
        emit[-1, CONTENT] = 1
        return Model(emit, np.zeros((2, 2)))
    x, y = np.concatenate([d for d, _ in data]), np.concatenate([np.full(len(d), k) for d, k in data])
    # each line by itself: logistic regression, both classes of equal weight
    c, theta, m, v = steps_matrix(), np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES)
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    for step in range(1, 301):
        p = 1 / (1 + np.exp(-(c @ theta)[x].sum(axis=1)))
        g = c.T @ np.bincount(x.ravel(), np.repeat((y - p) * share, x.shape[1]), FEATURES) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    sequences, w = [], c @ theta
    for d, bad in data:
        p = 1 / (1 + np.exp(-w[d].sum(axis=1)))
        sequences.append((d, (p > 0.5).astype(np.int64) if bad else (p > 0.95).astype(np.int64)))
    return fit_sequences(sequences)


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", per_class: int = TRAIN_PER_CLASS) -> Model:
    """A model from at most `per_class` labelled texts of each class, the first by a hash of their ids.

    Labels other than 0 and 1, null ids, and ids labelled both ways are left out; equal texts count once.
    """
    ids = labels.select(F.col(doc_id).alias("k"), F.col(quality).alias("y")).where("k is not null and y in (0, 1)").groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").withColumn("h", F.xxhash64("k"))
    sample = ids.where("y = 1").orderBy("h", "k").limit(per_class).unionByName(ids.where("y = 0").orderBy("h", "k").limit(per_class)).select("k", "y")
    chosen = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(sample), "k").select("t", "y").dropDuplicates(["t", "y"])  # at most 2 per_class rows
    def small(batches):  # features, not texts, go to the driver
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ls = lines(t)
                if ls:
                    yield pa.RecordBatch.from_arrays([pa.array([features(ls)[0].tolist()], pa.list_(pa.list_(pa.int32()))), pa.array([y], pa.int32())], names=["x", "y"])

    got = chosen.mapInArrow(small, "x array<array<int>>, y int").collect()
    return fit_features(sorted(((np.array(r["x"], dtype=np.int64), 0 if r["y"] else 1) for r in got), key=lambda d: (d[1], d[0].tobytes())))


def kept_documents(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, n_lines, n_content, content_share) of the documents that stay.

    A document stays if at least `min_share` of its words are in lines that
    Viterbi decoding labels content.  Lines are separated by line feeds; blank
    ones don't count.  Null texts and texts without words have no content and
    go.  Repeated rows are judged alike, each by itself; ids pass through,
    nulls included.  Whole texts are labelled, without a shuffle.  Of labels
    that score alike content is taken.  An empty table gives no rows; extra
    columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for part, texts in chunks(batches, 1):
            rows = []
            for i, t in enumerate(texts):
                if t:
                    ls, words = label(t, model)
                    if ls:
                        content = np.array(ls) == CONTENT
                        share = float(words[content].sum() / words.sum())
                        if share >= min_share:
                            rows.append((i, len(ls), int(content.sum()), share))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *[pa.array([r[j] for r in rows], k) for j, k in ((1, pa.int32()), (2, pa.int32()), (3, pa.float64()))]], names=["doc_id", "n_lines", "n_content", "content_share"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_lines int, n_content int, content_share double")
