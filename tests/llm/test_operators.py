"""Each operator against a brute-force version, and on awkward tables."""

import collections
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, cascade, common, components, context_tree, crf, debruijn, metric_join, mixing, sharding, simhash, suffix_tree, toxicity
from tessera.llm.common import Scratch

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, id string, row string, t long, k string, n int, u double, listed boolean, r int"


def awkward(spark, empty=False):
    """Nulls in any column, empty and very long texts, repeated rows, an id with two texts, and columns named like the operators' own."""
    a = " ".join(f"alpha{i}" for i in range(70))
    rows = [(1, a), (1, a), (2, a), (3, a + " omega"), (4, None), (5, ""), (6, "   \n "), (None, a), (None, "x"), (7, LONG), (8, "short"), (8, "another text"), (9, "é ß \U0001f600 ٣"), (10, "b " * 120)]
    full = [(i, t, None if i == 2 else "en", None if i in (3, None) else f"s{(i or 0) % 2}", None if t is None else len(t), 1, None, "r", 2, "k", 3, 0.5, None, 4) for i, t in rows]
    return spark.createDataFrame([] if empty else full, SCHEMA)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (8, 0, 1), (8, 0, 1), (9, 1, None), (None, 1, 1), (2, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")


def plain(df):
    return sorted(map(repr, df.collect()))


# -- 1


def test_range_join_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    x[200:260] = x[:60] + 0.08 * rng.normal(size=(60, 16))
    x[300:310] = x[0] * np.linspace(0.5, 3, 10)[:, None]  # same direction: ties at cosine 1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<double>")
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    for least in (0.96, 0.5):
        want = {(i, j) for i, j in zip(*np.nonzero(np.triu(y @ y.T >= least, 1)))}
        # one level of cells; several, with pivots sent or waiting where the rows come
        for how in ({"cell": 25}, {"cell": 10, "fan": 3}, {"cell": 10, "fan": 3, "broadcast_bytes": 0}):
            got = metric_join.range_join(df, min_cosine=least, **how).collect()
            assert len(got) == len(set(got)) and {(r[0], r[1]) for r in got} == want and want


def test_range_join_takes_equal_vectors(spark):
    """A cell of equal vectors can't be split: all its pairs are results, and at a bound of 1, too."""
    rows = [(i, [0.1, 0.2, 0.3]) for i in range(30)] + [(100 + i, [math.cos(i), math.sin(i), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in metric_join.range_join(df, min_cosine=1.0, cell=4, fan=3).collect()}
    assert got == {(i, j) for i in range(30) for j in range(i + 1, 30)}


def test_range_join_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, [None, 1.0]), (1, [1.0, 0.0]), (10, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cell int")
    assert [tuple(r) for r in metric_join.range_join(df).collect()] == [(1, 2)]
    assert metric_join.range_join(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        metric_join.range_join(df, min_cosine=1.5)


def test_assignment_covers_all_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = 0.6
    home, copies = metric_join.assign(x, metric_join.choose_pivots(x[:100], 9), r)
    assert copies.mean() < 0.5
    for i, j in itertools.combinations(range(300), 2):
        if np.linalg.norm(x[i] - x[j]) <= r:
            assert home[i] == home[j] or copies[i, home[j]] + copies[j, home[i]] == 1


# -- 2


def near_texts(n=120, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    base = [[word() for _ in range(rng.randint(60, 200))] for _ in range(n)]
    out = [" ".join(w) for w in base]
    for i in range(40):
        for _ in range(i % 3 + 1):
            w = list(base[i])
            for _ in range(max(1, len(w) // 30)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    return out


def brute_groups(f, radius):
    d = np.bitwise_count((f[:, None] ^ f[None]).view(np.uint64)).sum(-1) <= radius
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(d, 1))):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))], [(i, j) for i, j in zip(*np.nonzero(np.triu(d, 1)))]


def test_forest_against_all_pairs(spark):
    texts = near_texts(1200)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root, pairs = brute_groups(simhash.fingerprints(texts, simhash.Signs()), simhash.RADIUS)
    got = {r["doc_id"]: r["duplicate_of"] for r in simhash.near_duplicates(df).collect()}
    assert len(pairs) >= 80
    for x, y in got.items():
        assert root[x] == root[y] and y < x  # nothing that isn't near
    at = lambda i: got.get(i, i)
    assert sum(at(i) == at(j) for i, j in pairs) >= 0.9 * len(pairs)


def test_forest_plan_and_links():
    assert simhash.forest(10, 22, 0.95) == (0, 0, 1)
    least, depth, tries = simhash.forest(1 << 20, 22, 0.95)
    p = math.prod((128 - 22 - i) / (128 - i) for i in range(depth))
    assert 1 - (1 - p) ** tries >= 0.95 > 1 - (1 - p) ** (tries - 1) and depth == 14 and least == 10
    rng = np.random.default_rng(1)
    f = rng.integers(-(2**63), 2**63 - 1, (900, 2))
    f[1:700] = f[0] ^ (np.int64(1) << rng.integers(0, 60, (699, 2)))  # one dense node, by stars
    a, b = simhash.link(f, np.zeros(900, np.int64), 4, dense=64)
    v, r = simhash.thin(900, a, b)
    assert len(v) == 699 and len(set(r)) == 1
    few = simhash.link(f[:200], np.repeat([1, 2], 100), 128, dense=512)
    assert len(few[0]) == 2 * (100 * 99 // 2)  # all pairs of each node, none across
    keys = np.sort(rng.integers(0, 1 << 10, 500))
    node = simhash.nodes(keys, 4, 10, leaf=8)
    for n in np.unique(node):
        up = n & 255
        assert up == 0 or (node == n).sum() <= 8
        assert len(set(keys[node == n] >> up)) == 1


def test_near_duplicates_awkward(spark):
    df = awkward(spark)
    got = {r["doc_id"]: r["duplicate_of"] for r in simhash.near_duplicates(df).collect()}
    assert got == {2: 1, 3: 1}
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert collections.Counter(i for i, _ in left) == {1: 1, 4: 1, 5: 1, 6: 1, None: 1, 7: 1, 8: 2, 9: 1, 10: 1}
    assert simhash.near_duplicates(awkward(spark, True)).count() == simhash.drop_near_duplicates(awkward(spark, True)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(7, 7)]
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["v"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {v: root[v] for v in root if any(v in e and e[0] != e[1] for e in edges)}


# -- 3


def best_capacity(sizes, shards):
    """By dynamic programming over all partitions."""
    p = [0, *itertools.accumulate(sizes)]
    best = [0] + [math.inf] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[i], p[j] - p[i]) for i in range(j)) for j in range(1, len(p))]
    return best[-1]


@pytest.mark.parametrize("shards", [1, 3, 7, 500])
def test_smallest_capacity(shards):
    rng = random.Random(shards)
    sizes = [rng.choice([0, 1, 5, 40, 300]) for _ in range(80)]
    parts = [np.array(sizes[i : i + 9]) for i in range(0, 80, 9)]
    asked = []
    blocks = sharding.Blocks(np.array([p.sum() for p in parts]), np.array([len(p) for p in parts]), lambda ids: asked.append(ids) or {i: parts[i] for i in ids}, keep=4)
    cap, cuts = sharding.smallest_capacity(blocks, max(sizes), shards)
    assert cap == best_capacity(sizes, shards) and len(cuts) <= shards and max(np.diff([0, *cuts])) <= cap


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 3)
    df = awkward(spark)
    got = {r["doc_id"]: (r["size"], r["shard"]) for r in sharding.shard(df, shards=3).collect()}
    sizes = collections.Counter()
    for r in df.collect():
        sizes[r["doc_id"]] += len((r["text"] or "").encode())
    order = sorted(sizes, key=lambda k: (k is not None, k))
    assert {k: v[0] for k, v in got.items()} == sizes
    assert [got[k][1] for k in order] == sorted(got[k][1] for k in order)
    total = collections.Counter()
    for k in order:
        total[got[k][1]] += sizes[k]
    assert max(total.values()) == best_capacity([sizes[k] for k in order], 3)
    assert sharding.shard(awkward(spark, True)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(df.withColumn("n", F.lit(-1)), size="n")


# -- 4


def test_viterbi_and_gradient():
    rng = np.random.default_rng(2)
    for n in (1, 2, 6):
        s, move = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda y: s[range(n), y].sum() + sum(move[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert crf.viterbi(s, move) == list(max(itertools.product((0, 1), repeat=n), key=value))
    x = [np.array([[0, 5], [3, 7], [1, 5]]), np.array([[2, 9]])]
    batch = [(x[0], np.array([0, 1, 1])), (x[1], np.array([1]))]
    m = crf.Model(rng.normal(size=(crf.FEATURES, 2)), rng.normal(size=(2, 2)))
    ll, ge, gm = crf.gradient(m, batch)
    for arr, g, at in ((m.emit, ge, (5, 1)), (m.emit, ge, (3, 0)), (m.move, gm, (1, 1)), (m.move, gm, (0, 1))):
        arr[at] += 1e-6
        assert (crf.gradient(m, batch)[0] - ll) / 1e-6 == pytest.approx(g[at], abs=1e-3)
        arr[at] -= 1e-6
    exact = sum((m.emit[a].sum(1)[range(len(y)), y].sum() + sum(m.move[p, q] for p, q in zip(y, y[1:]))) - np.log(sum(np.exp(m.emit[a].sum(1)[range(len(z)), z].sum() + sum(m.move[p, q] for p, q in zip(z, z[1:]))) for z in map(list, itertools.product((0, 1), repeat=len(y))))) for a, y in batch)
    assert ll == pytest.approx(exact)


def test_crf_holds_out(spark):
    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    even, odd = lab.where("doc_id % 2 = 0"), lab.where("doc_id % 2 = 1")
    model = crf.train(docs, even)
    kept = {r["doc_id"] for r in crf.kept_documents(docs, model).collect()}
    truth = odd.collect()
    good, bad = [r["doc_id"] for r in truth if r["quality"] == 1], [r["doc_id"] for r in truth if r["quality"] == 0]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)
    rows = {r["doc_id"] for r in crf.kept_documents(awkward(spark), model).collect()}
    assert not rows & {4, 5, 6} and crf.kept_documents(awkward(spark, True), model).count() == 0
    none = crf.train(awkward(spark, True), labels(spark))
    assert crf.label("one line\n\n | | |", none)[0] == [0, 0]


# -- 5


def test_tree_against_counting(spark):
    texts = ["abracadabra " * 30, "the cat sat. " * 40, "", "Élan 42!", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, code string")
    coder = suffix_tree.Coder()
    seqs = [[0] * 4 + coder.codes([t])[0].__and__(31).tolist() for t in [*texts, texts[0]] if t is not None]
    count = [collections.Counter() for _ in range(6)]
    for s in seqs:
        for i in range(4, len(s)):
            for d in range(5):
                count[d][tuple(s[i - d : i + 1])] += 1
    base = sum(count[0].values())
    total = [collections.Counter() for _ in range(5)]
    for d in range(5):
        for c, n in count[d].items():
            total[d][c[:-1]] += n

    def dist(ctx):
        """By definition: the longest kept suffix, smoothed with the next one."""
        if not ctx:
            return [(count[0][(x,)] + 0.5) / (base + 16) for x in range(32)]
        parent, d, n = dist(ctx[1:]), len(ctx), total[len(ctx)][ctx]
        if not n:
            return parent
        own = [count[d][(*ctx, x)] for x in range(32)]
        g2 = 2 * sum(k * math.log(k / n / parent[x]) for x, k in enumerate(own) if k)
        if n < 50 or g2 < 61.1 or g2 < 2 * n * 0.002:
            return parent
        return [(k + 10 * parent[x]) / (n + 10) for x, k in enumerate(own)]

    got = {r["doc_id"]: r for r in suffix_tree.score_corpus(df).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i]["log_prob"] is got[i]["n_symbols"] is got[i]["perplexity"] is None
            continue
        s = [0] * 4 + (coder.codes([t])[0] & 31).tolist()
        want = sum(math.log(dist(tuple(s[j - 4 : j]))[s[j]]) for j in range(4, len(s)))
        assert got[i]["n_symbols"] == len(t) + 1 and got[i]["log_prob"] == pytest.approx(want, rel=1e-4)
        assert got[i]["perplexity"] == pytest.approx(math.exp(-want / (len(t) + 1)), rel=1e-4)
    tree = suffix_tree.train(df)
    assert tree.kept[1] > 0 and tree.kept[2] > 0
    assert np.exp(tree.table().reshape(-1, 32)[::997]).sum(axis=1) == pytest.approx(1, abs=1e-3)
    assert suffix_tree.score_corpus(awkward(spark, True)).count() == 0
    assert suffix_tree.score_corpus(awkward(spark)).where("log_prob is null").count() == 1


# -- 6


def test_cascade_is_exact(spark):
    rng = np.random.default_rng(4)
    for a, b in ((500, 9000), (5000, 300), (0, 50), (50, 0), (1, 1)):
        keys = rng.integers(-(2**62), 2**62, (a + b, 2))
        levels = cascade.build(keys[:a], keys[a:])
        got = cascade.lookup(levels, keys)
        assert got[:a].all() and not got[a:].any()
    urls = [f"https://www.Host{i % 90}.org/p/{i}/?q=1#f" for i in range(600)] + [None, "", "not a url", "HTTP://HOST1.org/p/1", "http://m.host2.org/p/2///"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls * 2)], "page_id long, url string, row string")
    keys = df.select(cascade.url_key(F.col("url")).alias("key"))
    listed = keys.where(F.crc32("key") % 3 == 0).unionByName(spark.createDataFrame([("elsewhere",), (None,)], "key string"))
    want = {r["key"] for r in listed.collect()} - {None}
    for shard_keys, limit in ((10**6, 1 << 20), (50, 1 << 20), (50, 0)):
        c = cascade.cascade(keys, listed, shard_keys=shard_keys)
        rows = cascade.flag(df, c, cascade.url_key(F.col("url")), broadcast_bytes=limit).withColumn("key", cascade.url_key(F.col("url"))).collect()
        assert len(rows) == len(urls) * 2 and all(r["listed"] == (r["key"] in want) for r in rows)
    empty = cascade.cascade(keys, listed.limit(0))
    assert cascade.flag(df, empty, cascade.url_key(F.col("url"))).where("listed").count() == 0
    assert cascade.flag(df.limit(0), c, cascade.url_key(F.col("url"))).count() == 0
    for limit in (0, 1 << 20):
        clash = cascade.flag(df.withColumn("Listed", F.lit("old")).withColumn("shard", F.lit(1)), c, cascade.url_key(F.col("url")), broadcast_bytes=limit)
        assert sorted(clash.columns) == sorted([*df.columns, "shard", "listed"]) and clash.count() == df.count()


# -- 7


def test_bpe_against_tiktoken(spark):
    import tiktoken

    ranks = bpe.read_ranks()
    own = bpe.Codec(ranks)
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\t é1²,.'s!\U0001f600\xa0") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdeftion") for _ in range(5000)), "a" * 3000, " " * 500, "xyx" * 400, "don't  we'll\n\n\n  go"]
    for t, got in zip(texts, own.encode(texts)):
        assert np.frombuffer(got, np.int32).tolist() == other.encode_ordinary(t), t[:60]
    df = awkward(spark)
    coded = bpe.encode(df)
    rows = coded.collect()
    assert len(rows) == df.count()
    for r, d in zip(rows, df.collect()):
        assert r["doc_id"] == d["doc_id"]
        if d["text"] is None:
            assert r["token_ids"] is r["n_tokens"] is r["round_trip"] is None
        else:
            assert r["token_ids"] == other.encode_ordinary(d["text"]) and r["round_trip"] and r["n_bytes"] == len(d["text"].encode())
    assert [r["text"] for r in bpe.decode(coded).collect()] == [r["text"] for r in df.collect()]
    assert bpe.encode(awkward(spark, True)).count() == 0


def test_merge_order_is_by_rank():
    """Against merging one pair at a time, with ranks in any order and a lower one that comes up late."""
    rng = random.Random(3)
    for trial in range(30):
        made = {bytes([b]): b for b in range(256)}
        words = ["".join(rng.choice("xyz") for _ in range(rng.randint(2, 4))).encode() for _ in range(14)]
        fresh = list(dict.fromkeys(w for w in words if w not in made))
        for i, w in enumerate(rng.sample(fresh, len(fresh))):
            made[w] = 256 + i
        c = bpe.Codec(made)
        pieces = ["".join(rng.choice("xyz") for _ in range(rng.randint(1, 25))).encode() for _ in range(40)]
        for piece, got in zip(pieces, c.merge(pieces)):
            parts = [bytes([b]) for b in piece]
            while True:
                best = min((made.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))) if len(parts) > 1 else (1 << 30, 0)
                if best[0] == 1 << 30:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert np.frombuffer(got, np.int32).tolist() == [made[p] for p in parts], (trial, piece)


def test_rank_queue():
    q, rng, want = bpe.RankQueue(70_000), random.Random(1), collections.defaultdict(list)
    for i in range(2000):
        r = rng.randrange(70_000)
        q.push(r, i)
        want[r].append(i)
    got = {}
    while q.top:
        r, at = q.pop()
        assert not got or r > max(got)
        got[r] = at
    assert got == dict(want)


# -- 8


def fill(sizes, weights, budget, cap):
    """Water-filling one clamp at a time."""
    live = {s for s in sizes if sizes[s] > 0 and weights.get(s, 0) > 0}
    out, left = dict.fromkeys(sizes, 0.0), budget
    while live:
        w = sum(weights[s] for s in live)
        over = {s for s in live if left * weights[s] / w > cap * sizes[s]}
        if not over:
            out |= {s: left * weights[s] / w for s in live}
            break
        s = min(over, key=lambda x: cap * sizes[x] / weights[x])
        out[s] = cap * sizes[s]
        left -= out[s]
        live.remove(s)
    return out


@pytest.mark.parametrize("case", range(4))
def test_water_filling(spark, case):
    rng = random.Random(case)
    sizes = {f"s{i}": rng.choice([0, 10, 100, 1000, 5000]) for i in range(9)} | {None: 70}
    weights = {s: rng.choice([0, 1, 1, 2, 5]) for s in sizes if s != "s3"}
    df = spark.createDataFrame([(i, "x" * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    cap, budget = [(4.0, None), (1.0, 3000.0), (0.5, 10**6), (3.0, 10.0)][case]
    got = {r["source"]: r["alloc"] for r in mixing.source_epochs(df, weights, max_epochs=cap, budget=budget).collect()}
    assert got == pytest.approx(fill(sizes, weights, budget or sum(sizes.values()), cap))


def test_mixing_rows(spark):
    df = awkward(spark)
    e = {r["source"]: r["epochs"] for r in mixing.source_epochs(df).collect()}
    out = mixing.mix(df, copy="copy")
    assert out.columns == [*df.columns, "copy"]
    count = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    given = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())
    for (i, t, s), n in given.items():
        assert count[i, t] in (n * math.floor(e[s]), n * math.ceil(e[s]))
    assert plain(mixing.mix(df)) == plain(mixing.mix(df)) and mixing.mix(awkward(spark, True)).count() == 0
    assert mixing.mix(df, {"s1": 0.0}).count() == 0
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan  # no text goes by its source
    clash = mixing.mix(df.withColumn("Copy", F.lit("old")), copy="copy")
    assert clash.columns == [*df.columns, "copy"] and plain(clash) == plain(out)


# -- 9


def all_maximal(scores):
    """Recursively: the best segment, then left and right of it (the definition of Ruzzo and Tompa)."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 0 and (best is None or s > best[2] or s == best[2] and j - i < best[1] - best[0]):
                best = (i, j, s)
    if not best:
        return []
    i, j, s = best
    return all_maximal(scores[:i]) + [best] + [(a + j, b + j, x) for a, b, x in all_maximal(scores[j:])]


def test_segments():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-5, -3, -2, -1, 1, 2, 3, 7]) + rng.random() * 1e-3 for _ in range(rng.randint(0, 14))]
        got = toxicity.segments((i, i + 1, s) for i, s in enumerate(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in all_maximal(scores)]


def test_toxic_holds_out(spark):
    """On sf0.1; the odd half of sf0.01 has but 16 different toxic texts to learn from, and 26 of 35 are found there."""
    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, lab.where("doc_id % 2 = 0"))
    found = {r["doc_id"] for r in toxicity.score(docs, model).collect()}
    truth = lab.where("doc_id % 2 = 1").collect()
    bad, good = [r["doc_id"] for r in truth if r["toxic"] == 1], [r["doc_id"] for r in truth if r["toxic"] == 0]
    assert sum(i in found for i in bad) >= 0.9 * len(bad) and sum(i in found for i in good) <= 0.005 * len(good)


def test_toxic_awkward(spark):
    assert toxicity.fit([]).words == {}
    m = toxicity.fit([("vile", 60, 0), ("common", 900, 900), *[(f"w{i}", 1, 1) for i in range(500)]])
    assert "vile" in m.words and "common" not in m.words and m.other < 0
    n, p, parts = toxicity.judge("common " * 40 + "vile vile common vile " + "common " * 40, m, 1e-3)
    assert n == 84 and p <= 1e-3 and [(a, b) for a, b, _ in parts] == [(40, 44)]
    df = awkward(spark)
    assert plain(toxicity.clean_documents(df, labels(spark))) == plain(df)
    assert toxicity.toxic_documents(df, labels(spark)).count() == 0 == toxicity.toxic_documents(awkward(spark, True), labels(spark)).count()
    bad = df.withColumn("text", F.when(F.col("doc_id") == 2, "vile " * 9).otherwise(F.col("text")))
    assert [r["doc_id"] for r in toxicity.score(bad, m).collect()] == [2]
    assert toxicity.score(bad, m, keep=True).where("doc_id = 2").count() == 0


# -- 10


def brute_spans(texts, k):
    at = collections.Counter(tuple(w[j : j + k]) for w in texts.values() for j in range(len(w) - k + 1))
    out = set()
    for i, w in texts.items():
        hit = np.zeros(len(w) + 1, bool)
        for j in range(len(w) - k + 1):
            if at[tuple(w[j : j + k])] > 1:
                hit[j : j + k] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(int)])))
        out |= {(i, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])}
    return out, at


@pytest.mark.parametrize("k", [6, 13])
def test_repeats_against_counting(spark, k):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    shared = [[rng.choice(words) for _ in range(rng.randint(k - 1, 4 * k))] for _ in range(12)]
    texts = {}
    for i in range(90):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += [rng.choice(words) for _ in range(rng.randint(0, 20))]
            w += rng.choice(shared)[rng.randint(0, 3) :] if rng.random() < 0.6 else []
        texts[i] = w
    texts[90], texts[91], texts[92] = ["x"] * 40, list(texts[5]), list("ab" * 20)
    df = spark.createDataFrame([(i, "  ".join(w) + "\n") for i, w in texts.items()], "doc_id long, text string")
    want, at = brute_spans(texts, k)
    got = debruijn.repeated_spans(df, k=k).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in got} == want and len(got) == len(want)
    assert all(r["n_paths"] >= 1 for r in got)
    after = {r["doc_id"]: r["text"].split() for r in debruijn.drop_repeats(df, k=k).collect()}
    left = collections.Counter(tuple(w[j : j + k]) for w in after.values() for j in range(len(w) - k + 1))
    planted = {tuple(s[j : j + k]) for s in shared for j in range(3, len(s) - k + 1)}
    for g, n in left.items():
        assert n == 1 or g not in at  # what still repeats has come up where cuts met
    assert {x for s in planted if at[s] for x in s} <= {x for w in after.values() for x in w}
    cuts = {r["doc_id"]: r["cuts"] for r in got if r["doc_id"] == 91 or r["copy_of"] is not None}
    assert (91 in cuts) == (len(texts[5]) >= k)


def test_repeats_are_verified(spark):
    """With hashes of eight bits nearly all edges collide; still nothing is cut that isn't repeated token by token."""
    rng, k = random.Random(4), 6
    passage = [f"p{i}" for i in range(15)]
    texts = {i: [f"w{rng.randrange(900)}" for _ in range(25)] + (passage if i % 5 == 0 else []) for i in range(40)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    _, at = brute_spans(texts, k)
    # what isn't of the passage stays everywhere, and the passage once
    stays = {g for g in at if not set(g) & set(passage) or set(g) <= set(passage)}
    for mask in (0xFF, 0xFFFFFFFF):
        cut = [(r["doc_id"], a, b) for r in debruijn.repeated_spans(df, k=k, mask=mask).collect() for a, b in r["cuts"]]
        assert all(at[tuple(texts[i][j : j + k])] > 1 for i, a, b in cut for j in range(a, b - k + 1))
        left = {tuple(w[j : j + k]) for r in debruijn.drop_repeats(df, k=k, mask=mask).collect() for w in [r["text"].split()] for j in range(len(w) - k + 1)}
        assert stays <= left
    assert len(cut) == 7


def test_repeats_take_repeated_names(spark):
    a = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(1, a, 5, 6), (2, a + " more", 7, 8)], "doc_id long, text string, x int, y int").toDF("doc_id", "text", "x", "x")
    out = debruijn.drop_repeats(df)
    rows = [tuple(r) for r in out.collect()]
    assert out.columns == df.columns and len(rows) in (1, 2) and {r[2:] for r in rows} <= {(5, 6), (7, 8)} and sum("a59" in r[1] for r in rows) == 1


def test_paths_compact(spark):
    """Two passages that share their middle: the graph has one path for the middle and one for each end."""
    k = 5
    head, mid, tail = ([f"{c}{i}" for i in range(12)] for c in "hmt")
    other = [f"o{i}" for i in range(12)]
    texts = [head + mid + tail] * 1 + [other + mid + [f"p{i}" for i in range(12)]] + [["q"] + head + mid + tail] + [other + mid + [f"p{i}" for i in range(12)] + ["z"]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in debruijn.repeated_spans(df, k=k).collect()}
    assert {i: (r["start"], r["end"], r["n_paths"]) for i, r in got.items()} == {0: (0, 36, 3), 1: (0, 36, 3), 2: (1, 37, 3), 3: (0, 36, 3)}


def test_repeats_awkward(spark):
    df = awkward(spark)
    got = {(r["doc_id"], r["start"], r["end"], r["copy_of"]) for r in debruijn.repeated_spans(df).collect()}
    assert {(1, 0, 70, None), (2, 0, 70, 1), (3, 0, 70, None), (10, 0, 120, None)} <= got
    assert {g[0] for g in got} == {1, 2, 3, 7, 10}
    out = debruijn.drop_repeats(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert collections.Counter(r["doc_id"] for r in rows if r["doc_id"] not in (1, 3)) == {4: 1, 5: 1, 6: 1, 7: 1, 8: 2, 9: 1, 10: 1, None: 1}
    text = {r["doc_id"]: r["text"] for r in rows}
    a = " ".join(f"alpha{i}" for i in range(70))
    assert (text.get(1), text[3]) in ((a, "omega"), (None, a + " omega"))
    assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in rows)
    assert debruijn.repeated_spans(awkward(spark, True)).count() == debruijn.drop_repeats(awkward(spark, True)).count() == 0


def test_minimizers_agree():
    """Equal windows choose the same place, whatever is around them."""
    rng = random.Random(1)
    w = [f"w{rng.randrange(50)}" for _ in range(30)]
    cache = debruijn.WordHash()
    a = debruijn.Slice([" ".join([f"a{i}" for i in range(9)] + w)], cache)
    b = debruijn.Slice(["x y", " ".join(w + [f"b{i}" for i in range(9)])], cache)
    k = 10
    for i in range(20):
        assert a.grams(k)[9 + i] == b.grams(k)[2 + i]
        one, two = (np.flatnonzero(s.windows(s.minimizers(k), k) == at) for s, at in ((a, 9 + i), (b, 2 + i)))
        assert len(one) == len(two) == 1
    assert (a.grams(k)[-9:] == debruijn.NONE).all()


# -- 5, words


def test_words_tree_against_counting(spark):
    rng = random.Random(5)
    lead = [f"q{i}" for i in range(9)]
    texts = [" ".join([rng.choice("ab"), *lead, "yes" if i % 2 else "no"] + [rng.choice(["red", "blue", "one\ntwo", ""]) for _ in range(12)]) for i in range(300)]
    # what comes after nine equal words depends on the word before them
    texts += [f"{'left' if i % 2 else 'right'} {' '.join(lead)} {'up' if i % 2 else 'down'}" for i in range(300)] + ["", "a", texts[0]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    seqs = [["<", *context_tree.tokens(t), ">"] for t in texts]
    count, deepest = collections.defaultdict(collections.Counter), 0
    for s in seqs:
        for i in range(1, len(s)):
            for d in range(i + 1):
                count[tuple(s[i - d : i])][s[i]] += 1
    base, memo = count[()], {}

    def dist(ctx):
        """By definition, over every context of any depth: (longest kept suffix, P by next word)."""
        if not ctx:
            return 0, {x: (n + 0.5) / (sum(base.values()) + 0.5 * (len(base) + 1)) for x, n in base.items()}
        if ctx not in memo:
            d, parent = dist(ctx[1:])
            own, n = count[ctx], sum(count[ctx].values())
            g2 = 2 * sum(k * math.log(k / n / parent[x]) for x, k in own.items())
            keep = n >= 50 and g2 >= context_tree.critical(max(len(own) - 1, 1)) and g2 >= 2 * n * 0.002
            memo[ctx] = (len(ctx), {x: (own[x] + 10 * p) / (n + 10) for x, p in parent.items()}) if keep else (d, parent)
        return memo[ctx]

    got = {r["doc_id"]: r for r in context_tree.score_corpus(df).collect()}
    for i, s in enumerate(seqs):
        want = 0
        for j in range(1, len(s)):
            d, p = dist(tuple(s[:j]))
            want, deepest = want + math.log(p[s[j]]), max(deepest, d)
        assert got[i]["n_symbols"] == len(s) - 1 and got[i]["log_prob"] == pytest.approx(want, rel=1e-4)
    assert deepest >= 10 and got[len(texts)]["log_prob"] is None
    # many slices, and contexts that several shards share, change nothing
    cut = {r["doc_id"]: r for r in context_tree.score_corpus(df, chars=3000, spread=40).collect()}
    assert cut.keys() == got.keys() and all(cut[i]["log_prob"] == pytest.approx(got[i]["log_prob"], rel=1e-4) for i in range(len(texts)))
    for empty in (True, False):
        d = awkward(spark, empty)
        assert context_tree.score_corpus(d).count() == d.count()


def test_words_tree_scores_other_texts(spark):
    rng = random.Random(2)
    line = lambda: " ".join(rng.choice(["sun rises early", "rain falls often", "wind turns cold"]) for _ in range(30))
    corpus = spark.createDataFrame([(i, line()) for i in range(100)], "doc_id long, text string")
    other = spark.createDataFrame([(1, line()), (1, "early cold falls rises sun often " * 15), (None, "never seen"), (2, None)], "doc_id long, text string")
    got = context_tree.score_corpus(other, train_on=corpus).collect()
    like, shuffled = sorted(r["perplexity"] for r in got if r["doc_id"] == 1)
    assert len(got) == 4 and like < 3 < 10 < shuffled
    empty = context_tree.score_corpus(other, train_on=corpus.limit(0)).collect()
    assert len(empty) == 4 and sum(r["log_prob"] is None for r in empty) == 1


def test_words_tree_answers_slices_in_rounds(spark, tmp_path, monkeypatch):
    """Slices are never all there twice, nor all shuffled at once, and scores don't depend on the rounds."""
    from pyspark.sql.readwriter import DataFrameWriter

    rng = random.Random(4)
    df = spark.createDataFrame([(i, " ".join(f"word{rng.randrange(40)}" for _ in range(60))) for i in range(150)], "doc_id long, text string")
    at_once, real = [], DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        real(self, path, *args, **kwargs)
        files = [f for f in tmp_path.rglob("*.parquet") if "state" in pq.read_schema(f).names]
        at_once.append(sum(pq.read_metadata(f).num_rows for f in files))

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(context_tree, "STATE", 50)  # else small states have one round
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    got = {r["doc_id"]: r["log_prob"] for r in context_tree.score_corpus(df, chars=600).collect()}
    assert at_once[0] >= 64 and max(at_once) <= 1.5 * at_once[0]
    monkeypatch.setattr(DataFrameWriter, "parquet", real)
    one = {r["doc_id"]: r["log_prob"] for r in context_tree.score_corpus(df).collect()}
    assert got.keys() == one.keys() and all(got[i] == pytest.approx(one[i], rel=1e-4) for i in one)


def test_suffix_tree_messages(spark, monkeypatch):
    """Slices ask few shards for their words, which are few beside their places, and shared contexts are found at once."""
    rng = np.random.default_rng(9)
    docs = [(i, " ".join(f"w{j}" for j in rng.zipf(1.5, 400) % 50)) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    want = {r["doc_id"]: r["log_prob"] for r in context_tree.score_corpus(df).collect()}
    rows, read = [], common.Scratch.read
    monkeypatch.setattr(common.Scratch, "read", lambda self, path, schema: (out := read(self, path, schema), rows.append(out.where("slice is not null").count()) if "asked" in out.columns else None)[0])
    monkeypatch.setattr(context_tree, "WORDS", 250)
    got = {r["doc_id"]: r["log_prob"] for r in context_tree.score_corpus(df, chars=4000, spread=100).collect()}
    assert got == pytest.approx(want, rel=1e-9)
    slices, shards = -(-sum(len(t) for _, t in docs) // 4000), 40 * 402 // 250
    assert rows[0] <= slices * 1.3 * shards / 4
    x = rng.integers(0, 7, 200)
    assert [g.tolist() for g in context_tree.grouped(x, 9)] == [np.flatnonzero(x == i).tolist() for i in range(9)]


def test_words_tree_states_hold_what_live_places_need():
    rng = np.random.default_rng(3)
    x = rng.integers(2, 100, 3000)
    x[1000:1010], x[2000:2004], x[0] = 1, 1, 0
    s = context_tree.Slice(np.array([3000]), np.arange(100), x)
    s.begin(np.where(np.arange(100) == 1, 60, 5), 600.0, 1 << 20)
    assert s.live.tolist() == [*range(1001, 1011), *range(2001, 2005)]
    state = s.save(0)
    a = context_tree.unpack(state)
    assert len(a["x"]) < 30 and a["n"].tolist() == [11, 5] and a["which"].tolist() == [0, 0]
    less = context_tree.Slice.load(None, state)
    deep = [5, 9, 13]
    for d in (1, 3):
        assert (less.context(less.live[deep], d) == s.context(s.live[deep], d)).all()
    assert (less.rare[less.live - 1] == s.rare[s.live - 1]).all() and np.allclose(less.q, s.q) and np.allclose(less.done, s.done)


def test_words_tree_rows_tell_depths_apart():
    x = np.array([2, 1, 0, 0, 1, 0, 0, 1, 1, 0, 0, 0, 1, 2, 1, 0, 0, 1, 0])
    s = context_tree.Slice(np.array([len(x)]), np.arange(3), x)  # a word of number 0 adds nothing to a hash
    s.live = np.arange(2, len(x))
    s.q, s.k = np.zeros(len(s.live)), np.ones(len(s.live), np.int64)
    for d0, d1 in ((1, 2), (1, 6)):
        j, d, c, row, shard, first = s.places(d0, d1, 4)
        grams = [(int(k), *x[i - k : i + 1]) for i, k in zip(s.live[j], d)]
        assert len({*zip(grams, row)}) == len({*grams}) == len(shard) == row.max() + 1
        assert [grams[f] for f in first] == [grams[np.flatnonzero(row == r)[0]] for r in range(len(first))] and (np.diff(shard) >= 0).all()


def test_words_tree_order_and_messages():
    rng = np.random.default_rng(4)
    for x in (rng.integers(0, 1 << 63, 5000), rng.integers(0, 50, 5000), (7 << 60) + rng.integers(0, 50, 5000), np.zeros(0, int), np.array([3])):
        x = x.astype(np.uint64)
        assert (context_tree.ordered(x) == np.argsort(x, kind="stable")).all()
        values, at, inv = context_tree.distinct(x)
        assert (values == np.unique(x)).all() and (values[inv] == x).all() and (x[at] == values).all()
        back = context_tree.unpack(context_tree.pack(x=x, f=x.astype(np.float32), b=x > 3))
        assert (back["x"] == x).all() and (back["f"] == x.astype(np.float32)).all() and (back["b"] == (x > 3)).all() and back["b"].dtype == bool


def test_words_tree_gives_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(context_tree, "release", lambda: calls.append(1))
    x = np.zeros(60, int)
    x[0] = 1
    s = context_tree.Slice(np.array([60]), np.arange(2), x)
    s.begin(np.array([59, 1]), 60.0, 1 << 20)
    one = lambda h, p: pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([h], pa.int32()), pa.array([p], pa.binary())], names=["slice", "shard", "payload"])
    asked = [one(h, context_tree.pack(**a)) for h, a in s.requests(0, 1, 1)]
    assert len(list(context_tree.settle(iter(asked), 0, 1, 60.0))) == 1 and len(calls) == 1
    words = one(0, context_tree.pack(word=np.array([5, 4], np.uint64), n=np.array([3, 2])))
    assert len(list(context_tree.tally(iter([words])))) == 2 and len(calls) == 2


# -- 9, calibration


def test_p_values_have_no_bound_of_segments():
    """Every segment may count, and p-values of clean texts are as rare as they say."""
    assert toxicity.p_value([3.0] * 3000, 10_000, 0.001) < 1e-300 < toxicity.p_value([3.0] * 40, 10_000, 0.001) < 1e-20
    assert toxicity.p_value([2000.0], 100, 0.1) == 0 and toxicity.p_value([], 9, 1) == toxicity.p_value([1.0], 0, 1) == 1
    rng, n, k, rate = np.random.default_rng(7), 500, 0.05, 1.2
    # segments of a clean text: K n of them, falling off at the rate
    found = [np.sort(rng.exponential(1 / rate, rng.poisson(k * n)))[::-1].tolist() for _ in range(20_000)]
    p = np.array([toxicity.p_value(x, n, k, rate) for x in found])
    for a in (0.1, 0.01, 0.001):
        assert a / 5 - 4e-4 <= (p <= a).mean() <= a + 4e-4
    # the sum of the five best alone
    sums = np.array([sum(rate * s - math.log(k * n) for s in x[:5]) for x in found if len(x) >= 5])
    for t in (0.0, 3.0):
        assert math.exp(toxicity.log_tail(5, t)) == pytest.approx((sums >= t).mean(), rel=0.15)


def test_toxic_calibration_is_fitted(spark):
    m = toxicity.Model({"vile": 6.0}, {}, -1.0, 1.0)
    rng = np.random.default_rng(1)
    n = rng.integers(50, 3000, 4000)
    best = (np.log(0.05 * n) - np.log(-np.log(rng.random(4000)))) / 1.2
    got = toxicity.calibrate(m, [(int(a), max(float(b), 0.0)) for a, b in zip(n, best)])
    assert got.k == pytest.approx(0.05, rel=0.3) and got.rate == pytest.approx(1.2, rel=0.1)
    assert toxicity.calibrate(m, []) == m
    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    for half in (0, 1):
        model = toxicity.train(docs, lab.where(f"doc_id % 2 = {half}"))
        found = {r["doc_id"] for r in toxicity.score(docs, model).collect()}
        truth = lab.where(f"doc_id % 2 = {1 - half}").collect()
        bad, good = [r["doc_id"] for r in truth if r["toxic"] == 1], [r["doc_id"] for r in truth if r["toxic"] == 0]
        print(half, model.k, model.rate, sum(i in found for i in bad), len(bad), sum(i in found for i in good), len(good))
        assert 0 < model.k < 1 and sum(i in found for i in bad) > 0.92 * len(bad) and sum(i in found for i in good) <= 0.005 * len(good)


# -- 1, dimensions


def test_range_join_takes_every_dimension(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [3.0, 0.0, 0.0]), (6, [-1.0]), (7, [-2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in metric_join.range_join(df).collect()) == [(1, 2), (4, 5), (6, 7)]


# -- 1, links


def test_range_links_is_exact(spark):
    """One row for each id, with its links and class, against all pairs; equal vectors, ids of several vectors, and rounds of a few vectors."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12))
    x[200:240] = x[:40] + 0.08 * rng.normal(size=(40, 12))
    x[240:260] = x[3]
    x[260:265] = x[4] * np.linspace(0.5, 3, 5)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [*rows[:3], (3, x[7].tolist()), (250, x[9].tolist()), (999, x[9].tolist()), (999, x[250].tolist()), (900, None), (901, [0.0] * 12), (902, [1.0]), (903, [2.0]), (None, x[0].tolist())]
    y = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i is not None and v and any(v)]
    for real, least, how in (("double", 0.96, {}), ("double", 0.4, {"pivots": 5, "round_bytes": 4000}), ("float", 0.4, {"round_bytes": 800})):
        if real == "float":
            y = [(i, (z := np.array(v, np.float32).astype(float)) / np.linalg.norm(z)) for i, v in rows if i is not None and v and any(v)][:60]
        some = rows if real == "double" else rows[:60]
        links = collections.defaultdict(set)
        for (i, u), (j, v) in itertools.combinations(y, 2):
            if i != j and len(u) == len(v) and u @ v >= least - 1e-12:
                links[i].add(j)
                links[j].add(i)
        want = {i: i for i, _ in some if i is not None}
        for _ in want:
            want = {i: min([c, *(want[j] for j in links[i])]) for i, c in want.items()}
        df = spark.createDataFrame(some, f"vec_id long, embedding array<{real}>")
        got = metric_join.range_links(df, min_cosine=least, **how).collect()
        assert len(got) == len(want) and {r["id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (c, len(links[i])) for i, c in want.items()}


def test_range_links_awkward(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in metric_join.range_links(df).collect()) == [(i, i, 0) for i in (1, 2, 3, 4)]
    assert metric_join.range_links(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        metric_join.range_links(df, min_cosine=1.5)


def test_forest_keeps_components():
    rng = np.random.default_rng(1)
    for n in (1, 30, 400):
        a, b = rng.integers(0, 300, (2, n))
        x, y = metric_join.forest(a, b)
        root = {int(v): int(v) for v in {*a, *b}}
        for _ in range(300):
            for i, j in zip(a.tolist(), b.tolist()):
                root[i] = root[j] = min(root[i], root[j])
        assert {**{v: v for v in root}, **dict(zip(x.tolist(), y.tolist()))} == root


# -- 7, memory


def test_bpe_slices_are_small(monkeypatch):
    """Two workers share what an executor's heap leaves: what is remembered at once is bounded by the slice, not by the batch."""
    import pyarrow as pa

    monkeypatch.setattr(bpe, "REMEMBER", 1000)
    texts = [" ".join(f"{i:05d}" for i in range(a, a + 1000)) for a in range(0, 300_000, 1000)]
    batch, c, most = pa.record_batch([pa.array(range(300)), pa.array(texts)], names=["doc_id", "text"]), bpe.Codec(bpe.read_ranks()), 0
    for part in bpe.cut(batch, 1, bpe.CHARS):
        back, n = c.decode_column(*c.encode_column(part.column(1)))
        assert bytes(back).decode() == "".join(part.column(1).to_pylist())
        most = max(most, len(c.words.new) + len(c.words.old))
    assert most < 200_000
