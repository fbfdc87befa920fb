"""Clustering of quantised vectors and ranked search: brute force and edge cases."""

import hashlib
import math
import re
from collections import Counter

import numpy as np

from graphloam.llm import ranked_search as rs
from graphloam.llm import weighted_lloyd as wl

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lloyd(rows, count, rounds):
    """vec_id, cluster, distance of plain Lloyd over all rows, in Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())
    centroids = [list(q) for _, q in order[:count]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        for n in range(len(centroids)):
            mine = [q for (_, q), c in zip(kept, of) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((i, *near(q)[::-1]) for i, q in kept), centroids


def test_lloyd_against_plain_rounds_with_a_hot_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(300)] + [(1000 + i, [0.25, -0.5, 0.0, 1.0, -1.0, 0.1]) for i in range(150)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    expected, centroids = lloyd([(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows], 7, 4)
    out, got = wl.cluster(vectors, 7, 4, length=6)
    found = out.collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found) == expected and got.tolist() == centroids
    spread = Counter()
    for _, c, far in expected:
        spread[c] += far
    assert all(r.cluster_inertia == spread[r.cluster] and r.inertia == sum(spread.values()) for r in found)


def test_lloyd_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1e30, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (None, [0.0, -0.001])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as key", "2 as cluster", "3 as q")
    out, centroids = wl.cluster(vectors, 40, 5, length=2)
    assert sorted((r.vec_id or 0, r.distance) for r in out.collect()) == [(0, 0), (8, 0), (8, 0)] and len(centroids) == 3
    none, centroids = wl.cluster(vectors.limit(0), 40, 5, length=2)
    assert none.count() == 0 and len(centroids) == 0 and wl.digest(vectors).count() == 0


def test_large_components_are_exact():
    x = np.array([[400_000 * 256, -1], [400_000 * 256, 1]], np.int64)
    near, far = wl.assign(x, np.array([[-400_000 * 256, 0], [400_000 * 256, 0]]))
    assert near.tolist() == [1, 1] and far.tolist() == [1, 1]
    assert wl.assign(np.array([[0, 0]]), np.array([[3, 4], [4, 3]]))[0].tolist() == [0]


def ranked(docs, items, top):
    """Plain scores of every document for every item."""
    words = [WORD.findall((t or "").encode().lower()) for _, t in docs]
    n_docs, total = sum(map(bool, words)), sum(map(len, words))
    df = Counter(w for x in words for w in set(x))
    out = []
    for item, text in items:
        scores = []
        for (doc, _), x in zip(docs, words):
            tf, m, score = Counter(x), 100 - 50 + ((50 * len(x) * n_docs) // max(total, 1)), 0
            for w in set(WORD.findall((text or "").encode().lower())):
                if tf[w]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 20 * m))
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, rank + 1, s[2], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:top])]
    return sorted(out, key=str)


LONG = "x" * 3000
DOCS = [(1, None), (2, ""), (3, "...\n"), (4, "Alpha beta, ALPHA"), (5, "alpha beta alpha"), (5, "alpha beta alpha"), (None, "alpha beta alpha"), (6, f"{LONG} gamma"), (7, f"{LONG}y gamma été ÉTÉ"), (8, "delta " * 9000 + "beta"), (9, "été 9delta"), (10, "other words here")] + [(100 + i, f"common alpha{i % 3} w{i}") for i in range(80)]
ITEMS = [(1, "alpha BETA beta"), (2, None), (3, "!!"), (4, f"{LONG} été"), (4, "delta gamma"), (None, "common w5"), (6, "nowhere")]


def test_search_against_plain_scores_both_ways(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as item", "2 as n", "3 as score").repartition(5)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as word", "2 as item")
    expected = ranked(DOCS, ITEMS, 5)
    monkeypatch.setattr(rs, "SALTS", 3)
    for bounds in ({}, {"most_pairs": 0}, {"most_items": 1}):
        got = rs.search(docs, items, 5, **bounds)
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected
        assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
        assert rs.search(docs.limit(0), items, 5, **bounds).count() == 0 and rs.search(docs, items.limit(0), 5, **bounds).count() == 0


def test_blocks_of_entries_give_the_same_sums(monkeypatch):
    rng = np.random.default_rng(3)
    item, doc, impact = rng.integers(0, 70_000, 5000), rng.integers(0, 9, 5000), rng.integers(0, 1 << 40, 5000)
    keys = rng.integers(0, 1 << 45, 4000)
    assert (keys[rs.radix_order(keys)] == np.sort(keys)).all()
    got = list(zip(*(x.tolist() for x in rs.summed(item, doc, impact, 9))))
    plain = Counter()
    for i, d, v in zip(item.tolist(), doc.tolist(), impact.tolist()):
        plain[i, d] += v
    assert got == sorted((i, d, v) for (i, d), v in plain.items())


def test_equal_hashes_are_told_apart():
    words, order, hashes, checks, lengths = rs._vocabulary([b"abc", b"x" * 100])
    data = np.frombuffer(b"abd " + b"x" * 99 + b"y", np.uint8)
    good = rs._equal(data, np.array([0, 4]), np.array([3, 104]), np.array([0, 1]), words, checks, lengths)
    assert not good.any()
