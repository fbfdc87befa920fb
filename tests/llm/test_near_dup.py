import random
import re

import pytest

from graphloam.llm import near_dup as nd
from graphloam.llm.common import table


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())


def alike(x, y):
    """Whether the edit distance of two lists of words is at most a fifth of the longer one: by the whole table, row by row."""
    import numpy as np

    code = {w: i for i, w in enumerate({*x, *y})}
    a, b = np.array([code[w] for w in x]), np.array([code[w] for w in y])
    shared = sum(min(x.count(w), y.count(w)) for w in set(x) & set(y)) if len(x) < 400 else len(a)
    if max(len(a), len(b)) - shared > 0.2 * max(len(a), len(b)) + 1e-9:
        return False  # so many words have no partner at all
    row, places = np.arange(len(b) + 1), np.arange(len(b) + 1)
    for i, w in enumerate(a, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (b != w))
        row = np.minimum.accumulate(np.concatenate([[i], new]) - places) + places
    return row[-1] <= 0.2 * max(len(a), len(b)) + 1e-9


def brute_force(rows):
    """Classes of (doc_id, text) by all pairs."""
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    toks = [(d, words(t) or [b"\0" + t.encode()]) for d, t in rows]
    for i, (a, x) in enumerate(toks):
        for b, y in toks[i + 1 :]:
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and alike(x, y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: root(d) for d, _ in rows}


def test_banded_distance_is_the_distance():
    rng = random.Random(3)
    for _ in range(3000):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.randint(0, 4)] * rng.randint(0, 1)
        most = rng.randint(0, 8)
        assert nd.banded_distance(a, b, most) == min(nd.distance(a, b), most + 1)


def test_long_texts_align_as_short_ones_do(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(nd, "PLACES", 3)
    for _ in range(400):
        a = [rng.randint(0, 9) for _ in range(rng.randint(0, 60))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randint(0, 9)):
            b.insert(rng.randint(0, len(b)), rng.randint(0, 9))
        most = rng.randint(0, 20)
        assert nd.banded_distance(a, b, most) == min(nd.distance(a, b), most + 1)


def test_two_very_long_texts_need_little_memory():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    a = list(range(100_000))
    b = [x if x % 7 else -x for x in a]
    assert nd.banded_distance(a, b, 20_000) == len([x for x in a if x and x % 7 == 0])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB


def test_blocks_of_any_size_give_the_same_pairs(spark, monkeypatch):
    rng = random.Random(21)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(120):
        text = list(base)
        for i in rng.sample(range(60), 14):
            text[i] = f"t{d // 2}x{i}" if rng.random() < 0.8 else f"u{d}x{i}"
        rows.append((d, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows)
    for size in (4, 1024):
        monkeypatch.setattr(nd, "BLOCK", size)
        monkeypatch.setattr(nd, "WORD_BLOCK", size)
        assert {r.doc_id: r.class_id for r in nd.near_duplicate_groups(docs).collect()} == want


def test_classes_are_those_of_all_pairs(spark, sf):
    docs = table(spark, sf, "documents")
    expected = brute_force([(r.doc_id, r.text) for r in docs.collect()])
    found = {r.doc_id: r.class_id for r in nd.near_duplicate_groups(docs).collect()}
    assert found == expected
    kept = [r.doc_id for r in nd.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(expected.values()))


def test_sketches_agree_more_for_smaller_edits():
    import numpy as np

    rng = np.random.default_rng(1)
    text = rng.integers(1, 2**60, 300, dtype=np.uint64)
    few, many = text.copy(), text.copy()
    few[::60] += np.uint64(1)
    many[::8] += np.uint64(1)
    moved = np.concatenate([text[150:], text[:150]])
    same = lambda x: int((nd.sketch(text) == nd.sketch(x)).sum())
    assert same(text) == nd.ENTRIES > same(few) > same(many)
    assert same(moved) < nd.ENTRIES  # the order counts


@pytest.mark.parametrize("extra", [False, True])
def test_nulls_empties_ties_and_long_texts(spark, extra):
    long = " ".join(f"w{i % 997}x{i}" for i in range(40_000))
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "..."), (6, "one"), (6, "one"), (7, "ONE!"), (None, "one"), (8, long), (9, long.replace("w5x", "v5x")), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        docs = docs.selectExpr("doc_id", "text", "1 as node", "2 as entries", "3 as _id")
    found = {(r.doc_id, r.class_id, r.class_size) for r in nd.near_duplicate_groups(docs).collect()}
    assert found == {(1, 1, 1), (2, 2, 1), (3, 3, 2), (4, 3, 2), (5, 5, 1), (6, 6, 4), (7, 6, 4), (None, 6, 4), (8, 8, 2), (9, 8, 2), (None, None, 1)}
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 3), (False, 5), (False, 6), (False, 8), (True, 0)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicate_groups(docs).count() == 0 and nd.keep_one(docs).count() == 0


def test_a_group_of_near_copies_stays_together(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(300):
        text = list(base)
        for _ in range(6):
            text[rng.randrange(200)] = f"z{rng.randrange(10**6)}"
        rows.append((d, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in nd.near_duplicate_groups(docs).collect()} == {0}


def test_pairs_inside_a_large_template_are_found(spark):
    # texts about 0.7 alike among themselves, and in them pairs about 0.82 alike: most have no link to a representative
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(150):
        text = list(base)
        for i in rng.sample(range(100, 120), 20) + rng.sample(range(100), 16):
            text[i] = f"t{d}x{i}"
        other = list(text)
        for i in rng.sample(range(120), 20):
            other[i] = f"o{d}x{i}"
        rows += [(2 * d, " ".join(text)), (2 * d + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in nd.near_duplicate_groups(docs).collect()} == brute_force(rows)


def test_recall_of_planted_pairs(spark):
    rng = random.Random(11)
    rows = []
    for d in range(600):
        n = rng.randint(60, 240)
        text = [f"a{d}x{i}" for i in range(n)]
        other = list(text)
        for i in rng.sample(range(n), int(n * (0.2, 0.15, 0.1)[d % 3])):
            other[i] = f"b{d}x{i}"
        rows += [(2 * d, " ".join(text)), (2 * d + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in nd.near_duplicate_groups(docs).collect()}
    got = [[found[2 * d + 1] == 2 * d for d in range(k, 600, 3)] for k in range(3)]
    assert sum(got[0]) >= 0.93 * 200 and sum(got[1]) >= 198 and sum(got[2]) == 200


def test_short_texts_are_found_exactly(spark):
    rng = random.Random(13)
    rows = [(0, "a b c d e"), (1, "a b x c d e"), (2, "f g h i j k l m n o"), (3, "f g h i x k l m n o")]
    for d in range(400):
        n = rng.randint(2, 100)
        text = [f"a{d}x{rng.randrange(120)}" for _ in range(n)]
        other = list(text)
        for _ in range(n // 5):
            at = rng.randrange(n)
            other[at : at + rng.randint(0, 1)] = [f"b{d}x{at}"] * rng.randint(0, 1)
        rows += [(2 * d + 10, " ".join(text)), (2 * d + 11, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    short = {d for d, t in rows if len(t.split()) <= nd.SHORT}
    want, found = brute_force(rows), {r.doc_id: r.class_id for r in nd.near_duplicate_groups(docs).collect()}
    assert {d: found[d] for d in short} == {d: want[d] for d in short}
