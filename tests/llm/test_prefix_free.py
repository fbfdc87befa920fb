"""Repeated passages by prefix-free parsing against brute force over all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from graphloam.llm import prefix_free as pf
from graphloam.llm.common import table


def covered(texts, length):
    """For each text a byte of 1 for each byte under a window that starts more than once."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        marks = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                marks[i : i + length] = b"\1" * length
        out.append(bytes(marks))
    return out


def row(doc, text, marks):
    data = (text or "").encode()
    kept = bytes(b for b, m in zip(data, marks) if not m)
    return doc, len(data), sum(marks), sum(1 for i, m in enumerate(marks) if m and not (i and marks[i - 1])), hashlib.sha256(kept).hexdigest()


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("n,length,phrase,widths", [(300, 40, 8, 11), (39, 40, 8, 11), (40, 40, 8, 11), (500, 40, 16, 40), (300, 24, 4, 2), (3000, 400, 64, 134)])
def test_every_window_has_one_place(n, length, phrase, widths):
    rng = np.random.default_rng(n)
    for letters in (1, 2, 26):
        data, starts = bytes(rng.integers(97, 97 + letters, n).astype(np.uint8)), []
        for first, last, place in pf.places(data, length, phrase, widths):
            pos, bucket, least, most = place >> 32, place >> 28 & 15, place >> 14 & 0x3FFF, place & 0x3FFF
            if bucket == 15:
                starts.append(pos)
            else:
                starts += [pos - d for d in range(least, most + 1)]
                a, b = pf.core_of(place, length, widths)
                assert first <= a < b <= last and first >= 0 and last <= n
        assert sorted(starts) == list(range(max(0, n - length + 1)))


def test_triggers_do_not_depend_on_what_is_before(monkeypatch):
    data = np.random.default_rng(5).integers(0, 256, 3_000_000).astype(np.uint8).tobytes()
    all_of = pf.triggers(data)
    cut = 1_234_567
    assert (pf.triggers(data[cut:]) + cut == all_of[all_of >= cut]).all()
    assert 55 < len(data) / len(all_of) < 75


def test_runs_in_both_orders_are_equal_windows():
    rng, widths = np.random.default_rng(7), 9
    many = 400
    group = np.sort(rng.integers(0, 12, many))
    pieces = [bytes(rng.integers(0, 2, rng.integers(0, widths)).astype(np.uint8)) for _ in range(2 * many)]
    left, right, weight = pieces[:many], pieces[many:], rng.integers(1, 3, many)
    got = pf.repeats(group, left, right, weight, widths)
    for u in range(widths):
        v = widths - 1 - u
        keys = [(int(g), x[len(x) - u :], y[:v]) if len(x) >= u and len(y) >= v else None for g, x, y in zip(group, left, right)]
        total = Counter()
        for k, w in zip(keys, weight):
            total[k] += int(w)
        assert got[:, u].tolist() == [k is not None and total[k] >= 2 for k in keys]


def made_texts():
    """Copies, near copies, passages of about the length in other surroundings, runs of one letter, overlaps of a text with itself."""
    rng = np.random.default_rng(11)
    letters = lambda n: "".join(rng.choice(list("abcdé ü"), n))
    base = [letters(rng.integers(0, 400)) for _ in range(30)]
    texts = base + [base[3], base[3], base[3], None, "", "a" * 39, "a" * 40, "a" * 41, "a" * 300, "ab" * 100, "ab" * 60]
    for n in (36, 38, 39, 40, 41, 45, 60, 90):
        passage = letters(n)
        texts += [letters(rng.integers(0, 30)) + passage + letters(rng.integers(0, 30)) for _ in range(3)]
    for x in base[:15]:
        y = list(x)
        for _ in range(len(y) // 60):
            y[rng.integers(len(y))] = "z"
        texts.append("".join(y))
    hot = letters(70)
    return texts + [letters(3) + hot + letters(3) for _ in range(60)]


@pytest.mark.parametrize("parts", [{}, {"most_members": 2}, {"phrase": 16, "widths": 7}])
def test_against_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(pf, "HOT_ROWS", 5)
    monkeypatch.setattr(pf, "BLOCK", 20)
    texts = made_texts()
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as hash", "1 as spans", "2 as id", "3 as _whole").repartition(6)
    parts = {"phrase": 8, "widths": 11} | parts
    expected = sorted((row(d, t, m) for (d, t), m in zip(rows, covered(texts, 40))), key=key)
    assert any(0 < r[2] < r[1] for r in expected)
    assert sorted((tuple(r) for r in pf.digest(docs, 40, **parts).collect()), key=key) == expected
    out = pf.remove_repeats(docs, 40, **parts)
    assert out.columns == ["doc_id", "text", "hash", "id", "_whole", "n_bytes", "spans", "kept"]


def test_texts_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(pf, "BROADCAST_ROWS", 1)
    texts = made_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    expected = sorted(row(d, t, m) for (d, t), m in zip(enumerate(texts), covered(texts, 40)))
    assert sorted(tuple(r) for r in pf.digest(docs, 40, phrase=8, widths=11).collect()) == expected


def test_no_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, pf.digest(docs).collect())) == [(1, 0, 0, 0, empty), (2, 0, 0, 0, empty)]
    assert pf.digest(docs.limit(0)).count() == 0


def test_production_length_over_the_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = sorted(row(d, t, m) for (d, t), m in zip(rows, covered([t for _, t in rows], 400)))
    assert sorted(map(tuple, pf.digest(docs).collect())) == expected
