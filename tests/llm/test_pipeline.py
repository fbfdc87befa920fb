"""The corpus pipeline: every stage on odd tables, and the whole of it against a plain version."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from graphloam.llm.common import table
from test_near_dup import brute_force
from test_sharding_mixing import targets, words
from test_texts import WORD


def grams_of(text):
    found = [w.decode() for w in WORD.findall((text or "").encode().lower())]
    return found, {tuple(found[i : i + 10]) for i in range(len(found) - 9)}


def plain_mix(rows):
    """(doc_id, number of words) of every document or piece that the mix takes, by walking the ring of each source word by word."""
    sizes = Counter()
    for r in rows:
        sizes[r.source] += words(r.text)
    goal = targets(sizes)
    rank = {s: i for i, s in enumerate(sorted(s for s in sizes if s is not None))}
    seats = sorted((-goal[s] / (2 * k + 1), rank[s], k, s) for s in sizes if goal[s] > 0 for k in range(int(goal[s] / 16) + 100))
    quota = Counter(s for *_, s in seats[: int(sum(sizes.values()) / 16 + 0.5)])
    out = []
    for source, size in sizes.items():
        if not size:
            continue
        mine = [r for r in rows if r.source == source]
        mine.sort(key=lambda r: (hashlib.md5(f"20:{r.doc_id}:{zlib.crc32((r.text or '').encode())}".encode()).hexdigest(), words(r.text)))
        ring = [r.doc_id for r in mine for _ in range(words(r.text))]
        start = zlib.crc32(f"start:20:{source}".encode()) % math.ceil(size / 16) * 16
        taken = min(quota[source] * 16, 3 * size)
        rounds, rest = divmod(taken, size)
        got = Counter(ring[(start + i) % size] for i in range(rest))
        out += [(r.doc_id, words(r.text) * rounds + got[r.doc_id]) for r in mine]
    return {d: n for d, n in out if n}


def shard_of(doc_id, shards=40):
    score = lambda s: -1 / math.log((int(hashlib.md5(f"{doc_id}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
    return max(range(shards), key=lambda s: (score(s), s))


def test_the_whole_against_a_plain_version(spark, sf):
    docs = table(spark, sf, "documents").collect()
    spoken = [r for r in docs if r.text and any(c.isalpha() for c in r.text)]  # the languages of these tables are all learned
    classes = brute_force([(r.doc_id, r.text) for r in spoken])
    single = [r for r in spoken if classes[r.doc_id] == r.doc_id]
    items = [grams_of(r.text) for r in table(spark, sf, "benchmark").collect()]
    windows = {g for _, x in items for g in x}
    short = [w for w, _ in items if 0 < len(w) < 10]

    def clean(text):
        found, mine = grams_of(text)
        return not mine & windows and not any(found[i : i + len(s)] == s for s in short for i in range(len(found)))

    kept = [r for r in single if clean(r.text)]
    want = plain_mix(kept)
    at = table(spark, sf, "documents")
    for (name, stage), left in zip(cp.STAGES[:-1], (spoken, single, kept, None), strict=True):
        out = stage(spark, at, sf)
        assert out.columns == at.columns, name
        at = out.cache()
        if left is not None:
            assert sorted(r.doc_id for r in at.collect()) == sorted(r.doc_id for r in left), name
    got = Counter()
    for r in at.collect():
        got[r.doc_id] += words(r.text)
    assert got == want
    rows = cp.run(spark, sf).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in at.collect())
    assert all(r.shard == shard_of(r.doc_id) for r in rows)
    for shard in {r.shard for r in rows}:
        mine = sorted(r.slot for r in rows if r.shard == shard)
        assert mine == list(range(len(mine)))


ROWS = [
    (1, None, "en", "web"), (2, "", "en", "web"), (3, "the and of that with this from", "en", "web"), (3, "the and of that with this from", "en", "web"), (None, "the and of that with this from", None, None),
    (4, "123 ...", "en", "news"), (5, "word " * 60_000, "en", "news"), (6, "one more text of words that are not those of others", None, None), (None, None, None, None),
]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_on_odd_tables(spark, sf, name):
    stage = dict(cp.STAGES)[name]
    plain = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    for column in ("node", "_h", "score", "shard", "size", "hits", "copy"):
        plain = plain.withColumn(column, F.lit("kept"))
    for docs in (plain, plain.limit(0), plain.withColumn("text", F.lit(None).cast("string"))):
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name != "sharding":
            assert out.columns == docs.columns and all(r.node == "kept" and r["_h"] == "kept" for r in rows)
        else:
            assert len(rows) == docs.count()
        if name == "near_duplicates" and docs is plain:
            assert Counter((r.doc_id is None, r.text is None) for r in rows)[True, True] == 1 and sum(r.text == "the and of that with this from" for r in rows) == 1
        if name == "decontamination":
            assert len(rows) == docs.count()  # nothing of the benchmark is in these
