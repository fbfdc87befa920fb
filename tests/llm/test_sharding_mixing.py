import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from graphloam.llm import mixing, sharding
from graphloam.llm.common import table

EDGE = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "z", "b"), (None, "z", "b"), (4, "ü " * 5000, "b"), (5, "one two three", "c")]


def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, source string").selectExpr("*", "1 as _h", "2 as shard", "length(text) as n_chars")


def test_shards_move_rows_only_into_the_new_one(spark, sf):
    docs = table(spark, sf, "documents")
    rows = sharding.shard_layout(docs, [1.0] * 40).collect()
    assert len(rows) == docs.count()
    assert all(r.grown_shard in (r.shard, 40) for r in rows)
    again = {r.doc_id: r.shard for r in sharding.shard_layout(docs, [1.0] * 41).collect()}
    assert all(again[r.doc_id] == r.grown_shard for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    crc = {r.doc_id: (len(r.text.encode()) + 16, zlib.crc32(r.text.encode())) for r in docs.collect()}
    assert all(crc[r.doc_id] == (r["size"], r.text_crc32) for r in rows)


def test_weights_share_keys(spark):
    keys = spark.range(20_000).selectExpr("id as doc_id")
    counts = Counter(r.shard for r in sharding.assign_shards(keys, ["doc_id"], [1.0, 2.0, 5.0]).select("shard").collect())
    assert abs(counts[2] / 20_000 - 5 / 8) < 0.02 and abs(counts[0] / 20_000 - 1 / 8) < 0.02


def test_shard_edges(spark):
    rows = sharding.shard_layout(edge(spark), [1.0] * 40).collect()
    assert len(rows) == len(EDGE)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.shard)
        assert (r["size"], r.text_crc32) == ((16, 0) if r.doc_id in (1, 2) else (r["size"], r.text_crc32))
    assert all(len(s) == 1 for s in by.values())
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert sharding.shard_layout(edge(spark).limit(0), [1.0] * 40).count() == 0


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Water filling, step by step as it is defined."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = sum(weight[s] for s in names if s not in capped)
        goal = {s: capped[s] if s in capped else rest * weight[s] / free for s in names}
        over = [s for s in names if s not in capped and goal[s] > 3 * sizes[s]]
        if not over:
            return goal
        capped |= {s: 3 * sizes[s] for s in over}


def test_mix_meets_targets(spark, sf):
    docs = table(spark, sf, "documents")
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += words(r.text)
    goal, taken = targets(sizes), Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"] and abs(r.target - goal[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - goal[s]) <= 16 for s in goal)
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())


def test_each_shard_gets_the_blocks_of_its_quota(spark, sf):
    docs = table(spark, sf, "documents")
    for shards in (1, 8):
        rows = mixing.mix(docs, shards=shards).collect()
        got = Counter()
        for r in rows:
            assert sum(r.shard_words) == r.taken and min(r.shard_words) >= 0
            for s, n in enumerate(r.shard_words):
                got[r.source, s] += n
        plan = mixing.source_targets(mixing.sized(docs).select("source", (F.col("size") * F.col("_n")).alias("size")))
        sizes = {r.source: r.source_size for r in plan.collect()}
        for r in mixing.shard_quotas(plan, 16, shards).collect():
            assert got[r.source, r.shard] == min(r.upto * 16, 3 * sizes[r.source]) - min((r.upto - r.blocks) * 16, 3 * sizes[r.source])


def test_many_equal_rows_are_mixed_as_others_are(spark):
    docs = spark.createDataFrame([(1, "one two three", "a")] * 700 + [(i, f"w{i} x", "ab"[i % 2]) for i in range(2, 300)] + [(1, "one two three", None)], "doc_id long, text string, source string").repartition(5)
    rows = mixing.mix(docs).collect()
    assert len(rows) == 999 and sorted(r.copy for r in rows if r.doc_id == 1 and r.source == "a") == list(range(700))
    assert sum(words(r.text) for r in mixing.mixed_documents(docs).collect()) == sum(r.taken for r in rows)


def test_quotas_of_many_sources(spark):
    import random

    rng = random.Random(8)
    sizes = {f"s{i:03}": rng.choice((0, 1, 5, 50, 5000)) for i in range(60)}
    plan = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long"))
    goal = targets(sizes)
    seats = sorted((-goal[s] / (2 * k + 1), s, k) for s in sizes for k in range(3000) if goal[s] > 0)
    for r in mixing.shard_quotas(plan, 16, 3).collect():
        house = round(sum(sizes.values()) / 16) * (r.shard + 1) // 3
        assert r.upto == sum(s == r.source for _, s, _ in seats[:house])


def test_quotas_are_those_of_the_highest_quotients(spark):
    sizes = {"a": 1000, "b": 333, "c": 90, "d": 7, None: 40}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    plan = mixing.source_targets(rows)
    quota = defaultdict(list)
    for r in mixing.shard_quotas(plan, 10, 4).orderBy("shard").collect():
        quota[r.source].append(r.blocks)
    goal = targets(sizes)
    seats = sorted(((-goal[s] / (2 * k + 1), s or "~", k) for s in sizes for k in range(200)))[: round(sum(sizes.values()) / 10)]
    assert {s: sum(q) for s, q in quota.items()} == {s: sum((s or "~") == x for _, x, _ in seats) for s in sizes}
    assert all(q >= 0 for v in quota.values() for q in v)


def test_mixed_documents_hold_the_words_taken(spark, sf):
    docs = table(spark, sf, "documents")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += words(r.text)
    assert got == Counter({r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken})


def test_mix_edges(spark):
    docs = edge(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(EDGE) and all(r.taken <= 3 * r["size"] for r in rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(words(r.text) for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0
    assert mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0
