"""Sharding by weighted rendezvous hashing, with DataFrame functions alone.

Every record key scores each shard with a hash of (key, shard), scaled by the shard's weight,
and goes to the best. A key's score for a shard depends on nothing else, so one more shard
takes rows only into itself and a removed shard gives its rows to all others by weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloam.llm.common import copies, id_text, running_start, settle


def _score(key: Column, shard: Column, weight: Column) -> Column:
    """-weight / ln(u) with u in (0, 1) from 52 bits of md5: the largest of these is a weighted draw."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, 13), 16, 10).cast("double")
    return -weight / F.ln((bits + 0.5) / float(1 << 52))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (int, from 0) of a string key among ``len(weights)`` shards; ties go to the larger number."""
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    scored = F.transform(shards, lambda s: F.struct(_score(key, s["shard"], s["weight"]).alias("score"), s["shard"].alias("shard")))
    return F.array_max(scored)["shard"]


def regrown(key: Column, weights: list[float], shard: Column, extra_weight: float) -> Column:
    """The key's shard once a shard of ``extra_weight`` is added: its own, or the new one."""
    at = lambda i, w: _score(key, i, w)
    own = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), shard + 1)
    new = F.lit(len(weights))
    return F.when(at(new, F.lit(float(extra_weight))) >= at(shard, own), new).otherwise(shard)


def assign_shards(df: DataFrame, keys: list[str], weights: list[float], column: str = "shard") -> DataFrame:
    """Add the shard of each row. Narrow: no row moves.

    Rows with equal keys share a shard. A null key is a key like any other. A column of the
    same name as ``column`` is replaced; other columns stay.
    """
    return df.withColumn(column, rendezvous(F.concat_ws("\x1f", *[id_text(df[k]) for k in keys]), weights))


def shard_layout(docs: DataFrame, weights: list[float], grown_weight: float = 1.0, bucket_digits: int = 3) -> DataFrame:
    """One row for each document: its shard, its slot there, and its shard if there were one more.

    Slots count from 0 without gaps in the order of a hash of doc_id, size and checksum. Shards
    are scored where the texts are read. Equal rows are counted before the shuffle and expanded
    after their slots are known, so a row that a third of all rows repeat is one row on the way,
    and rows of one doc_id with different texts are dealt to many buckets. A null text has no
    bytes: size 16, checksum 0. A null doc_id is a key of its own. Columns beside doc_id and
    text are ignored.
    """
    rows = docs.select(F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"))
    key = id_text(F.col("doc_id"))
    scored = rows.withColumn("shard", rendezvous(key, weights))
    scored = scored.withColumn("grown_shard", regrown(key, weights, F.col("shard"), grown_weight))
    counted = settle(scored.groupBy("doc_id", "size", "text_crc32", "shard", "grown_shard").agg(F.count("*").alias("_n")))
    placed = counted.withColumn("_h", F.md5(F.concat_ws(":", key, F.col("size").cast("string"), F.col("text_crc32").cast("string"))))
    placed = running_start(placed.withColumn("_bucket", F.substring("_h", 1, bucket_digits)), ["shard"], "_bucket", ["_h", "size", "text_crc32"], "_n", "_from")
    many = copies(placed, "_n", "_i")
    return many.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), (F.col("_from") + F.col("_i")).alias("slot"), F.col("grown_shard").cast("int"))
