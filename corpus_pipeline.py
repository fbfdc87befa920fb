"""The corpus pipeline: documents through five operators, from language to shards.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept. All but the
last return the columns of documents. The stages write nothing themselves; ``run`` stores the
rows between them in the checkpoint folder, so that each stage starts from a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloam.llm import decontaminate, lang_id, mixing, near_dup, sharding
from graphloam.llm.common import table
from graphloam.session import stored

SHARDS = 40


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language. Null texts, texts without letters, junk and other languages go; an empty table stays empty."""
    return lang_id.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least doc_id. Null texts are alone; of repeated rows one stays."""
    return near_dup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null and empty texts have none."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each time they are taken. Texts without words are never taken; repeated rows count each."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document of the mix; a null doc_id is a key of its own."""
    return sharding.shard_layout(docs, [1.0] * SHARDS)


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL can express neither the Bloom filters of the first stage nor the sketches of the second.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


__all__ = ["ORACLE_SQL", "STAGES", "run"]
