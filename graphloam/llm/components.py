"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloam.llm.common import TASK_ROWS, settle


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node, component (the least node) for every node of ``edges`` (columns a, b of any ordered type).

    Each step hangs the neighbours of a node onto the least of them, which keeps the
    components and makes the trees flat; rounds grow with the logarithm of the longest path.
    Nodes stay in tables: the driver sees two counts a round. No round has many more edges than
    the first, so the steps keep as many tasks as that one has TASK_ROWS edges. Loops and
    nulls are left out.
    """
    edges = settle(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    tasks = max(1, -(-edges.count() // TASK_ROWS))
    seen = None
    for _ in range(most_rounds):
        edges = edges.coalesce(tasks)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.min("a")).alias("m")).coalesce(tasks)
        large = both.join(least, F.col("a") == F.col("u")).filter("b > u").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
        root = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).coalesce(tasks)
        small = large.join(root, F.col("a") == F.col("u"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(root.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = settle(small.filter("a <> b").coalesce(tasks).distinct().coalesce(tasks))
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == (now["n"], now["x"]):
            break
        seen = (now["n"], now["x"])
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
