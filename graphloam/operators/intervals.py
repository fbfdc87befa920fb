"""Joins and windows over ranges of lines: inclusive on both ends, within a key such as a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines in a bucket of a range join.
BUCKET = 64


def buckets(start: Column, end: Column, width: int = BUCKET) -> Column:
    """The numbers of the buckets that a range touches."""
    return F.sequence(F.floor(start / width), F.floor(end / width))


def point_in_range(points: DataFrame, ranges: DataFrame, key: str, point: str, start: str, end: str, width: int = BUCKET) -> DataFrame:
    """Pairs of a point and a range of the same key that holds it.

    An equi-join by (key, bucket): a range goes to each bucket it touches, a point to its own,
    so no pair is found twice and a long file is spread over as many keys as it has buckets.
    """
    left = points.withColumn("_b", F.floor(F.col(point) / width))
    right = ranges.withColumn("_b", F.explode(buckets(F.col(start), F.col(end), width)))
    return left.join(right, [key, "_b"]).filter(F.col(point).between(F.col(start), F.col(end))).drop("_b")


def overlapping(left: DataFrame, right: DataFrame, key: str, l_start: str, l_end: str, r_start: str, r_end: str, width: int = BUCKET) -> DataFrame:
    """Pairs of overlapping ranges of the same key, each once: in the first bucket that both touch."""
    a = left.withColumn("_b", F.explode(buckets(F.col(l_start), F.col(l_end), width)))
    b = right.withColumn("_b", F.explode(buckets(F.col(r_start), F.col(r_end), width)))
    first = F.floor(F.greatest(F.col(l_start), F.col(r_start)) / width)
    meet = (F.col(l_start) <= F.col(r_end)) & (F.col(l_end) >= F.col(r_start)) & (F.col("_b") == first)
    return a.join(b, [key, "_b"]).filter(meet).drop("_b")


def innermost(points: DataFrame, ranges: DataFrame, key: str, point: str, ids: list[str], start: str = "start_line", end: str = "end_line", depth: str | None = None, order: str | None = None) -> DataFrame:
    """For each point (named by ``ids`` and ``point``) the smallest range around it.

    On equal spans the deeper range wins, then the later one. One aggregate, no sort of pairs.
    """
    found = point_in_range(points, ranges, key, point, start, end)
    rank = F.struct((F.col(start) - F.col(end)).alias("small"), (F.col(depth) if depth else F.lit(0)).alias("deep"), (F.col(order) if order else F.lit(0)).alias("late"))
    others = [c for c in ranges.columns if c != key]
    best = F.max(F.struct(rank.alias("_rank"), *others)).alias("_best")
    return found.groupBy(*ids, key, point).agg(best).select(*ids, key, point, *[F.col(f"_best.{c}").alias(c) for c in others])


def innermost_all(points: DataFrame, ranges: DataFrame, key: str, point: str, ids: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Every range of the least span around each point."""
    found = point_in_range(points, ranges, key, point, start, end)
    rank = F.rank().over(Window.partitionBy(*ids, key, point).orderBy(F.col(end) - F.col(start)))
    return found.withColumn("_r", rank).filter("_r = 1").drop("_r")


def merge_ranges(ranges: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Ranges that share a line made one; ranges that only touch stay apart."""
    by = Window.partitionBy(*keys).orderBy(start, F.desc(end))
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.withColumn("_new", F.coalesce((F.col(start) > before).cast("int"), F.lit(1)))
    islands = islands.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop("_island")


def clusters(points: DataFrame, keys: list[str], point: str, gap: int = 3) -> DataFrame:
    """Runs of points whose neighbours are at most ``gap`` apart: first, last, count."""
    by = Window.partitionBy(*keys).orderBy(point)
    marked = points.withColumn("_new", F.coalesce((F.col(point) - F.lag(point).over(by) > gap).cast("int"), F.lit(1)))
    marked = marked.withColumn("_run", F.sum("_new").over(by))
    return marked.groupBy(*keys, "_run").agg(F.min(point).alias("first"), F.max(point).alias("last"), F.count("*").alias("n")).drop("_run")


def frame_depth(frames: DataFrame, key: str, frame: str, start: str, end: str) -> DataFrame:
    """How many other frames of the same key hold each frame; of equal frames the one with the smaller name holds the others."""
    inner = frames.select(key, F.col(frame), F.col(start).alias("_s"), F.col(end).alias("_e"))
    outer = frames.select(key, F.col(frame).alias("_of"), F.col(start).alias("_os"), F.col(end).alias("_oe"))
    meets = overlapping(inner, outer, key, "_s", "_e", "_os", "_oe")
    holds = (F.col("_os") <= F.col("_s")) & (F.col("_oe") >= F.col("_e")) & (F.col("_of") != F.col(frame))
    wider = (F.col("_oe") - F.col("_os") > F.col("_e") - F.col("_s")) | (F.col("_of") < F.col(frame))
    return meets.groupBy(key, frame).agg(F.sum((holds & wider).cast("long")).alias("depth"))


def dedup_number(rows: DataFrame, keys: list[str], path: str, order: list[Column]) -> DataFrame:
    """``path`` with ~n for the n-th row of the same keys and path."""
    n = F.row_number().over(Window.partitionBy(*keys, path).orderBy(*order))
    return rows.withColumn("_n", n).withColumn(path, F.when(F.col("_n") > 1, F.concat(F.col(path), F.lit("~"), F.col("_n").cast("string"))).otherwise(F.col(path))).drop("_n")


def assign_parent(symbols: DataFrame, file: str = "file", ident: str = "id", start: str = "start_line", end: str = "end_line") -> DataFrame:
    """id, parent: the innermost other range around each range of its file; ties go to the larger id before it."""
    inner = symbols.select(file, F.col(ident), F.col(start).alias("_s"), F.col(end).alias("_e"))
    outer = symbols.select(file, F.col(ident).alias("_of"), F.col(start).alias("_os"), F.col(end).alias("_oe"))
    inside = (F.col("_os") <= F.col("_s")) & (F.col("_oe") >= F.col("_e")) & (F.col("_of") != F.col(ident)) & ((F.col("_oe") - F.col("_os") > F.col("_e") - F.col("_s")) | (F.col("_of") < F.col(ident)))
    best = F.max(F.when(inside, F.struct((F.col("_os") - F.col("_oe")).alias("a"), F.col("_of").alias("of"))))
    return overlapping(inner, outer, file, "_s", "_e", "_os", "_oe").groupBy(file, ident).agg(best["of"].alias("parent"))
