"""A view of a graph: arrows between included elements, stubs to what lies outside."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloam.session import settle_round as settle


def common_or_mixed(column: str) -> Column:
    """The one value of a group, or 'mixed'."""
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise("mixed")


def better_resolution(column: str) -> Column:
    """precise if any row is."""
    return F.when(F.max((F.col(column) == "precise").cast("int")) == 1, "precise").otherwise("heuristic")


def ends(refs: DataFrame, reps: DataFrame) -> DataFrame:
    """References with the element that stands for each end (columns a and b, null outside)."""
    a = reps.select(F.col("node").alias("src"), F.col("rep").alias("a"))
    b = reps.select(F.col("node").alias("dst"), F.col("rep").alias("b"))
    return refs.join(a, "src", "left").join(b, "dst", "left")


def project(refs: DataFrame, reps: DataFrame, nested: DataFrame | None = None) -> DataFrame:
    """kind, a, b, n, resolution: the arrows of a view.

    References inside one element are dropped unless they are a call of that very element by
    itself. ``nested`` (inner, outer) names pairs of drawn elements of which one holds the
    other; arrows between those are dropped.
    """
    found = ends(refs, reps).filter("a is not null and b is not null")
    found = found.filter("a <> b or (src = dst and src = a)")
    out = found.groupBy("kind", "a", "b").agg(F.count("*").alias("n"), common_or_mixed("resolution").alias("resolution"))
    if nested is not None:
        pairs = nested.select(F.col("inner").alias("a"), F.col("outer").alias("b"))
        pairs = pairs.union(pairs.select("b", "a")).distinct()
        out = out.join(pairs, ["a", "b"], "left_anti")
    return out


def stubs(refs: DataFrame, reps: DataFrame, targets: DataFrame) -> DataFrame:
    """direction, inside, ghost, n, kinds: references with one end in the view.

    ``targets`` (node, ghost) names the outside element that stands for each node outside; an
    outside end without one is dropped.
    """
    found = ends(refs, reps).filter("(a is null) <> (b is null)")
    found = found.select(F.when(F.col("a").isNotNull(), "out").otherwise("in").alias("direction"), F.coalesce("a", "b").alias("inside"), F.when(F.col("a").isNotNull(), F.col("dst")).otherwise(F.col("src")).alias("node"), "kind")
    return found.join(targets, "node").groupBy("direction", "inside", "ghost").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("kind")).alias("kinds"))


def plan_stubs(found: DataFrame, mode: str = "top", most: int = 8) -> DataFrame:
    """Stubs with at most ``most`` ghosts; the rest fold into more:in and more:out.

    Ghosts are ranked by their references, most first, names decide ties. Mode `all` keeps
    every ghost, `none` keeps no stub.
    """
    if mode == "none":
        return found.limit(0)
    if mode == "all":
        return found
    found = settle(found)  # a row for each box and outside element; the references behind it are read once
    totals = found.groupBy("ghost").agg(F.sum("n").alias("_total"))
    kept = totals.orderBy(F.desc("_total"), "ghost").limit(most).select("ghost", F.lit(True).alias("_keep"))
    named = found.join(F.broadcast(kept), "ghost", "left").withColumn("ghost", F.when(F.col("_keep"), F.col("ghost")).otherwise(F.concat(F.lit("more:"), "direction")))
    return named.groupBy("direction", "inside", "ghost").agg(F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))


def ghosts(planned: DataFrame) -> DataFrame:
    """ghost, n, direction: in, out or both."""
    way = F.when(F.min("direction") == F.max("direction"), F.min("direction")).otherwise("both")
    return planned.groupBy("ghost").agg(F.sum("n").alias("n"), way.alias("direction"))


def ghost_targets(refs: DataFrame, reps: DataFrame, targets: DataFrame, most: int = 5) -> DataFrame:
    """ghost, node, n, rank: the outside elements behind each ghost, most references first."""
    found = ends(refs, reps).filter("(a is null) <> (b is null)").select(F.when(F.col("a").isNotNull(), F.col("dst")).otherwise(F.col("src")).alias("node"))
    counted = found.groupBy("node").agg(F.count("*").alias("n")).join(targets, "node")
    rank = F.row_number().over(Window.partitionBy("ghost").orderBy(F.desc("n"), "node"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= most)


def matrix(arrows: DataFrame) -> DataFrame:
    """row, col, n, trust: a dependency matrix over drawn elements; a null end is 'outside'."""
    cell = arrows.select(F.coalesce("a", F.lit("outside")).alias("row"), F.coalesce("b", F.lit("outside")).alias("col"), "n", "resolution")
    return cell.groupBy("row", "col").agg(F.sum("n").alias("n"), common_or_mixed("resolution").alias("trust"))


def evidence(refs: DataFrame, keys: list[str], order: list[str], most: int = 50) -> DataFrame:
    """The first ``most`` references of each arrow and how many there are: n and rank."""
    by = Window.partitionBy(*keys)
    ranked = refs.withColumn("rank", F.row_number().over(by.orderBy(*order)))
    counts = refs.groupBy(*keys).agg(F.count("*").alias("n"))
    return ranked.filter(F.col("rank") <= most).join(counts, keys)


def hide(view: DataFrame, hidden: DataFrame) -> DataFrame:
    """Arrows without those that start or end at a hidden element (column element)."""
    gone = hidden.select("element").distinct()
    return view.join(gone.withColumnRenamed("element", "a"), "a", "left_anti").join(gone.withColumnRenamed("element", "b"), "b", "left_anti")


def exclude_refs(refs: DataFrame, excluded: DataFrame) -> DataFrame:
    """References whose ends are both outside the excluded files (column file; refs have src_file and dst_file)."""
    gone = excluded.select("file").distinct()
    return refs.join(gone.withColumnRenamed("file", "src_file"), "src_file", "left_anti").join(gone.withColumnRenamed("file", "dst_file"), "dst_file", "left_anti")


def distinguish(paths: DataFrame, group: str, path: str, separator: str = "/") -> DataFrame:
    """group, path, label: the shortest ends of paths that no other path of their group has; else the whole path.

    Each round takes one more part of the paths that are not told apart yet, until all are or
    are whole.
    """
    parts = F.split(F.col(path), separator)
    left = settle(paths.select(group, path).distinct())
    out = None
    for k in count(1):
        tail = left.withColumn("label", F.array_join(F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), F.least(F.size(parts), F.lit(k))), separator))
        # what is told apart by fewer parts, or whole, shares no longer end with those that are left
        same = F.count("*").over(Window.partitionBy(group, "label"))
        step = settle(tail.withColumn("_done", (same == 1) | (F.size(parts) <= k)))
        done = step.filter("_done").select(group, path, "label")
        out = done if out is None else out.unionByName(done)
        left = step.filter("not _done").select(group, path)
        if left.isEmpty():
            return out
