"""The part of a snapshot that a set of files needs, and the files one call away from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloam.operators.merge import round_robin
from graphloam.session import settle_round as settle
from graphloam.session import small


def kept_refs(symbols: DataFrame, refs: DataFrame, files: DataFrame, keep_kinds: tuple[str, ...] = ("extends", "implements")) -> DataFrame:
    """References with an end in an embedded file (both ends for reads), and those of kinds that are always kept.

    symbols(id, file); refs(src, dst, kind); files(file): embedded. References to unknown
    symbols are dropped. Only the symbols of embedded files are looked up for an end that is in one.
    """
    inside = symbols.select("id", "file").join(files.select("file").distinct(), "file", "left_semi").select("id", F.lit(True).alias("_in"))
    inside = small(settle(inside))
    ends = refs.join(inside.toDF("src", "_a"), "src", "left").join(inside.toDF("dst", "_b"), "dst", "left")
    touches = F.when(F.col("kind") == "read", F.col("_a") & F.col("_b")).otherwise(F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False)))
    kept = ends.filter(F.coalesce(touches, F.lit(False)) | F.col("kind").isin(*keep_kinds)).select(*refs.columns)
    known = symbols.select("id")
    return kept.join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi").select(*refs.columns)


def with_parents(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """id: the wanted symbols (id) and everything above them (symbols: id, parent), level by level from what is wanted."""
    frontier = settle(wanted.select("id").distinct())
    seen = frontier
    while not frontier.isEmpty():
        up = symbols.join(frontier, "id", "left_semi").filter("parent is not null").select(F.col("parent").alias("id")).distinct()
        frontier = settle(up.join(seen, "id", "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def prune(symbols: DataFrame, refs: DataFrame, files: DataFrame, named: DataFrame, keep_kinds: tuple[str, ...] = ("extends", "implements")) -> tuple[DataFrame, DataFrame]:
    """(symbols, refs) that keep every projection of the embedded files.

    symbols(id, file, parent); refs(src, dst, kind); files(file): embedded; named(id): symbols
    that are named somewhere. References are those of ``kept_refs``. Symbols stay if embedded,
    named, or an end of a reference that stays; and so do all their parents.
    """
    kept = settle(kept_refs(symbols, refs, files, keep_kinds))
    inside = symbols.join(files.select("file").distinct(), "file", "left_semi").select("id")
    wanted = inside.union(named.select("id")).union(kept.select("src")).union(kept.select("dst")).distinct()
    wanted = wanted.join(symbols.select("id"), "id", "left_semi")
    return symbols.join(with_parents(symbols, wanted), "id", "left_semi"), kept


def boundary_files(anchored: DataFrame, refs: DataFrame, symbols: DataFrame, tests: DataFrame, most: int = 40) -> DataFrame:
    """file, reason, n, place: files that test, call or are called by anchored symbols.

    anchored(id); refs(src, dst, kind); symbols(id, file); tests(file). A file has one reason:
    test before caller before callee. Callers, tests and callees are taken in turn, those with
    the most references first.
    """
    inside = anchored.select("id").distinct().join(symbols.select("id", "file"), "id")
    own = inside.select("file").distinct()
    place = symbols.select("id", "file")
    into = refs.join(inside.select(F.col("id").alias("dst")), "dst", "left_semi").join(place.toDF("src", "file"), "src").join(tests.select("file").distinct().withColumn("_t", F.lit(True)), "file", "left")
    into = into.filter("_t or kind = 'call'").select("file", F.when(F.col("_t"), "test").otherwise("caller").alias("reason"))
    out = refs.filter("kind = 'call'").join(inside.select(F.col("id").alias("src")), "src", "left_semi").join(place.toDF("dst", "file"), "dst").select("file", F.lit("callee").alias("reason"))
    rank = F.when(F.col("reason") == "test", 0).when(F.col("reason") == "caller", 1).otherwise(2)
    counted = into.unionByName(out).join(own, "file", "left_anti").groupBy("file", "reason").agg(F.count("*").alias("n"))
    one = counted.groupBy("file").agg(F.min_by(F.struct("reason", "n"), rank).alias("_b")).select("file", F.col("_b.reason").alias("reason"), F.col("_b.n").alias("n"))
    return round_robin(one, "reason", ["caller", "test", "callee"], [F.desc("n"), "file"], most)


def related_files(selection: DataFrame, resources: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """file, why: files that go with a selection (column file): loaded or loading, joined by a stored edge, or anchored with it."""
    sel = selection.select("file").distinct()
    loads = resources.select(F.col("src_file").alias("file"), F.explode("files").alias("other"))
    a = loads.join(sel, "file", "left_semi").select(F.col("other").alias("file"), F.lit("loads").alias("why"))
    b = loads.join(sel.withColumnRenamed("file", "other"), "other", "left_semi").select("file", F.lit("loaded by").alias("why"))
    both = edges.select(F.col("src_file").alias("file"), F.col("dst_file").alias("other")).union(edges.select("dst_file", "src_file"))
    c = both.join(sel, "file", "left_semi").select(F.col("other").alias("file"), F.lit("edge").alias("why"))
    owners = anchors.join(sel, "file", "left_semi").select("owner").distinct()
    d = anchors.join(owners, "owner", "left_semi").select("file", F.lit("anchor").alias("why"))
    return a.union(b).union(c).union(d).join(sel, "file", "left_anti").distinct()
