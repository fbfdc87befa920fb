"""Keyed overwrites: which of several rows for one key stands, and what a patch may change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key. One aggregate with a partial step, no sort."""
    others = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.col(order)).alias("_b")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in others])


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The values of the last row of each key at the place of the first."""
    others = [c for c in rows.columns if c not in keys and c != order]
    agg = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("_b"), F.min(order).alias(order))
    return agg.select(*keys, order, *[F.col(f"_b.{c}").alias(c) for c in others])


def merge_provider(refs: DataFrame, update: DataFrame, coverage: DataFrame, symbols: DataFrame, order: str = "resolution") -> DataFrame:
    """References after a provider has spoken.

    ``coverage`` (file, kind, status) says what the provider analysed; where its status is
    supported or partial, earlier references of that kind and file give way to its own.
    References to or from symbols that are not there are dropped; of equal ones the provider's
    count, and among these the last in ``order`` (any column), so reruns agree.
    """
    covered = coverage.filter(F.col("status").isin("supported", "partial")).select("file", "kind").distinct()
    kept = refs.join(covered, ["file", "kind"], "left_anti").withColumn("_ord", F.struct(F.lit(0).alias("of"), F.col(order).alias("at")))
    both = kept.unionByName(update.withColumn("_ord", F.struct(F.lit(1).alias("of"), F.col(order).alias("at"))))
    known = symbols.select("id").distinct()
    both = both.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    keys = ["src", "dst", "kind", "file", "line"]
    return last_wins(both, keys, "_ord").drop("_ord")


def apply_patch(rows: DataFrame, patch: DataFrame, key: str, fields: list[str], owned: str = "user_fields", cleared: str = "clear_fields") -> DataFrame:
    """Rows after an upsert by key: fields that are set replace, fields named in ``cleared`` become null, user-owned fields stay."""
    old = rows.select(key, owned, *[F.col(f).alias(f"_old_{f}") for f in fields])
    new = patch.select(key, cleared, F.lit(True).alias("_patched"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    both = old.join(new, key, "full")
    merged = []
    for f in fields:
        mine = F.coalesce(F.array_contains(owned, F.lit(f)), F.lit(False))
        clear = F.coalesce(F.array_contains(cleared, F.lit(f)), F.lit(False))
        merged.append(F.when(mine, F.col(f"_old_{f}")).when(clear, F.lit(None)).otherwise(F.coalesce(f"_new_{f}", f"_old_{f}")).alias(f))
    return both.select(key, owned, *merged)


def merge_feedback(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """id, status, outcome, conflict: requests by id. A closed one stays closed; different closed outcomes conflict.

    Both have id, status (open, answered, closed), outcome, ord.
    """
    rank = F.when(F.col("status") == "closed", 2).when(F.col("status") == "answered", 1).otherwise(0)
    both = stored.unionByName(incoming).withColumn("_rank", rank)
    best = F.max_by(F.struct("status", "outcome"), F.struct("_rank", "ord"))
    closed = F.count_distinct(F.when(F.col("status") == "closed", F.col("outcome")))
    return both.groupBy("id").agg(best.alias("_b"), (closed > 1).alias("conflict")).select("id", F.col("_b.status").alias("status"), F.col("_b.outcome").alias("outcome"), "conflict")


def identity(rows: DataFrame, group: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """A hash of the rows of each group in order: equal content, equal identity."""
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    ordered = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["_line"]), "\n")
    return rows.groupBy(*group).agg(F.sha2(joined, 256).alias("identity"))


def use_cache(inputs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts from the cache, inputs to work on): content-addressed by (hash, profile), never by path.

    A cached row whose checksum does not fit its facts is not used.
    """
    valid = cache.filter(F.sha2("facts", 256) == F.col("checksum")).select("hash", "profile", "facts").dropDuplicates(["hash", "profile"])
    return inputs.join(valid, ["hash", "profile"]), inputs.join(valid, ["hash", "profile"], "left_anti")


def user_edits(include: DataFrame, edits: DataFrame) -> DataFrame:
    """A view after group, ungroup and hide edits: the last edit of each element counts. edits(element, action, grp, version)."""
    last = edits.groupBy("element").agg(F.max_by(F.struct("action", "grp"), F.col("version")).alias("_e"))
    out = include.join(last, "element", "left")
    shown = F.when(F.col("_e.action") == "hide", F.lit(None)).when(F.col("_e.action") == "group", F.col("_e.grp")).otherwise(F.col("element"))
    return out.withColumn("shown", shown).filter("shown is not null").select("shown").distinct().withColumnRenamed("shown", "element")


def round_robin(rows: DataFrame, category: str, categories: list[str], order: list, most: int) -> DataFrame:
    """Rows taken from the categories in turn, best first in each, until ``most`` are taken; with their place."""
    turn = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(category))
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(category).orderBy(*order))).filter((F.col("_rn") <= most) & (turn > 0)).withColumn("_turn", turn)
    top = ranked.orderBy("_rn", "_turn").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy("_rn", "_turn"))).drop("_rn", "_turn")
