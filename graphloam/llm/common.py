"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloam.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six whitespace characters of the record formats: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast on purpose only when its settled row count is at most this.
BROADCAST_ROWS = 100_000
#: Rows of a few numbers each that make a task worth its files.
TASK_ROWS = 25_000


#: Rows of an Arrow batch when rows hold whole texts: Spark's own 10,000 would be tens of MB on each side.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; a smaller setting of the caller stays. Results do not depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def id_text(col: Column) -> Column:
    """A key as text; null keys share one text that no number has."""
    return F.coalesce(col.cast("string"), F.lit("null"))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, which must be settled, with a broadcast hint if it has at most ``limit`` rows; else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def packed(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` settled, in no more partitions than it has ``rows`` rows: each further one would be a task and its files in every later shuffle."""
    done = settle(df)
    return done.coalesce(max(1, -(-done.count() // rows)))


def shield(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(docs, restore): all columns but the ``used`` ones under names that nothing else has, and the way back.

    An operator joins and adds columns freely in between, whatever the caller's columns are called.
    ``restore(out, *added)`` gives the caller's columns in their order and then the added ones,
    which replace columns of the same names.
    """
    names = {c: f"_given_{i}" for i, c in enumerate(docs.columns) if c not in used}
    inner = docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns])

    def restore(out: DataFrame, *added: str) -> DataFrame:
        return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns if c not in added], *added)

    return inner, restore


def same(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of two lists of columns."""
    out = left[0].eqNullSafe(right[0])
    for a, b in zip(left[1:], right[1:], strict=True):
        out = out & a.eqNullSafe(b)
    return out


def join_salted(rows: DataFrame, unique: DataFrame, key: str, unique_key: str, spread: Column, salts: int = 32, how: str = "inner") -> DataFrame:
    """``rows`` joined with a settled table that has each key once, however many rows share a key.

    A small table is broadcast. A larger one is repeated under each of ``salts`` numbers, and a
    row looks under the number that ``spread`` gives it, so a hot key is dealt to that many tasks.
    """
    if unique.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(unique), F.col(key) == F.col(unique_key), how)
    each = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    mine = rows.withColumn("_salted", F.pmod(spread, F.lit(salts)).cast("int"))
    return mine.join(each, (F.col(key) == F.col(unique_key)) & (F.col("_salted") == F.col("_salt")), how).drop("_salt", "_salted")


def count_rank(n: Column) -> Column:
    """A number that grows with a count and has some 2,000 values: the count itself up to 1,023, then 16 for each doubling."""
    return F.when(n < 1024, n).otherwise(F.floor(F.log2(n) * 16) + 1024 - 160).cast("int")


def rank_edge(counts: DataFrame, most: int) -> int:
    """The least rank of ``n`` from which on ``counts`` has at most ``most`` rows: no task sorts or holds them."""
    edge, held = 2**31 - 1, 0
    for r in sorted(counts.groupBy(count_rank(F.col("n")).alias("r")).agg(F.count("*").alias("v")).collect(), reverse=True):
        if held + r["v"] > most:
            break
        edge, held = r["r"], held + r["v"]
    return edge


def running_start(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come before.

    Rows are ordered by ``bucket`` and then ``order``. Each window holds one bucket of one
    group, and only the sums of buckets are added up by group, so a group of any size is
    spread over as many tasks as it has buckets. ``group`` and ``bucket`` must not be null.
    """
    keys = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys).agg(F.sum(value).alias("_sum")).select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return placed.join(offsets, keys).withColumn(out, F.col("_offset") + F.col("_inside")).drop("_offset", "_inside")


def copies(df: DataFrame, count: str, out: str, chunk: int = 10_000) -> DataFrame:
    """Each row ``count`` times, with its number from 0 in ``out``; no array holds more than ``chunk`` numbers."""
    step = F.lit(chunk)
    many = df.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / step))))
    return many.withColumn(out, F.explode(F.sequence(F.col("_part") * step, F.least(F.col("_part") * step + step, F.col(count)) - 1))).drop("_part", count)


def numbered(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Number the rows of equal ``keys`` (nulls are equal) from 0 in ``out``, by the partitions they are read in.

    A window holds the equal rows of one partition of ``df``, and only counts are added up by
    key, so rows that are all equal stay in as many tasks as they came in.
    """
    given = df.withColumn("_in", F.spark_partition_id())
    inside = Window.partitionBy(*keys, "_in").orderBy(F.lit(0))
    before = Window.partitionBy(*[f"_key{i}" for i in range(len(keys))]).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    counts = given.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_in").alias("_of")).agg(F.count("*").alias("_rows"))
    counts = settle(counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows"))
    match = same([*[F.col(k) for k in keys], F.col("_in")], [*[F.col(f"_key{i}") for i in range(len(keys))], F.col("_of")])
    placed = given.withColumn("_place", F.row_number().over(inside) - 1).join(small(counts), match)
    return placed.withColumn(out, F.col("_before") + F.col("_place")).drop("_place", "_before", "_of", "_in", *[f"_key{i}" for i in range(len(keys))])


__all__ = ["BLANKS", "BLANK_WORD", "BROADCAST_ROWS", "LOWER", "UPPER", "ascii_lower", "copies", "count_rank", "id_text", "join_salted", "numbered", "packed", "rank_edge", "running_start", "same", "settle", "shield", "small", "small_batches", "table"]
