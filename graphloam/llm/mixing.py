"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Three steps. Targets: the sources share all words by weight, none above a multiple of its own
size. Quotas: every output shard gets whole numbers of blocks of each source by the highest
quotients target / (2k + 1); the method is house-monotone, so the quotas of successive shards are
the differences of successive apportionments. Selection: the documents of a source stand in a
seeded order, their words form a ring of blocks from a seeded start, and the shards take their
quotas of blocks one after another along the ring, as often round as it takes. So the quotas
decide which blocks each shard gets, and a document is cut only where two shards meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloam.llm.common import BLANK_WORD, copies, id_text, numbered, running_start, same, settle, shield, small

WEIGHTS = (5.0, 2.0, 1.0)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, checksum and number of each distinct row. A null text has size 0."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", F.regexp_count(text, F.lit(BLANK_WORD)).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("crc"))
    return rows.groupBy("doc_id", "source", "size", "crc").agg(F.count("*").alias("_n"))


def source_targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, rank, source_size and target of each source of ``rows`` (source, size).

    Weights go round over the sources in code-point order, null last. Sources are filled in
    the order of cap / weight: those that reach their cap are the first ones, and the first
    that does not reach it sets the level for all that follow. One row for each source.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    shared = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"]
    return ranked.select("source", "rank", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared * F.col("weight")).alias("target"))


def shard_quotas(targets: DataFrame, block_tokens: int, shards: int) -> DataFrame:
    """source, rank, shard, blocks and upto: Sainte-Lague quotas of each output shard, and their sums over the shards so far.

    Shard s completes a house of N = floor(all blocks * (s + 1) / shards). Rounding moves s
    sources by half a seat each, so at a divisor total / (N - s) fewer than N seats are won and
    at total / (N + s) more: the seats below the first are certain, those above the second are
    lost, and only some 3 s seats between them compete, however many sources there are.
    """
    every = Window.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = targets.withColumn("_sources", F.count("*").over(every)).withColumn("_total", F.sum("target").over(every)).withColumn("_words", F.sum("source_size").over(every))
    base = base.withColumn("_blocks", F.round(F.col("_words") / block_tokens).cast("long"))
    houses = base.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("_house", F.floor(F.col("_blocks") * (F.col("shard") + 1) / shards))
    seats = lambda house: F.when(F.col("_total") > 0, F.floor(F.col("target") * house / F.col("_total") + 0.5)).otherwise(0)
    # one seat more on each side, for what division rounds
    houses = houses.withColumn("_sure", F.greatest(seats(F.greatest(F.col("_house") - F.col("_sources"), F.lit(0))) - 1, F.lit(0))).withColumn("_last", seats(F.col("_house") + F.col("_sources")) + 1)
    open_ = houses.withColumn("_seat", F.explode(F.sequence("_sure", "_last"))).withColumn("_quotient", F.col("target") / (2 * F.col("_seat") + 1))
    by_quotient = Window.partitionBy("shard").orderBy(F.col("_quotient").desc(), "rank", "_seat")
    sure = F.sum(F.when(F.col("_seat") == F.col("_sure"), F.col("_sure")).otherwise(0)).over(Window.partitionBy("shard"))
    open_ = open_.withColumn("_won", ((F.row_number().over(by_quotient) <= F.col("_house") - sure) & (F.col("target") > 0)).cast("long"))
    houses = open_.groupBy("source", "rank", "shard").agg((F.max("_sure") + F.sum("_won")).alias("upto"))
    step = Window.partitionBy("rank").orderBy("shard")
    return houses.select("source", "rank", "shard", (F.col("upto") - F.coalesce(F.lag("upto").over(step), F.lit(0))).alias("blocks"), "upto")


def mix(docs: DataFrame, seed: int = 20, block_tokens: int = 16, shards: int = 8, weights: tuple[float, ...] = WEIGHTS, most: int = 3, bucket_digits: int = 3) -> DataFrame:
    """One row for each document: how many of its words the mix takes, where, and for which shards.

    doc_id, crc, copy (the number among equal rows), source, size, source_size, target, rounds
    (times it is taken whole) and the piece taken once more: words [piece_from, piece_to) and
    [0, piece_wrap); taken is the sum, and shard_words says how much of it each shard takes.
    Every block counts ``block_tokens`` words; no source gives more than ``most`` times its size, so
    only a shard whose blocks would be beyond that has fewer than its quota. A source is missing
    only if it has no document. Equal rows are placed one after another, as one row on the way.
    """
    rows = settle(sized(docs))
    targets = settle(source_targets(rows.select("source", (F.col("size") * F.col("_n")).alias("size")), weights, most))
    quotas = shard_quotas(targets, block_tokens, shards).groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("shard", "upto"))).alias("_upto"))  # one for each shard
    plan = targets.join(quotas, "rank").withColumn("_ends", F.transform("_upto", lambda x: F.least(x["upto"] * block_tokens, F.col("source_size") * most)))
    plan = plan.withColumn("_cuts", F.zip_with(F.concat(F.array(F.lit(0).cast("long")), F.slice("_ends", 1, shards - 1)), "_ends", lambda a, b: F.struct(a.alias("a"), b.alias("b")))).withColumn("_take", F.element_at("_ends", -1))
    size = F.greatest("source_size", F.lit(1))
    start = F.pmod(F.crc32(F.concat_ws(":", F.lit(f"start:{seed}"), F.coalesce("source", F.lit("null"))).cast("binary")), F.ceil(size / block_tokens)) * block_tokens
    plan = settle(plan.withColumn("rounds", F.floor(F.col("_take") / size)).withColumn("_rest", F.pmod("_take", size)).withColumn("_start", start).drop("_upto", "_ends", "_take"))
    placed = rows.join(small(plan.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), id_text(F.col("doc_id")), F.col("crc").cast("string")))).withColumn("_words", F.col("size") * F.col("_n"))
    placed = running_start(placed.withColumn("_bucket", F.substring("place", 1, bucket_digits)), ["rank"], "_bucket", ["place", "size"], "_words", "_from")
    placed = copies(placed, "_n", "copy").withColumn("_at", F.col("_from") + F.col("copy") * F.col("size"))
    end, stop = F.col("_at") + F.col("size"), F.col("_start") + F.col("_rest")
    inside = lambda x: F.greatest(F.lit(0), F.least(x, F.col("size")))
    placed = placed.withColumn("piece_from", inside(F.col("_start") - F.col("_at"))).withColumn("piece_to", F.greatest("piece_from", inside(F.least(stop, end) - F.col("_at"))))
    placed = placed.withColumn("piece_wrap", inside(stop - F.col("source_size") - F.col("_at")))
    taken = F.col("rounds") * F.col("size") + F.col("piece_to") - F.col("piece_from") + F.col("piece_wrap")
    # the same along the ring: words from the start on, with the document before the start at its end
    length = F.greatest("source_size", F.lit(1))
    ahead = F.pmod(F.col("_at") - F.col("_start"), length)
    met = lambda c, lo, hi: F.greatest(F.lit(0), F.least(c["b"], hi) - F.greatest(c["a"], lo))
    once = lambda c, w: met(c, ahead + w * length, F.least(ahead + F.col("size"), length) + w * length) + met(c, w * length, ahead + F.col("size") - length + w * length)
    by_shard = F.transform("_cuts", lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(most)), F.lit(0).cast("long"), lambda acc, w: acc + once(c, w)))
    return placed.select("doc_id", "crc", "copy", "source", "size", "source_size", "target", taken.alias("taken"), "rounds", "piece_from", "piece_to", "piece_wrap", by_shard.alias("shard_words"))


def words_between(text: str, first: str, last: str):
    """Words [first, last) of a text with the whitespace after each, as a column."""
    parts = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    return F.concat_ws("", F.slice(parts, F.col(first) + 1 + F.when(F.col(text).rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0), F.col(last) - F.col(first)))


def mixed_documents(docs: DataFrame, seed: int = 20, **how) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: one row for each time a document or a piece of it is taken.

    Documents are matched to their plan by doc_id, source and checksum; equal rows are numbered, so
    each gets one plan row. Pieces keep their words and the whitespace between. ``n_chars``,
    where it is there, is counted anew for pieces.
    """
    columns = docs.columns
    inner, restore = shield(docs, ("doc_id", "source", "text", "n_chars"))
    keys = ["doc_id", "source", "crc"]
    planned = mix(docs, seed, **how).select(*[F.col(k).alias(f"_{k}") for k in keys], "copy", F.struct("taken", "size", "rounds", "piece_from", "piece_to", "piece_wrap").alias("_p"))
    plan = settle(planned.filter("_p.taken > 0 or copy > 0"))
    given = inner.withColumn("_c", F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")))
    mine = [F.col("doc_id"), F.col("source"), F.col("_c")]
    repeated = settle(plan.filter("copy > 0").select("_doc_id", "_source", "_crc").distinct())
    match = same(mine, [F.col("_doc_id"), F.col("_source"), F.col("_crc")])
    if repeated.isEmpty():
        given = given.withColumn("_i", F.lit(0).cast("long"))
    else:
        several = numbered(given.join(small(repeated), match, "left_semi"), ["doc_id", "source", "_c"], "_i")
        given = given.join(small(repeated), match, "left_anti").withColumn("_i", F.lit(0).cast("long")).unionByName(several)
    each = given.join(plan.filter("_p.taken > 0"), match & (F.col("_i") == F.col("copy")))
    piece = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    zero = F.lit(0)
    wholes = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_p.rounds"), F.lit(1))), lambda _: piece(zero, F.col("_p.size")))
    runs = F.concat(F.when(F.col("_p.rounds") > 0, wholes).otherwise(F.slice(wholes, 1, 0)), F.array(piece(F.col("_p.piece_from"), F.col("_p.piece_to")), piece(zero, F.col("_p.piece_wrap"))))
    each = each.withColumn("_run", F.explode(F.filter(runs, lambda r: r["b"] > r["a"]))).withColumn("_a", F.col("_run.a").cast("int")).withColumn("_b", F.col("_run.b").cast("int"))
    whole = (F.col("_a") == 0) & (F.col("_b") == F.col("_p.size"))
    each = each.withColumn("text", F.when(whole, F.col("text")).otherwise(words_between("text", "_a", "_b")))
    if "n_chars" in columns:
        each = each.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return restore(each)
