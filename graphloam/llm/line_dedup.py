"""Line dedup over a whole corpus, with DataFrame functions alone.

Lines are exploded with their positions, their normalised keys hashed, the distinct documents
of each hash counted, and the positions of lines over the threshold carried back to their
document, which is put together again without them. Only keys and positions are shuffled for
the counts; a text moves once, to meet its positions. Work is linear in the lines of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloam.llm.common import BLANKS, ascii_lower, join_salted, same, settle, shield


def lines_of(text: Column) -> Column:
    """The lines of a whole text, cut at \\n. A null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def drop_repeated_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Add kept_text, n_lines and n_dropped to the rows of ``docs``.

    A key of at least ``least_chars`` code points that occurs in at least ``least_docs``
    documents stays only in the largest doc_id that holds it, with all its lines there. All
    rows with a null doc_id count as one document, which is never the largest. Rows with the
    same doc_id are one document for the counts; each row is put together by itself. Texts of
    any length go whole. Columns of the same names as the added ones are replaced.
    """
    inner, restore = shield(docs, ("doc_id", "text"))
    given = inner.withColumn("_h", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    found = given.select("doc_id", "_h", F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("_at", "_line"))
    found = settle(found.filter(F.char_length("_line") >= least_chars).select("doc_id", "_h", "_at", F.unhex(F.md5("_line")).alias("_key")))
    held = found.select("_key", "doc_id").distinct().groupBy("_key").agg(F.count("*").alias("_docs"), F.max("doc_id").alias("_keeper"))
    common = settle(held.filter(F.col("_docs") >= least_docs).select(F.col("_key").alias("_common"), "_keeper"))
    lost = join_salted(found, common, "_key", "_common", F.xxhash64("doc_id")).filter(~F.col("doc_id").eqNullSafe(F.col("_keeper")))
    lost = lost.groupBy(F.col("doc_id").alias("_id"), F.col("_h").alias("_of")).agg(F.collect_set("_at").alias("_lost"))
    # lines are cut below the join, so that above it they are a column and not cut again for each line
    joined = given.withColumn("_lines", lines_of(F.col("text"))).join(lost, same([F.col("doc_id"), F.col("_h")], [F.col("_id"), F.col("_of")]), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_lost")
    out = joined.withColumns(
        {
            "kept_text": F.array_join(F.when(F.col("_lost").isNull(), F.col("_lines")).otherwise(F.transform(places, lambda i: F.element_at("_lines", i + 1))), "\n"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dropped": F.coalesce(F.size("_lost"), F.lit(0)).cast("long"),
        }
    )
    return restore(out, "kept_text", "n_lines", "n_dropped")


def digest(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped and the sha256 of what is kept of each document."""
    out = drop_repeated_lines(docs.select("doc_id", "text"), least_chars, least_docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))
