"""Wording and layout rules over the texts and steps of a guide: summaries, details, titles of steps, places in a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloam.functions.text import sentences
from graphloam.operators.rules import without_code, word_count

# Sentences and words of a summary, words of a paragraph, characters of a first sentence that can be a
# title and of a talk note, lines between two places of a file, places of a file that a slide shows.
SUMMARY_SENTENCES, SUMMARY_WORDS, PARAGRAPH_WORDS = 2, 45, 80
TITLE_CHARS, TALK_CHARS, FAR_LINES, FILE_PLACES = 80, 280, 40, 3

#: A heading line; a link with a letter in its label and a target that looks like an address or a path.
HEADING_LINE = r"(?m)^ {0,3}#{1,6}[ \t]+\S"
LINK = r"\[[^\]\n]*[A-Za-z][^\]\n]*\]\([^)\s]*[/#:.][^)\s]*\)"
#: Starts of items of a list, after the line end before them.
_ITEM = r"\n([ \t]*(?:[-*+]|[0-9]+[.)])[ \t])"
_DRAFT = r"\bTODO\b"


def paragraphs(text: Column) -> Column:
    """The blocks of a text: between blank lines, and each item of a list by itself."""
    return F.split(F.regexp_replace(F.regexp_replace(text, _ITEM, "\x01$1"), r"\n[ \t]*\n", "\x01"), "\x01")


def lint_summaries(fields: DataFrame) -> DataFrame:
    """rule, element, field, n over fields (element, field, text): long-summary, long-detail, markdown-in-summary.

    n: words of the summary, words of the longest paragraph, marks found (1 or 2). Code spans count as one word. A
    null or blank text has no finding; text with a TODO is judged for its marks only.
    """
    text = F.col("text")
    plain = without_code(text)
    summary, detail, written = F.col("field") == "summary", F.col("field") == "detail", ~text.rlike(_DRAFT)
    words = word_count(plain)
    longest = F.array_max(F.transform(paragraphs(plain), lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != ""))))
    marks = text.rlike(HEADING_LINE).cast("int") + text.rlike(LINK).cast("int")
    rule = lambda name, test, n: F.when(test, F.struct(F.lit(name).alias("rule"), n.cast("long").alias("n")))
    rules = F.array(
        rule("long-summary", summary & written & ((F.size(sentences(plain)) > SUMMARY_SENTENCES) | (words > SUMMARY_WORDS)), words),
        rule("long-detail", detail & written & (longest > PARAGRAPH_WORDS), longest),
        rule("markdown-in-summary", summary & (marks > 0), marks),
    )
    found = fields.filter(F.trim(text) != "").select("element", "field", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("_r"))
    return found.select(F.col("_r.rule").alias("rule"), "element", "field", F.col("_r.n").alias("n"))


def lint_steps(steps: DataFrame) -> DataFrame:
    """rule, tour, step, n over steps (tour, step, note, talk): untitled-step, note-heading, long-talk-note.

    A step needs a heading as its first line with text. Without one it is untitled if it is empty (n = 0) or its first
    sentence has more characters than a title takes (n), and lacks a heading otherwise. A note of a
    talk is long by the characters under its heading.
    """
    note = F.trim(F.coalesce("note", F.lit("")), F.lit(" \t\r\n"))
    first = F.substring_index(note, "\n", 1)
    headed = first.rlike(r"^#{1,6}[ \t]+\S")
    opening = F.coalesce(F.get(sentences(first), 0), F.lit(""))
    body = F.trim(F.when(headed, F.when(note.contains("\n"), F.expr("substring(_note, position('\n', _note) + 1)")).otherwise("")).otherwise(note), F.lit(" \t\r\n"))
    size = F.length(opening)
    rule = lambda name, test, n: F.when(test, F.struct(F.lit(name).alias("rule"), n.cast("long").alias("n")))
    rules = F.array(
        rule("untitled-step", ~headed & ((size == 0) | (size > TITLE_CHARS)), size),
        rule("note-heading", ~headed & (size > 0) & (size <= TITLE_CHARS), size),
        rule("long-talk-note", F.coalesce("talk", F.lit(False)) & (F.length(body) > TALK_CHARS), F.length(body)),
    )
    found = steps.withColumn("_note", note).select("tour", "step", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("_r"))
    return found.select(F.col("_r.rule").alias("rule"), "tour", "step", F.col("_r.n").alias("n"))


def far_ranges(ranges: DataFrame, lines: int = FAR_LINES, most: int = FILE_PLACES) -> DataFrame:
    """step, file, places: the first file of a step with more places than a slide shows.

    ranges(step, ord, file, start_line, end_line). Ranges at most ``lines`` apart are one place. The
    file whose first range stands first in the step is reported, one for each step.
    """
    by = Window.partitionBy("step", "file").orderBy("start_line", "end_line")
    reach = F.max("end_line").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = ranges.select("step", "ord", "file", "start_line", "end_line").withColumn("_new", (reach.isNull() | (F.col("start_line") - reach > lines)).cast("int"))
    files = cut.groupBy("step", "file").agg(F.sum("_new").alias("places"), F.min("ord").alias("_ord")).filter(F.col("places") > most)
    return files.groupBy("step").agg(F.min(F.struct("_ord", "file", "places")).alias("_f")).select("step", F.col("_f.file").alias("file"), F.col("_f.places").alias("places"))
