"""Text search with exact totals: one hit for each matching line, symbol or note, ranked and paged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloam.functions.text import literal_match, regex_match
from graphloam.operators.intervals import innermost

CODE = ("typescript", "tsx", "javascript", "python", "go", "java", "rust", "ruby", "php")
CONFIG = ("yaml", "json", "toml")


def file_rank(language: Column) -> Column:
    """Code before configuration before the rest."""
    return F.when(language.isin(*CODE), 0).when(language.isin(*CONFIG), 1).otherwise(2)


def explode_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """The lines of each file: all other columns, line (from 1) and line_text."""
    from graphloam.functions.text import lines

    return files.select(*[c for c in files.columns if c != text], F.posexplode(lines(F.col(text))).alias("line", "line_text")).withColumn("line", F.col("line") + 1)


def search_lines(lines: DataFrame, needle: str, regex: bool = False, ignore_case: bool = False) -> DataFrame:
    """Matching lines with the place of their first match: start and length in UTF-16 units.

    The test is a plain filter, so it runs before anything is sorted; a match of no width has no place.
    """
    line = F.col("line_text")
    if regex:
        pattern = ("(?i)" if ignore_case else "") + needle
        hits, at = lines.filter(line.rlike(pattern)), regex_match(line, pattern)
    else:
        test = F.contains(F.lower(line), F.lit(needle.lower())) if ignore_case else line.contains(needle)
        hits, at = lines.filter(test), literal_match(line, needle, ignore_case)
    return hits.withColumn("_at", at).withColumn("start", F.col("_at.start")).withColumn("length", F.col("_at.length")).drop("_at")


def page(hits: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows [offset, offset + limit) in order, with their place; limit 0 gives all.

    The page itself is a limit by order that each task applies before the shuffle.
    """
    if limit == 0:
        ranked = hits.withColumn("place", F.row_number().over(Window.orderBy(*order)))
        return ranked.filter(F.col("place") > offset)
    top = hits.orderBy(*order).limit(offset + limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).filter(F.col("place") > offset)


def totals(hits: DataFrame, file: str = "file") -> DataFrame:
    """total and matched_files over all hits, not only the page."""
    return hits.agg(F.count("*").alias("total"), F.count_distinct(file).alias("matched_files"))


def with_symbols(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hits (file, line) with the innermost symbol around each and the offset of the line in it."""
    found = innermost(hits.select("file", "line").distinct(), symbols.select("file", "id", "start_line", "end_line"), "file", "line", [])
    return hits.join(found.select("file", "line", F.col("id").alias("symbol"), (F.col("line") - F.col("start_line")).alias("offset")), ["file", "line"], "left")


def under(hits: DataFrame, dirs: list[str] = (), files: list[str] = (), globs: list[str] = ()) -> DataFrame:
    """Hits whose file lies in any of the folders, is any of the files, or matches any glob."""
    from graphloam.functions.globs import glob_match

    tests = [F.col("file").startswith(f"{d.rstrip('/')}/") for d in dirs] + [F.col("file") == f for f in files] + [glob_match(F.col("file"), g) for g in globs]
    keep = F.lit(not tests)
    for t in tests:
        keep = keep | t
    return hits.filter(keep)


def guide_catalog(guides: DataFrame) -> DataFrame:
    """guide, kind, questions, roots: what each guide answers. guides(guide, views array, questions array, roots array)."""
    kind = F.when(F.size("views") == 0, "note").when(F.size("views") == 1, "single").otherwise("tour")
    return guides.select("guide", kind.alias("kind"), F.array_distinct("questions").alias("questions"), F.array_sort(F.array_distinct("roots")).alias("roots"))
