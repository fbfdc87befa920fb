"""Rules of ignore files as a table, and which paths they leave out.

A rule holds in the folder of its file (``dir``, empty at the top) and below. Of the rules that match a
path, those of the nearest folder decide, there the last one; an ignored folder closes all below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloam.functions.ids import dir_of, directories
from graphloam.session import BROADCAST_ROWS, settle

#: The pieces of a pattern: an escaped sign, a set, folders at the start of a segment, all below at the end, stars, one sign.
_PIECES = r"\\.|\[[!^]?\]?[^\]]*\]|(?:^|(?<=/))\*\*/|(?<=/)\*\*$|\*+|."


#: Folders with rules that are met without a shuffle, if there are too many to broadcast them all: those above most paths.
HOT_FOLDERS = 10_000


def _quoted(sign: Column) -> Column:
    return F.concat(F.lit(r"\Q"), sign, F.lit(r"\E"))


def _set(piece: Column) -> Column:
    """A set of signs as a Java one, which never takes a slash. Signs that only Java gives a meaning are escaped."""
    inner = F.regexp_replace(piece, r"^\[[!^]?|\]$", "")
    inner = F.regexp_replace(F.regexp_replace(inner, r"\\([A-Za-z])", "$1"), r"([\[\]&^])", r"\\$1")
    return F.concat(F.when(piece.rlike(r"^\[[!^]"), "(?!/)[^").otherwise("(?!/)["), inner, F.lit("]"))


def pattern_regex(pattern: Column) -> Column:
    """The regular expression, over whole paths below the rule's folder, of a pattern without ``!`` and closing slash.

    A pattern with a slash at its start or inside is read from the folder, any other at every
    depth below it. Named classes in sets are not known.
    """
    body = F.regexp_replace(pattern, "^/", "")
    piece = lambda p: (
        F.when(p == "**/", "(?:.*/)?")
        .when(p == "**", ".+")
        .when(F.startswith(p, F.lit("*")), "[^/]*")
        .when(p == "?", "[^/]")
        .when((F.length(p) > 2) & F.startswith(p, F.lit("[")), _set(p))
        .when((F.length(p) == 2) & F.startswith(p, F.lit("\\")), _quoted(F.substring(p, 2, 1)))
        .otherwise(_quoted(p))
    )
    # two stars are all below only at the end of a path of their own; elsewhere they are one
    stars = F.when(pattern.rlike(r"(?:^|/)\*\*$") & pattern.contains("/"), body).otherwise(F.regexp_replace(body, r"(?<!^|/)\*\*+|\*\*+(?!/)", "*"))
    pieces = F.transform(F.regexp_extract_all(stars, F.lit(_PIECES), 0), piece)
    return F.concat(F.when(pattern.contains("/"), "^").otherwise("^(?:.*/)?"), F.array_join(pieces, ""), F.lit("$"))


def ignore_rules(files: DataFrame) -> DataFrame:
    """dir, ord, regex, negated, folders of ignore files (path, text).

    Empty lines, comments and a lone ``!`` or ``/`` give none; blanks at the end go unless escaped; a null text has none.
    """
    each = files.select(dir_of(F.col("path")).alias("dir"), F.posexplode(F.split("text", "\r?\n", -1)).alias("ord", "line"))
    line = F.regexp_replace("line", r"(?<!\\)((?:\\\\)*) +$", "$1")
    rows = each.withColumn("line", line).filter(~F.col("line").rlike("^#"))
    rows = rows.withColumn("negated", F.startswith("line", F.lit("!"))).withColumn("line", F.regexp_replace("line", "^!", ""))
    rows = rows.withColumn("folders", F.endswith("line", F.lit("/"))).withColumn("line", F.regexp_replace("line", "/$", "")).filter("line <> ''")
    return rows.select("dir", "ord", pattern_regex(F.col("line")).alias("regex"), "negated", "folders")


def _by_folder(rows: DataFrame, table: DataFrame, folder: str, how: str = "inner") -> DataFrame:
    """Join of rows, one for each folder above a path, with a settled table that has a folder once.

    The top and its folders stand above nearly all paths, so that a join by folder would put all of them
    into one task. A table that is too large to broadcast is cut: its folders above most paths are broadcast, the others shuffled.
    """
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), folder, how)
    heat = rows.groupBy(folder).agg(F.count("*").alias("_n")).join(table.select(folder), folder, "left_semi")
    keys = F.broadcast(settle(heat.orderBy(F.desc("_n")).limit(HOT_FOLDERS).select(folder)))
    hot = rows.join(F.broadcast(table.join(keys, folder, "left_semi")), folder, how)
    return hot.unionByName(rows.join(keys, folder, "left_anti").join(table, folder, how))


def _decided(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """path of the entries (path, is_folder) that the rules themselves ignore, whatever stands above them."""
    by_dir = settle(rules.groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("ord", "regex", "negated", "folders"))).alias("rules")))
    holds = entries.select("path", "is_folder", F.explode(F.concat(F.array(F.lit("")), directories(F.col("path")))).alias("dir"))
    below = F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))
    met = _by_folder(holds, by_dir, "dir").withColumn("_below", below)
    # null with no rule that matches
    last = F.try_element_at(F.filter("rules", lambda r: (~r["folders"] | F.col("is_folder")) & F.regexp_like(F.col("_below"), r["regex"])), F.lit(-1))
    said = met.select("path", F.length("dir").alias("_deep"), last.alias("_last")).filter("_last is not null")
    return said.groupBy("path").agg(F.max_by("_last.negated", "_deep").alias("_kept")).filter("not _kept").select("path")


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path of the files that are ignored, by a rule of their own or with a folder above them. Each path once; null is none.

    Folders are judged once each. Rules are gathered by folder (one ignore file each), so a path
    meets one row for each folder above it that has rules.
    """
    files = settle(paths.select("path").filter("path is not null").distinct())
    above = files.select(F.explode(directories(F.col("path"))).alias("path")).distinct()
    closed = settle(_decided(above.withColumn("is_folder", F.lit(True)), rules))
    each = files.select("path", F.explode(directories(F.col("path"))).alias("_above"))
    inside = _by_folder(each, closed.withColumnRenamed("path", "_above"), "_above", "left_semi").select("path")
    return _decided(files.withColumn("is_folder", F.lit(False)), rules).unionByName(inside).distinct()


def not_ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``paths`` that no rule leaves out; all other columns and repeated rows stay."""
    return paths.join(ignored(paths, rules), "path", "left_anti")
