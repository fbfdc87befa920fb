"""Anchored text: is it still where it was, has it moved, has it changed, is it gone?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloam.functions.ids import last_segment, parent_path
from graphloam.functions.text import HASH_PREFIX, edit_distance, hash_range, name_similarity, size_similarity


def resolve_anchors(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """anchor, status, start_line, end_line of each anchor: ok, moved, drifted or missing.

    anchors(anchor, file, base, size, hash, was_start): lines base .. base + size - 1 held text
    with that hash; was_start is where they stood before. files(file, lines array). The hash is
    looked for at its place, then at every other place of the file, the nearest first and the
    upper one of two. A hash of another version is drifted.
    """
    joined = anchors.join(files.select("file", "lines"), "file", "left")
    n = F.size("lines")
    at = F.greatest(F.lit(1), F.least(F.col("base"), n - F.col("size") + 1))
    here = hash_range(F.col("lines"), at, at + F.col("size") - 1)
    versioned = F.col("hash").startswith(HASH_PREFIX)
    first = joined.withColumn("_at", at).withColumn("_here", F.when(versioned & F.col("lines").isNotNull() & (n >= F.col("size")), here))
    settled = first.withColumn("_ok", F.coalesce(F.col("_here") == F.col("hash"), F.lit(False)))
    # only anchors that are not at their place look further
    lost = settled.filter(~F.col("_ok") & versioned & F.col("lines").isNotNull() & (F.size("lines") >= F.col("size")))
    # each window of a size is hashed once for a file, and only its hash goes on
    sizes = lost.select("file", "size").distinct().join(files.select("file", "lines"), "file")
    starts = F.sequence(F.lit(1), F.size("lines") - F.col("size") + 1)
    windows = sizes.select("file", "size", F.posexplode(F.transform(starts, lambda s: hash_range(F.col("lines"), s, s + F.col("size") - 1))).alias("_p", "hash"))
    found = lost.select("anchor", "file", "hash", "size", "_at").join(windows, ["file", "size", "hash"]).withColumn("_s", F.col("_p") + 1)
    near = found.groupBy("anchor").agg(F.min(F.struct(F.abs(F.col("_s") - F.col("_at")).alias("d"), F.col("_s").alias("s")))["s"].alias("_new"))
    out = settled.join(near, "anchor", "left")
    status = (
        F.when(F.col("lines").isNull(), "missing")
        .when(F.col("_ok"), F.when(F.col("_at") == F.col("was_start"), "ok").otherwise("moved"))
        .when(F.col("_new").isNotNull(), "moved")
        .otherwise("drifted")
    )
    start = F.when(F.col("_ok"), F.col("_at")).otherwise(F.col("_new"))
    return out.select("anchor", status.alias("status"), start.cast("long").alias("start_line"), (start + F.col("size") - 1).cast("long").alias("end_line"))


def resolve_by_hash(anchors: DataFrame, regions: DataFrame) -> DataFrame:
    """anchor, status of anchors of whole regions by an equi-join on (owner, hash).

    anchors(anchor, owner, hash, start_line); regions(owner, hash, start_line): what is there now.
    """
    owners = regions.select("owner").distinct().withColumn("_there", F.lit(True))
    same = regions.groupBy("owner", "hash").agg(F.array_sort(F.collect_set("start_line")).alias("_starts"))
    joined = anchors.join(owners, "owner", "left").join(same, ["owner", "hash"], "left")
    status = F.when(F.col("_there").isNull(), "missing").when(F.col("_starts").isNull(), "drifted").when(F.array_contains("_starts", F.col("start_line")), "ok").otherwise("moved")
    return joined.select("anchor", status.alias("status"))


def status_counts(resolved: DataFrame, owner: str) -> DataFrame:
    """owner, status, n: how the anchors of each owner stand."""
    return resolved.groupBy(owner, "status").agg(F.count("*").alias("n"))


def suggest_symbols(wanted: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """wanted, id, tier, score, place: symbols that a vanished one may have become.

    wanted(wanted, file, path, kind, lines, hash) and symbols(id, file, path, kind, lines,
    hash, start_line, test). Tiers: -1 the same text of 3 lines or more, if one or two have
    it; 0 a sibling with a similar name (0.5 if of another kind); 1 the same last name in the
    file, 1.05 ignoring case; 1.2 the same path elsewhere; 1.3 the same name elsewhere; 2 a
    path within two edits in the file. Tests come 10 later. Each tier is an equi-join of its own.
    """
    w = wanted.select("wanted", F.col("file").alias("wf"), F.col("path").alias("wp"), F.col("kind").alias("wk"), F.col("lines").alias("wl"), F.col("hash").alias("wh"), last_segment(F.col("path")).alias("wn"), parent_path(F.col("path")).alias("wq"))
    s = symbols.select("id", "file", "path", "kind", "lines", "hash", "start_line", "test", last_segment(F.col("path")).alias("name"), parent_path(F.col("path")).alias("up"))
    name = name_similarity(F.col("wn"), F.col("name"))
    score = 0.65 * name + 0.35 * size_similarity(F.col("wl"), F.col("lines"))
    cut = lambda df, tier, sc=score: df.select("wanted", "id", "file", "start_line", "test", (tier if not isinstance(tier, float) else F.lit(tier)).alias("tier"), sc.alias("score"))
    in_file = w.join(s, F.col("wf") == F.col("file"))
    alike = w.join(s, (F.col("wh") == F.col("hash")) & (F.col("wl") >= 3))
    alike = alike.withColumn("_n", F.count("*").over(Window.partitionBy("wanted"))).filter("_n <= 2")
    siblings = in_file.filter(F.col("wq").eqNullSafe(F.col("up")) & (name >= 0.5))
    tiers = [
        cut(alike, -1.0),
        cut(siblings, F.when(F.col("wk") == F.col("kind"), 0.0).otherwise(0.5)),
        cut(in_file.filter("wn = name"), 1.0),
        cut(in_file.filter("wn <> name and lower(wn) = lower(name)"), 1.05),
        cut(w.join(s, (F.col("wp") == F.col("path")) & (F.col("wf") != F.col("file"))), 1.2),
        cut(w.join(s, (F.col("wn") == F.col("name")) & (F.col("wf") != F.col("file")) & (F.col("wp") != F.col("path"))), 1.3),
        cut(in_file.filter(edit_distance(F.col("wp"), F.col("path"), 2) <= 2), 2.0),
    ]
    rows = tiers[0]
    for t in tiers[1:]:
        rows = rows.unionByName(t)
    best = rows.groupBy("wanted", "id").agg(F.min("tier").alias("tier"), F.max("score").alias("score"), F.first("file").alias("file"), F.first("start_line").alias("start_line"), F.first("test").alias("test"))
    best = best.withColumn("tier", F.col("tier") + F.when(F.col("test"), 10.0).otherwise(0.0))
    place = F.row_number().over(Window.partitionBy("wanted").orderBy("tier", F.desc("score"), "file", "start_line", "id"))
    return best.withColumn("place", place).filter(F.col("place") <= most).select("wanted", "id", "tier", "score", "place")


def _grams(text: Column, n: int = 3) -> Column:
    """The distinct runs of ``n`` characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def suggest_files(wanted: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """wanted, file, tier: files of the same base name (0), then files whose base name holds the wanted one without its ending (1).

    Names meet by their rarest run of three characters, so a wanted name is compared with the
    files that share it and no others. Shorter names meet by all of their one or two
    characters; names that are nothing but an ending have files of the same base name only.
    """
    base = lambda c: F.substring_index(c, "/", -1)
    f = files.select("file", base(F.col("file")).alias("_base")).distinct()
    w = wanted.select("wanted").distinct().select("wanted", base(F.col("wanted")).alias("_base"), F.regexp_replace(base(F.col("wanted")), r"\.[^.]*$", "").alias("_stem"))
    same = w.join(f, "_base").select("wanted", "file", F.lit(0).alias("tier"))
    found = same
    for n in (1, 2, 3):
        mine = w.filter(F.length("_stem") == n if n < 3 else F.length("_stem") >= n).select("wanted", "_stem", F.explode(_grams(F.col("_stem"), n)).alias("_gram"))
        index = f.filter(F.length("_base") >= n).select("file", "_base", F.explode(_grams(F.col("_base"), n)).alias("_gram"))
        often = index.join(mine.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_n"))
        rare = mine.join(often, "_gram", "left").groupBy("wanted", "_stem").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram"))["_gram"].alias("_gram"))
        found = found.unionByName(rare.join(index, "_gram").filter(F.contains(F.col("_base"), F.col("_stem"))).select("wanted", "file", F.lit(1).alias("tier")))
    best = found.groupBy("wanted", "file").agg(F.min("tier").alias("tier"))
    return best.withColumn("_r", F.row_number().over(Window.partitionBy("wanted").orderBy("tier", "file"))).filter(F.col("_r") <= most).drop("_r")


def unique_find(anchors: DataFrame, texts: DataFrame) -> DataFrame:
    """anchor, n: how often a quoted text occurs in its file, blanks collapsed; one time makes an anchor."""
    from graphloam.functions.text import occurrences

    return anchors.join(texts, "file").select("anchor", occurrences(F.col("text"), F.col("find")).alias("n"))
