"""Where a change lies on the maps of a guide: files that boxes hold, also through the maps they open, and files without a box.

Boxes are elements with an id: file:, dir: and sym: stand for code, ``repo`` for everything, any
other is a group with members. ``changed`` has path, status (added, changed, renamed, deleted),
added, removed; a path that is null is in no box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloam.functions.globs import glob_match, is_test_file
from graphloam.functions.ids import dir_of, directories
from graphloam.operators.change import range_status
from graphloam.operators.closure import closure
from graphloam.session import settle, small
from graphloam.sources.repo import LANGUAGES

#: Languages whose files are data, not code.
DATA_LANGUAGES = ("json", "yaml", "toml")
CODE_LANGUAGES = tuple(sorted(set(LANGUAGES.values()) - set(DATA_LANGUAGES)))


def elements_of(path: Column) -> Column:
    """Ids of what holds a path by itself: the file, its place on a map that does not draw it any more, each folder above it, the whole."""
    return F.concat(F.array(F.concat(F.lit("file:"), path), F.concat(F.lit("gone:"), path), F.lit("repo")), F.transform(directories(path), lambda d: F.concat(F.lit("dir:"), d)))


def _kind(element: str = "element") -> Column:
    return F.substring_index(element, ":", 1)


def _path(element: str) -> Column:
    return F.expr(f"substring({element}, position(':', {element}) + 1)")


def deleted_on(includes: DataFrame, changed: DataFrame, files: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """view, box (file: or dir:), path: deleted files that a view would draw if they were there, each under one box.

    The deepest folder or file on the way to a deleted file whose parent is the parent of a box of the view
    decides: the file is a box of its own, a folder is one if no file of ``files`` (path) is left in it. A folder that
    is still there shows nothing, even if one above it is gone from the view.
    """
    parents = includes.filter(_kind().isin("file", "dir")).select("view", dir_of(_path("element")).alias("parent")).distinct()
    gone = changed.filter("status = 'deleted'").select("path").distinct()
    if exclude:
        gone = gone.filter(~glob_match(F.col("path"), *exclude))
    way = F.transform(F.concat(directories(F.col("path")), F.array("path")), lambda e: F.struct(e.alias("at"), dir_of(e).alias("parent")))
    steps = gone.select("path", F.posexplode(way).alias("deep", "e")).select("path", "deep", "e.at", "e.parent")
    found = steps.join(parents, "parent").groupBy("view", "path").agg(F.max_by("at", "deep").alias("at"))
    left = files.select(F.explode(directories(F.col("path"))).alias("at")).distinct()
    boxes = found.filter("at = path").select("view", F.concat(F.lit("file:"), "at").alias("box"), "path")
    return boxes.unionByName(found.filter("at <> path").join(left, "at", "left_anti").select("view", F.concat(F.lit("dir:"), "at").alias("box"), "path"))


def holding(members: DataFrame, opens: DataFrame, includes: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """src, dst: from a group to its members (box, member) and from a box to what the map it opens (box, view) includes.

    ``gone`` (see ``deleted_on``) adds the deleted files of the opened maps, as ends of their own (gone:): they open nothing.
    """
    edges = members.select(F.col("box").alias("src"), F.col("member").alias("dst"))
    edges = edges.unionByName(opens.select("box", "view").join(includes.select("view", "element"), "view").select(F.col("box").alias("src"), F.col("element").alias("dst")))
    if gone is not None:
        edges = edges.unionByName(opens.select(F.col("box").alias("src"), "view").join(gone.select("view", F.concat(F.lit("gone:"), "path").alias("dst")), "view").select("src", "dst"))
    return edges.filter("src is not null and dst is not null").distinct()


def touched_ranges(ranges: DataFrame, changed: DataFrame, hunks: DataFrame) -> DataFrame:
    """element, path, status of ranges that a change touches.

    ranges(element, path, start_line, end_line, base): code of symbols and anchors of groups. Without
    lines it is the whole file; with ``base`` it is code from before the change, which only a deletion touches.
    """
    state = changed.select("path", "status")
    now = ranges.filter("not coalesce(base, false)")
    whole = now.filter("start_line is null").join(state, "path").select("element", "path", F.lit("changed").alias("status"))
    before = ranges.filter("base").join(state.filter("status = 'deleted'"), "path").select("element", "path", F.lit("changed").alias("status"))
    lined = settle(now.filter("start_line is not null").withColumn("id", F.monotonically_increasing_id()))
    said = range_status(lined.select("id", "path", "start_line", "end_line"), hunks, state).filter("status is not null")
    part = said.join(lined.select("id", "element", "path"), "id").groupBy("element", "path").agg(F.max_by("status", F.when(F.col("status") == "changed", 1).otherwise(0)).alias("status"))
    return part.unionByName(whole).unionByName(before)


def held_files(boxes: DataFrame, edges: DataFrame, touched: DataFrame, changed: DataFrame) -> DataFrame:
    """element, path: the changed files that each box (element) holds, by itself, its members and the maps they open.

    ``edges`` as of ``holding``, ``touched`` as of ``touched_ranges``. Rings of boxes end by themselves.
    """
    seeds = settle(boxes.select("element").filter("element is not null").distinct())
    edges = settle(edges.select("src", "dst"))
    holders = small(settle(edges.select(F.col("src").alias("element")).distinct()))
    # most boxes open nothing: they hold what stands under their own id, and need neither a closure nor a distinct
    opening = settle(seeds.join(holders, "element", "left_semi"))
    reached = closure(edges, opening.select(F.col("element").alias("seed"))).select(F.col("seed").alias("element"), "node")
    reached = settle(reached.unionByName(opening.select("element", F.col("element").alias("node"))).distinct())
    alone = seeds.join(holders, "element", "left_anti").select("element", F.col("element").alias("node"))
    # of the places of a path (distinct in themselves) only kinds that some box reaches are made
    kinds = [r[0] for r in seeds.select(_kind().alias("k")).union(reached.select(_kind("node").alias("k"))).filter(F.col("k").isin("file", "gone", "dir", "repo")).distinct().collect()]  # four at most
    places = F.filter(elements_of(F.col("path")), lambda e: F.substring_index(e, ":", 1).isin(*kinds)) if kinds else F.array().cast("array<string>")
    own = changed.filter("path is not null").select("path").distinct().select("path", F.explode(places).alias("node"))
    said = touched.filter(~F.coalesce(F.array_contains(elements_of(F.col("path")), F.col("element")), F.lit(False))).select(F.col("element").alias("node"), "path").distinct()
    own = own.unionByName(said)
    return alone.join(own, "node").select("element", "path").unionByName(reached.join(own, "node").select("element", "path").distinct())


def whole_new(elements: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """element of the files that a change added, and of the folders that hold files now, all of them added."""
    fresh = changed.filter("status = 'added'").select("path", F.lit(1).alias("fresh")).distinct()
    state = files.select("path").distinct().join(fresh, "path", "left")
    folders = state.select(F.explode(directories(F.col("path"))).alias("d"), F.coalesce("fresh", F.lit(0)).alias("fresh")).groupBy("d").agg(F.min("fresh").alias("all")).filter("all = 1")
    new = fresh.select(F.concat(F.lit("file:"), "path").alias("element")).unionByName(folders.select(F.concat(F.lit("dir:"), "d").alias("element")))
    return elements.select("element").distinct().join(new, "element", "left_semi")


def lift_opened(boxes: DataFrame, members: DataFrame, edges: DataFrame, touched: DataFrame, files: DataFrame, changed: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """element, status, files, added, removed of the boxes that a change touches.

    A file is new or changed (deleted ones are no box), a symbol has the status of its range. A group without members
    that holds deleted files only is removed. A folder whose files are all new, and a group whose members all are and
    which holds added files only, is new; all else is inside. Lines are summed over the files.
    """
    held = held_files(boxes, edges, touched, changed) if held is None else held
    sums = held.join(changed.select("path", "status", "added", "removed"), "path").groupBy("element").agg(
        F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.every(F.col("status") == "deleted").alias("_gone"), F.every(F.col("status") == "added").alias("_fresh")
    )
    parts = members.select(F.col("box").alias("element"), "member").distinct()
    new = settle(whole_new(boxes.select("element").unionByName(parts.select(F.col("member").alias("element"))), files, changed).withColumn("_new", F.lit(True)))
    groups = parts.join(new.withColumnRenamed("element", "member"), "member", "left").groupBy("element").agg(F.every(F.coalesce("_new", F.lit(False))).alias("_all"))
    ranged = touched.filter(_kind() == "sym").select("element", F.col("status").alias("_range")).distinct()
    joined = sums.join(new, "element", "left").join(groups, "element", "left").join(ranged, "element", "left")
    status = (
        F.when(_kind() == "file", F.when(~F.col("_gone"), F.when(F.col("_fresh"), "new").otherwise("changed")))
        .when(_kind() == "sym", F.coalesce("_range", F.lit("changed")))
        .when((_kind() != "dir") & (F.col("element") != "repo") & F.col("_all").isNull() & F.col("_gone"), "removed")
        .when((_kind() == "dir") & F.col("_new"), "new")
        .when(F.col("_all") & F.col("_fresh"), "new")
        .otherwise("inside")
    )
    return joined.select("element", status.alias("status"), "files", "added", "removed").filter("status is not null")


def part_views(views: DataFrame, includes: DataFrame, opens: DataFrame, system: str = "view:system", design: str = "view:design") -> DataFrame:
    """view, ord: the maps that boxes of the top map open, in the order of those boxes; the top map itself if there are none.

    views(view, type, ord), includes(view, ord, element), opens(box, view). The top map is ``system``, else
    the first map, ``design`` aside, that no box of another map opens. Without maps there are no rows.
    """
    maps = views.filter("type = 'graph'").select("view", "ord")
    drawn = opens.select(F.col("box").alias("element"), F.col("view").alias("inner")).join(includes.select("element", F.col("view").alias("outer"), F.col("ord").alias("at")), "element")
    inner = drawn.filter("inner <> outer").select(F.col("inner").alias("view")).distinct()
    free = maps.filter(F.col("view") != design).join(inner, "view", "left_anti").unionByName(maps.filter(F.col("view") == system))
    top = settle(free.orderBy(F.col("view") != system, "ord", "view").limit(1))  # one row
    found = drawn.join(top.select(F.col("view").alias("outer")), "outer").join(maps.select(F.col("view").alias("inner")), "inner")
    parts = found.groupBy("outer", F.col("inner").alias("view")).agg(F.min("at").alias("ord"))
    alone = top.join(parts.select(F.col("outer").alias("view")).distinct(), "view", "left_anti").select("view", F.lit(0).cast(parts.schema["ord"].dataType).alias("ord"))
    return parts.select("view", "ord").unionByName(alone)


def design_files(members: DataFrame, files: DataFrame) -> DataFrame:
    """box, path: the files that boxes hold now, by file: members and under dir: members (box, member)."""
    by = files.filter("path is not null").select(F.explode(F.filter(elements_of(F.col("path")), lambda e: e != "repo")).alias("member"), "path").distinct()
    return members.select("box", "member").distinct().join(by, "member").select("box", "path").distinct()


def unassigned_files(changed: DataFrame, members: DataFrame, files: DataFrame, exclude: tuple[str, ...] = (), languages: tuple[str, ...] = CODE_LANGUAGES) -> DataFrame:
    """path: code files that a change added and no design box holds. Tests and what the level leaves out need none.

    ``files`` has path, language of what is there now; a null language is no code.
    """
    fresh = changed.filter("status = 'added'").select("path").distinct().join(files.filter(F.col("language").isin(*languages)).select("path").distinct(), "path", "left_semi")
    fresh = fresh.filter(~is_test_file(F.col("path")))
    if exclude:
        fresh = fresh.filter(~glob_match(F.col("path"), *exclude))
    return fresh.join(design_files(members, files).select("path").distinct(), "path", "left_anti")


def drawn_on(includes: DataFrame, depth: DataFrame, changed: DataFrame) -> DataFrame:
    """path, view: the deepest map (view, depth, ord) on which a changed file is a box; of equally deep ones the first."""
    boxes = changed.select("path", F.concat(F.lit("file:"), "path").alias("element")).distinct().join(includes.select("view", "element").distinct(), "element")
    best = F.min_by("view", F.struct(-F.col("depth"), F.col("ord")))
    return boxes.join(depth.select("view", "depth", "ord"), "view").groupBy("path").agg(best.alias("view"))


def elsewhere(changed: DataFrame, held: DataFrame, parts: DataFrame) -> DataFrame:
    """The changed files that no box of ``parts`` (element) holds."""
    return changed.join(held.join(parts.select("element").distinct(), "element", "left_semi").select("path").distinct(), "path", "left_anti")
