"""A view of a code graph: boxes, the arrows between them, and stubs to what lies outside.

References are the only large table. They meet the boxes that stand for their ends once and
are counted in one aggregate, by pair of boxes, or by box and outside element; everything after
that works on counts. A view names few elements, so what follows from them (boxes, their
containers, what they cover) is settled and broadcast if its size allows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloam.operators.closure import closure
from graphloam.operators.hierarchy import single_child_chain
from graphloam.operators.projection import plan_stubs
from graphloam.session import settle_round as settle
from graphloam.session import small

ROOT = "repo"


class View:
    """nodes(id, parent, container), edges(id, kind, a, b, n, resolution, stored, label), stubs(direction, inside, ghost, n, kinds).

    Each is made when it is first asked for: boxes need no reference, and arrows no ghosts.
    """

    def __init__(self, nodes: Callable[[], DataFrame], edges: Callable[[], DataFrame], stubs: Callable[[], DataFrame]) -> None:
        self._nodes, self._edges, self._stubs = nodes, edges, stubs

    @cached_property
    def nodes(self) -> DataFrame:
        return self._nodes()

    @cached_property
    def edges(self) -> DataFrame:
        return self._edges()

    @cached_property
    def stubs(self) -> DataFrame:
        return self._stubs()


def edge_id(kind: Column, a: Column, b: Column) -> Column:
    """The id of a derived arrow."""
    return F.concat(F.lit("edge:derived:"), kind, F.lit(":"), a, F.lit("->"), b)


def containers(ancestors: DataFrame, memberships: DataFrame | None) -> DataFrame:
    """node, element, level, sub: all that holds a node, nearest first: itself at level 0, its parents, and at each level the groups that list it."""
    own = ancestors.select("node", F.col("ancestor").alias("element"), "level", F.lit(0).alias("sub"))
    if memberships is None:
        return own
    listed = ancestors.join(memberships, F.col("ancestor") == F.col("member")).filter("grp <> node")
    return own.unionByName(listed.select("node", F.col("grp").alias("element"), "level", F.col("sub_level").alias("sub")))


def covered(include: DataFrame, ancestors: DataFrame, memberships: DataFrame | None = None) -> DataFrame:
    """element: what holds an included element, or a member of an included group, or is one."""
    inside = include.select(F.col("element").alias("node"))
    if memberships is not None:
        inside = inside.union(memberships.join(include, F.col("grp") == F.col("element")).select("member")).distinct()
    return ancestors.join(small(settle(inside)), "node", "left_semi").select(F.col("ancestor").alias("element")).distinct()


def box_parents(include: DataFrame, held: DataFrame) -> DataFrame:
    """node, parent: the nearest included container of each included element.

    Groups that hold each other would be each other's parent: of such a cycle the first
    element that is met from the least name that leads to it has no parent.
    """
    mine = held.join(include.select(F.col("element").alias("node")), "node", "left_semi").filter("element <> node")
    found = mine.join(include, "element", "left_semi").groupBy("node").agg(F.min(F.struct("level", "sub", "element"))["element"].alias("parent"))
    found = settle(found)
    up = closure(found.select(F.col("node").alias("src"), F.col("parent").alias("dst")), found.select(F.col("node").alias("seed")))
    around = settle(up.filter("seed = node").select("node", F.lit(True).alias("in_cycle")))
    if around.isEmpty():
        return found
    selves = around.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth"))
    ways = up.join(around.select("node"), "node", "left_semi").filter("seed <> node").unionByName(selves)
    entry = ways.groupBy("seed").agg(F.min(F.struct("depth", "node"))["node"].alias("entry"))
    # a name leads to one cycle; the cycle is named by its least element
    ring = up.join(around.select("node"), "node", "left_semi").join(around.select(F.col("node").alias("seed")), "seed", "left_semi").groupBy(F.col("seed").alias("entry")).agg(F.min("node").alias("ring"))
    cut = entry.join(ring, "entry").groupBy("ring").agg(F.min(F.struct("seed", "entry"))["entry"].alias("node"))
    return settle(found.join(cut, "node", "left_anti"))


def drawn_inside(parents: DataFrame) -> DataFrame:
    """inner, outer, depth: boxes and the boxes they are drawn in, at any depth."""
    up = closure(parents.select(F.col("node").alias("src"), F.col("parent").alias("dst")), parents.select(F.col("node").alias("seed")))
    return settle(up.select(F.col("seed").alias("inner"), F.col("node").alias("outer"), "depth"))


def not_nested(arrows: DataFrame, inside: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Arrows without those between a box and one it is drawn in."""
    both = inside.select(F.col("inner").alias(a), F.col("outer").alias(b)).union(inside.select("outer", "inner"))
    return arrows.join(small(settle(both)), [a, b], "left_anti")


def named_files(include: DataFrame, nodes: DataFrame, memberships: DataFrame | None = None) -> DataFrame:
    """file: the files that a view names: as a file, as a symbol in it, or as a member of an included group."""
    named = include.select(F.col("element").alias("id"))
    if memberships is not None:
        named = named.union(memberships.join(include, F.col("grp") == F.col("element")).select("member"))
    return nodes.join(named.distinct(), "id", "left_semi").filter("file is not null").select("file").distinct()


def without_files(refs: DataFrame, excluded: DataFrame, named: DataFrame) -> DataFrame:
    """References that neither start nor end in an excluded file (column file) that the view does not name.

    ``refs`` has src_file and dst_file; an end in no file stays.
    """
    gone = small(settle(excluded.select("file").distinct().join(named, "file", "left_anti")))
    return refs.join(gone.withColumnRenamed("file", "src_file"), "src_file", "left_anti").join(gone.withColumnRenamed("file", "dst_file"), "dst_file", "left_anti")


def _flows(refs: DataFrame, reps: DataFrame) -> DataFrame:
    """kind, a, b, outside, n, least, most: references counted by their boxes and, where one end is in none, by that end."""
    a, b = reps.select(F.col("node").alias("src"), F.col("rep").alias("a")), reps.select(F.col("node").alias("dst"), F.col("rep").alias("b"))
    both = refs.join(a, "src", "left").join(b, "dst", "left").filter("a is not null or b is not null")
    loop = "a = b and not (kind = 'calls' and src = dst and src = a)"
    seen = both.filter(f"a is null or b is null or not ({loop})")
    outside = F.when(F.col("a").isNull(), F.col("src")).when(F.col("b").isNull(), F.col("dst"))
    # references are counted by hash; least and greatest of texts are sorted for, so they are taken of the counts
    counts = seen.groupBy("kind", "a", "b", outside.alias("outside"), "resolution").agg(F.count("*").alias("n"))
    return settle(counts.groupBy("kind", "a", "b", "outside").agg(F.sum("n").alias("n"), F.min("resolution").alias("least"), F.max("resolution").alias("most")))


def _dispatched(refs: DataFrame, reps: DataFrame, dispatch: DataFrame) -> DataFrame:
    """Arrows to the one implementation that a call of an interface's member runs; precise if call and implementation both are."""
    one = dispatch.groupBy("dst").agg(F.count("*").alias("many"), F.min("target").alias("target"), F.min("resolution").alias("trust")).filter("many = 1").drop("many")
    boxes = reps.select(F.col("node").alias("target"), F.col("rep").alias("c"))
    one = small(settle(one.join(boxes, "target")))
    calls = refs.filter("kind = 'calls'").join(one, "dst")
    a, b = reps.select(F.col("node").alias("src"), F.col("rep").alias("a")), reps.select(F.col("node").alias("dst"), F.col("rep").alias("b"))
    found = calls.join(a, "src").join(b, "dst", "left").filter("c <> a and (b is null or c <> b)")
    trust = F.when(F.col("trust") == "precise", F.col("resolution")).otherwise("heuristic")
    counts = found.groupBy("kind", "a", F.col("c").alias("b"), trust.alias("trust")).agg(F.count("*").alias("n"))
    return counts.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.min("trust").alias("least"), F.max("trust").alias("most"))


def ghost_targets_of(outside: DataFrame, held: DataFrame, cover: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, target: the highest parent of each outside element below the root that holds nothing of the view; a group is its own."""
    blocked = small(cover).withColumn("holds", F.lit(True))
    chain = held.filter("sub = 0").join(outside.select("node").distinct(), "node", "left_semi").join(blocked, "element", "left")
    stop = F.coalesce(F.col("holds"), F.lit(False)) | (F.col("element") == ROOT)
    # the chain of parents is as long as the tree is deep
    rows = chain.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("level", "element", stop.alias("stop")))).alias("up"))
    last = F.coalesce(F.expr("array_min(transform(filter(up, x -> x.level > 0 and x.stop), x -> x.level))"), F.expr("up[size(up) - 1].level + 1"))
    rows = rows.withColumn("last", last).select("node", F.expr("filter(up, x -> x.level = last - 1)[0].element").alias("found"))
    groups = nodes.filter("kind = 'group'").select(F.col("id").alias("node"), F.lit(True).alias("is_group"))
    known = outside.select("node").distinct().join(rows, "node", "left").join(groups, "node", "left")
    return known.select("node", F.when(F.col("is_group"), F.col("node")).otherwise(F.coalesce("found", "node")).alias("target"))


def derive_graph(
    nodes: DataFrame,
    ancestors: DataFrame,
    refs: DataFrame,
    include: DataFrame,
    *,
    kinds: list[str] | None = None,
    memberships: DataFrame | None = None,
    hidden: DataFrame | None = None,
    excluded: DataFrame | None = None,
    dispatch: DataFrame | None = None,
    stored: DataFrame | None = None,
    stub_mode: str = "top",
    most: int = 8,
) -> View:
    """What a view shows: boxes with their parents, arrows between them, stubs to outside elements.

    nodes(id, kind, file); ancestors(node, ancestor, level), level 0 the node itself and the
    root named ``repo``; refs(src, dst, kind, resolution, src_file, dst_file);
    include(element); memberships(member, grp, sub_level), nested groups too;
    hidden(element); excluded(file); dispatch(dst, target, resolution, target_file): the
    implementations outside tests of each interface member; stored(id, src, dst, kind, origin,
    label, via). Included elements that do not exist are left out, and so are references to
    unknown ends. The order of steps: excluded files (but those the view names), boxes, arrows
    and dispatch, stored arrows, via paths, ghosts, and hidden elements last; what is hidden
    gives its place among the ghosts to the next one. An empty view has no rows.
    """
    drawn = settle(include.select("element").distinct().join(nodes.select(F.col("id").alias("element")), "element", "left_semi"))
    view = small(drawn)
    held = containers(ancestors, memberships)
    parents = box_parents(view, held)
    inside = drawn_inside(parents)
    gone = settle(hidden.select("element").distinct()) if hidden is not None else drawn.limit(0)
    left = small(gone)

    @cache
    def counted() -> tuple[DataFrame, DataFrame, DataFrame]:
        """reps; derived arrows; references between a box and what is in none."""
        reps = settle(held.join(view, "element", "left_semi").groupBy("node").agg(F.min(F.struct("level", "sub", "element"))["element"].alias("rep")))
        used = refs if kinds is None else refs.filter(F.col("kind").isin(kinds))
        calls = dispatch
        if excluded is not None:
            named = named_files(view, nodes, memberships)
            used = without_files(used, excluded, named)
            if dispatch is not None:
                calls = dispatch.join(small(settle(excluded.join(named, "file", "left_anti").select(F.col("file").alias("target_file")))), "target_file", "left_anti")
        flows = _flows(used, reps)
        arrows = flows.filter("outside is null").select("kind", "a", "b", "n", "least", "most")
        if calls is not None:
            arrows = arrows.unionByName(_dispatched(used, reps, calls))
        summed = not_nested(arrows, inside).groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        common = F.when(F.col("least") == F.col("most"), F.col("least")).otherwise("mixed")
        edges = summed.select(edge_id(F.col("kind"), F.col("a"), F.col("b")).alias("id"), "kind", "a", "b", "n", common.alias("resolution"), F.lit(False).alias("stored"), F.lit(None).cast("string").alias("label"))
        touching = flows.filter("outside is not null").select(F.when(F.col("a").isNull(), "in").otherwise("out").alias("direction"), F.coalesce("a", "b").alias("inside"), F.col("outside").alias("node"), "kind", "n")
        return reps, settle(edges), touching

    @cache
    def with_stored() -> tuple[DataFrame, DataFrame, DataFrame]:
        reps, edges, _ = counted()
        return _with_stored(edges, stored, nodes, reps, inside)

    def shown_edges() -> DataFrame:
        edges = counted()[1] if stored is None else with_stored()[0]
        edges = edges.join(left.withColumnRenamed("element", "a"), "a", "left_anti").join(left.withColumnRenamed("element", "b"), "b", "left_anti").join(left.withColumnRenamed("element", "id"), "id", "left_anti")
        return edges.select("id", "kind", "a", "b", "n", "resolution", "stored", "label")

    def shown_stubs() -> DataFrame:
        touching = counted()[2]
        if stored is not None:
            _, more, through = with_stored()
            # what a stored path names in between is part of its arrow and no stub
            ways = held.join(touching.select("node").distinct(), "node", "left_semi").join(through.select("via").distinct(), F.col("element") == F.col("via"), "left_semi")
            part = touching.select("inside", "node").distinct().join(ways.select("node", F.col("element").alias("via")), "node").join(through, ["inside", "via"], "left_semi").select("inside", "node").distinct()
            touching = touching.join(part, ["inside", "node"], "left_anti").unionByName(more)
        touching, cover = settle(touching), settle(covered(view, ancestors, memberships))
        targets = settle(ghost_targets_of(touching, held, cover, nodes))
        found = touching.join(targets, "node").groupBy("direction", "inside", "target").agg(F.sum("n").alias("n"), F.sort_array(F.collect_set("kind")).alias("kinds"))
        # no place outside holds the box itself, or is in it
        above = settle(held.join(view.select(F.col("element").alias("node")), "node", "left_semi").select(F.col("node").alias("inside"), F.col("element").alias("target")).distinct())
        below = held.join(view, "element", "left_semi").select(F.col("element").alias("inside"), F.col("node").alias("target"))
        found = settle(found.join(small(above), ["inside", "target"], "left_anti").join(below, ["inside", "target"], "left_anti"))
        return _stubs(found, nodes, cover, gone, stub_mode, most)

    def shown_boxes() -> DataFrame:
        seen = drawn.join(left, "element", "left_anti").select(F.col("element").alias("id"))
        open_ = inside.join(left.withColumnRenamed("element", "outer"), "outer", "left_anti").groupBy(F.col("inner").alias("id")).agg(F.min(F.struct("depth", "outer"))["outer"].alias("parent"))
        placed = seen.join(open_, "id", "left")
        full = placed.filter("parent is not null").select(F.col("parent").alias("id"), F.lit(True).alias("full")).distinct()
        return placed.join(full, "id", "left").select("id", "parent", F.coalesce("full", F.lit(False)).alias("container"))

    return View(shown_boxes, shown_edges, shown_stubs)


def _with_stored(edges: DataFrame, stored: DataFrame, nodes: DataFrame, reps: DataFrame, inside: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(arrows with the stored ones, stubs of stored arrows, inside and via of stored paths between two boxes).

    A stored arrow of the same id as a derived one gives it its label. Others go between the
    boxes of their ends; of those that a box stands for, all of one kind and pair are one.
    """
    once = settle(stored.groupBy("id").agg(F.min(F.struct("src", "dst", "kind", "origin", "label", "via")).alias("s")).select("id", "s.*"))
    over = once.select("id", F.col("label").alias("_label"), F.lit(True).alias("_stored"))
    edges = edges.join(over, "id", "left").select("id", "kind", "a", "b", "n", "resolution", F.coalesce("_stored", F.lit(False)).alias("stored"), F.col("_label").alias("label"))
    there = nodes.select("id")
    known = once.join(there.withColumnRenamed("id", "src"), "src", "left_semi").join(there.withColumnRenamed("id", "dst"), "dst", "left_semi")
    ends = known.join(reps.select(F.col("node").alias("src"), F.col("rep").alias("a")), "src", "left").join(reps.select(F.col("node").alias("dst"), F.col("rep").alias("b")), "dst", "left")
    through = ends.filter("a is not null and b is not null").select(F.explode(F.array("a", "b")).alias("inside"), F.col("via").alias("all")).select("inside", F.explode("all").alias("via")).distinct()
    ends = ends.join(edges.select("id"), "id", "left_anti")
    both = not_nested(ends.filter("a is not null and b is not null and (a <> b or (a = src and b = dst))"), inside)
    trust = F.when(F.col("origin").isin("llm", "user"), F.col("origin")).otherwise("static")
    shown = both.withColumn("own", F.when((F.col("a") == F.col("src")) & (F.col("b") == F.col("dst")), F.col("id")))
    first = F.min(F.struct("id", trust.alias("resolution")))
    label = F.when((F.min("label") == F.max("label")) & (F.count("label") == F.count("*")), F.min("label"))
    shown = shown.groupBy("kind", "a", "b", "own").agg(first.alias("f"), F.count("*").alias("n"), label.alias("label"))
    shown = shown.select("f.id", "kind", "a", "b", "n", "f.resolution", F.lit(True).alias("stored"), "label")
    one = ends.filter("(a is null) <> (b is null)")
    stubs = one.select(F.when(F.col("a").isNull(), "in").otherwise("out").alias("direction"), F.coalesce("a", "b").alias("inside"), F.when(F.col("a").isNull(), F.col("src")).otherwise(F.col("dst")).alias("node"), "kind", F.lit(1).cast("long").alias("n"))
    return edges.unionByName(shown), stubs, through


def _stubs(found: DataFrame, nodes: DataFrame, cover: DataFrame, gone: DataFrame, mode: str, most: int) -> DataFrame:
    """Stubs by ghost: symbols of partly shown files as one ghost for each file, then the ``most`` largest."""
    partly = small(cover).select(F.col("element").alias("file"), F.lit(True).alias("partly"))
    place = nodes.filter("kind in ('symbol', 'file')").select(F.col("id").alias("target"), "file").join(partly, "file", "left")
    keyed = found.join(place, "target", "left")
    key = F.when(F.col("partly"), F.concat(F.lit("rest:"), F.col("file"))).otherwise(F.col("target")) if mode == "top" else F.col("target")
    keyed = keyed.withColumn("ghost", key)
    for column in ("inside", "target", "ghost"):
        keyed = keyed.join(small(gone).withColumnRenamed("element", column), column, "left_anti")
    # many targets may share a ghost
    summed = keyed.groupBy("direction", "inside", "ghost").agg(F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"))
    planned = plan_stubs(summed, mode, most)
    return planned.join(small(gone).withColumnRenamed("element", "ghost"), "ghost", "left_anti").select("direction", "inside", "ghost", "n", "kinds")


def expand_stub(include: DataFrame, ghost: str) -> DataFrame:
    """The view with one ghost added; ghosts that stand for several elements (``rest:``, ``more:``) add nothing."""
    if ghost.startswith(("rest:", "more:")):
        return include.select("element")
    spark: SparkSession = include.sparkSession
    return include.select("element").union(spark.createDataFrame([(ghost,)], "element string")).distinct()


def default_include(parents: DataFrame, folders: DataFrame, depth: int = 1, root: str = ROOT) -> DataFrame:
    """element: what lies ``depth`` levels below ``root``, and what ends above that.

    ``parents`` has node and parent; chains of folders (column node of ``folders``, the root
    among them) that hold only another folder are one level, shown as their last folder. A
    root with nothing below is shown itself; one that does not exist gives no rows.
    """
    ends = settle(single_child_chain(parents, folders))
    known = parents.filter(F.col("node") == root)
    if depth < 1:
        return known.select(F.col("node").alias("element")).distinct()
    level = known.select("node").distinct().join(ends, "node").select(F.col("last").alias("node"))
    below = settle(parents.filter("parent is not null").join(ends, "node").select(F.col("parent").alias("above"), F.col("last").alias("child")))
    out = None
    for d in range(1, depth + 1):
        step = settle(level.join(below, F.col("above") == F.col("node")).select(F.col("child").alias("node")).distinct())
        if d == depth:
            done = step
        else:
            has = step.join(below.select(F.col("above").alias("node")), "node", "left_semi")
            done, level = step.join(has, "node", "left_anti"), has
        out = done if out is None else out.union(done)
    out = settle(out.select(F.col("node").alias("element")).distinct())
    return known.select(F.col("node").alias("element")).distinct() if out.isEmpty() else out
