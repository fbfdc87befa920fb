"""Reachability by frontiers: each round joins only the nodes that the round before has found."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloam.session import settle_round as settle

#: Rounds after which the pairs found so far become one table.
GATHER = 32


def rounds(most: int | None) -> Iterator[int]:
    """Round numbers without end, or an error once ``most`` rounds did not settle."""
    yield from count() if most is None else range(most)
    raise RuntimeError(f"not settled in {most} rounds")


def closure(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None, keep: Column | None = None) -> DataFrame:
    """seed, node, depth: what each seed reaches over ``edges`` (src, dst), with the least number of steps.

    ``seeds`` has the column seed. A seed reaches itself only over a cycle. Cycles end by
    themselves: a pair is expanded once. Each round is checkpointed, so plans stay short.
    Rounds go on until nothing new is found; with ``max_rounds``, up to that depth only.
    """
    edges = settle(edges.select("src", "dst").distinct() if keep is None else edges.filter(keep).select("src", "dst").distinct())
    frontier = seeds.select("seed").distinct().join(edges, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(1))
    frontier = settle(frontier)
    seen = frontier
    for depth in count(2) if max_rounds is None else range(2, max_rounds + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = settle(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % GATHER == 0:
            seen = settle(seen)
    return seen


def reach_count(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """seed, n: how many nodes each seed reaches; 0 for those that reach none."""
    found = closure(edges, seeds, max_rounds).filter("seed <> node").groupBy("seed").agg(F.count("*").alias("_n"))
    return seeds.select("seed").distinct().join(found, "seed", "left").select("seed", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def reach_of(edges: DataFrame, start: DataFrame, backward: bool = False, max_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, depth) reached from any of ``start`` (column seed), and the edges between them."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backward else edges
    one = start.select("seed").distinct()
    nodes = closure(turned, one, max_rounds).groupBy("node").agg(F.min("depth").alias("depth"))
    nodes = one.select(F.col("seed").alias("node")).withColumn("depth", F.lit(0)).unionByName(nodes.join(one.select(F.col("seed").alias("node")), "node", "left_anti"))
    ends = nodes.select("node")
    inside = edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes, inside


def ancestors(parents: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """node, ancestor, level over a table of node, parent: level 0 is the node itself."""
    up = parents.filter("parent is not null").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    found = closure(up, parents.select(F.col("node").alias("seed")), max_rounds)
    selves = parents.select("node", F.col("node").alias("ancestor")).distinct().withColumn("level", F.lit(0))
    return selves.unionByName(found.filter("seed <> node").select(F.col("seed").alias("node"), F.col("node").alias("ancestor"), F.col("depth").alias("level")))


class _Merged(NamedTuple):
    """What undoes a contraction: root of each node, the jumps by powers of two, and edges (w, t) into nodes that went."""

    roots: DataFrame
    jumps: list[DataFrame]
    into: DataFrame


def _contract(edges: DataFrame) -> tuple[DataFrame, _Merged | None]:
    """Nodes with one way out merged into where that way leads, along ways of any length; (edges left, how to undo it).

    Every cycle through such a node goes on along its one way, so cycles among the others stay
    as they are. Ways are followed by doubling: log2 of their length rounds, in which those that have ended take no part.
    """
    one = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("to")).filter("n = 1").select("node", "to")
    one = settle(one)
    many = one.count()
    if not many:
        return edges, None
    # only nodes whose way goes on are followed further
    ends = one.select(F.col("node").alias("to"))
    on = settle(one.join(ends, "to", "left_semi").withColumn("low", F.least("node", "to")).select("node", "to", "low"))
    found, jumps, left = one.join(ends, "to", "left_anti").select("node", F.col("to").alias("root")), [], on.count()
    while left:
        jumps.append(on.select("node", "to"))
        nxt = on.select(F.col("node").alias("to"), F.col("to").alias("_far"), F.col("low").alias("_low"))
        step = settle(on.join(nxt, "to", "left").select("node", "to", "_far", "low", "_low"))
        # the next node has ended: it leads to its root
        ended = step.filter("_far is null").select("node", "to").join(found.select(F.col("node").alias("to"), "root"), "to").select("node", "root")
        further = step.filter("_far is not null").select("node", F.col("_far").alias("to"), F.least("low", "_low").alias("low"))
        still = further.count()
        if still < left:
            found = found.unionByName(settle(ended))
        elif step.filter("low <> _low").select("node").join(step.select(F.col("to").alias("node")), "node", "left_semi").isEmpty():
            # no way ended, so all that are left run into rings; and nothing lower comes where they have run to, so that is the least of the ring: its root
            ring = step.select(F.col("node").alias("to"), F.col("low").alias("root"))
            found = found.unionByName(on.join(ring, "to").select("node", "root"))
            break
        on, left = further, still
    roots = settle(found.filter("node <> root"))
    gone = roots.select("node")
    into = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("w"), F.col("dst").alias("t"))
    a, b = roots.toDF("src", "_a"), roots.toDF("dst", "_b")
    left = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("_a", "src").alias("src"), F.coalesce("_b", "dst").alias("dst")).filter("src <> dst").distinct()
    return settle(left), _Merged(roots, jumps, settle(into))


def _restored(parts: DataFrame, merged: _Merged) -> DataFrame:
    """node, component with the merged nodes: those in their root's component to which a way from it leads back."""
    name = lambda node, out: parts.select(F.col("node").alias(node), F.col("component").alias(out))
    ends = merged.into.join(merged.roots.toDF("t", "root"), "t").join(name("w", "_w"), "w", "left").join(name("root", "_r"), "root", "left")
    marked = settle(ends.filter(F.coalesce("_w", "w") == F.coalesce("_r", "root")).select(F.col("t").alias("node")).distinct())
    for jump in merged.jumps:  # everything on the way from a marked node to the root
        further = marked.join(jump, "node").select(F.col("to").alias("node"))
        marked = settle(marked.union(further).distinct())
    back = merged.roots.join(marked, "node", "left_semi").join(name("root", "_r"), "root", "left").select("node", F.coalesce("_r", "root").alias("component"))
    return settle(parts.unionByName(back))


def _on_cycles(edges: DataFrame) -> DataFrame:
    """Edges without those of nodes that have no way in or none out; once, not until nothing changes."""
    both = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
    return settle(edges.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi"))


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _coloured(edges: DataFrame, max_rounds: int | None) -> DataFrame:
    """node, component by colours: the greatest name that reaches each node; of one colour, what leads back to that name is a component."""
    found = None
    for _ in rounds(max_rounds):
        colour = settle(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("colour", F.col("node")))
        while True:
            best = edges.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_c"))
            nxt = settle(colour.join(best, "node", "left").select("node", F.greatest("colour", F.coalesce("_c", "colour")).alias("colour"), (F.col("_c") > F.col("colour")).alias("moved")))
            colour = nxt.select("node", "colour")
            if nxt.filter("moved").isEmpty():
                break
        inside = edges.join(colour.toDF("src", "_a"), "src").join(colour.toDF("dst", "_b"), "dst").filter("_a = _b").select("src", "dst")
        back = settle(_turned(inside))
        frontier = settle(colour.filter("node = colour").select("node", F.col("colour").alias("component")))
        part = frontier
        while not frontier.isEmpty():
            step = frontier.join(back, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "component").distinct()
            frontier = settle(step.join(part, "node", "left_anti"))
            part = settle(part.unionByName(frontier))
        found = part if found is None else settle(found.unionByName(part))
        done = part.select("node")
        edges = settle(edges.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti"))
        edges = _on_cycles(edges)
        if edges.isEmpty():
            return found


def strong_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """node, component: nodes that reach each other share the least of their names.

    Nodes outside every cycle go, and nodes with one way out, or one way in, are merged along it,
    in both directions in turn until neither makes the graph smaller. Long chains and rings
    take the logarithm of their length in rounds, and no set of reachable pairs is made. What is left has
    several ways in and out everywhere and is coloured; ``max_rounds`` bounds the colourings.
    """
    edges = settle(edges.select("src", "dst").filter("src <> dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    core, undo, size = _on_cycles(edges), [], None
    while core.count() and core.count() != size:
        size = core.count()
        for _ in range(2):  # along ways out, then, turned, along ways in
            core, merged = _contract(core)
            undo.append(merged)
            core = _turned(core)
        core = _on_cycles(core)
    parts = _coloured(core, max_rounds) if core.count() else None
    if parts is None:
        parts = settle(nodes.limit(0).withColumn("component", F.col("node")))
    for merged in reversed(undo):
        if merged is not None:
            parts = _restored(parts, merged)
    named = nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("_c"))
    low = named.groupBy("_c").agg(F.min("node").alias("component"))
    return named.join(low, "_c").select("node", "component")


def reading_order(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """node, component, level: users before what they use; a cycle is one step.

    The level of a component is the longest way to it from a component that nobody uses.
    """
    parts = settle(strong_components(edges, max_rounds))
    a, b = parts.toDF("src", "ca"), parts.toDF("dst", "cb")
    steps = settle(edges.join(a, "src").join(b, "dst").filter("ca <> cb").select("ca", "cb").distinct())
    level = settle(parts.select(F.col("component").alias("c")).distinct().withColumn("level", F.lit(0)))
    for _ in rounds(max_rounds):
        longer = level.join(steps, F.col("c") == F.col("ca")).groupBy("cb").agg((F.max("level") + 1).alias("to"))
        nxt = settle(level.join(longer, F.col("c") == F.col("cb"), "left").select("c", F.greatest("level", F.coalesce("to", F.lit(0))).alias("level")))
        moved = nxt.join(level.withColumnRenamed("level", "was"), "c").filter("level <> was").isEmpty()
        level = nxt
        if moved:
            break
    return parts.join(level, F.col("component") == F.col("c")).select("node", "component", "level")


def expand_tree(edges: DataFrame, roots: DataFrame, depth: int, children: int = 15) -> DataFrame:
    """A bounded tree of references: root, node, parent, level, and how many children a cap leaves out.

    Each element stands once under a root, at its least level and under its least parent. Of
    the children of a node the first ``children`` by count and name are drawn.
    """
    edges = settle(edges.groupBy("src", "dst").agg(F.count("*").alias("n")))
    level = settle(roots.select(F.col("seed").alias("root"), F.col("seed").alias("node")).distinct().withColumn("parent", F.lit(None).cast(roots.schema["seed"].dataType)).withColumn("level", F.lit(0)).withColumn("more", F.lit(0).cast("long")))
    seen = level
    for d in range(1, depth + 1):
        found = level.filter(F.col("level") == d - 1).select("root", F.col("node").alias("src")).join(edges, "src").select("root", F.col("src").alias("parent"), F.col("dst").alias("node"), "n")
        found = found.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        first = found.withColumn("_p", F.row_number().over(Window.partitionBy("root", "node").orderBy("parent"))).filter("_p = 1")
        by = Window.partitionBy("root", "parent")
        ranked = first.withColumn("_r", F.row_number().over(by.orderBy(F.desc("n"), "node"))).withColumn("_all", F.count("*").over(by))
        level = settle(ranked.filter(F.col("_r") <= children).select("root", "node", "parent", F.lit(d).alias("level"), F.when(F.col("_r") == F.least(F.col("_all"), F.lit(children)), F.col("_all") - F.least(F.col("_all"), F.lit(children).cast("long"))).otherwise(0).alias("more")))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def ref_tree(refs: DataFrame, hops: DataFrame, roots: DataFrame, depth: int, children: int = 15) -> DataFrame:
    """A tree of references with free hops: root, parent, node, level, hop, note, n.

    refs(src, dst), one row for each reference; hops(src, dst): from a declaration to what
    stands for it (an implementation, an override), which costs no level; roots(seed). Of the
    references of an element the first ``children`` by count and name are listed; a row with
    note ``more`` and no node says how many are left. Hops are closed before the next level,
    and hopped elements are expanded like others. An element is expanded once under a root, at
    its least level, referred to before hopped to and then under its least parent; elsewhere
    its note is ``cycle`` if it is above itself, or ``seen`` if something is listed below it
    there. ``n`` counts references; 0 for a hop.
    """
    edges = settle(refs.groupBy("src", "dst").agg(F.count("*").alias("n")))
    free = settle(hops.select("src", "dst").distinct())
    kind = roots.schema["seed"].dataType
    start = roots.select(F.col("seed").alias("root"), F.col("seed").alias("node"), F.array("seed").alias("path")).distinct()
    frontier = settle(start)
    open_ = frontier.select("root", "node")
    out = None
    by = Window.partitionBy("root", "parent")
    first = Window.partitionBy("root", "node").orderBy("parent")

    def met(found: DataFrame, taken: DataFrame, last: bool) -> DataFrame:
        """Notes of rows that meet elements: above them, expanded before, or met again in this round."""
        known = found.join(taken.withColumn("_known", F.lit(True)), ["root", "node"], "left")
        above = F.array_contains("path", F.col("node"))
        again = F.lit(False) if last else F.row_number().over(first) > 1
        fresh = known.withColumn("note", F.when(above, "cycle").when(F.col("_known"), "seen"))
        new = fresh.filter("note is null").withColumn("note", F.when(again, "seen"))
        return settle(fresh.filter("note is not null").unionByName(new).drop("_known"))

    for level in range(1, depth + 1):
        last = level == depth
        found = frontier.select("root", F.col("node").alias("src"), "path").join(edges, "src").select("root", F.col("src").alias("parent"), F.col("dst").alias("node"), "n", "path")
        # only what is listed is written down; selections and unions of written rounds are not written again
        ranked = settle(found.withColumn("_r", F.row_number().over(by.orderBy(F.desc("n"), "node"))).withColumn("_all", F.count("*").over(by)).filter(F.col("_r") <= children))
        more = ranked.filter(f"_r = {children} and _all > {children}").select("root", "parent", F.lit(None).cast(kind).alias("node"), F.lit(False).alias("hop"), F.lit("more").alias("note"), (F.col("_all") - children).alias("n"))
        rows = met(ranked.drop("_r", "_all"), open_, last)
        listed = rows.select("root", "parent", "node", F.lit(False).alias("hop"), "note", "n").unionByName(more)
        new = rows.filter("note is null").select("root", "node", F.concat("path", F.array("node")).alias("path"))
        step = new
        taken = open_ if last else open_.unionByName(step.select("root", "node"))
        hops_done = 0
        while not free.isEmpty():
            hopped = step.select("root", F.col("node").alias("src"), "path").join(free, "src").select("root", F.col("src").alias("parent"), F.col("dst").alias("node"), F.lit(0).cast("long").alias("n"), "path")
            rows = met(hopped, taken, last)
            listed = listed.unionByName(rows.select("root", "parent", "node", F.lit(True).alias("hop"), "note", "n"))
            step = rows.filter("note is null").select("root", "node", F.concat("path", F.array("node")).alias("path"))
            if step.isEmpty():
                break
            new = new.unionByName(step)
            if not last:
                taken = taken.unionByName(step.select("root", "node"))
            hops_done += 1
            if hops_done % GATHER == 0:  # plans stay short
                new, taken, listed = settle(new), taken if last else settle(taken), settle(listed)
        part = listed.withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
        frontier, open_ = new, taken
        if level % GATHER == 0:
            frontier, open_, out = settle(frontier), settle(open_), settle(out)
        if frontier.isEmpty():
            break
    if out is None:
        return start.select("root", F.col("root").alias("parent"), "node", F.lit(0).alias("level"), F.lit(False).alias("hop"), F.lit("").alias("note"), F.lit(0).cast("long").alias("n")).limit(0)
    # what has nothing below it is not marked as listed elsewhere
    below = edges.select(F.col("src").alias("node")).union(free.select("src")).distinct().withColumn("_below", F.lit(True))
    names = ["root", "parent", "node", "level", "hop", "note", "n"]
    again = out.filter("note = 'seen'").join(below, "node", "left").withColumn("note", F.when(F.col("_below"), F.col("note")))
    return out.filter("note is null or note <> 'seen'").select(names).unionByName(again.select(names))
