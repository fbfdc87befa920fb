"""Roll-ups over a hierarchy: which container stands for an element, and what crosses its border."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloam.session import settle_round as settle


def representative(ancestors: DataFrame, include: DataFrame, memberships: DataFrame | None = None) -> DataFrame:
    """node, rep: the nearest included element at or above each node.

    ``ancestors`` has node, ancestor, level; ``include`` has element; ``memberships`` has
    member, grp, sub_level for groups that list an element (nested groups have larger
    sub_levels). At each level the element itself comes before its groups, nearer groups
    before farther ones, names decide ties. Nodes without any are left out: they are outside.
    """
    own = ancestors.select("node", "ancestor", "level", F.col("ancestor").alias("rep"), F.lit(0).alias("sub"))
    if memberships is not None:
        listed = ancestors.join(memberships, F.col("ancestor") == F.col("member")).filter("grp <> node")
        own = own.unionByName(listed.select("node", "ancestor", "level", F.col("grp").alias("rep"), F.col("sub_level").alias("sub")))
    found = own.join(include.select(F.col("element").alias("rep")).distinct(), "rep", "left_semi")
    return found.groupBy("node").agg(F.min(F.struct("level", "sub", "rep"))["rep"].alias("rep"))


def render_parent(ancestors: DataFrame, include: DataFrame) -> DataFrame:
    """node, parent for each included node: the nearest included element strictly above."""
    inside = ancestors.join(include.select(F.col("element").alias("node")).distinct(), "node", "left_semi").filter("level > 0")
    found = inside.join(include.select(F.col("element").alias("ancestor")).distinct(), "ancestor", "left_semi")
    return found.groupBy("node").agg(F.min(F.struct("level", "ancestor"))["ancestor"].alias("parent"))


def group_reach(memberships: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """member, grp, sub_level: transitive membership of groups (member, grp), safe against cycles."""
    from graphloam.operators.closure import closure

    up = memberships.select(F.col("member").alias("src"), F.col("grp").alias("dst"))
    return closure(up, up.select(F.col("src").alias("seed")), max_rounds).select(F.col("seed").alias("member"), F.col("node").alias("grp"), F.col("depth").alias("sub_level"))


def subtree(ancestors: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node: everything at or below each root (column element)."""
    return ancestors.join(roots.select(F.col("element").alias("ancestor")).distinct(), "ancestor").select(F.col("ancestor").alias("root"), "node").distinct()


def fans(refs: DataFrame, chains: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """element, fan_in, fan_out: references that cross the border of each element's subtree.

    ``chains`` has node and chain (array: the node and all its containers). A reference counts
    out for what holds only its source and in for what holds only its target. References are
    counted by their pair of ends before the arrays are compared.
    """
    pairs = refs.groupBy(src, dst).agg(F.count("*").alias("_n"))
    both = pairs.join(chains.select(F.col("node").alias(src), F.col("chain").alias("_from")), src).join(chains.select(F.col("node").alias(dst), F.col("chain").alias("_to")), dst)
    side = lambda a, b, out: F.transform(F.array_except(a, b), lambda e: F.struct(e.alias("element"), F.lit(out).alias("out")))
    ends = both.select(F.explode(F.concat(side("_from", "_to", True), side("_to", "_from", False))).alias("_e"), "_n")
    count = lambda out: F.coalesce(F.sum(F.when(F.col("_e.out") == out, F.col("_n"))), F.lit(0))
    return ends.groupBy(F.col("_e.element").alias("element")).agg(count(False).alias("fan_in"), count(True).alias("fan_out"))


def crossing(refs: DataFrame, inside: DataFrame) -> DataFrame:
    """References with exactly one end in a set of nodes (column node), and calls of itself, with their direction."""
    a, b = inside.select(F.col("node").alias("src"), F.lit(True).alias("_a")).distinct(), inside.select(F.col("node").alias("dst"), F.lit(True).alias("_b")).distinct()
    marked = refs.join(a, "src", "left").join(b, "dst", "left")
    way = F.when(F.col("_a") & F.col("_b"), F.when(F.col("src") == F.col("dst"), "self")).when(F.col("_a"), "out").when(F.col("_b"), "in")
    return marked.withColumn("direction", way).filter("direction is not null").drop("_a", "_b")


def drill_in(include: DataFrame, children: DataFrame, element: str) -> DataFrame:
    """The view with the children (parent, node) of one element added."""
    return include.select("element").union(children.filter(F.col("parent") == element).select(F.col("node").alias("element"))).distinct()


def collapse(include: DataFrame, ancestors: DataFrame, element: str) -> DataFrame:
    """The view without what lies below one element, which stays."""
    below = ancestors.filter((F.col("ancestor") == element) & (F.col("level") > 0)).select(F.col("node").alias("element"))
    return include.select("element").join(below, "element", "left_anti")


def single_child_chain(parents: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """node, last: where a chain of only children that starts at a node ends.

    With ``folders`` (column node) a chain runs from folder to folder only. Each round doubles
    the length that is known of every chain, so a chain of n steps takes log2(n) rounds; only
    children that are their own ancestors are an error.
    """
    from graphloam.operators.closure import rounds

    only = parents.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n"), F.min("node").alias("child")).filter("n = 1").select("parent", "child")
    if folders is not None:
        inside = folders.select("node").distinct()
        only = only.join(inside.withColumnRenamed("node", "parent"), "parent", "left_semi").join(inside.withColumnRenamed("node", "child"), "child", "left_semi")
    jump = settle(only.select("parent", "child"))
    for _ in rounds(64):
        step = jump.join(jump.select(F.col("parent").alias("at"), F.col("child").alias("to")), F.col("child") == F.col("at"), "left")
        step = settle(step.select("parent", F.coalesce("to", "child").alias("child"), F.col("to").isNotNull().alias("moved")))
        jump = step.select("parent", "child")
        if step.filter("moved").isEmpty():
            break
    return parents.select("node").distinct().join(jump, F.col("node") == F.col("parent"), "left").select("node", F.coalesce("child", "node").alias("last"))
