"""Name resolution as ordered joins: the first tier that has a candidate decides."""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloam.operators.closure import GATHER
from graphloam.session import settle_round as settle
from graphloam.session import dealt, small, stored


def first_tier(sites: DataFrame, tiers: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """keys, tier, target of each site: from the lowest tier that has any row.

    ``sites`` has ``keys``; each tier has ``keys``, target and the ``order`` columns, which
    rank candidates inside a tier (least first, names decide ties). A null target stops the
    search: the name is bound, but to something outside. Tiers are joined, united and reduced
    by one aggregate: no sort, and the number of tiers does not change the number of shuffles.
    """
    rows = None
    for i, tier in enumerate(tiers, 1):
        part = tier.select(*keys, F.lit(i).alias("tier"), *order, "target")
        rows = part if rows is None else rows.unionByName(part)
    best = F.min(F.struct("tier", *order, "target"))
    return sites.select(*keys).distinct().join(rows, keys).groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.tier").alias("tier"), F.col("_b.target").alias("target"))


def bare_names(sites: DataFrame, scopes: DataFrame, symbols: DataFrame, bindings: DataFrame, stars: DataFrame, packages: DataFrame) -> DataFrame:
    """site, tier, target of names without a receiver.

    sites(site, file, name, local); scopes(site, scope, depth): enclosing functions, innermost
    depth 0; symbols(id, file, name, scope): scope null at the top; bindings(file, name, scope,
    target, ord): imports; stars(file, name, target, ord): names from star imports;
    packages(file, other): files whose top-level names a file sees without import.

    Tiers: nested symbol, import inside a function, top-level symbol, import (final even when
    its target is null), star import, package. A local site uses the first tier only.
    """
    base = sites.select("site", "file", "name", "local")
    inner = base.join(scopes, "site")
    nested = inner.join(symbols.filter("scope is not null").select("file", "name", "scope", F.col("id").alias("target")), ["file", "name", "scope"]).withColumn("ord", F.col("depth"))
    free = base.filter("not local")
    bound_in = inner.filter("not local").join(bindings.filter("scope is not null").select("file", "name", "scope", "target", "ord"), ["file", "name", "scope"])
    bound_in = bound_in.withColumn("ord", F.col("depth") * 1_000_000 + F.col("ord"))
    top = symbols.filter("scope is null").select("file", "name", F.col("id").alias("target"))
    here = free.join(top, ["file", "name"]).withColumn("ord", F.lit(0))
    imported = free.join(bindings.filter("scope is null").select("file", "name", "target", "ord"), ["file", "name"])
    starred = free.join(stars.select("file", "name", "target", "ord"), ["file", "name"])
    package = free.join(packages, "file").join(top.withColumnRenamed("file", "other"), ["other", "name"]).withColumn("ord", F.lit(0))
    return first_tier(base, [nested, bound_in, here, imported, starred, package], ["site"], ["ord"])


def exported_names(wanted: DataFrame, direct: DataFrame, exports: DataFrame, stars: DataFrame, max_depth: int = 8) -> DataFrame:
    """file, name, target: what an exported name of a module stands for, through re-exports.

    wanted(file, name); direct(file, name, target); exports(file, name, from_file, from_name);
    stars(file, from_file). A direct symbol comes before an explicit re-export, that before a
    star. Each (file, name) is visited once for each start. As a rule of resolution, names that
    stand up to ``max_depth`` files further on are found and others are not.
    """
    at = settle(wanted.select(F.col("file").alias("f"), F.col("name").alias("n")).distinct().select("f", "n", F.col("f").alias("file"), F.col("n").alias("name"), F.lit("").alias("way")))
    seen, found = at.select("f", "n", "file", "name"), None
    for _ in range(max_depth + 1):
        hit = at.join(direct, ["file", "name"]).select("f", "n", "way", "target")
        found = hit if found is None else found.unionByName(hit)
        named = at.join(exports, ["file", "name"]).select("f", "n", F.col("from_file").alias("file"), F.col("from_name").alias("name"), F.concat("way", F.lit("1")).alias("way"))
        starred = at.join(stars, "file").select("f", "n", F.col("from_file").alias("file"), "name", F.concat("way", F.lit("2")).alias("way"))
        step = named.unionByName(starred).groupBy("f", "n", "file", "name").agg(F.min("way").alias("way"))
        at = settle(step.join(seen, ["f", "n", "file", "name"], "left_anti"))
        if at.isEmpty():
            break
        seen = seen.unionByName(at.select("f", "n", "file", "name"))
    return found.groupBy("f", "n").agg(F.min(F.struct("way", "target"))["target"].alias("target")).select(F.col("f").alias("file"), F.col("n").alias("name"), "target")


def member_of(sites: DataFrame, members: DataFrame, bases: DataFrame, max_depth: int = 6) -> DataFrame:
    """site, target, depth: the member of a receiver's type, looked for in the type and then its bases.

    sites(site, type, name); members(type, name, id); bases(type, base, ord): the order of
    bases decides at the same depth. Cycles end at ``max_depth``.
    """
    at = sites.select("site", "type", "name", F.lit("").alias("way"))
    found = None
    for depth in range(max_depth + 1):
        hit = at.join(members, ["type", "name"]).select("site", F.lit(depth).alias("depth"), "way", F.col("id").alias("target"))
        found = hit if found is None else found.unionByName(hit)
        at = at.join(bases, "type").select("site", F.col("base").alias("type"), "name", F.concat("way", F.format_string("%03d", F.col("ord").cast("int"))).alias("way"))
        at = at.groupBy("site", "type", "name").agg(F.min("way").alias("way"))
    best = F.min(F.struct("depth", "way", "target"))
    return found.groupBy("site").agg(best.alias("b")).select("site", F.col("b.target").alias("target"), F.col("b.depth").alias("depth"))


def closest_unique(candidates: DataFrame, site: str, rank: str, target: str) -> DataFrame:
    """The candidate of the least rank of each site, if it is the only one of that rank."""
    least = F.min(rank).over(Window.partitionBy(site))
    best = candidates.withColumn("_least", least).filter(F.col(rank) == F.col("_least"))
    # least and greatest alike: one candidate, without a table of the different ones
    return best.groupBy(site, rank).agg(F.max(target).alias("_last"), F.min(target).alias(target)).filter(F.col("_last") == F.col(target)).drop("_last")


def divides(owners: DataFrame, required: DataFrame, owner: str, member: str, demander: str) -> DataFrame:
    """owner, demander: owners whose members cover all that a demander requires (relational division).

    Owners of the same members are one class, and so are demanders of the same requirements; classes are divided, and
    what fits is expanded where the owners are, in as many tasks as there are shuffle partitions. Only
    classes with a demander's rarest member are looked at further, so that a member which everything has
    does not pair everything with everything, and a pair is tested on the two sets themselves, so
    that it stays one row. A requirement of null is never met; no demander is none.
    """
    spark = owners.sparkSession
    has = _sets(owners.filter(F.col(member).isNotNull()), owner, member)
    lacks = required.filter(F.col(member).isNull()).select(demander).distinct()
    needs = _sets(required.filter(F.col(member).isNotNull() & F.col(demander).isNotNull()).join(lacks, demander, "left_anti"), demander, member)
    have, need = _classes(has, "_have"), _classes(needs, "_need")
    held = have.select("_have", F.explode("_set").alias("_m"))
    common = held.groupBy("_m").agg(F.count("*").alias("_n"))
    wanted = need.select("_need", F.explode("_set").alias("_m")).join(common, "_m", "left")
    rarest = wanted.groupBy("_need").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_m")).alias("_r")).select("_need", F.col("_r._m").alias("_m"))
    probes = rarest.join(held, "_m").select("_need", "_have").join(need.withColumnRenamed("_set", "_w"), "_need").join(have, "_have")
    fits = settle(probes.filter(F.size(F.array_except("_w", "_set")) == 0).select("_have", "_need"))
    # an owner and what its class covers, then the demanders of that
    met = _named(needs, need, "_need").select(demander, "_need")
    named = _named(has, have, "_have").select(owner, "_have").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return named.join(small(fits), "_have").join(small(settle(met)), "_need").select(owner, demander)


def _sets(rows: DataFrame, key: str, member: str) -> DataFrame:
    """key, _set: all members of each key, in order."""
    return settle(rows.select(key, member).distinct().groupBy(key).agg(F.sort_array(F.collect_list(member)).alias("_set")))


def _classes(sets: DataFrame, name: str) -> DataFrame:
    """name, _set: one number for each distinct set."""
    return settle(sets.select("_set").distinct().withColumn(name, F.monotonically_increasing_id()))


def _named(sets: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    return sets.join(small(classes), "_set")


def match_requests(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """request, route, literals, score: the best routes of each request, ties kept.

    requests(request, method, path) and routes(route, method, path) hold normalised paths.
    Methods are equal or '*'. The score is twice the literal segments, one more if the methods
    are equal. A catch-all without a literal links nothing. Requests meet routes by their
    number of segments and first literal, so that a route table is not paired with everything.
    """
    from graphloam.functions.routes import match_literals, segments

    q = requests.select("request", F.col("method").alias("qm"), segments(F.col("path")).alias("qs"))
    r = routes.select("route", F.col("method").alias("rm"), segments(F.col("path")).alias("rs"))
    rest = F.array_position("rs", "{*}")
    first = lambda s: F.coalesce(F.try_element_at(s, F.lit(1)), F.lit(""))
    wild = first(F.col("rs")).isin("{}", "{*}")
    # a route of n segments is found under n; a catch-all under each length from its own on is found under -1
    r = r.withColumn("_len", F.when(rest > 0, -1).otherwise(F.size("rs"))).withColumn("_first", F.when(wild, F.lit("*")).otherwise(first(F.col("rs"))))
    q = q.withColumn("_len", F.explode(F.array(F.size("qs"), F.lit(-1)))).withColumn("_first", F.explode(F.array_distinct(F.array(first(F.col("qs")), F.lit("*")))))
    pairs = q.join(r, ["_len", "_first"]).withColumn("literals", match_literals(F.col("rs"), F.col("qs")))
    fits = (F.col("qm") == F.col("rm")) | (F.col("qm") == "*") | (F.col("rm") == "*")
    pairs = pairs.filter(F.col("literals").isNotNull() & fits & ~((F.col("literals") == 0) & (F.array_position("rs", "{*}") > 0)))
    scored = pairs.withColumn("score", 2 * F.col("literals") + (F.col("qm") == F.col("rm")).cast("int"))
    best = F.max("score").over(Window.partitionBy("request"))
    return scored.withColumn("_best", best).filter("score = _best").select("request", "route", "literals", "score").distinct()


def implementers(refs: DataFrame, interfaces: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """type, implementer, resolution: who implements a type, through interfaces that extend it.

    refs(src, dst, kind, resolution); interfaces(id). The better resolution wins.
    """
    from graphloam.operators.closure import closure

    extends = refs.filter("kind = 'extends'").join(interfaces.select(F.col("id").alias("src")), "src", "left_semi")
    up = extends.select("src", "dst")
    reach = closure(up, up.select(F.col("src").alias("seed")), max_rounds).select(F.col("seed").alias("dst"), F.col("node").alias("type"))
    own = settle(refs.filter("kind = 'implements'").select("src", "dst", "resolution"))
    lifted = own.join(small(reach), "dst").select("src", F.col("type").alias("dst"), "resolution").unionByName(own)
    lifted = dealt(lifted, lifted.count(), "dst", "src")
    best = F.when(F.max((F.col("resolution") == "precise").cast("int")) == 1, "precise").otherwise("heuristic")
    return lifted.groupBy(F.col("dst").alias("type"), F.col("src").alias("implementer")).agg(best.alias("resolution"))


def _near(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """The member at file and path, or else at that path in another file of the same folder and language, least name first.

    wanted(file, folder, language, path, ...); members(id, file, folder, language, path).
    """
    names = [c for c in wanted.columns if c not in ("file", "folder", "language", "path")]
    place = members.select(F.col("id").alias("_id"), F.col("file").alias("_file"), "folder", "language", "path")
    found = wanted.join(place, ["folder", "language", "path"])
    best = F.min(F.struct((F.col("_file") != F.col("file")).alias("far"), "_file", "_id"))
    return found.groupBy("file", "folder", "language", "path", *names).agg(best["_id"].alias("member"))


def implementations(symbols: DataFrame, refs: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """id, implementation, resolution of every type and every member that something implements.

    symbols(id, file, folder, language, path, kind), a path being the names of what holds a
    symbol and its own, with dots; refs(src, dst, kind, resolution). A type is implemented by
    what names it, or an interface that extends it. A method or variable is implemented by what
    names it, and by the member of the same name of each type that implements its owner: in that
    type's file, else in a file of the same folder and language. The owner is the symbol at the
    path above, in the member's own file first. The better resolution wins; nothing implements itself.
    """
    said = refs.filter("kind in ('implements', 'extends')").select("src", "dst", "kind", "resolution")
    symbols = settle(symbols.select("id", "file", "folder", "language", "path", "kind"))
    n = symbols.count()
    # what refers to a type, and where it stands: the only symbols that are looked up by id one by one
    starts = said.groupBy(F.col("src").alias("id")).agg(F.max(F.col("kind") == "implements").alias("implements"))
    sources = settle(dealt(symbols, n, "id").join(starts, "id"))
    said = settle(said.join(sources.select(F.col("id").alias("src")), "src", "left_semi"))
    types = settle(implementers(said, sources.filter("kind = 'interface'").select("id"), max_rounds))
    ends = settle(said.select(F.col("dst").alias("id")).distinct())
    targets = settle(symbols.join(small(ends), "id"))
    is_member = F.col("kind").isin("method", "variable")
    last = F.substring_index("path", ".", -1)
    above = F.expr("substr(path, 1, length(path) - length(substring_index(path, '.', -1)) - 1)")
    inner = symbols.filter(F.col("path").contains(".")).select("id", "file", "folder", "language", above.alias("path"), last.alias("last"), "kind")
    # only members of what is implemented need their owner
    place = ["folder", "language", "path"]
    spots = small(settle(targets.select(place).distinct()))
    wanted = inner.filter(is_member).join(spots, place, "left_semi").select(F.col("id").alias("of"), "file", *place, F.regexp_replace("last", r"~\d+$", "").alias("name"))
    owners = _near(wanted, symbols.join(spots, place, "left_semi")).select("of", "name", F.col("member").alias("type"))
    owners = settle(owners.join(small(ends).withColumnRenamed("id", "type"), "type", "left_semi"))
    # the member of each implementer and name is looked for once, whatever types it implements
    names = small(settle(owners.select(F.col("name").alias("last")).distinct()))
    at = sources.filter("implements").select(F.col("id").alias("implementer"), "file", *place)
    below = inner.join(names, "last", "left_semi").select(F.col("id").alias("_id"), F.col("file").alias("_file"), *place, F.col("last").alias("name"))
    best = F.min(F.struct((F.col("_file") != F.col("file")).alias("far"), "_file", "_id"))
    found = dealt(at, n, *place).join(dealt(below, n, *place), place).groupBy("implementer", "file", *place, "name").agg(best["_id"].alias("member"))
    met = types.count()
    through = dealt(found.select("implementer", "name", "member"), n + met, "implementer").join(dealt(types, n + met, "implementer"), "implementer").join(small(owners), ["type", "name"])
    through = through.select(F.col("of").alias("id"), F.col("member").alias("implementation"), "resolution")
    held = lambda rows: small(settle(rows.select("id").distinct()))
    own = said.filter("kind = 'implements'").select(F.col("dst").alias("id"), F.col("src").alias("implementation"), "resolution").join(held(targets), "id", "left_semi")
    direct = types.select(F.col("type").alias("id"), F.col("implementer").alias("implementation"), "resolution").join(held(targets.filter(~is_member)), "id", "left_semi")
    # no more than each implementer with each member of its types
    most = types.groupBy("type").agg(F.count("*").alias("_n")).join(owners.groupBy("type").agg(F.count("*").alias("_m")), "type").agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0
    best = F.when(F.max((F.col("resolution") == "precise").cast("int")) == 1, "precise").otherwise("heuristic")
    rows = own.unionByName(direct).unionByName(through).filter("id <> implementation")
    return dealt(rows, most + 2 * met, "id", "implementation").groupBy("id", "implementation").agg(best.alias("resolution"))


def overridden_by(methods: DataFrame, bases: DataFrame, max_depth: int | None = None) -> DataFrame:
    """method, overrides, precise: the nearest base class that has a method of the same name.

    methods(id, type, name); bases(type, base, precise). Breadth first; trust holds over every
    step. Cycles of bases end by themselves; ``max_depth`` bounds the steps only if it is given.
    """
    at = settle(methods.select("id", "type", "name", F.lit(True).alias("precise")))
    own = methods.select("type", "name", F.col("id").alias("overrides"))
    done, seen = None, at.select("id", "type")
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = at.join(bases.withColumnRenamed("precise", "_p"), "type").select("id", F.col("base").alias("type"), "name", (F.col("precise") & F.col("_p")).alias("precise"))
        step = step.groupBy("id", "type", "name").agg(F.max("precise").alias("precise"))
        at = settle(step.join(seen, ["id", "type"], "left_anti"))
        if at.isEmpty():
            break
        seen = seen.unionByName(at.select("id", "type"))
        hit = at.join(own, ["type", "name"]).groupBy("id").agg(F.min(F.struct("overrides", "precise")).alias("b"))
        hit = settle(hit.select(F.col("id").alias("method"), F.col("b.overrides").alias("overrides"), F.col("b.precise").alias("precise"), F.lit(depth).alias("depth")))
        done = hit if done is None else done.unionByName(hit)
        at = at.join(hit.select(F.col("method").alias("id")), "id", "left_anti")
    empty = methods.select(F.col("id").alias("method"), F.col("id").alias("overrides"), F.lit(True).alias("precise"), F.lit(0).alias("depth")).limit(0)
    return empty if done is None else done


def merged_order(name: str, orders: list[list[str]], bases: list[str]) -> list[str] | None:
    """A type before its bases, each base's own order kept, and bases in the order they are written; None if these contradict."""
    left, out = [list(x) for x in (*orders, bases) if len(x)], [name]
    while left:
        # the first head that no list has further on
        head = next((x[0] for x in left if not any(x[0] in y[1:] for y in left)), None)
        if head is None:
            return None
        out.append(head)
        left = [y for x in left if (y := x[1:] if x[0] == head else x)]
    return out


def method_order(types: DataFrame, bases: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """type, order: the linear order in which a type and its bases are asked for a member; null where there is none.

    types(type); bases(type, base, ord): ord is the place of a base as it is written. A round
    orders all types whose bases are ordered, so rounds are as many as the hierarchy is deep.
    Types that contradict themselves, or stand on a cycle or on such types, have no order.
    Bases that are no types of the table count as types without bases.

    Types with the same list of bases are one class, merged once, in the round that orders the last of its bases.
    """
    def merge(orders: pd.Series, own: pd.Series) -> pd.Series:
        merged = [merged_order("", [list(o) for o in x], list(b)) for x, b in zip(orders, own, strict=True)]
        return pd.Series([m if m is None else m[1:] for m in merged], dtype=object)

    ordered = F.pandas_udf(merge, "array<string>")
    kin = stored(bases.groupBy("type").agg(F.transform(F.array_sort(F.collect_set(F.struct("ord", "base"))), lambda x: x["base"]).alias("bases")), "kin")
    # ids are drawn once, here: the stored table is all that is read from now on
    classes = stored(kin.select("bases").distinct().withColumn("id", F.monotonically_increasing_id()), "classes")
    links = settle(classes.select("id", F.posexplode("bases").alias("pos", "base")))
    named = settle(links.select("base").filter("base is not null").distinct())
    inner = settle(kin.join(named.withColumnRenamed("base", "type"), "type", "left_semi").join(classes, "bases").select("id", F.col("type").alias("base")))
    news = settle(named.join(inner.select("base"), "base", "left_anti").select("base", F.array("base").alias("order")))
    done, tails, waiting = news, None, links
    for depth in count(1):
        if max_rounds is not None and depth > max_rounds:
            raise RuntimeError(f"not settled in {max_rounds} rounds")
        fresh = small(news).select("base")
        rest = settle(waiting.join(fresh, "base", "left_anti"))
        # only classes over what the last round ordered can be ready
        ready = waiting.join(fresh, "base", "left_semi").select("id").distinct().join(rest.select("id"), "id", "left_anti")
        parts = links.join(ready, "id").join(done, "base").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "base", "order"))).alias("x"))
        made = settle(parts.select("id", ordered(F.transform("x", lambda v: v["order"]), F.transform("x", lambda v: v["base"])).alias("tail")))
        if made.isEmpty():
            break
        tails = made if tails is None else tails.unionByName(made)
        news = settle(inner.join(made.filter("tail is not null"), "id").select("base", F.concat(F.array("base"), "tail").alias("order")))
        done, waiting = done.unionByName(news), rest
        if depth % GATHER == 0:
            done, tails = settle(done), settle(tails)
    alone = types.select("type").union(links.select("base")).alias("a").join(kin.select("type").alias("k"), F.expr("a.type <=> k.type"), "left_anti").distinct()
    alone = alone.select("type", F.when(F.col("type").isNotNull(), F.array("type")).alias("order"))
    if tails is None:
        return alone.unionByName(kin.select("type", F.lit(None).cast("array<string>").alias("order")))
    own = kin.join(classes.join(tails, "id").select("bases", "tail"), "bases", "left")
    return alone.unionByName(own.select("type", F.when(F.col("type").isNotNull(), F.concat(F.array("type"), "tail")).alias("order")))


def outside_systems(imports: DataFrame, catalogue: DataFrame, own: DataFrame) -> DataFrame:
    """file, module, system: imports of modules that a catalogue names, by whole leading parts; own modules left out.

    imports(file, module); catalogue(prefix, system); own(prefix). The longest prefix decides.
    """
    cut = F.filter(F.transform(F.sequence(F.lit(1), F.length("module")), lambda i: F.when((i == F.length("module")) | F.substring(F.col("module"), i + 1, F.lit(1)).rlike("[./:]"), F.substring(F.col("module"), F.lit(1), i))), lambda x: x.isNotNull())
    each = imports.select("file", "module", F.explode(cut).alias("prefix"))
    foreign = imports.join(each.join(own.select("prefix"), "prefix").select("file", "module").distinct(), ["file", "module"], "left_anti")
    found = each.join(catalogue, "prefix").join(foreign.select("file", "module").distinct(), ["file", "module"], "left_semi")
    return found.groupBy("file", "module").agg(F.max(F.struct(F.length("prefix").alias("n"), "system"))["system"].alias("system"))
