"""Hierarchies, projections and closures over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloam import bindings as b
from graphloam.operators import closure as cl
from graphloam.operators import hierarchy as h
from graphloam.operators import projection as pr
from graphloam.plans.registry import query

_R, _P = b.SQL_REFS, b.SQL_PLACES
#: The view of most queries here: the nations of the first two regions are drawn.
_VIEW = f"""{_R}, {_P}, places AS (SELECT node, nation, region FROM op UNION ALL SELECT node, nation, region FROM sp),
ends AS (SELECT refs.*, CASE WHEN x.region IN ('r:0', 'r:1') THEN x.nation END AS a, CASE WHEN y.region IN ('r:0', 'r:1') THEN y.nation END AS b,
  x.nation AS sn, x.region AS sr, y.nation AS dn, y.region AS dr FROM refs JOIN places x ON src = x.node JOIN places y ON dst = y.node)"""
_STUBS = f"""{_VIEW}, stubs AS (SELECT CASE WHEN a IS NOT NULL THEN 'out' ELSE 'in' END AS direction, coalesce(a, b) AS inside, CASE WHEN a IS NOT NULL THEN dn ELSE sn END AS ghost, count(*) AS n, list_sort(list(DISTINCT kind)) AS kinds
  FROM ends WHERE (a IS NULL) <> (b IS NULL) GROUP BY ALL)"""


def _places(spark, sf):
    return b.order_places(spark, sf).select("node", "nation", "region").unionByName(b.supplier_places(spark, sf))


def _reps(spark, sf):
    nations = b.nations(spark, sf).filter("rk < 2").select(b.tag("n:", "nk").alias("element"))
    return h.representative(b.ancestor_rows(_places(spark, sf), ["node", "nation", "region"]), F.broadcast(nations))


def _targets(spark, sf):
    return _places(spark, sf).select("node", F.col("nation").alias("ghost"))


@query(f"""WITH {_R}, {_P} SELECT kind, op.nation, p_brand AS brand, count(*) AS n, CASE WHEN min(resolution) = max(resolution) THEN min(resolution) ELSE 'mixed' END AS resolution
FROM (SELECT 'o:' || l_orderkey AS src, l_partkey, l_returnflag AS kind, CASE WHEN l_linestatus = 'F' THEN 'precise' ELSE 'heuristic' END AS resolution FROM lineitem) r JOIN op ON src = op.node JOIN part ON l_partkey = p_partkey GROUP BY kind, op.nation, p_brand""")
def edge_agg(spark, sf):
    """References rolled up to arrows from nations to brands: joined first, as an order seldom names a part twice, and counted once."""
    line = b.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.col("l_returnflag").alias("kind"), "l_linestatus")
    orders = b.table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(b.table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    parts = b.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    joined = line.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    named = F.when(F.min("l_linestatus") != F.max("l_linestatus"), "mixed").when(F.min("l_linestatus") == "F", "precise").otherwise("heuristic")
    return joined.groupBy("kind", "c_nationkey", "brand").agg(F.count("*").alias("n"), named.alias("resolution")).select("kind", b.tag("n:", "c_nationkey").alias("nation"), "brand", "n", "resolution")


@query(f"""WITH {_P} SELECT node, CASE WHEN region IN ('r:0', 'r:2') THEN nation WHEN region = 'r:1' THEN region WHEN customer LIKE '%7' THEN customer END AS rep FROM op
WHERE region IN ('r:0', 'r:1', 'r:2') OR customer LIKE '%7'""")
def representative(spark, sf):
    places = b.order_places(spark, sf)
    drawn = places.filter(F.col("region").isin("r:0", "r:2")).select(F.col("nation").alias("element")).union(places.filter("region = 'r:1'").select("region")).union(places.filter("customer like '%7' and region > 'r:2'").select("customer")).distinct()
    return h.representative(b.ancestor_rows(places, ["node", "customer", "nation", "region"]), drawn)


@query("""WITH g AS (SELECT 'g:' || c_mktsegment AS grp, 'c:' || c_custkey AS customer FROM customer WHERE c_custkey % 5 = 0),
op AS (SELECT 'o:' || o_orderkey AS node, 'c:' || o_custkey AS customer, 'n:' || c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT node, coalesce(g.grp, op.nation) AS rep FROM op LEFT JOIN g USING (customer)""")
def representative_groups(spark, sf):
    places = b.order_places(spark, sf)
    groups = b.table(spark, sf, "customer").filter("c_custkey % 5 = 0").select(b.tag("c:", "c_custkey").alias("member"), b.tag("g:", "c_mktsegment").alias("grp"), F.lit(1).alias("sub_level"))
    drawn = groups.select(F.col("grp").alias("element")).union(places.select("nation")).distinct()
    return h.representative(b.ancestor_rows(places, ["node", "customer", "nation"]), drawn, groups)


@query(f"""WITH {b.SQL_PARENTS} SELECT p.node, CASE WHEN p.parent LIKE 'n:%' AND substr(p.parent, 3)::INT % 2 = 0 THEN p.parent WHEN p.parent LIKE 'n:%' THEN q.parent ELSE p.parent END AS parent
FROM parents p LEFT JOIN parents q ON p.parent = q.node WHERE p.parent IS NOT NULL AND (p.node LIKE 's:%' OR p.node LIKE 'n:%' AND substr(p.node, 3)::INT % 2 = 0)""")
def render_parent(spark, sf):
    rows = b.parents(spark, sf).filter("node not like 'c:%'")
    drawn = rows.filter("node like 's:%' or node like 'r:%' or (node like 'n:%' and cast(substr(node, 3) as int) % 2 = 0)").select(F.col("node").alias("element"))
    return h.render_parent(cl.ancestors(rows), drawn)


@query(f"""WITH RECURSIVE {b.SQL_PARENTS}, up AS (SELECT node, node AS ancestor, 0 AS level FROM parents UNION ALL SELECT up.node, p.parent, level + 1 FROM up JOIN parents p ON up.ancestor = p.node WHERE p.parent IS NOT NULL)
SELECT node, ancestor, level::INT AS level FROM up""")
def ancestors(spark, sf):
    return cl.ancestors(b.parents(spark, sf))


@query(f"""WITH {b.SQL_PARENTS}, up AS (SELECT p.node, p.parent AS a, q.parent AS c FROM parents p LEFT JOIN parents q ON p.parent = q.node)
SELECT 'r:1' AS root, node FROM up WHERE node = 'r:1' OR a = 'r:1' OR c = 'r:1'""")
def subtree(spark, sf):
    root = spark.createDataFrame([("r:1",)], "element string")
    return h.subtree(cl.ancestors(b.parents(spark, sf)), root)


@query(f"""WITH {_R}, {_P}, e AS (SELECT op.node AS o, op.customer AS c, op.nation AS n1, op.region AS r1, sp.node AS s, sp.nation AS n2, sp.region AS r2 FROM refs JOIN op ON src = op.node JOIN sp ON dst = sp.node),
out AS (SELECT unnest([o, c] || CASE WHEN n1 <> n2 THEN [n1] ELSE [] END || CASE WHEN r1 <> r2 THEN [r1] ELSE [] END) AS element, 0 AS i, 1 AS o FROM e),
inn AS (SELECT unnest([s] || CASE WHEN n1 <> n2 THEN [n2] ELSE [] END || CASE WHEN r1 <> r2 THEN [r2] ELSE [] END) AS element, 1 AS i, 0 AS o FROM e)
SELECT element, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT * FROM out UNION ALL SELECT * FROM inn) GROUP BY element""")
def fans(spark, sf):
    return h.fans(b.refs(spark, sf), b.chains(spark, sf))


@query(f"""WITH {_R}, {_P}, i AS (SELECT node FROM op WHERE nation = 'n:3' UNION ALL SELECT node FROM sp WHERE nation = 'n:3')
SELECT CASE WHEN x.node IS NOT NULL THEN 'out' ELSE 'in' END AS direction, kind, count(*) AS n FROM refs LEFT JOIN i x ON src = x.node LEFT JOIN i y ON dst = y.node WHERE (x.node IS NULL) <> (y.node IS NULL) GROUP BY ALL""")
def crossing(spark, sf):
    inside = _places(spark, sf).filter("nation = 'n:3'").select("node")
    return h.crossing(b.refs(spark, sf), inside).groupBy("direction", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {_VIEW} SELECT kind, a, b, count(*) AS n, CASE WHEN min(resolution) = max(resolution) THEN min(resolution) ELSE 'mixed' END AS resolution FROM ends WHERE a <> b GROUP BY kind, a, b")
def project(spark, sf):
    return pr.project(b.refs(spark, sf), _reps(spark, sf))


@query(f"WITH {_STUBS} SELECT * FROM stubs")
def stub_agg(spark, sf):
    return pr.stubs(b.refs(spark, sf), _reps(spark, sf), _targets(spark, sf))


_PLAN = f"""{_STUBS}, top AS (SELECT ghost FROM stubs GROUP BY ghost ORDER BY sum(n) DESC, ghost LIMIT 4),
plan AS (SELECT direction, inside, CASE WHEN ghost IN (SELECT ghost FROM top) THEN ghost ELSE 'more:' || direction END AS ghost, sum(n)::BIGINT AS n, list_sort(list_distinct(flatten(list(kinds)))) AS kinds FROM stubs GROUP BY ALL)"""


@query(f"WITH {_PLAN.replace('GROUP BY ALL)', 'GROUP BY 1, 2, 3)').replace('FROM ends WHERE (a IS NULL) <> (b IS NULL) GROUP BY 1, 2, 3)', 'FROM ends WHERE (a IS NULL) <> (b IS NULL) GROUP BY ALL)')} SELECT * FROM plan")
def plan_stubs(spark, sf):
    return pr.plan_stubs(stub_agg(spark, sf), "top", 4)


@query(f"WITH {_STUBS} SELECT ghost, sum(n)::BIGINT AS n, CASE WHEN min(direction) = max(direction) THEN min(direction) ELSE 'both' END AS direction FROM stubs GROUP BY ghost")
def ghosts(spark, sf):
    return pr.ghosts(stub_agg(spark, sf))


@query(f"""WITH {_VIEW}, c AS (SELECT CASE WHEN a IS NOT NULL THEN dst ELSE src END AS node, CASE WHEN a IS NOT NULL THEN dn ELSE sn END AS ghost, count(*) AS n FROM ends WHERE (a IS NULL) <> (b IS NULL) GROUP BY 1, 2)
SELECT ghost, node, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ghost ORDER BY n DESC, node) AS rank FROM c) WHERE rank <= 5""")
def ghost_targets(spark, sf):
    return pr.ghost_targets(b.refs(spark, sf), _reps(spark, sf), _targets(spark, sf)).select("ghost", "node", "n", "rank")


@query(f"WITH {_VIEW} SELECT coalesce(a, 'outside') AS row, coalesce(b, 'outside') AS col, count(*) AS n, CASE WHEN min(resolution) = max(resolution) THEN min(resolution) ELSE 'mixed' END AS trust FROM ends GROUP BY 1, 2")
def matrix(spark, sf):
    arrows = pr.ends(b.refs(spark, sf), _reps(spark, sf)).groupBy("a", "b").agg(F.count("*").alias("n"), pr.common_or_mixed("resolution").alias("resolution"))
    return pr.matrix(arrows)


@query(f"WITH {_VIEW}, e AS (SELECT kind, a, b, src, dst, resolution, row_number() OVER (PARTITION BY kind, a, b ORDER BY src, dst, resolution) AS rank, count(*) OVER (PARTITION BY kind, a, b) AS n FROM ends WHERE a <> b) SELECT kind, a, b, src, dst, resolution, rank::INT AS rank, n FROM e WHERE rank <= 3")
def evidence(spark, sf):
    rows = pr.ends(b.refs(spark, sf), _reps(spark, sf)).filter("a <> b")
    return pr.evidence(rows, ["kind", "a", "b"], ["src", "dst", "resolution"], 3).select("kind", "a", "b", "src", "dst", "resolution", "rank", "n")


@query(f"WITH {_VIEW} SELECT kind, a, b, count(*) AS n, CASE WHEN min(resolution) = max(resolution) THEN min(resolution) ELSE 'mixed' END AS resolution FROM ends WHERE a <> b AND a NOT IN ('n:1', 'n:2') AND b NOT IN ('n:1', 'n:2') GROUP BY kind, a, b")
def hidden(spark, sf):
    gone = spark.createDataFrame([("n:1",), ("n:2",)], "element string")
    return pr.hide(project(spark, sf), F.broadcast(gone))


@query(f"WITH {_R}, {_P} SELECT kind, count(*) AS n FROM refs JOIN op ON src = op.node JOIN sp ON dst = sp.node WHERE op.region <> 'r:0' AND sp.region <> 'r:0' GROUP BY kind")
def exclude_refs(spark, sf):
    src = b.order_places(spark, sf).select(F.col("node").alias("src"), F.col("region").alias("src_file"))
    dst = b.supplier_places(spark, sf).select(F.col("node").alias("dst"), F.col("region").alias("dst_file"))
    gone = spark.createDataFrame([("r:0",)], "file string")
    return pr.exclude_refs(b.refs(spark, sf).join(src, "src").join(dst, "dst"), gone).groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT DISTINCT lang AS grp, source || '/' || (doc_id % 40) || '/' || (doc_id % 3) AS path FROM documents),
t AS (SELECT grp, path, k, array_to_string(string_split(path, '/')[-k:], '/') AS tail FROM (SELECT *, unnest([1, 2, 3]) AS k FROM u)),
n AS (SELECT *, count(*) OVER (PARTITION BY grp, k, tail) AS n FROM t)
SELECT grp, path, coalesce(arg_min(tail, k) FILTER (n = 1), max(tail) FILTER (k = 3)) AS label FROM n GROUP BY grp, path""")
def distinguish(spark, sf):
    docs = b.table(spark, sf, "documents")
    paths = docs.select(F.col("lang").alias("grp"), F.concat_ws("/", "source", F.col("doc_id") % 40, F.col("doc_id") % 3).alias("path")).distinct()
    return pr.distinguish(paths, "grp", "path")


@query(f"WITH {b.SQL_TRADE} SELECT src, dst, n FROM trade")
def trade(spark, sf):
    return b.trade(spark, sf)


@query(f"""WITH RECURSIVE {b.SQL_RELAYS}, walk AS (SELECT src AS seed, dst AS node, 1 AS depth FROM relays UNION ALL SELECT seed, dst, depth + 1 FROM walk JOIN relays ON node = src WHERE depth < 6)
SELECT seed, node, min(depth)::INT AS depth FROM walk GROUP BY seed, node""")
def closure(spark, sf):
    edges = b.relays(spark, sf)
    return cl.closure(edges, edges.select(F.col("src").alias("seed")))


@query(f"""WITH RECURSIVE {b.SQL_RELAYS}, walk AS (SELECT src AS seed, dst AS node, 1 AS depth FROM relays UNION ALL SELECT seed, dst, depth + 1 FROM walk JOIN relays ON node = src WHERE depth < 6)
SELECT seed, count(DISTINCT node) FILTER (node <> seed) AS n FROM walk GROUP BY seed""")
def reach_count(spark, sf):
    edges = b.relays(spark, sf)
    return cl.reach_count(edges, edges.select(F.col("src").alias("seed")))


#: Relays, and a chain over all customers through their first orders.
_LINKED = f"""{b.SQL_RELAYS}, fo AS (SELECT c, min(o) AS o FROM rb GROUP BY c), hand AS (SELECT 'o:' || o AS src, 'o:' || lead(o) OVER (ORDER BY c) AS dst FROM fo),
linked AS (SELECT * FROM relays UNION SELECT * FROM hand WHERE dst IS NOT NULL),
ln AS (SELECT src AS node FROM linked UNION SELECT dst FROM linked),
comp AS (SELECT node, CASE WHEN c % 2 = 0 THEN min('o:' || o) OVER (PARTITION BY c, blk) ELSE node END AS component FROM rb JOIN ln ON node = 'o:' || o)"""


def _linked(spark, sf):
    from pyspark.sql import Window

    # the key of the next customer that has orders; customers are few against what they order
    first = b.table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o"))
    bounds = first.withColumn("b", F.floor(F.col("o_custkey") / 512))
    inside = bounds.withColumn("next", F.lead("o").over(Window.partitionBy("b").orderBy("o_custkey")))
    heads = bounds.groupBy("b").agg(F.min(F.struct("o_custkey", "o"))["o"].alias("head")).withColumn("after", F.lead("head").over(Window.orderBy("b"))).select("b", "after")
    hand = inside.join(F.broadcast(heads), "b").withColumn("to", F.coalesce("next", "after")).filter("to is not null").select(b.tag("o:", "o").alias("src"), b.tag("o:", "to").alias("dst"))
    return b.relays(spark, sf).union(hand).distinct()


@query(f"WITH {_LINKED} SELECT node, component FROM comp")
def strong_components(spark, sf):
    return cl.strong_components(_linked(spark, sf))


@query(f"""WITH RECURSIVE {b.SQL_RELAYS}, seeds AS (SELECT 'o:' || min(o) AS node FROM rb GROUP BY c), walk AS (SELECT node, 0 AS depth FROM seeds UNION ALL SELECT dst, depth + 1 FROM walk JOIN relays ON node = src WHERE depth < 6)
SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node""")
def reach_of(spark, sf):
    start = b.table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o")).select(b.tag("o:", "o").alias("seed"))
    return cl.reach_of(b.relays(spark, sf), start)[0]


_TREE = """ln AS (SELECT 'o:' || l_orderkey AS o, 'p:' || l_partkey AS p, 's:' || min(l_suppkey) OVER (PARTITION BY l_partkey) AS s FROM lineitem),
e AS (SELECT o, p, count(*) AS n, any_value(s) AS s FROM ln GROUP BY o, p),
r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n DESC, p) AS rk, count(*) OVER (PARTITION BY o) AS total FROM e),
a AS (SELECT o, p, s, n FROM r WHERE rk <= 3),
h AS (SELECT o, p, s, row_number() OVER (PARTITION BY o, s ORDER BY p) AS again FROM a)"""


@query(f"""WITH {_TREE} SELECT o AS root, o AS parent, p AS node, 1 AS level, false AS hop, NULL::VARCHAR AS note, n FROM a
UNION ALL SELECT o, o, NULL, 1, false, 'more', total - 3 FROM r WHERE rk = 3 AND total > 3
UNION ALL SELECT o, p, s, 1, true, CASE WHEN again > 1 THEN 'seen' END, 0 FROM h
UNION ALL SELECT o, s, 'n:' || s_nationkey, 2, false, NULL, 1 FROM h JOIN supplier ON s = 's:' || s_suppkey WHERE again = 1""")
def ref_tree(spark, sf):
    """Orders and their parts; a part stands for its first supplier, as an interface for what implements it; suppliers and their nations."""
    line = b.table(spark, sf, "lineitem").select(b.tag("o:", "l_orderkey").alias("src"), b.tag("p:", "l_partkey").alias("dst"))
    nations = b.table(spark, sf, "supplier").select(b.tag("s:", "s_suppkey").alias("src"), b.tag("n:", "s_nationkey").alias("dst"))
    hops = b.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s")).select(b.tag("p:", "l_partkey").alias("src"), b.tag("s:", "s").alias("dst"))
    roots = b.table(spark, sf, "orders").select(b.tag("o:", "o_orderkey").alias("seed"))
    return cl.ref_tree(line.unionByName(nations), hops, roots, 2, 3)


@query(f"""WITH {_R}, {_P}, c1 AS (SELECT op.customer AS node, 1 AS k, count(*) AS n FROM refs JOIN op ON src = op.node WHERE dst = 's:1' GROUP BY 1)
SELECT 's:1' AS root, 's:1' AS node, NULL::VARCHAR AS parent, 0 AS level, 0::BIGINT AS more
UNION ALL SELECT 's:1', node, 's:1', 1, CASE WHEN r = least(total, 15) THEN total - least(total, 15) ELSE 0 END::BIGINT FROM (SELECT node, row_number() OVER (ORDER BY n DESC, node) AS r, count(*) OVER () AS total FROM c1) WHERE r <= 15""")
def expand_tree(spark, sf):
    up = b.refs(spark, sf).join(b.order_places(spark, sf).select(F.col("node").alias("src"), "customer"), "src").select(F.col("dst").alias("src"), F.col("customer").alias("dst"))
    return cl.expand_tree(up, spark.createDataFrame([("s:1",)], "seed string"), 3).withColumn("level", F.col("level").cast("int"))


@query(f"""WITH {b.SQL_PARENTS}, one AS (SELECT parent, min(node) AS child FROM parents WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) = 1)
SELECT p.node, coalesce(b.child, a.child, p.node) AS last FROM parents p LEFT JOIN one a ON p.node = a.parent LEFT JOIN one b ON a.child = b.parent""")
def single_child_chain(spark, sf):
    return h.single_child_chain(b.parents(spark, sf))


@query(f"""WITH {b.SQL_PARENTS} SELECT node AS element FROM parents WHERE node LIKE 'r:%' UNION SELECT node FROM parents WHERE parent = 'r:2'""")
def drill_in(spark, sf):
    rows = b.parents(spark, sf)
    return h.drill_in(rows.filter("node like 'r:%'").select(F.col("node").alias("element")), rows, "r:2")


@query("SELECT 'r:' || r_regionkey AS element FROM region UNION SELECT 'n:' || n_nationkey FROM nation WHERE n_regionkey <> 2")
def collapse(spark, sf):
    rows = b.parents(spark, sf).filter("node like 'r:%' or node like 'n:%'")
    return h.collapse(rows.select(F.col("node").alias("element")), cl.ancestors(rows), "r:2")


@query(f"""WITH {_R}, {_P} SELECT ancestor AS box, count(DISTINCT node)::BIGINT AS files, sum(n)::BIGINT AS lines FROM (SELECT op.node, n, unnest([op.node, customer, nation, region]) AS ancestor FROM (SELECT src, count(*) AS n FROM refs WHERE kind = 'R' GROUP BY src) t JOIN op ON src = op.node) GROUP BY ancestor""")
def lift_change(spark, sf):
    from graphloam.operators.change import lift_change as lift

    touched = b.refs(spark, sf).filter("kind = 'R'").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("lines"))
    return lift(touched, b.order_places(spark, sf).select("node", F.array("node", "customer", "nation", "region").alias("chain")))
