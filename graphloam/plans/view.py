"""A composed view over the driver's tables: all line items, with groups, dispatch, stored arrows, excluded and hidden elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloam import bindings as b
from graphloam.operators import view as v
from graphloam.plans.registry import query
from graphloam.session import settle_round as settle

_KINDS = {"R": "calls", "A": "reads", "N": "references"}

_MODEL = f"""cust AS (SELECT c_custkey AS k, 'c:' || c_custkey AS c, 'n:' || c_nationkey AS n, 'r:' || n_regionkey AS r, c_custkey % 500 IN (7, 9) AS drawn,
  c_custkey % 5 = 0 AND c_mktsegment = 'BUILDING' AND n_regionkey <= 3 AS grouped FROM customer JOIN nation ON c_nationkey = n_nationkey),
place AS (SELECT 'o:' || o_orderkey AS node, 'o:' || o_orderkey AS o, cust.* FROM orders JOIN cust ON o_custkey = k UNION ALL SELECT c, NULL, cust.* FROM cust
  UNION ALL SELECT 's:' || s_suppkey, NULL, NULL, NULL, 'n:' || s_nationkey, 'r:' || n_regionkey, false, false FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'n:' || n_nationkey, NULL, NULL, NULL, 'n:' || n_nationkey, 'r:' || n_regionkey, false, false FROM nation),
reps AS (SELECT *, CASE WHEN drawn THEN c WHEN grouped THEN 'g:BUILDING' WHEN r IN ('r:0', 'r:1') THEN n WHEN r = 'r:2' THEN r END AS rep FROM place),
cn AS (SELECT DISTINCT n FROM reps WHERE drawn OR grouped OR r IN ('r:0', 'r:1')), cr AS (SELECT DISTINCT r FROM reps WHERE drawn OR grouped UNION SELECT 'r:0' UNION SELECT 'r:1' UNION SELECT 'r:2'),
t AS (SELECT *, CASE WHEN o IS NOT NULL AND (drawn OR grouped) THEN o WHEN c IS NOT NULL AND n IN (FROM cn) THEN c WHEN c IS NULL AND node <> n AND n IN (FROM cn) THEN node WHEN r IN (FROM cr) THEN n ELSE r END AS target FROM reps),
boxes AS (SELECT c AS id, CASE WHEN r IN ('r:0', 'r:1') THEN n WHEN r = 'r:2' THEN r END AS parent FROM cust WHERE drawn UNION ALL SELECT DISTINCT n, NULL FROM cust WHERE r IN ('r:0', 'r:1') UNION ALL SELECT 'r:2', NULL UNION ALL SELECT 'g:BUILDING', NULL),
refs AS (SELECT CASE l_returnflag WHEN 'R' THEN 'calls' WHEN 'A' THEN 'reads' ELSE 'references' END AS kind, l_suppkey AS k, CASE WHEN l_linestatus = 'F' THEN 'precise' ELSE 'heuristic' END AS resolution, x.rep AS a, y.rep AS b, x.target AS sx, y.target AS dx
  FROM lineitem JOIN t x ON x.node = 'o:' || l_orderkey JOIN t y ON y.node = 's:' || l_suppkey WHERE x.k % 10 <> 9 OR x.drawn),
disp AS (SELECT s_suppkey AS k, rep AS c, s_suppkey % 3 = 0 AS sure FROM supplier JOIN t ON node = 's:' || (s_suppkey + 1) WHERE s_suppkey % 4 = 0 AND s_suppkey % 8 <> 0),
flow AS (SELECT kind, a, b, resolution FROM refs WHERE a <> b UNION ALL SELECT kind, a, c, CASE WHEN sure THEN resolution ELSE 'heuristic' END FROM refs JOIN disp USING (k) WHERE kind = 'calls' AND c <> a AND c IS DISTINCT FROM b AND a IS NOT NULL),
nest AS (SELECT id AS a, parent AS b FROM boxes WHERE parent IS NOT NULL UNION ALL SELECT parent, id FROM boxes WHERE parent IS NOT NULL),
arrow AS (SELECT 'edge:derived:' || kind || ':' || a || '->' || b AS id, kind, a, b, count(*) AS n, CASE WHEN min(resolution) = max(resolution) THEN min(resolution) ELSE 'mixed' END AS resolution FROM flow WHERE (a, b) NOT IN (FROM nest) GROUP BY kind, a, b),
st AS (SELECT 'e:' || k AS id, c AS src, 'n:' || k % 25 AS dst, 'flow' AS kind, CASE WHEN k % 80 = 0 THEN 'llm' ELSE 'file' END AS origin, 'l' || k % 3 AS label, k % 3 = 0 AS via FROM cust WHERE k % 40 = 0
  UNION ALL SELECT 'edge:derived:calls:n:' || x.n_nationkey || '->n:' || y.n_nationkey, 'n:' || x.n_nationkey, 'n:' || y.n_nationkey, 'calls', 'user', 'seen', false FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey),
ends AS (SELECT st.*, x.rep AS a, y.rep AS b, x.target AS sx, y.target AS dx FROM st JOIN t x ON x.node = src JOIN t y ON y.node = dst),
through AS (SELECT DISTINCT unnest([a, b]) AS inside FROM ends WHERE via AND a IS NOT NULL AND b IS NOT NULL),
own AS (SELECT *, CASE WHEN a = src AND b = dst THEN id END AS own FROM ends WHERE id NOT IN (SELECT id FROM arrow) AND (a <> b OR a = src AND b = dst) AND (a, b) NOT IN (FROM nest)),
stored AS (SELECT min(id) AS id, kind, a, b, count(*) AS n, arg_min(CASE WHEN origin IN ('llm', 'user') THEN origin ELSE 'static' END, id) AS resolution, CASE WHEN min(label) = max(label) THEN min(label) END AS label FROM own GROUP BY kind, a, b, own)"""


def _view(spark, sf):
    table = lambda name: b.table(spark, sf, name)
    nations = table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("rk"))
    cust = table("customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(F.broadcast(nations), "c_nationkey")
    root = F.lit(v.ROOT).alias("root")
    # read for ancestors, elements and files alike
    orders, supp = settle(b.order_places(spark, sf)), b.supplier_places(spark, sf)
    customers = cust.select(b.tag("c:", "c_custkey").alias("node"), b.tag("n:", "c_nationkey").alias("nation"), b.tag("r:", "rk").alias("region"))
    lands = nations.select(b.tag("n:", "c_nationkey").alias("node"), b.tag("r:", "rk").alias("region"))
    regions = table("region").select(b.tag("r:", "r_regionkey").alias("node"))
    group = lambda: spark.createDataFrame([("g:BUILDING",)], "node string")
    ancestors = b.ancestor_rows(orders.select("*", root), ["node", "customer", "nation", "region", "root"])
    for places, levels in ((customers, ["node", "nation", "region", "root"]), (supp, ["node", "nation", "region", "root"]), (lands, ["node", "region", "root"]), (regions, ["node", "root"]), (group(), ["node"])):
        ancestors = ancestors.unionByName(b.ancestor_rows(places.select("*", root), levels))
    nodes = orders.select(F.col("node").alias("id"), F.lit("symbol").alias("kind"), F.col("customer").alias("file"))
    for places, kind in ((customers, "file"), (supp, "file")):
        nodes = nodes.unionByName(places.select(F.col("node").alias("id"), F.lit(kind).alias("kind"), F.col("node").alias("file")))
    for places, kind in ((lands, "dir"), (regions, "dir"), (group(), "group")):
        nodes = nodes.unionByName(places.select(F.col("node").alias("id"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("file")))
    members = cust.filter("c_custkey % 5 = 0 and c_mktsegment = 'BUILDING' and rk <= 3").select(b.tag("c:", "c_custkey").alias("member"), F.lit("g:BUILDING").alias("grp"), F.lit(1).alias("sub_level"))
    include = lands.filter("region in ('r:0', 'r:1')").select("node").union(regions.filter("node = 'r:2'")).union(group()).union(customers.filter("cast(substr(node, 3) as long) % 500 in (7, 9)").select("node")).select(F.col("node").alias("element"))
    kind = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    line = table("lineitem").select("l_orderkey", b.tag("o:", "l_orderkey").alias("src"), b.tag("s:", "l_suppkey").alias("dst"), kind[F.col("l_returnflag")].alias("kind"), F.when(F.col("l_linestatus") == "F", "precise").otherwise("heuristic").alias("resolution"))
    refs = line.join(orders.select(F.col("node").alias("src"), F.col("customer").alias("src_file")), "src").withColumn("dst_file", F.col("dst")).drop("l_orderkey")
    one, two = F.col("s_suppkey") + 1, F.col("s_suppkey") + 2
    hop = table("supplier").filter("s_suppkey % 4 = 0").select(b.tag("s:", "s_suppkey").alias("dst"), F.explode(F.when(F.col("s_suppkey") % 8 == 0, F.array(one, two)).otherwise(F.array(one))).alias("to"), F.when(F.col("s_suppkey") % 3 == 0, "precise").otherwise("heuristic").alias("resolution"))
    hop = hop.select("dst", b.tag("s:", "to").alias("target"), "resolution", b.tag("s:", "to").alias("target_file"))
    key = F.col("c_custkey")
    stored = cust.filter("c_custkey % 40 = 0").select(b.tag("e:", "c_custkey").alias("id"), b.tag("c:", "c_custkey").alias("src"), F.concat(F.lit("n:"), key % 25).alias("dst"), F.lit("flow").alias("kind"), F.when(key % 80 == 0, "llm").otherwise("file").alias("origin"), F.concat(F.lit("l"), key % 3).alias("label"), F.when(key % 3 == 0, F.array(F.lit("r:3"))).otherwise(F.array().cast("array<string>")).alias("via"))
    x, y = nations.select(F.col("c_nationkey").alias("x")), nations.select(F.col("c_nationkey").alias("y"))
    seen = x.join(y, F.col("x") < F.col("y")).select(F.concat(F.lit("edge:derived:calls:n:"), "x", F.lit("->n:"), "y").alias("id"), b.tag("n:", "x").alias("src"), b.tag("n:", "y").alias("dst"), F.lit("calls").alias("kind"), F.lit("user").alias("origin"), F.lit("seen").alias("label"), F.array().cast("array<string>").alias("via"))
    hidden = spark.createDataFrame([("n:0",), ("n:1",), ("c:7",)], "element string")
    excluded = customers.filter("cast(substr(node, 3) as long) % 10 = 9").select(F.col("node").alias("file"))
    return v.derive_graph(nodes, ancestors, refs, include, memberships=members, hidden=hidden, excluded=excluded, dispatch=hop, stored=stored.unionByName(seen), most=6)


@query(f"""WITH {_MODEL}, every AS (SELECT arrow.id, arrow.kind, arrow.a, arrow.b, n, resolution, st.id IS NOT NULL AS stored, st.label FROM arrow LEFT JOIN st USING (id) UNION ALL SELECT id, kind, a, b, n, resolution, true, label FROM stored)
SELECT id, kind, a, b, n, resolution, stored, label FROM every WHERE a NOT IN ('n:0', 'n:1', 'c:7') AND b NOT IN ('n:0', 'n:1', 'c:7')""")
def derive_graph(spark, sf):
    return _view(spark, sf).edges


@query(f"""WITH {_MODEL}, item AS (SELECT 'out' AS direction, a AS inside, dx AS ghost, kind, r3.r AS far FROM refs JOIN t r3 ON r3.node = 's:' || refs.k WHERE a IS NOT NULL AND b IS NULL
  UNION ALL SELECT 'in', b, sx, kind, NULL FROM refs WHERE a IS NULL AND b IS NOT NULL),
kept AS (SELECT direction, inside, ghost, kind FROM item WHERE NOT (inside IN (FROM through) AND direction = 'out' AND far = 'r:3')),
incoming AS (SELECT direction, inside, ghost, kind FROM kept WHERE direction = 'out' UNION ALL
  SELECT 'in', b, x.target, kind FROM lineitem JOIN t x ON x.node = 'o:' || l_orderkey JOIN t y ON y.node = 's:' || l_suppkey, LATERAL (SELECT y.rep AS b, CASE l_returnflag WHEN 'R' THEN 'calls' WHEN 'A' THEN 'reads' ELSE 'references' END AS kind) WHERE (x.k % 10 <> 9 OR x.drawn) AND x.rep IS NULL AND b IS NOT NULL AND NOT (x.r = 'r:3' AND b IN (FROM through))
  UNION ALL SELECT CASE WHEN a IS NULL THEN 'in' ELSE 'out' END, coalesce(a, b), CASE WHEN a IS NULL THEN sx ELSE dx END, kind FROM ends WHERE (a IS NULL) <> (b IS NULL) AND id NOT IN (SELECT id FROM arrow)),
good AS (SELECT direction, inside, ghost, kind FROM incoming WHERE inside NOT IN ('n:0', 'n:1', 'c:7') AND ghost NOT IN ('n:0', 'n:1', 'c:7') AND (inside, ghost) NOT IN (SELECT c, n FROM cust)),
top AS (SELECT ghost FROM good GROUP BY ghost ORDER BY count(*) DESC, ghost LIMIT 6)
SELECT direction, inside, ghost, count(*) AS n, list_sort(list(DISTINCT kind)) AS kinds FROM (SELECT direction, inside, CASE WHEN ghost IN (FROM top) THEN ghost ELSE 'more:' || direction END AS ghost, kind FROM good) GROUP BY direction, inside, ghost""")
def derive_stubs(spark, sf):
    return _view(spark, sf).stubs


@query(f"""WITH {_MODEL}, seen AS (SELECT id, CASE WHEN parent NOT IN ('n:0', 'n:1') THEN parent END AS parent FROM boxes WHERE id NOT IN ('n:0', 'n:1', 'c:7'))
SELECT id, parent, id IN (SELECT parent FROM seen WHERE parent IS NOT NULL) AS container FROM seen""")
def derive_nodes(spark, sf):
    return _view(spark, sf).nodes
