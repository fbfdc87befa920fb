"""A change on the maps of a guide and ignore files, over the driver's tables.

Files are orders in folders of their customers and nations: n3/c17/o5. Their status is added (O), deleted (F) or
changed (P). The top map has a group for each region, which opens a map of groups for its nations; a nation
has the folders of its even customers and a third of the orders of its odd ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloam import bindings as b
from graphloam.operators import placement as pl
from graphloam.plans.registry import query
from graphloam.session import settle
from graphloam.sources import ignore


def _orders(spark, sf):
    """One row for each order: its folder, path, status and lines."""
    joined = b.table(spark, sf, "orders").join(b.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(b.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    status = F.when(F.col("o_orderstatus") == "O", "added").when(F.col("o_orderstatus") == "F", "deleted").otherwise("changed")
    folder = F.concat(F.lit("n"), "c_nationkey", F.lit("/c"), "o_custkey")
    return joined.select("o_orderkey", "o_custkey", "c_nationkey", "n_regionkey", folder.alias("dir"), F.concat(folder, F.lit("/o"), "o_orderkey").alias("path"), status.alias("status"), (F.col("o_orderkey") % 50).alias("added"), (F.col("o_orderkey") % 7).alias("removed"))


_SQL = """w AS (SELECT o_orderkey AS o, o_custkey AS c, c_nationkey AS k, n_regionkey AS r, 'n' || c_nationkey || '/c' || o_custkey AS dir, 'n' || c_nationkey || '/c' || o_custkey || '/o' || o_orderkey AS path,
  CASE o_orderstatus WHEN 'O' THEN 'added' WHEN 'F' THEN 'deleted' ELSE 'changed' END AS status, o_orderkey % 50 AS added, o_orderkey % 7 AS removed FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _members(orders):
    """box, member of the nations."""
    nation = F.concat(F.lit("grp:n"), F.col("c_nationkey"))
    folders = orders.filter(F.col("o_custkey") % 2 == 0).select(nation.alias("box"), F.concat(F.lit("dir:"), "dir").alias("member")).distinct()
    return folders.unionByName(orders.filter((F.col("o_custkey") % 2 == 1) & (F.col("o_orderkey") % 3 == 0)).select(nation.alias("box"), F.concat(F.lit("file:"), "path").alias("member")))


def _maps(orders):
    """(opens, includes) of the regions."""
    region, view = F.concat(F.lit("grp:r"), F.col("n_regionkey")), F.concat(F.lit("view:r"), F.col("n_regionkey"))
    opens = orders.select(region.alias("box"), view.alias("view")).distinct()
    inner = orders.select(view.alias("view"), F.concat(F.lit("grp:n"), F.col("c_nationkey")).alias("element"), F.col("c_nationkey").cast("int").alias("ord")).distinct()
    top = orders.select(F.lit("view:system").alias("view"), region.alias("element"), (-F.col("n_regionkey")).cast("int").alias("ord")).distinct()
    return opens, inner.unionByName(top)


@query(f"""WITH {_SQL}, h AS (SELECT *, c % 2 = 0 OR o % 3 = 0 AS held FROM w),
d AS (SELECT dir, k, c, count(*) FILTER (status <> 'deleted') > 0 AND count(*) FILTER (status = 'changed') = 0 AS new FROM w GROUP BY ALL),
m AS (SELECT k, bool_and(new) AS new FROM (SELECT k, new FROM d WHERE c % 2 = 0 UNION ALL SELECT k, status = 'added' FROM w WHERE c % 2 = 1 AND o % 3 = 0) GROUP BY k)
SELECT 'grp:r' || r AS element, CASE WHEN bool_and(status = 'deleted') THEN 'removed' ELSE 'inside' END AS status, count(*) AS files, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed FROM h WHERE held GROUP BY r
UNION ALL SELECT 'grp:n' || k, CASE WHEN bool_and(new) AND bool_and(status = 'added') THEN 'new' ELSE 'inside' END, count(*), sum(added)::BIGINT, sum(removed)::BIGINT FROM h JOIN m USING (k) WHERE held GROUP BY k
UNION ALL SELECT 'dir:' || dir, CASE WHEN bool_and(new) THEN 'new' ELSE 'inside' END, count(*), sum(added)::BIGINT, sum(removed)::BIGINT FROM w JOIN d USING (dir) GROUP BY dir
UNION ALL SELECT 'file:' || path, CASE status WHEN 'added' THEN 'new' ELSE 'changed' END, 1, added, removed FROM w WHERE status <> 'deleted'""")
def lift_opened(spark, sf):
    orders = settle(_orders(spark, sf))
    (opens, includes), members = _maps(orders), _members(orders)
    boxes = includes.select("element").unionByName(orders.select(F.concat(F.lit("dir:"), "dir").alias("element"))).unionByName(orders.select(F.concat(F.lit("file:"), "path").alias("element"))).distinct()
    touched = spark.createDataFrame([], "element string, path string, status string")
    return pl.lift_opened(boxes, members, pl.holding(members, opens, includes), touched, orders.filter("status <> 'deleted'"), orders)


@query(f"""WITH {_SQL}, f AS (SELECT DISTINCT 'n' || k AS view, dir FROM w WHERE o % 3 = 0 AND status <> 'deleted'), t AS (SELECT DISTINCT 'n' || k AS view FROM w WHERE c % 5 = 0), left_over AS (SELECT DISTINCT dir FROM w WHERE status <> 'deleted')
SELECT 'n' || k AS view, 'file:' || path AS box, path FROM w WHERE status = 'deleted' AND dir IN (SELECT dir FROM f)
UNION ALL SELECT 'n' || k, 'dir:' || dir, path FROM w WHERE status = 'deleted' AND dir NOT IN (SELECT dir FROM f) AND dir NOT IN (FROM left_over) AND 'n' || k IN (FROM t)""")
def deleted_on(spark, sf):
    orders = settle(_orders(spark, sf))
    view = F.concat(F.lit("n"), F.col("c_nationkey")).alias("view")
    now = orders.filter("status <> 'deleted'")
    includes = now.filter(F.col("o_orderkey") % 3 == 0).select(view, F.concat(F.lit("file:"), "path").alias("element")).unionByName(orders.filter(F.col("o_custkey") % 5 == 0).select(view, F.concat(F.lit("dir:"), "dir").alias("element")).distinct())
    return pl.deleted_on(includes, orders, now)


@query("SELECT 'view:r' || r_regionkey AS view, (-r_regionkey)::INT AS ord FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)")
def part_views(spark, sf):
    opens, includes = _maps(_orders(spark, sf))
    views = includes.select("view").distinct().select("view", F.lit("graph").alias("type"), F.crc32(F.col("view").cast("binary")).alias("ord"))
    return pl.part_views(views, includes, opens)


@query(f"""WITH {_SQL} SELECT path || '.py' AS path FROM w WHERE status = 'added' AND o % 5 <> 0 AND c % 2 = 1 AND o % 3 <> 0 AND NOT (k = 4 AND o % 10 = 1)""")
def unassigned_files(spark, sf):
    orders = settle(_orders(spark, sf))
    named = orders.withColumn("path", F.concat("path", F.lit(".py"))).withColumn("language", F.when(F.col("o_orderkey") % 5 == 0, "json").otherwise("python"))
    return pl.unassigned_files(named, _members(named), named.filter("status <> 'deleted'"), ("n4/**/*1.py",))


@query(f"""WITH {_SQL}, p AS (SELECT *, CASE status WHEN 'added' THEN 'o' WHEN 'deleted' THEN 'f' ELSE 'p' END AS s FROM w)
SELECT path || '.' || s AS path FROM p WHERE (k % 3 = 0 AND c % 10 = 5) OR (k % 3 <> 0 AND c % 10 = 7)
OR CASE WHEN c % 4 = 0 AND s = 'p' THEN true WHEN c % 4 = 0 AND s = 'f' AND o % 10 = 1 THEN false WHEN k % 3 = 0 THEN false ELSE s = 'o' OR (s = 'f' AND o % 10 = 9) OR (s = 'p' AND o % 10 IN (1, 3)) END""")
def ignored_paths(spark, sf):
    orders = settle(_orders(spark, sf))
    paths = orders.select(F.concat("path", F.lit("."), F.when(F.col("status") == "added", "o").when(F.col("status") == "deleted", "f").otherwise("p")).alias("path"))
    nations = b.table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey", F.lit("/.gitignore")).alias("path"), F.when(F.col("n_nationkey") % 3 == 0, "!*.o\nc*5/").otherwise("# kept small\n/c*7/\n*9.f\no*[!24-9a-z0].p").alias("text"))
    customers = orders.filter(F.col("o_custkey") % 4 == 0).select(F.concat("dir", F.lit("/.gitignore")).alias("path"), F.lit("!*1.f\n*.p").alias("text")).distinct()
    top = b.table(spark, sf, "region").limit(1).select(F.lit(".gitignore").alias("path"), F.lit("*.o").alias("text"))
    return ignore.ignored(paths, ignore.ignore_rules(top.unionByName(nations).unionByName(customers)))
