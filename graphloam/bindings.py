"""How the driver's star schema stands for a code graph. One place, used by every query.

Hierarchy: region > nation > customer > order (sources) and region > nation > supplier
(targets), with ids r:, n:, c:, o:, s:. A reference is a line item, from its order to its
supplier; its kind is the return flag, and its resolution is precise where the line status is
F. Files and lines are documents; symbols are windows of their lines, ten lines for a class
and five for a method in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.operators.search import explode_lines


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tag(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def refs(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst, kind, resolution: one row for each line item."""
    resolution = F.when(F.col("l_linestatus") == "F", "precise").otherwise("heuristic")
    return table(spark, folder, "lineitem").select(tag("o:", "l_orderkey").alias("src"), tag("s:", "l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"), resolution.alias("resolution"))


def nations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("rk"))


def order_places(spark: SparkSession, folder: str) -> DataFrame:
    """node, customer, nation, region of each order."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("nk"))
    joined = orders.join(customers, "c_custkey").join(nations(spark, folder), "nk")
    return joined.select(tag("o:", "o_orderkey").alias("node"), tag("c:", "c_custkey").alias("customer"), tag("n:", "nk").alias("nation"), tag("r:", "rk").alias("region"))


def supplier_places(spark: SparkSession, folder: str) -> DataFrame:
    """node, nation, region of each supplier."""
    joined = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nk")).join(nations(spark, folder), "nk")
    return joined.select(tag("s:", "s_suppkey").alias("node"), tag("n:", "nk").alias("nation"), tag("r:", "rk").alias("region"))


def ancestor_rows(places: DataFrame, levels: list[str]) -> DataFrame:
    """node, ancestor, level from the columns of a table of places, the node itself first."""
    chain = F.array(*[F.col(c) for c in levels])
    return places.select("node", F.posexplode(chain).alias("level", "ancestor")).select("node", "ancestor", "level")


def chains(spark: SparkSession, folder: str) -> DataFrame:
    """node, chain of orders and suppliers: the node and all its containers."""
    a = order_places(spark, folder).select("node", F.array("node", "customer", "nation", "region").alias("chain"))
    return a.unionByName(supplier_places(spark, folder).select("node", F.array("node", "nation", "region").alias("chain")))


def parents(spark: SparkSession, folder: str) -> DataFrame:
    """node, parent over all levels; regions have no parent."""
    c = table(spark, folder, "customer").select(tag("c:", "c_custkey").alias("node"), tag("n:", "c_nationkey").alias("parent"))
    s = table(spark, folder, "supplier").select(tag("s:", "s_suppkey").alias("node"), tag("n:", "s_nationkey").alias("parent"))
    n = table(spark, folder, "nation").select(tag("n:", "n_nationkey").alias("node"), tag("r:", "n_regionkey").alias("parent"))
    r = table(spark, folder, "region").select(tag("r:", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    return c.unionByName(s).unionByName(n).unionByName(r)


def trade(spark: SparkSession, folder: str, top: int = 2) -> DataFrame:
    """src, dst, n: each nation's ``top`` supplier nations by line items, itself left out. Cyclic at every scale for 2."""
    from pyspark.sql import Window

    a = order_places(spark, folder).select(F.col("node").alias("src"), F.col("nation").alias("a"))
    b = supplier_places(spark, folder).select(F.col("node").alias("dst"), F.col("nation").alias("b"))
    pairs = refs(spark, folder).join(a, "src").join(b, "dst").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
    return pairs.withColumn("_r", rank).filter(F.col("_r") <= top).select(F.col("a").alias("src"), F.col("b").alias("dst"), "n")


def relays(spark: SparkSession, folder: str, size: int = 6) -> DataFrame:
    """src, dst: from each order to the customer's next one, ``size`` at a time; a ring where the customer's key is even."""
    from pyspark.sql import Window

    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    blocks = orders.withColumn("block", F.floor(place / size))
    by = Window.partitionBy("o_custkey", "block").orderBy("o_orderkey")
    ring = F.when((F.col("o_custkey") % 2 == 0) & (F.first("o_orderkey").over(by) != F.col("o_orderkey")), F.first("o_orderkey").over(by))
    steps = blocks.withColumn("next", F.coalesce(F.lead("o_orderkey").over(by), ring)).filter("next is not null")
    return steps.select(tag("o:", "o_orderkey").alias("src"), tag("o:", "next").alias("dst"))


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """file (doc_id), line, line_text, source."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("file"), "source", "text")
    return explode_lines(docs)


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    """file, id, kind, start_line, end_line: windows of ten lines, and of five lines in them."""
    n = F.size(F.split("text", "\r?\n", -1))
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("file"), n.alias("n"))

    def cut(width: int, kind: str) -> DataFrame:
        each = docs.select("file", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / width).cast("int"))).alias("k"))
        return each.select("file", F.concat_ws(":", F.lit(kind), "file", "k").alias("id"), F.lit(kind).alias("kind"), (F.col("k") * width + 1).alias("start_line"), F.least(F.col("k") * width + width, F.col("n")).alias("end_line"))

    return cut(10, "class").unionByName(cut(5, "method"))


# ---- the same in SQL, as common table expressions ------------------------------------------

SQL_REFS = "refs AS (SELECT 'o:' || l_orderkey AS src, 's:' || l_suppkey AS dst, l_returnflag AS kind, CASE WHEN l_linestatus = 'F' THEN 'precise' ELSE 'heuristic' END AS resolution FROM lineitem)"
SQL_PLACES = """op AS (SELECT 'o:' || o_orderkey AS node, 'c:' || o_custkey AS customer, 'n:' || c_nationkey AS nation, 'r:' || n_regionkey AS region
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
sp AS (SELECT 's:' || s_suppkey AS node, 'n:' || s_nationkey AS nation, 'r:' || n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
SQL_PARENTS = """parents AS (SELECT 'c:' || c_custkey AS node, 'n:' || c_nationkey AS parent FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, NULL FROM region)"""
SQL_TRADE = f"""{SQL_REFS}, {SQL_PLACES},
pairs AS (SELECT op.nation AS a, sp.nation AS b, count(*) AS n FROM refs JOIN op ON src = op.node JOIN sp ON dst = sp.node WHERE op.nation <> sp.nation GROUP BY 1, 2),
trade AS (SELECT a AS src, b AS dst, n FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM pairs) WHERE r <= 2)"""
SQL_RELAYS = """rb AS (SELECT o_orderkey AS o, o_custkey AS c, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 6 AS blk FROM orders),
rn AS (SELECT *, lead(o) OVER w AS nxt, first(o) OVER w AS f FROM rb WINDOW w AS (PARTITION BY c, blk ORDER BY o)),
relays AS (SELECT 'o:' || o AS src, 'o:' || coalesce(nxt, f) AS dst FROM rn WHERE nxt IS NOT NULL OR (c % 2 = 0 AND f <> o))"""
SQL_LINES = "lines AS (SELECT file, source, i::INT AS line, l[i] AS line_text FROM (SELECT doc_id AS file, source, regexp_split_to_array(text, '\\r?\\n') AS l, unnest(range(1, len(regexp_split_to_array(text, '\\r?\\n')) + 1)) AS i FROM documents))"
SQL_SYMBOLS = """docs AS (SELECT doc_id AS file, len(regexp_split_to_array(text, '\\r?\\n')) AS n FROM documents),
symbols AS (SELECT file, kind || ':' || file || ':' || k AS id, kind, k * width + 1 AS start_line, least(k * width + width, n) AS end_line
  FROM (SELECT file, n, kind, width, unnest(range(0, (n - 1) // width + 1)) AS k FROM docs, (VALUES ('class', 10), ('method', 5)) v(kind, width)))"""
