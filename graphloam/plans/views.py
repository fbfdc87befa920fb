"""Smaller derivations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloam import bindings as b
from graphloam.operators import views as vw
from graphloam.plans.registry import query


@query("WITH c AS (SELECT conv_id, list(role || turn ORDER BY turn) AS via FROM conversations GROUP BY conv_id) SELECT conv_id, (i - 1)::INT AS hop, via[i] AS src, via[i + 1] AS dst FROM (SELECT *, unnest(range(1, len(via))) AS i FROM c)")
def via_hops(spark, sf):
    turns = b.table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], x["turn"].cast("string"))).alias("via"))
    return vw.via_hops(turns, "conv_id", "via")


@query("""WITH RECURSIVE v AS (SELECT c_custkey AS view, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent FROM customer),
up AS (SELECT view, parent, 1 AS d FROM v WHERE parent IS NOT NULL UNION ALL SELECT up.view, v.parent, d + 1 FROM up JOIN v ON up.parent = v.view WHERE v.parent IS NOT NULL)
SELECT v.view::VARCHAR AS view, coalesce((SELECT list(parent::VARCHAR ORDER BY d DESC) FROM up WHERE up.view = v.view), []) AS trail FROM v""")
def zoom_trail(spark, sf):
    k = F.col("c_custkey")
    rows = b.table(spark, sf, "customer").select(k.cast("string").alias("view"), F.when(k > 1, F.floor(k / 2).cast("string")).alias("parent"))
    return vw.zoom_trail(rows)


@query("SELECT 'r:' || r_regionkey AS element FROM region WHERE r_regionkey NOT IN (1, 3) UNION SELECT 'n:' || n_nationkey FROM nation WHERE n_regionkey IN (1, 3)")
def expand_in_place(spark, sf):
    rows = b.parents(spark, sf).filter("node like 'n:%' and parent in ('r:1', 'r:3')").select(F.col("parent").alias("box"), F.col("node").alias("member"))
    return vw.expand_in_place(b.table(spark, sf, "region").select(b.tag("r:", "r_regionkey").alias("element")), rows)


@query("SELECT source AS dir, count(*) AS n FROM (SELECT DISTINCT source, doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 = 0) GROUP BY source")
def removed_boxes(spark, sf):
    docs = b.table(spark, sf, "documents").filter("doc_id % 3 <> 0").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("file"))
    return vw.removed_boxes(docs.select("file"), docs.filter("doc_id % 5 <> 0").select("file"))


@query(f"""WITH {b.SQL_RELAYS} SELECT 'o:' || o AS node, min('o:' || o) OVER (PARTITION BY c, blk) AS grp FROM rb QUALIFY count(*) OVER (PARTITION BY c, blk) > 1""")
def type_groups(spark, sf):
    return vw.type_groups(b.relays(spark, sf))


@query("""WITH u AS (SELECT user_id AS function, event_id AS line, event_type AS state, CASE WHEN event_id % 2 = 0 THEN 'test' ELSE 'set' END AS action FROM events),
t AS (SELECT *, last_value(CASE WHEN action = 'test' THEN state END IGNORE NULLS) OVER (PARTITION BY function ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src_state FROM u)
SELECT src_state, state AS dst_state, function, count(*) AS n FROM t WHERE action = 'set' AND src_state <> state GROUP BY ALL""")
def state_transitions(spark, sf):
    uses = b.table(spark, sf, "events").select(F.col("user_id").alias("function"), F.col("event_id").alias("line"), F.col("event_type").alias("state"), F.when(F.col("event_id") % 2 == 0, "test").otherwise("set").alias("action"))
    return vw.state_transitions(uses)


@query(f"""WITH {b.SQL_LINES}, l AS (SELECT file, line, length(line_text) % 4 AS indent, 's' || length(line_text) % 5 AS state, CASE WHEN line % 3 = 1 THEN 'test' ELSE 'set' END AS action FROM lines WHERE line_text <> ''),
t AS (SELECT *, coalesce((SELECT min(x.line) FROM l x WHERE x.file = l.file AND x.line > l.line AND x.indent <= l.indent), 1000000000) AS stop FROM l WHERE action = 'test'),
h AS (SELECT s.file, s.line, s.state AS dst_state, arg_max(t.state, t.line) AS src_state FROM l s JOIN t ON s.file = t.file AND s.line > t.line AND s.line < t.stop WHERE s.action = 'set' GROUP BY ALL)
SELECT src_state, dst_state, file, count(*) AS n FROM h WHERE src_state <> dst_state GROUP BY ALL""")
def block_transitions(spark, sf):
    lines = b.document_lines(spark, sf).filter("line_text <> ''")
    rows = lines.select("file", "line", (F.length("line_text") % 4).alias("indent"), F.concat(F.lit("s"), (F.length("line_text") % 5).cast("string")).alias("state"), F.when(F.col("line") % 3 == 1, "test").otherwise("set").alias("action"))
    return vw.block_transitions(rows, rows)


@query("""WITH RECURSIVE t AS (SELECT n_nationkey::VARCHAR AS type, (n_nationkey // 2)::VARCHAR AS base FROM nation WHERE n_nationkey > 0),
up AS (SELECT '5' AS type, 0 AS d UNION ALL SELECT base, d - 1 FROM up JOIN t USING (type)), down AS (SELECT '5' AS type, 0 AS d UNION ALL SELECT t.type, d + 1 FROM down JOIN t ON t.base = down.type WHERE d < 2)
SELECT '5' AS root, type, d::INT AS depth FROM (SELECT * FROM up UNION ALL SELECT * FROM down) WHERE d <> 0""")
def type_hierarchy(spark, sf):
    k = F.col("n_nationkey")
    bases = b.table(spark, sf, "nation").filter(k > 0).select(k.cast("string").alias("type"), F.floor(k / 2).cast("string").alias("base"))
    return vw.type_hierarchy(bases, spark.createDataFrame([("5",)], "seed string"))


@query("""WITH s AS (SELECT conv_id, turn, turn::VARCHAR AS step, CASE WHEN turn % 3 = 2 THEN ['0', '1'] ELSE [] END AS nxt FROM conversations),
w AS (SELECT *, CASE WHEN len(nxt) > 0 THEN nxt ELSE list_filter([lead(step) OVER (PARTITION BY conv_id ORDER BY turn)], lambda x: x IS NOT NULL) END AS ways FROM s)
SELECT conv_id AS flow, step AS src, unnest(ways) AS dst, len(ways) > 1 AS decision FROM w""")
def process_flow(spark, sf):
    none = F.array().cast("array<string>")
    steps = b.table(spark, sf, "conversations").select(F.col("conv_id").alias("flow"), F.col("turn").alias("n"), F.col("turn").cast("string").alias("step"), F.when(F.col("turn") % 3 == 2, F.array(F.lit("0"), F.lit("1"))).otherwise(none).alias("next"))
    return vw.process_flow(steps)


@query(f"WITH {b.SQL_SYMBOLS} SELECT file, id, (row_number() OVER (PARTITION BY file ORDER BY start_line, id) - 1)::INT AS row FROM symbols")
def row_order(spark, sf):
    return vw.row_order(b.symbols(spark, sf), "file", "start_line", "id").select("file", "id", "row")


@query(f"WITH {b.SQL_LINES}, {b.SQL_SYMBOLS} SELECT s.file, s.id, count(*) AS n FROM lines l JOIN symbols s ON l.file = s.file AND line BETWEEN start_line AND end_line WHERE contains(line_text, 'tion') GROUP BY s.file, s.id")
def inside_points(spark, sf):
    return vw.inside_points(b.document_lines(spark, sf).filter("line_text like '%tion%'").select("file", "line"), b.symbols(spark, sf))


@query("""WITH r AS (SELECT doc_id AS file, 'd' || doc_id % 50 || '/x.' || lang AS p FROM documents), d AS (SELECT DISTINCT p AS file FROM r)
SELECT 1 AS id, file FROM d WHERE file = 'd1/x.en' UNION ALL SELECT 2, file FROM d WHERE starts_with(file, 'd2/') AND regexp_matches(file, '^d2/x\\.(en|de)$') UNION ALL SELECT 3, file FROM d WHERE regexp_matches(file, '^d[0-9]/x\\.fr$')""")
def resource_join(spark, sf):
    files = b.table(spark, sf, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 50).cast("string"), F.lit("/x."), "lang").alias("file")).distinct()
    resources = spark.createDataFrame([(1, "d1/x.en", None, None), (2, None, "d2", r"^d2/x\.(en|de)$"), (3, None, "", r"^d[0-9]/x\.fr$")], "id int, path string, prefix string, regex string")
    return vw.resource_join(resources, files)


@query("""SELECT doc_id AS file, CASE WHEN doc_id % 4 = 0 THEN 'not analysed' WHEN doc_id % 4 = 1 THEN 'unsupported' ELSE 'partial' END AS reason FROM documents WHERE doc_id % 4 <> 3""")
def coverage_report(spark, sf):
    docs = b.table(spark, sf, "documents").select(F.col("doc_id").alias("file"))
    status = F.when(F.col("file") % 4 == 1, "failed").when(F.col("file") % 4 == 2, "partial").otherwise("supported")
    return vw.coverage_report(docs.filter("file % 4 <> 0").withColumn("status", status), docs)


@query("""WITH e AS (SELECT c_custkey AS element FROM customer), a AS (SELECT o_custkey AS element, o_orderkey AS file, 1 AS s, 3 AS e FROM orders), s AS (SELECT c_custkey AS element, c_custkey AS file, 5 AS s, 9 AS e FROM customer WHERE c_custkey % 3 = 0)
SELECT element, file, s AS start_line, e AS end_line FROM a UNION ALL SELECT * FROM s WHERE element NOT IN (SELECT element FROM a) UNION ALL SELECT element, element, 1, 100 FROM e WHERE element NOT IN (SELECT element FROM a) AND element % 3 <> 0""")
def code_focus(spark, sf):
    c = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("element"))
    anchors = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("element"), F.col("o_orderkey").alias("file"), F.lit(1).alias("start_line"), F.lit(3).alias("end_line"))
    symbols = c.filter("element % 3 = 0").select("element", F.col("element").alias("file"), F.lit(5).alias("start_line"), F.lit(9).alias("end_line"))
    return vw.code_focus(c, anchors, symbols, c.select("element", F.col("element").alias("file"), F.lit(100).alias("lines")))


@query(f"""WITH {b.SQL_PARENTS}, {b.SQL_PLACES}, hops AS (SELECT 0 AS hop, 'n:0' AS a, 'n:1' AS b UNION ALL SELECT 1, 'n:1', 'n:2'), {b.SQL_REFS}
SELECT hop, kind, count(*) AS n FROM hops JOIN op ON op.nation = a JOIN refs ON src = op.node JOIN sp ON dst = sp.node AND sp.nation = b GROUP BY hop, kind""")
def hop_refs(spark, sf):
    inside = b.order_places(spark, sf).select(F.col("nation").alias("element"), "node").unionByName(b.supplier_places(spark, sf).select(F.col("nation").alias("element"), "node"))
    hops = spark.createDataFrame([(0, "n:0", "n:1"), (1, "n:1", "n:2")], "hop int, a string, b string")
    return vw.hop_refs(b.refs(spark, sf), hops, inside).groupBy("hop", "kind").agg(F.count("*").alias("n"))


@query("WITH i AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 's' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'f' || s_suppkey || '#' ELSE 'none' END AS id, s_suppkey AS k FROM supplier) SELECT DISTINCT id, CASE WHEN k % 3 = 0 THEN 'file' || (k % 7) WHEN k % 3 = 1 AND k % 2 = 0 THEN 'f' || k END AS file FROM i")
def file_of(spark, sf):
    k = F.col("s_suppkey")
    s = b.table(spark, sf, "supplier").select(k)
    ids = s.select(F.when(k % 3 == 0, b.tag("s", "s_suppkey")).when(k % 3 == 1, F.concat(b.tag("f", "s_suppkey"), F.lit("#"))).otherwise("none").alias("id"))
    symbols = s.filter(k % 3 == 0).select(b.tag("s", "s_suppkey").alias("id"), F.concat(F.lit("file"), (k % 7).cast("string")).alias("file"))
    return vw.file_of(ids, symbols, s.filter(k % 2 == 0).select(b.tag("f", "s_suppkey").alias("file")))
