"""Derivations on lines, positions and groups, over columns made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloam import bindings as b
from graphloam.operators import closure as cl
from graphloam.operators import drift as dr
from graphloam.operators import hierarchy as h
from graphloam.operators import rules as ru
from graphloam.operators import views as vw
from graphloam.plans.registry import query

_L, _S = b.SQL_LINES, b.SQL_SYMBOLS


@query(f"""WITH RECURSIVE {b.SQL_PARENTS}, up AS (SELECT node AS member, parent AS grp, 1 AS sub_level FROM parents WHERE parent IS NOT NULL UNION ALL SELECT up.member, p.parent, sub_level + 1 FROM up JOIN parents p ON p.node = up.grp WHERE p.parent IS NOT NULL)
SELECT member, grp, sub_level::INT AS sub_level FROM up""")
def group_reach(spark, sf):
    rows = b.parents(spark, sf).filter("parent is not null")
    return h.group_reach(rows.select(F.col("node").alias("member"), F.col("parent").alias("grp")))


@query(f"""WITH {b.SQL_PARENTS}, c AS (SELECT parent FROM parents WHERE node LIKE 'c:%'), r AS (SELECT parent FROM parents WHERE node IN (FROM c))
SELECT node AS id, substr(node, 1, 1) AS kind FROM parents WHERE node LIKE 'c:%' OR node IN (FROM c) OR node IN (FROM r)""")
def of_kinds(spark, sf):
    rows = b.parents(spark, sf)
    return vw.of_kinds(rows.select(F.col("node").alias("id"), F.substring("node", 1, 1).alias("kind")), ["c"], cl.ancestors(rows))


@query(f"""WITH {_L}, {_S}, p AS (SELECT file, line, (line * 7 % 40)::INT AS col FROM lines),
r AS (SELECT file, id, start_line AS sl, CASE WHEN kind = 'method' THEN 10 ELSE 0 END AS sc, end_line AS el, CASE WHEN kind = 'method' THEN 20 ELSE 99 END AS ec FROM symbols)
SELECT p.file, p.line, p.col, arg_max(id, ((sl - el) * 1048576 + sc - ec, sl * 1048576 + sc, id)) AS id FROM p JOIN r ON p.file = r.file AND (line, col) >= (sl, sc) AND (line, col) <= (el, ec) GROUP BY p.file, line, col""")
def innermost_at(spark, sf):
    points = b.document_lines(spark, sf).select("file", "line", (F.col("line") * 7 % 40).cast("int").alias("col"))
    method = F.col("kind") == "method"
    ranges = b.symbols(spark, sf).select("file", "id", F.col("start_line").alias("s_line"), F.when(method, 10).otherwise(0).alias("s_col"), F.col("end_line").alias("e_line"), F.when(method, 20).otherwise(99).alias("e_col"))
    return vw.innermost_at(points, ranges, []).select("file", "line", "col", "id")


@query(f"""WITH {_L}, {_S}, s AS (SELECT file || ':' || line AS site, file, line, (file % 7)::INT AS src, (line % 5)::INT AS dst FROM lines),
i AS (SELECT s.site, arg_max(id, (start_line - end_line, start_line, id)) AS inside FROM s JOIN symbols y ON s.file = y.file AND line BETWEEN start_line AND end_line GROUP BY s.site)
SELECT s.site, file, line, src, dst, inside FROM s JOIN i USING (site) WHERE src <> dst""")
def keep_blind(spark, sf):
    sites = b.document_lines(spark, sf).select(F.concat_ws(":", "file", "line").alias("site"), "file", "line", (F.col("file") % 7).cast("int").alias("src"), (F.col("line") % 5).cast("int").alias("dst"))
    known = spark.range(5).select(F.col("id").cast("int").alias("src"), F.col("id").cast("int").alias("dst"))
    return vw.keep_blind(sites, known, b.symbols(spark, sf)).select("site", "file", "line", "src", "dst", "inside")


@query("SELECT doc_id AS anchor, ((length(text) - length(replace(text, 'tion', ''))) // 4)::INT AS n FROM documents")
def unique_find(spark, sf):
    docs = b.table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text")
    return dr.unique_find(docs.select(F.col("file").alias("anchor"), "file", F.lit("tion").alias("find")), docs)


@query(f"""WITH {_L} SELECT file, 'from ' || source AS comment FROM lines WHERE line = 1""")
def header_comment(spark, sf):
    # a comment, an empty line, and then code
    head = F.when(F.col("line") == 1, F.concat(F.lit("// from "), "source")).when(F.col("line") == 2, "").otherwise(F.concat(F.lit("x = "), "line_text"))
    return vw.header_comment(b.document_lines(spark, sf).select("file", "line", head.alias("line_text")))


@query(f"""WITH {_L} SELECT file, line, CASE line % 5 WHEN 0 THEN 'm' || file WHEN 1 THEN 'pkg.m' || file WHEN 2 THEN 'crate::m' || file ELSE 'r' || file END AS module FROM lines WHERE line % 5 < 4""")
def imports_of(spark, sf):
    name = F.col("file").cast("string")
    text = F.when(F.col("line") % 5 == 0, F.concat(F.lit("import a from 'm"), name, F.lit("'"))).when(F.col("line") % 5 == 1, F.concat(F.lit("from pkg.m"), name, F.lit(" import b")))
    text = text.when(F.col("line") % 5 == 2, F.concat(F.lit("use crate::m"), name)).when(F.col("line") % 5 == 3, F.concat(F.lit("const z = require('r"), name, F.lit("')"))).otherwise(F.col("line_text"))
    return vw.imports_of(b.document_lines(spark, sf).select("file", "line", text.alias("line_text")).filter("line % 5 < 4"))


@query(f"""WITH {_L}, s AS (SELECT 'd' || file % 200 || '/.env' AS file, line, CASE WHEN line % 3 = 0 AND file % 2 = 0 THEN 0 ELSE 1 END AS rank FROM lines WHERE line % 7 <> 1)
SELECT file, (min((rank, line)))[2]::INT AS line, CASE WHEN min(rank) = 0 THEN 'high' ELSE 'medium' END AS severity FROM s GROUP BY file""")
def env_findings(spark, sf):
    named = (F.col("line") % 3 == 0) & (F.col("file") % 2 == 0)
    text = F.when(F.col("line") % 7 == 1, F.lit("# nothing")).when(named, "export API_KEY=q8f3z1").otherwise("NEXT_PUBLIC_API_KEY=q8f3z1 # shown")
    return ru.env_findings(b.document_lines(spark, sf).select(F.concat(F.lit("d"), (F.col("file") % 200).cast("string"), F.lit("/.env")).alias("file"), "line", text.alias("line_text")))
