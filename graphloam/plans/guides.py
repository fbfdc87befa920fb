"""Rules over guides, over the driver's tables: benchmark items as summaries, documents as details, conversations as tours."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloam import bindings as b
from graphloam.operators import guide_lint as gl
from graphloam.plans.registry import query

_WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"
_SENTENCES = "list_filter(list_transform(regexp_split_to_array(regexp_replace({}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"""WITH f AS (SELECT 'i' || item_id AS element, 'summary' AS field, text AS raw FROM benchmark UNION ALL SELECT 'd' || doc_id, 'detail', text FROM documents),
t AS (SELECT *, regexp_replace(raw, '`[^`]*`', '``', 'g') AS p FROM f WHERE trim(raw) <> ''),
c AS (SELECT *, {_WORDS.format('p')} AS words, len({_SENTENCES.format('p')}) AS said, NOT regexp_matches(raw, '\\bTODO\\b') AS written,
  list_max(list_transform(string_split(regexp_replace(regexp_replace(p, '\\n([ \\t]*(?:[-*+]|[0-9]+[.)])[ \\t])', chr(1) || '\\1', 'g'), '\\n[ \\t]*\\n', chr(1), 'g'), chr(1)), lambda x: {_WORDS.format('x')})) AS longest,
  regexp_matches(raw, '(?m)^ {{0,3}}#{{1,6}}[ \\t]+\\S')::INT + regexp_matches(raw, '\\[[^\\]\\n]*[A-Za-z][^\\]\\n]*\\]\\([^)\\s]*[/#:.][^)\\s]*\\)')::INT AS marks FROM t)
SELECT 'long-summary' AS rule, element, field, words::BIGINT AS n FROM c WHERE field = 'summary' AND written AND (said > 2 OR words > 45)
UNION ALL SELECT 'long-detail', element, field, longest::BIGINT FROM c WHERE field = 'detail' AND written AND longest > 80
UNION ALL SELECT 'markdown-in-summary', element, field, marks::BIGINT FROM c WHERE field = 'summary' AND marks > 0""")
def lint_summaries(spark, sf):
    items = b.table(spark, sf, "benchmark").select(b.tag("i", "item_id").alias("element"), F.lit("summary").alias("field"), "text")
    return gl.lint_summaries(items.unionByName(b.table(spark, sf, "documents").select(b.tag("d", "doc_id").alias("element"), F.lit("detail").alias("field"), "text")))


@query(f"""WITH s AS (SELECT conv_id AS tour, turn AS step, trim(CASE WHEN turn % 3 = 0 THEN '### Turn' || chr(10) || text ELSE text END, ' ' || chr(9) || chr(13) || chr(10)) AS note, role = 'user' AS talk FROM conversations),
u AS (SELECT *, regexp_matches(note, '^#{{1,6}}[ \\t]+\\S') AS headed, string_split(note, chr(10))[1] AS head FROM s),
v AS (SELECT *, coalesce(length({_SENTENCES.format('head')}[1]), 0) AS size, length(trim(CASE WHEN headed THEN CASE WHEN contains(note, chr(10)) THEN substr(note, instr(note, chr(10)) + 1) ELSE '' END ELSE note END, ' ' || chr(9) || chr(13) || chr(10))) AS body FROM u)
SELECT 'untitled-step' AS rule, tour, step, size::BIGINT AS n FROM v WHERE NOT headed AND (size = 0 OR size > 80)
UNION ALL SELECT 'note-heading', tour, step, size::BIGINT FROM v WHERE NOT headed AND size BETWEEN 1 AND 80
UNION ALL SELECT 'long-talk-note', tour, step, body::BIGINT FROM v WHERE talk AND body > 280""")
def lint_steps(spark, sf):
    turns = b.table(spark, sf, "conversations")
    note = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("### Turn\n"), "text")).otherwise(F.col("text"))
    return gl.lint_steps(turns.select(F.col("conv_id").alias("tour"), F.col("turn").alias("step"), note.alias("note"), (F.col("role") == "user").alias("talk")))


@query("""WITH r AS (SELECT l_orderkey AS step, l_linenumber AS ord, l_suppkey % 2 AS file, (l_partkey * 7) % 500 AS s, (l_partkey * 7) % 500 + l_quantity::BIGINT AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY step, file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
f AS (SELECT step, file, count(*) FILTER (reach IS NULL OR s - reach > 40) AS places, min(ord) AS ord FROM m GROUP BY ALL)
SELECT step, file, places FROM f WHERE places > 3 QUALIFY row_number() OVER (PARTITION BY step ORDER BY ord, file) = 1""")
def far_ranges(spark, sf):
    start = (F.col("l_partkey") * 7) % 500
    rows = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("step"), F.col("l_linenumber").alias("ord"), (F.col("l_suppkey") % 2).alias("file"), start.alias("start_line"), (start + F.col("l_quantity").cast("long")).alias("end_line"))
    return gl.far_ranges(rows)
