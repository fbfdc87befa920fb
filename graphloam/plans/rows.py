"""Keyed merges, identities and event windows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloam import bindings as b
from graphloam.operators import merge as mg
from graphloam.plans.registry import query
from graphloam.sources import repo
from graphloam.streaming import watch as wt


@query("SELECT o_custkey AS k, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def first_wins(spark, sf):
    return mg.first_wins(b.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus"), ["k"], "o_orderkey")


@query("SELECT o_custkey AS k, min(o_orderkey) AS ord, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def last_wins(spark, sf):
    return mg.last_wins(b.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord"), "o_orderstatus"), ["k"], "ord")


@query("""WITH r AS (SELECT 'o:' || l_orderkey AS src, 's:' || l_suppkey AS dst, l_returnflag AS kind, l_orderkey % 50 AS file, l_linenumber AS line, l_linestatus AS resolution FROM lineitem),
cov AS (SELECT DISTINCT file, kind FROM r WHERE file % 3 = 0 AND kind = 'A'), u AS (SELECT src, dst, kind, file, line, 'P' AS resolution FROM r WHERE file % 3 = 0 AND kind = 'A' AND line <= 2),
a AS (SELECT *, 0 AS o FROM r WHERE (file, kind) NOT IN (SELECT file, kind FROM cov) UNION ALL SELECT *, 1 FROM u)
SELECT src, dst, kind, file, line, count(*) AS n FROM (SELECT DISTINCT src, dst, kind, file, line FROM a WHERE dst IN (SELECT 's:' || s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0)) GROUP BY ALL""")
def merge_provider(spark, sf):
    line = b.table(spark, sf, "lineitem")
    refs = line.select(b.tag("o:", "l_orderkey").alias("src"), b.tag("s:", "l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") % 50).alias("file"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("resolution"))
    coverage = refs.filter("file % 3 = 0 and kind = 'A'").select("file", "kind").distinct().withColumn("status", F.lit("supported"))
    update = refs.filter("file % 3 = 0 and kind = 'A' and line <= 2").withColumn("resolution", F.lit("P"))
    known = b.table(spark, sf, "supplier").filter("s_suppkey % 7 <> 0").select(b.tag("s:", "s_suppkey").alias("id")).union(b.table(spark, sf, "orders").select(b.tag("o:", "o_orderkey")))
    out = mg.merge_provider(refs, update, coverage, known)
    return out.groupBy("src", "dst", "kind", "file", "line").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT c_custkey AS id, c_name AS label, c_mktsegment AS role, CASE WHEN c_custkey % 4 = 0 THEN ['label'] ELSE [] END AS mine FROM customer WHERE c_custkey % 2 = 0),
p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name END AS label, CASE WHEN c_custkey % 5 = 0 THEN 'X' END AS role, CASE WHEN c_custkey % 7 = 0 THEN ['role', 'label'] ELSE [] END AS gone FROM customer WHERE c_custkey % 3 <> 1)
SELECT coalesce(o.id, p.id) AS id, CASE WHEN list_contains(mine, 'label') THEN o.label WHEN list_contains(gone, 'label') THEN NULL ELSE coalesce(p.label, o.label) END AS label, CASE WHEN list_contains(gone, 'role') THEN NULL ELSE coalesce(p.role, o.role) END AS role FROM o FULL JOIN p ON o.id = p.id""")
def apply_patch(spark, sf):
    c = b.table(spark, sf, "customer")
    none = F.array().cast("array<string>")
    k = F.col("c_custkey")
    old = c.filter("c_custkey % 2 = 0").select(k.alias("id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("role"), F.when(k % 4 == 0, F.array(F.lit("label"))).otherwise(none).alias("user_fields"))
    new = c.filter("c_custkey % 3 <> 1").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("new "), "c_name")).alias("label"), F.when(k % 5 == 0, "X").alias("role"), F.when(k % 7 == 0, F.array(F.lit("role"), F.lit("label"))).otherwise(none).alias("clear_fields"))
    return mg.apply_patch(old, new, "id", ["label", "role"]).select("id", "label", "role")


@query("""WITH r AS (SELECT o_custkey AS id, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'answered' END AS status, o_orderpriority AS outcome, o_orderkey AS ord FROM orders)
SELECT id, arg_max(status, (CASE status WHEN 'closed' THEN 2 WHEN 'answered' THEN 1 ELSE 0 END, ord)) AS status, arg_max(outcome, (CASE status WHEN 'closed' THEN 2 WHEN 'answered' THEN 1 ELSE 0 END, ord)) AS outcome, count(DISTINCT outcome) FILTER (status = 'closed') > 1 AS conflict FROM r GROUP BY id""")
def merge_feedback(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("answered")
    rows = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), status.alias("status"), F.col("o_orderpriority").alias("outcome"), F.col("o_orderkey").alias("ord"))
    return mg.merge_feedback(rows.filter("ord % 2 = 0"), rows.filter("ord % 2 = 1"))


@query("""SELECT conv_id, sha256(string_agg(coalesce(role, '') || chr(31) || coalesce(text, ''), chr(10) ORDER BY turn, coalesce(role, '') || chr(31) || coalesce(text, ''))) AS identity FROM conversations GROUP BY conv_id""")
def identity(spark, sf):
    return mg.identity(b.table(spark, sf, "conversations"), ["conv_id"], ["turn"], ["role", "text"])


@query("""WITH i AS (SELECT doc_id, sha256(text) AS hash, lang AS profile FROM documents), c AS (SELECT DISTINCT sha256(text) AS hash, lang AS profile FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0)
SELECT doc_id, (hash, profile) IN (SELECT hash, profile FROM c) AS cached FROM i""")
def use_cache(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("hash"), F.col("lang").alias("profile"))
    cache = docs.filter("doc_id % 3 = 0").select("hash", "profile", F.lit("facts").alias("facts"), F.when(F.col("doc_id") % 2 == 0, F.sha2(F.lit("facts"), 256)).otherwise("broken").alias("checksum"))
    hits, misses = mg.use_cache(docs, cache)
    return hits.select("doc_id", F.lit(True).alias("cached")).unionByName(misses.select("doc_id", F.lit(False).alias("cached")))


@query("""WITH e AS (SELECT 'n:' || c_nationkey AS element, arg_max(CASE c_custkey % 3 WHEN 0 THEN 'hide' WHEN 1 THEN 'group' ELSE 'ungroup' END, c_custkey) AS action, arg_max('g:' || c_custkey % 2, c_custkey) AS grp FROM customer GROUP BY 1)
SELECT DISTINCT CASE WHEN action = 'group' THEN grp ELSE v.element END AS element FROM (SELECT 'n:' || n_nationkey AS element FROM nation) v LEFT JOIN e USING (element) WHERE action IS NULL OR action <> 'hide'""")
def user_edits(spark, sf):
    view = b.table(spark, sf, "nation").select(b.tag("n:", "n_nationkey").alias("element"))
    k = F.col("c_custkey")
    edits = b.table(spark, sf, "customer").select(b.tag("n:", "c_nationkey").alias("element"), F.when(k % 3 == 0, "hide").when(k % 3 == 1, "group").otherwise("ungroup").alias("action"), F.concat(F.lit("g:"), (k % 2).cast("string")).alias("grp"), k.alias("version"))
    return mg.user_edits(view, edits)


@query("""WITH k AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn, list_position(['MACHINERY', 'AUTOMOBILE', 'BUILDING'], c_mktsegment) AS turn FROM customer)
SELECT c_custkey, (row_number() OVER (ORDER BY rn, turn))::INT AS place FROM k WHERE turn > 0 ORDER BY rn, turn LIMIT 40""")
def round_robin(spark, sf):
    rows = b.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return mg.round_robin(rows, "c_mktsegment", ["MACHINERY", "AUTOMOBILE", "BUILDING"], [F.desc("c_acctbal"), "c_custkey"], 40).select("c_custkey", "place")


@query("""WITH r AS (SELECT l_returnflag || '/' || l_linestatus AS v, l_orderkey FROM lineitem), d AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::BIGINT AS number FROM (SELECT DISTINCT v FROM r)) SELECT number AS v, count(*) AS n FROM r JOIN d USING (v) GROUP BY number""")
def pack(spark, sf):
    rows = b.table(spark, sf, "lineitem").select(F.concat_ws("/", "l_returnflag", "l_linestatus").alias("v"), "l_orderkey")
    return repo.pack(rows, "v")[0].groupBy("v").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, g""")
def bursts(spark, sf):
    return wt.bursts(b.table(spark, sf, "events"), ["user_id"], quiet="6 hours")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def windows(spark, sf):
    return wt.windows(b.table(spark, sf, "events"), ["event_type"], "1 day")


@query("""SELECT user_id, event_id, event_id < max(event_id) OVER (PARTITION BY user_id) AS superseded FROM events""")
def latest_revision(spark, sf):
    return wt.latest_revision(b.table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id").select("user_id", "event_id", "superseded")


@query("""WITH a AS (SELECT event_id AS p, event_type AS s FROM events WHERE event_id % 3 <> 0), c AS (SELECT event_id AS p, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE event_type END AS s FROM events WHERE event_id % 4 <> 0)
SELECT coalesce(a.p, c.p) AS path, CASE WHEN a.p IS NULL THEN 'added' WHEN c.p IS NULL THEN 'removed' ELSE 'edited' END AS change FROM a FULL JOIN c ON a.p = c.p WHERE a.p IS NULL OR c.p IS NULL OR a.s <> c.s""")
def changed_inputs(spark, sf):
    e = b.table(spark, sf, "events").select(F.col("event_id").alias("path"), F.col("event_type").alias("signature"))
    after = e.filter("path % 4 <> 0").withColumn("signature", F.when(F.col("path") % 5 == 0, "x").otherwise(F.col("signature")))
    return wt.changed_inputs(e.filter("path % 3 <> 0"), after)


@query("SELECT lang, count(*) AS files, sum(n_chars)::BIGINT AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def language_summary(spark, sf):
    return b.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"))
