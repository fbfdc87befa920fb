"""Scalar functions and path rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloam.bindings import table
from graphloam.functions import globs, ids, routes
from graphloam.functions import text as tx
from graphloam.plans.registry import query
from graphloam.sources import repo

_PARTS = "part.parquet"
_PATH = "CASE p_partkey % 9 WHEN 0 THEN 'src/a.test.ts' WHEN 1 THEN 'pkg/tests/b.py' WHEN 2 THEN 'node_modules/x/i.js' WHEN 3 THEN 'yarn.lock' WHEN 4 THEN 'src/deep/er/c.PY' WHEN 5 THEN 'go.sum' WHEN 6 THEN 'web/package-lock.json' WHEN 7 THEN 'cmd/main_test.go' ELSE 'README' END"


def _paths(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr(_PATH).alias("path"), "p_name", "p_type", "p_brand")


@query("SELECT doc_id, 'sha256-v2:' || substr(sha256(replace(text, chr(13) || chr(10), chr(10))), 1, 12) AS hash FROM documents")
def hash_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.hash_text(F.col("text")).alias("hash"))


@query("""SELECT doc_id, array_to_string(regexp_split_to_array(text, '\\r?\\n')[2:4], chr(10)) AS part,
'sha256-v2:' || substr(sha256(array_to_string(regexp_split_to_array(text, '\\r?\\n')[1:3], chr(10))), 1, 12) AS hash FROM documents""")
def slice_lines(spark, sf):
    lines = tx.lines(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(tx.slice_lines(lines, F.lit(2), F.lit(4)), "\n").alias("part"), tx.hash_range(lines, F.lit(1), F.lit(3)).alias("hash"))


@query("SELECT doc_id, (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))::INT AS units FROM documents")
def utf16_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.utf16_length(F.col("text")).alias("units"))


@query("SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> ''))::INT AS n FROM documents")
def trimmed_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(tx.trimmed_lines(F.col("text"))).alias("n"))


@query(f"""WITH p AS (SELECT p_partkey, {_PATH} AS path FROM part)
SELECT p_partkey, regexp_full_match(path, '(?:[^/]+/)*[^/]*\\.py') AS any_py, regexp_full_match(path, 'src/.*') AS in_src, regexp_full_match(path, '(?:.*/)?[^/]*\\.lock') AS lock, regexp_full_match(path, 's.*c/[^/][^/]*\\.ts') AS inner_stars,
regexp_matches(path, '(_test\\.go$)|((^|/)tests?/)|((^|/)__tests__/)|((^|/)[^/]*\\.(test|spec)\\.[^/]*$)|((^|/)test_[^/]*\\.py$)|(_test\\.py$)') AS test FROM p""")
def glob_match(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).select("p_partkey", globs.glob_match(p, "**/*.py").alias("any_py"), globs.glob_match(p, "src/**").alias("in_src"), globs.glob_match(p, "*.lock").alias("lock"), globs.glob_match(p, "s**c/?*.ts").alias("inner_stars"), globs.is_test_file(p).alias("test"))


@query(f"""WITH p AS (SELECT p_partkey, {_PATH} AS path FROM part), b AS (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM p)
SELECT p_partkey, CASE lower(CASE WHEN contains(base, '.') THEN regexp_extract(base, '\\.([^.]*)$', 1) ELSE '' END) WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'json' THEN 'json' ELSE 'text' END AS language,
CASE WHEN contains('/' || path, '/node_modules/') THEN 'dependency' WHEN path LIKE '%-lock.json' OR path LIKE '%.lock' OR base = 'go.sum' THEN 'lockfile' END AS reason FROM b""")
def path_rules(spark, sf):
    return _paths(spark, sf).select("p_partkey", repo.language_of(F.col("path")).alias("language"), repo.path_exclusion(F.col("path")).alias("reason"))


@query(f"""WITH p AS (SELECT p_partkey || '/' || {_PATH} AS path FROM part), r AS (SELECT path, CASE WHEN contains(path, '/node_modules/') THEN 'dependency' WHEN path LIKE '%-lock.json' OR path LIKE '%.lock' OR path LIKE '%/go.sum' THEN 'lockfile' END AS reason FROM p)
SELECT reason, count(*) AS n, list_sort(list(path ORDER BY path))[1:3] AS examples FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def exclusion_report(spark, sf):
    rows = _paths(spark, sf).select(F.concat_ws("/", "p_partkey", "path").alias("path"))
    return repo.exclusion_report(rows.withColumn("reason", repo.path_exclusion(F.col("path"))).filter("reason is not null"))


@query(f"""WITH p AS (SELECT p_partkey, {_PATH} AS path, replace(p_name, ' ', '.') AS dotted FROM part)
SELECT p_partkey, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, regexp_extract(path, '[^/]*$') AS base, regexp_extract(dotted, '[^.]*$') AS last, CASE WHEN contains(dotted, '.') THEN regexp_replace(dotted, '\\.[^.]*$', '') END AS up,
list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/')) AS dirs FROM p""")
def path_parts(spark, sf):
    p, d = F.col("path"), F.replace(F.col("p_name"), F.lit(" "), F.lit("."))
    return _paths(spark, sf).select("p_partkey", ids.dir_of(p).alias("dir"), globs.base_name(p).alias("base"), ids.last_segment(d).alias("last"), ids.parent_path(d).alias("up"), ids.directories(p).alias("dirs"))


_ID = "CASE p_partkey % 6 WHEN 0 THEN 'repo' WHEN 1 THEN 'dir:src/' || p_brand WHEN 2 THEN 'file:src/a.ts' WHEN 3 THEN 'sym:src/a.ts#' || replace(p_name, ' ', '.') || '#x' WHEN 4 THEN 'edge:calls:file:a->file:b->c' ELSE 'nothing' END"


@query(f"""WITH p AS (SELECT p_partkey, {_ID} AS id FROM part)
SELECT p_partkey, CASE WHEN id = 'repo' THEN 'repo' WHEN id LIKE 'dir:_%' THEN 'dir' WHEN id LIKE 'file:_%' THEN 'file' WHEN id LIKE 'sym:_%#_%' THEN 'symbol' WHEN id LIKE 'edge:%' THEN 'edge' ELSE 'unknown' END AS kind,
CASE WHEN id LIKE 'sym:%' THEN split_part(substr(id, 5), '#', 1) WHEN id LIKE 'dir:%' THEN substr(id, 5) WHEN id LIKE 'file:%' THEN substr(id, 6) END AS file,
CASE WHEN id LIKE 'sym:%' THEN substr(id, strpos(id, '#') + 1) END AS path, CASE WHEN id LIKE 'edge:%' THEN 'file:a' END AS src, CASE WHEN id LIKE 'edge:%' THEN 'file:b->c' END AS dst FROM p""")
def parse_id(spark, sf):
    parsed = table(spark, sf, "part").select("p_partkey", ids.parse_id(F.expr(_ID)).alias("i"))
    return parsed.select("p_partkey", "i.kind", "i.file", "i.path", "i.src", "i.dst")


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b,
round(CASE WHEN lower(a.n_name) = lower(b.n_name) THEN 1.0 ELSE greatest(1 - levenshtein(lower(a.n_name), lower(b.n_name))::DOUBLE / greatest(length(a.n_name), length(b.n_name)),
CASE WHEN contains(lower(a.n_name), lower(b.n_name)) OR contains(lower(b.n_name), lower(a.n_name)) THEN 0.5 + 0.5 * least(length(a.n_name), length(b.n_name)) / greatest(length(a.n_name), length(b.n_name)) ELSE 0 END) END, 6)::DOUBLE AS score,
least(levenshtein(a.n_name, b.n_name), 3)::INT AS edits
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""")
def name_similarity(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"), "n_regionkey")
    b = table(spark, sf, "nation").select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"), "n_regionkey")
    return a.join(b, "n_regionkey").select("a", "b", F.round(tx.name_similarity(F.col("x"), F.col("y")), 6).alias("score"), tx.edit_distance(F.col("x"), F.col("y"), 2).alias("edits"))


@query("""SELECT p_partkey, round(list_sum(list_transform(list_distinct(regexp_extract_all(p_name, '(?s).')), lambda c: -(len(list_filter(regexp_extract_all(p_name, '(?s).'), lambda x: x = c)) / length(p_name)::DOUBLE) * log2(len(list_filter(regexp_extract_all(p_name, '(?s).'), lambda x: x = c)) / length(p_name)::DOUBLE))), 6)::DOUBLE AS bits,
substr(p_name, 1, least(4, length(p_name) // 4)::INT) || '…' AS hint FROM part""")
def entropy(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(tx.entropy(F.col("p_name")), 6).alias("bits"), tx.mask(F.col("p_name")).alias("hint"))


@query("""SELECT p_partkey, list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(p_type || 'HTTPServer', '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS words FROM part""")
def identifier_words(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.identifier_words(F.concat("p_type", F.lit("HTTPServer"))).alias("words"))


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS rest, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages),
v AS (SELECT page_id, host, list_transform(list_filter(string_split(regexp_replace(CASE WHEN rest = '' THEN '/' ELSE rest END, '[?#].*$', ''), '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^[*]') THEN '{*}' WHEN regexp_matches(s, '^:|[{<\\[]') THEN '{}' ELSE s END) AS s, rest FROM u)
SELECT page_id, CASE WHEN regexp_matches(lower(regexp_replace(host, ':[0-9]*$', '')), '^(?:localhost|.*\\.(?:localhost|local|test|example)|(?:.*\\.)?example\\.(?:com|org|net))$') AND (rest = '' OR starts_with(rest, '/')) THEN '/' || array_to_string(s, '/') END AS route FROM v""")
def normalize_route(spark, sf):
    return table(spark, sf, "pages").select("page_id", routes.normalize_route(F.col("url")).alias("route"))


@query("""SELECT doc_id, strpos(text, 'the')::INT - 1 AS start, 3 AS length FROM documents WHERE contains(text, 'the')""")
def literal_match(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", tx.literal_match(F.col("text"), "the").alias("m"))
    return docs.filter("m is not null").select("doc_id", "m.start", "m.length")


@query("""SELECT item_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> ''))::INT AS n FROM benchmark""")
def sentences(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(tx.sentences(F.col("text"))).alias("n"))


@query("""SELECT p_partkey, (p_retailprice > 0 AND length(v) BETWEEN 8 AND 200 AND NOT regexp_matches(v, '\\s') AND NOT contains(v, '://')
AND NOT regexp_full_match(v, '[a-z0-9]+(?:[._:/-][a-z0-9]+)+') AND (regexp_matches(v, '[a-z]')::INT + regexp_matches(v, '[A-Z]')::INT + regexp_matches(v, '[0-9]')::INT + regexp_matches(v, '[^A-Za-z0-9_./-]')::INT) >= 2
AND list_sum(list_transform(list_distinct(regexp_extract_all(v, '.')), lambda c: -(len(list_filter(regexp_extract_all(v, '.'), lambda x: x = c)) / length(v)::DOUBLE) * log2(len(list_filter(regexp_extract_all(v, '.'), lambda x: x = c)) / length(v)::DOUBLE))) >= 3) AS secret
FROM (SELECT p_partkey, p_retailprice, substr(md5(p_name), 1, 4 + (p_partkey % 20)::INT) || CASE WHEN p_partkey % 3 = 0 THEN 'Q' ELSE '' END AS v FROM part)""")
def looks_secret(spark, sf):
    v = F.concat(F.expr("substr(md5(p_name), 1, cast(4 + p_partkey % 20 as int))"), F.when(F.col("p_partkey") % 3 == 0, "Q").otherwise(""))
    # a file of names is small for the work on them, so it would be one task
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return parts.select("p_partkey", ((F.col("p_retailprice") > 0) & tx.looks_secret(v)).alias("secret"))
