"""Lines, ranges, search, change and drift over the driver's texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloam import bindings as b
from graphloam.functions import text as tx
from graphloam.operators import change as ch
from graphloam.operators import drift as dr
from graphloam.operators import intervals as iv
from graphloam.operators import search as se
from graphloam.plans.registry import query

_L, _S = b.SQL_LINES, b.SQL_SYMBOLS
_HITS = f"{_L}, {_S}, hits AS (SELECT file, line, strpos(line_text, 'the')::INT - 1 AS start, 3 AS length FROM lines WHERE contains(line_text, 'the'))"
_INNER = "inner_s AS (SELECT h.file, h.line, arg_max(s.id, (s.start_line - s.end_line, s.id)) AS symbol, arg_max(h.line - s.start_line, (s.start_line - s.end_line, s.id)) AS offset_in FROM (SELECT DISTINCT file, line FROM hits) h JOIN symbols s ON h.file = s.file AND h.line BETWEEN s.start_line AND s.end_line GROUP BY h.file, h.line)"


@query(f"WITH {_L} SELECT file, line, line_text FROM lines")
def read_lines(spark, sf):
    return b.document_lines(spark, sf).select("file", "line", "line_text")


@query(f"WITH {_HITS} SELECT file, line, start, length FROM hits")
def search_literal(spark, sf):
    return se.search_lines(b.document_lines(spark, sf), "the").select("file", "line", "start", "length")


@query(f"WITH {_L} SELECT file, line, strpos(line_text, regexp_extract(line_text, '[a-z]+@mail[0-9]'))::INT - 1 AS start FROM lines WHERE regexp_matches(line_text, '[a-z]+@mail[0-9]')")
def search_regex(spark, sf):
    return se.search_lines(b.document_lines(spark, sf), "[a-z]+@mail[0-9]", regex=True).select("file", "line", "start")


@query(f"WITH {_L} SELECT count(*) AS total, count(DISTINCT file) AS matched_files FROM lines WHERE contains(lower(line_text), 'der ')")
def search_totals(spark, sf):
    return se.totals(se.search_lines(b.document_lines(spark, sf), "DER ", ignore_case=True))


@query(f"WITH {_HITS} SELECT file, line, (row_number() OVER (ORDER BY file, line))::INT AS place FROM hits ORDER BY file, line LIMIT 50 OFFSET 20")
def search_page(spark, sf):
    return se.page(search_literal(spark, sf), ["file", "line"], 20, 50).select("file", "line", "place")


@query(f"WITH {_HITS}, {_INNER} SELECT file, line, symbol, offset_in::BIGINT AS offset FROM inner_s")
def search_symbols(spark, sf):
    hits = search_literal(spark, sf)
    return se.with_symbols(hits, b.symbols(spark, sf)).select("file", "line", "symbol", F.col("offset").cast("long").alias("offset"))


@query(f"WITH {_L} SELECT file, line FROM lines WHERE contains(line_text, 'the') AND (source LIKE 'src1%' OR source = 'src5')")
def search_under(spark, sf):
    rows = b.document_lines(spark, sf).withColumn("doc", F.col("file")).withColumn("file", F.concat("source", F.lit("/x")))
    hits = se.under(se.search_lines(rows, "the"), dirs=["src5"], globs=["src1*/**"])
    return hits.select(F.col("doc").alias("file"), "line")


@query(f"WITH {_HITS} SELECT h.file, h.line, s.id FROM hits h JOIN symbols s ON h.file = s.file AND h.line BETWEEN s.start_line AND s.end_line")
def point_in_range(spark, sf):
    return iv.point_in_range(search_literal(spark, sf).select("file", "line"), b.symbols(spark, sf), "file", "line", "start_line", "end_line").select("file", "line", "id")


@query(f"WITH {_HITS}, r AS (SELECT h.file, h.line, s.id, rank() OVER (PARTITION BY h.file, h.line ORDER BY s.end_line - s.start_line) AS r FROM (SELECT DISTINCT file, line FROM hits) h JOIN symbols s ON h.file = s.file AND h.line BETWEEN s.start_line AND s.end_line) SELECT file, line, id FROM r WHERE r = 1")
def innermost_ties(spark, sf):
    return iv.innermost_all(search_literal(spark, sf).select("file", "line").distinct(), b.symbols(spark, sf), "file", "line", []).select("file", "line", "id")


_HUNKS = "hunks AS (SELECT file AS path, k * 14 + (file % 7) + 1 AS new_start, (k + file) % 4 AS new_lines, (k * file) % 3 AS old_lines FROM (SELECT file, n, unnest(range(0, n // 14 + 1)) AS k FROM docs) WHERE (k + file) % 4 + (k * file) % 3 > 0)"
_FILES = "files AS (SELECT file AS path, CASE file % 11 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'modified' END AS status FROM docs)"


def _hunks(spark, sf):
    docs = b.table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.size(F.split("text", "\r?\n", -1)).alias("n"))
    each = docs.select("file", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 14).cast("int"))).alias("k"))
    rows = each.select(F.col("file").alias("path"), (F.col("k") * 14 + F.col("file") % 7 + 1).alias("new_start"), ((F.col("k") + F.col("file")) % 4).alias("new_lines"), ((F.col("k") * F.col("file")) % 3).alias("old_lines"))
    return rows.filter("new_lines + old_lines > 0")


def _files(spark, sf):
    status = F.when(F.col("doc_id") % 11 == 0, "added").when(F.col("doc_id") % 11 == 1, "deleted").otherwise("modified")
    return b.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), status.alias("status"))


@query(f"WITH {_S}, {_HUNKS} SELECT path, sum(new_lines)::BIGINT AS added, sum(old_lines)::BIGINT AS removed, count(*) AS hunks FROM hunks GROUP BY ROLLUP (path)")
def change_totals(spark, sf):
    return ch.totals(_hunks(spark, sf))


@query(f"""WITH {_S}, {_HUNKS}, {_FILES},
e AS (SELECT s.id, max((h.old_lines > 0)::INT) AS mixed, sum(CASE WHEN h.old_lines = 0 THEN least(h.new_start + h.new_lines - 1, s.end_line) - greatest(h.new_start, s.start_line) + 1 ELSE 0 END) AS covered
  FROM symbols s JOIN hunks h ON s.file = h.path AND h.new_lines > 0 AND h.new_start <= s.end_line AND h.new_start + h.new_lines - 1 >= s.start_line GROUP BY s.id),
c AS (SELECT DISTINCT s.id FROM symbols s JOIN hunks h ON s.file = h.path AND h.new_lines = 0 AND s.start_line <= h.new_start AND h.new_start < s.end_line)
SELECT s.id, CASE WHEN f.status = 'deleted' THEN NULL WHEN f.status = 'added' THEN 'new' WHEN e.mixed = 0 AND e.covered = s.end_line - s.start_line + 1 AND c.id IS NULL THEN 'new' WHEN e.id IS NOT NULL OR c.id IS NOT NULL THEN 'changed' END AS status
FROM symbols s JOIN files f ON s.file = f.path LEFT JOIN e ON s.id = e.id LEFT JOIN c ON s.id = c.id""")
def range_status(spark, sf):
    ranges = b.symbols(spark, sf).withColumnRenamed("file", "path")
    return ch.range_status(ranges, _hunks(spark, sf), _files(spark, sf))


@query(f"""WITH {_S}, {_HUNKS}, l AS (SELECT DISTINCT path, unnest(range(new_start, new_start + new_lines)) AS line FROM hunks WHERE new_lines > 0),
a AS (SELECT id, count(*) AS lines FROM (SELECT arg_max(s.id, (s.start_line - s.end_line, s.start_line, s.id)) AS id FROM l JOIN symbols s ON path = s.file AND line BETWEEN start_line AND end_line GROUP BY path, line) GROUP BY id),
d AS (SELECT id, count(*) AS deletions FROM (SELECT arg_max(s.id, (s.start_line - s.end_line, s.id)) AS id, arg_max(s.end_line, (s.start_line - s.end_line, s.id)) AS e, line FROM (SELECT DISTINCT path, greatest(1, new_start) AS line FROM hunks WHERE new_lines = 0) c JOIN symbols s ON path = s.file AND line BETWEEN start_line AND end_line GROUP BY path, line) WHERE line + 1 <= e GROUP BY id)
SELECT coalesce(a.id, d.id) AS id, coalesce(lines, 0)::BIGINT AS lines, coalesce(deletions, 0)::BIGINT AS deletions FROM a FULL JOIN d ON a.id = d.id""")
def touched_symbols(spark, sf):
    return ch.touched_symbols(_hunks(spark, sf), b.symbols(spark, sf))


@query("""WITH w AS (SELECT doc_id, (SELECT p.text FROM documents p WHERE p.doc_id = d.doc_id - 1) AS old, text AS new FROM documents d),
d AS (SELECT doc_id, regexp_split_to_array(old, '\\r?\\n') AS a, regexp_split_to_array(new, '\\r?\\n') AS b FROM w WHERE old IS NOT NULL),
h AS (SELECT *, (SELECT count(*) FROM range(1, least(len(a), len(b)) + 1) t(i) WHERE a[1:i] = b[1:i]) AS head FROM d),
t AS (SELECT *, (SELECT count(*) FROM range(1, least(len(a), len(b)) - head + 1) t(i) WHERE a[len(a) - i + 1:] = b[len(b) - i + 1:]) AS tail FROM h),
o AS (SELECT doc_id, head, len(a) - head - tail AS ol, len(b) - head - tail AS nl FROM t)
SELECT doc_id, (head + (ol > 0)::INT)::INT AS old_start, ol::INT AS old_lines, (head + (nl > 0)::INT)::INT AS new_start, nl::INT AS new_lines FROM o WHERE ol + nl > 0""")
def line_hunks(spark, sf):
    docs = b.table(spark, sf, "documents")
    pairs = docs.select("doc_id", F.col("text").alias("new")).join(docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("old")), "doc_id").filter("old is not null")
    return ch.line_hunks(pairs, "doc_id", "old", "new").select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("old_start", "old_lines", "new_start", "new_lines")])


# Lines with their numbers in front stand once, so what differs is what was edited: every seventh rewritten, others dropped or added.
_EDITED = """l AS (SELECT doc_id, i, i || '|' || l[i] AS old FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
e AS (SELECT doc_id, i, old, CASE WHEN i % 11 = 5 THEN 'drop' WHEN i % 7 = 3 THEN 'edit' WHEN i % 13 = 6 THEN 'grow' ELSE 'keep' END AS act FROM l),
n AS (SELECT *, (act <> 'drop')::INT + (act = 'grow')::INT AS gives, sum((act <> 'drop')::INT + (act = 'grow')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum((act IN ('keep'))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e)"""


def _edited(spark, sf, drop=(11, 5), edit=(7, 3), grow=(13, 6)):
    docs = b.table(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("l"))
    old = F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit("|"), x))
    rows = docs.withColumn("a", old)
    new = F.flatten(F.transform("a", lambda x, k: F.when((k + 1) % drop[0] == drop[1], F.array().cast("array<string>")).when((k + 1) % edit[0] == edit[1], F.array(F.concat(x, F.lit(" edited")))).when((k + 1) % grow[0] == grow[1], F.array(x, F.concat(F.lit("new "), x))).otherwise(F.array(x))))
    return rows.select("doc_id", F.array_join("a", "\n").alias("old"), F.array_join(new, "\n").alias("new"))


# A line that only grows stays, and the new line after it is part of the run that follows.
_RUNS = f"""WITH {_EDITED.replace("act IN ('keep')", "act IN ('keep', 'grow')")},
g AS (SELECT *, run - (act IN ('keep', 'grow'))::INT + (act = 'grow')::INT AS grp FROM n),
part AS (SELECT doc_id, run AS grp, i, (act IN ('drop', 'edit'))::INT AS o, (act = 'edit')::INT + (act = 'grow')::INT AS w, upto, act FROM n),
h AS (SELECT doc_id, grp, sum(o) AS ol, sum(w) AS nl, min(CASE WHEN o = 1 THEN i END) AS fo, max(CASE WHEN act IN ('keep', 'grow') THEN i END) AS before, max(CASE WHEN act IN ('keep', 'grow') THEN upto - (act = 'grow')::INT END) AS kept FROM part GROUP BY doc_id, grp)
SELECT doc_id, (coalesce(before, 0) + (ol > 0)::INT)::INT AS old_start, ol::INT AS old_lines, (coalesce(kept, 0) + (nl > 0)::INT)::INT AS new_start, nl::INT AS new_lines FROM h WHERE ol + nl > 0"""


@query(_RUNS)
def diff_hunks(spark, sf):
    return ch.diff_hunks(_edited(spark, sf), "doc_id", "old", "new")


# Edits that stand alone: each removed line of theirs was rewritten to the added one.
_APART = _EDITED.replace("i % 11 = 5", "i % 12 = 6").replace("i % 7 = 3", "i % 12 = 3").replace("i % 13 = 6", "i % 12 = 9")


@query(f"WITH {_APART} SELECT doc_id, i::INT AS old_line, upto::INT AS new_line FROM n WHERE act = 'edit'")
def rewritten_lines(spark, sf):
    return ch.rewritten_lines(_edited(spark, sf, (12, 6), (12, 3), (12, 9)), "doc_id", "old", "new")


_LH = f"{_L}, h AS (SELECT file, line, 'sha256-v2:' || substr(sha256(line_text), 1, 12) AS hash FROM lines)"


@query(f"""WITH {_LH}, o AS (SELECT file, hash, list(line) AS starts FROM h GROUP BY file, hash), f AS (SELECT DISTINCT file FROM h),
a AS (SELECT file || ':' || line AS anchor, file + CASE WHEN file % 5 = 0 THEN 1 ELSE 0 END AS owner, hash, line + file % 2 AS start_line FROM h)
SELECT anchor, CASE WHEN f.file IS NULL THEN 'missing' WHEN o.starts IS NULL THEN 'drifted' WHEN list_contains(o.starts, a.start_line) THEN 'ok' ELSE 'moved' END AS status FROM a LEFT JOIN f ON a.owner = f.file LEFT JOIN o ON a.owner = o.file AND a.hash = o.hash""")
def resolve_by_hash(spark, sf):
    lines = b.document_lines(spark, sf).select("file", "line", tx.hash_text(F.col("line_text")).alias("hash"))
    regions = lines.select(F.col("file").alias("owner"), "hash", F.col("line").alias("start_line").cast("long"))
    anchors = lines.select(F.concat_ws(":", "file", "line").alias("anchor"), (F.col("file") + F.when(F.col("file") % 5 == 0, 1).otherwise(0)).alias("owner"), "hash", (F.col("line") + F.col("file") % 2).alias("start_line"))
    return dr.resolve_by_hash(anchors, regions)


@query(f"""WITH {_L}, d AS (SELECT doc_id AS file, regexp_split_to_array(text, '\\r?\\n') AS l FROM documents),
a AS (SELECT file, l, CASE WHEN file % 3 = 0 THEN 'sha256-v2:000000000000' ELSE 'sha256-v2:' || substr(sha256(array_to_string(l[2:3], chr(10))), 1, 12) END AS hash, 1 + (file % 4)::INT AS base FROM d WHERE len(l) >= 3),
p AS (SELECT a.*, greatest(1, least(base, len(l) - 1)) AS cur FROM a),
s AS (SELECT file, min((abs(i - cur), i)) AS best FROM (SELECT file, l, hash, cur, unnest(range(1, len(l))) AS i FROM p) WHERE 'sha256-v2:' || substr(sha256(array_to_string(l[i:i + 1], chr(10))), 1, 12) = hash GROUP BY file)
SELECT p.file::VARCHAR AS anchor, CASE WHEN best IS NULL THEN 'drifted' WHEN best[1] = 0 AND cur = 2 THEN 'ok' ELSE 'moved' END AS status, best[2]::BIGINT AS start_line, (best[2] + 1)::BIGINT AS end_line FROM p LEFT JOIN s USING (file)""")
def resolve_anchors(spark, sf):
    docs = b.table(spark, sf, "documents").select(F.col("doc_id").alias("file"), tx.lines(F.col("text")).alias("lines")).filter(F.size("lines") >= 3)
    wrong = F.lit(tx.HASH_PREFIX + "000000000000")
    anchors = docs.select(F.col("file").cast("string").alias("anchor"), F.lit(2).alias("size"), "file", (1 + F.col("file") % 4).cast("int").alias("base"), F.when(F.col("file") % 3 == 0, wrong).otherwise(tx.hash_range(F.col("lines"), F.lit(2), F.lit(3))).alias("hash"), F.lit(2).alias("was_start"))
    return dr.resolve_anchors(anchors, docs)


@query(f"""WITH {_LH}, o AS (SELECT file, hash, list(line) AS starts FROM h GROUP BY file, hash), f AS (SELECT DISTINCT file FROM h),
a AS (SELECT file + CASE WHEN file % 5 = 0 THEN 1 ELSE 0 END AS owner, hash, line + file % 2 AS start_line FROM h),
s AS (SELECT owner % 10 AS bucket, CASE WHEN f.file IS NULL THEN 'missing' WHEN o.starts IS NULL THEN 'drifted' WHEN list_contains(o.starts, a.start_line) THEN 'ok' ELSE 'moved' END AS status FROM a LEFT JOIN f ON a.owner = f.file LEFT JOIN o ON a.owner = o.file AND a.hash = o.hash)
SELECT status, count(*) AS n FROM s GROUP BY status""")
def anchor_status(spark, sf):
    return resolve_by_hash(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {_L}, e AS (SELECT file, min(line) AS first, max(line) AS last, count(*) AS n FROM (SELECT file, line, sum(f) OVER (PARTITION BY file ORDER BY line) AS g FROM (SELECT file, line, CASE WHEN line - lag(line) OVER (PARTITION BY file ORDER BY line) <= 3 THEN 0 ELSE 1 END AS f FROM lines WHERE line_text LIKE '%tion%')) GROUP BY file, g) SELECT file, first, last, n FROM e""")
def clusters(spark, sf):
    return iv.clusters(b.document_lines(spark, sf).filter("line_text like '%tion%'").select("file", "line"), ["file"], "line", 3)


@query(f"""WITH {_S}, {_HUNKS}, r AS (SELECT path, new_start AS s, new_start + new_lines * 5 AS e FROM hunks),
p AS (SELECT *, max(e) OVER (PARTITION BY path ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM r),
g AS (SELECT *, sum(CASE WHEN s <= pe THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY s, e DESC ROWS UNBOUNDED PRECEDING) AS g FROM p)
SELECT path, min(s)::BIGINT AS s, max(e)::BIGINT AS e, count(*) AS merged FROM g GROUP BY path, g.g""")
def merge_ranges(spark, sf):
    rows = _hunks(spark, sf).select("path", F.col("new_start").cast("long").alias("s"), (F.col("new_start") + F.col("new_lines") * 5).cast("long").alias("e"))
    return iv.merge_ranges(rows, ["path"], "s", "e")


@query(f"""WITH {_S}, c AS (SELECT s.file, s.id, (SELECT arg_max(o.id, (o.start_line - o.end_line, o.id)) FROM symbols o WHERE o.file = s.file AND o.id <> s.id AND o.start_line <= s.start_line AND o.end_line >= s.end_line AND (o.end_line - o.start_line > s.end_line - s.start_line OR o.id < s.id)) AS parent FROM symbols s) SELECT file, id, parent FROM c""")
def assign_parent(spark, sf):
    return iv.assign_parent(b.symbols(spark, sf))


@query(f"""WITH {_S} SELECT s.file, s.id, (SELECT count(*) FROM symbols o WHERE o.file = s.file AND o.id <> s.id AND o.start_line <= s.start_line AND o.end_line >= s.end_line AND (o.end_line - o.start_line > s.end_line - s.start_line OR o.id < s.id))::BIGINT AS depth FROM symbols s""")
def frame_depth(spark, sf):
    return iv.frame_depth(b.symbols(spark, sf), "file", "id", "start_line", "end_line")


@query("""WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS n FROM documents) SELECT doc_id, source, CASE WHEN n > 1 THEN lang || '~' || n ELSE lang END AS lang FROM r""")
def dedup_number(spark, sf):
    rows = b.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return iv.dedup_number(rows, ["source"], "lang", [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "source", "lang")


@query("""WITH a AS (SELECT doc_id AS k, lang AS v FROM documents WHERE doc_id % 3 <> 0), c AS (SELECT doc_id AS k, CASE WHEN doc_id % 5 = 0 THEN source ELSE lang END AS v FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(a.k, c.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN c.k IS NULL THEN 'removed' ELSE 'edited' END AS change FROM a FULL JOIN c ON a.k = c.k WHERE a.k IS NULL OR c.k IS NULL OR a.v <> c.v""")
def snapshot_diff(spark, sf):
    docs = b.table(spark, sf, "documents")
    before = docs.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("k"), F.col("lang").alias("v"))
    after = docs.filter("doc_id % 4 <> 0").select(F.col("doc_id").alias("k"), F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise(F.col("lang")).alias("v"))
    return ch.snapshot_diff(before, after, "k", "v")
