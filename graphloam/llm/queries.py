"""The registered queries of this package and their SQL. Each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.llm import ann, decontaminate, hmm_lm, lang_id, line_dedup, mixing, near_dup, pii, prefix_free, ranked_search, secret_forest, sharding, weighted_lloyd
from graphloam.llm.common import table

SHARDS = 40


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_layout(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dup.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken", F.array_join(F.transform("shard_words", lambda n: n.cast("string")), ",").alias("shard_words"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_documents(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "first", "last", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


def op11_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_lloyd.digest(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_near_dedup, op3_mixing, op4_decontamination, op5_line_dedup, op6_nearest, op7_surrogates, op8_language, op9_language_model, op10_secrets, op11_weighted_lloyd, op12_ranked_search, op13_prefix_free)}

# CRC-32 by half bytes; fixed values of the reflected polynomial 0xEDB88320.
_CRC_TABLE = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"


def _crc(text: str) -> str:
    """DuckDB expression: CRC-32 of the UTF-8 bytes of a text expression."""
    half = "xor(t.c[(xor({c}, {b}) & 15)::INT + 1], {c} >> 4)"
    low = half.format(c="acc", b="b")
    both = half.format(c=f"({low})", b="(b >> 4)")
    return f"(SELECT xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT), lambda acc, b: {both}), 4294967295) FROM (SELECT {_CRC_TABLE}::BIGINT[] AS c) t)"


_OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, (coalesce(strlen(text), 0) + 16)::BIGINT AS size, {_crc("coalesce(text, '')")} AS text_crc32 FROM documents),
s AS (SELECT *, list_transform(range({SHARDS + 1}), lambda i: ('0x' || substr(md5(k || ':' || i), 1, 13))::BIGINT) AS draws FROM d),
p AS (SELECT *, list_max(list_transform(range({SHARDS}), lambda i: {{'v': draws[i + 1], 'i': i}})).i AS shard, list_max(list_transform(range({SHARDS + 1}), lambda i: {{'v': draws[i + 1], 'i': i}})).i AS grown FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY md5(k || ':' || size || ':' || text_crc32), size, text_crc32) - 1)::BIGINT AS slot, grown::INT AS grown_shard
FROM p"""

_OP3 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, {_crc("coalesce(text, '')")} AS crc FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM src),
w AS (SELECT *, [5.0, 2.0, 1.0][(rank % 3)::INT + 1]::DOUBLE AS weight, source_size * 3 AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
c AS (SELECT *, cap <= level * weight AS capped FROM l),
t AS (SELECT source, rank, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (SELECT arg_min(level, (cap / weight, rank)) FROM c WHERE NOT capped) * weight END AS target FROM c),
n AS (SELECT round(sum(source_size) / 16)::BIGINT AS blocks FROM t),
seats AS (SELECT rank, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, rank, seat) AS place
          FROM (SELECT rank, target, unnest(range((target / 16)::BIGINT + 100)) AS seat FROM t WHERE target > 0)),
q AS (SELECT t.rank, s, least(count(place) FILTER (place <= n.blocks * (s + 1) // 8) * 16, any_value(t.source_size) * 3) AS upto
      FROM t CROSS JOIN n CROSS JOIN range(8) g(s) LEFT JOIN seats ON seats.rank = t.rank GROUP BY t.rank, s, n.blocks),
cuts AS (SELECT rank, s, coalesce(lag(upto) OVER (PARTITION BY rank ORDER BY s), 0) AS lo, upto AS hi FROM q),
p AS (SELECT t.*, q.upto AS take, greatest(source_size, 1) AS size1 FROM t JOIN q ON q.rank = t.rank AND s = 7),
o AS (SELECT *, take // size1 AS rounds, take % size1 AS rest, {_crc("'start:20:' || coalesce(source, 'null')")} % ceil(size1 / 16)::BIGINT * 16 AS start FROM p),
a AS (SELECT row_number() OVER () AS r, d.doc_id, d.source, d.size, o.* EXCLUDE (source), coalesce(sum(d.size) OVER (PARTITION BY o.rank ORDER BY md5('20:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || d.crc), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source),
b AS (SELECT r, s, sum(greatest(least(hi, least(ahead + size, size1) + w * size1) - greatest(lo, ahead + w * size1), 0) + greatest(least(hi, ahead + size - size1 + w * size1) - greatest(lo, w * size1), 0))::BIGINT AS n
      FROM (SELECT r, rank, size, size1, (pos - start + size1) % size1 AS ahead FROM a) JOIN cuts USING (rank) CROSS JOIN range(4) g(w) GROUP BY r, s),
v AS (SELECT r, string_agg(n::VARCHAR, ',' ORDER BY s) AS shard_words FROM b GROUP BY r)
SELECT doc_id, source, size, source_size, target, shard_words, (rounds * size + greatest(least(start + rest, pos + size) - greatest(start, pos), 0) + least(greatest(start + rest - source_size - pos, 0), size))::BIGINT AS taken
FROM a JOIN v USING (r)"""

_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, width, array_to_string(w[i:i + width - 1], ' ') AS gram FROM (SELECT item, w, least(len(w), 10) AS width, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM bw),
dw AS (SELECT r, width, i, array_to_string(w[i:i + width - 1], ' ') AS gram FROM (SELECT r, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, widths)),
hits AS (SELECT r, item, width, i FROM dw JOIN bw USING (width, gram)),
hit AS (SELECT r, count(DISTINCT word) AS n FROM (SELECT r, unnest(range(i, i + width)) AS word FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

_OP5 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, i, lines[i] AS line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
bad AS (SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT key, doc_id FROM l WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5),
m AS (SELECT l.*, bad.key IS NOT NULL AND l.doc_id IS DISTINCT FROM bad.keeper AS dropped FROM l LEFT JOIN bad ON l.key = bad.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r"""

# Lloyd over all vectors, none grouped: x has a row for each component, c the centroids of a round.
_NEAR = """a{i} AS (SELECT r, arg_min(c, (far, c)) AS c, min(far) AS far FROM (SELECT x.r, c, sum((x.v - k.v) * (x.v - k.v))::BIGINT AS far FROM x JOIN c{i} k USING (d) GROUP BY x.r, c) GROUP BY r)"""
_MEAN = """c{j} AS (SELECT k.c, k.d, coalesce(m.v, k.v) AS v FROM c{i} k LEFT JOIN (SELECT a.c, x.d, floor(sum(x.v) / count(*))::BIGINT AS v FROM x JOIN a{i} a USING (r) GROUP BY a.c, x.d) m ON m.c = k.c AND m.d = k.d)"""
_OP11 = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
x AS (SELECT r, unnest(range(64)) AS d, unnest(q) AS v FROM e),
c0 AS (SELECT c, unnest(range(64)) AS d, unnest(q) AS v FROM (SELECT q, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM e ORDER BY c LIMIT 40)),
{", ".join(_NEAR.format(i=i) + ", " + _MEAN.format(i=i, j=i + 1) for i in range(5))}, {_NEAR.format(i=5)},
h AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c5 GROUP BY c)
SELECT vec_id, c::INT AS cluster, far AS distance, sum(far) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(far) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a5 JOIN e USING (r) JOIN h USING (c)"""

_OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_WORDS.format("coalesce(text, '')")}) AS w FROM benchmark),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
q AS (SELECT i, unnest(w) AS t FROM b),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
f AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY t, docs),
v AS (SELECT i, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(w) * docs) // words))))::BIGINT AS score FROM q JOIN p USING (t) JOIN f USING (t) JOIN d USING (r) CROSS JOIN s GROUP BY i, r)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM v JOIN d USING (r) WHERE score > 0) JOIN b USING (i) WHERE rank <= 50"""

# All windows of every text, by their MD5; h has two digits for each byte.
_OP13 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d)),
hit AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
runs AS (SELECT r, i, sum(gap) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, (i - lag(i, 1, -401) OVER (PARTITION BY r ORDER BY i) > 400)::INT AS gap FROM hit)),
s AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY r, g),
o AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS z FROM s),
kept AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS front, max(b) AS last FROM o JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""

ORACLES: dict[str, str] = {"op1_sharding": _OP1, "op3_mixing": _OP3, "op4_decontamination": _OP4, "op5_line_dedup": _OP5, "op11_weighted_lloyd": _OP11, "op12_ranked_search": _OP12, "op13_prefix_free": _OP13}
