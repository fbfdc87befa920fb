"""Approximate nearest neighbours by additive quantisation.

A vector is stored as one number from each of several full-dimensional codebooks; the sum of
the chosen code vectors stands for it. Codebooks are trained one after another on what the
ones before leave over (a bounded sample), vectors are encoded by beam search, and how far each
approximation is off is stored. A query scores codes by adding numbers from a table of its
products with all code vectors; the best by that score are then ranked by their exact cosine, and so
is every other vector whose approximation is off by enough that it could be nearer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloam.llm.common import settle

BOOKS, CODES, BEAM = 24, 256, 4
#: Vectors that codebooks are trained on: those with the least hashes.
SAMPLE = 8192
#: Distinct vectors of each block that are ranked exactly before the errors decide which others are.
SHORTLIST = 200
#: Rows of a block of codes and of a block of queries, about, and the meetings of blocks that there should be at least.
CODE_BLOCK, QUERY_BLOCK, MEETINGS = 32_768, 4096, 16
#: Far more than what single precision loses in the lookup of a vector of length 1.
SLACK = 1e-3


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmax(x @ book.T - 0.5 * (book**2).sum(1), axis=1)


def train_codebooks(sample: np.ndarray, books: int = BOOKS, codes: int = CODES, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """(books, codes, dimensions) float32: k-means on the residuals of the books before."""
    rng, left = np.random.default_rng(seed), sample.astype(np.float32)
    out = np.zeros((books, codes, sample.shape[1]), np.float32)
    for b in range(books):
        k = min(codes, len(left))
        book = left[rng.choice(len(left), k, replace=False)].copy() if k else left
        for _ in range(rounds if k else 0):
            near = _nearest(left, book)
            count = np.bincount(near, minlength=k)
            total = np.zeros_like(book)
            np.add.at(total, near, left)
            full = count > 0
            book[full] = total[full] / count[full, None]
        out[b, :k] = book
        if k:
            left = left - book[_nearest(left, book)]
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) uint8 and distances (n) of the approximations from the vectors, by beam search."""
    n, dim = x.shape
    left, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8)
    for book in books:
        width = left.shape[1]
        # what each choice would leave over, without the part that is the same for all choices of a path
        error = (left**2).sum(2)[:, :, None] - 2 * left @ book.T + (book**2).sum(1)
        flat = error.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        path, code = best // len(book), best % len(book)
        rows = np.arange(n)[:, None]
        left = left[rows, path] - book[code]
        codes = np.concatenate([codes[rows, path], code[:, :, None].astype(np.uint8)], axis=2)
    last = np.argmin((left**2).sum(2), axis=1)
    rows = np.arange(n)
    return codes[rows, last], np.linalg.norm(left[rows, last], axis=1).astype(np.float32)


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero and holds only finite numbers."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors in double precision."""
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), zero, lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    peak = np.abs(x).max(axis=1, keepdims=True)
    x = x / peak
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build_index(vectors: DataFrame, sample: int = SAMPLE, books: int = BOOKS) -> tuple[DataFrame, np.ndarray]:
    """(node, code, error) and the other columns for every distinct vector (columns node, vector), and the codebooks.

    Vectors are scaled to length 1 first. ``error`` is how far the approximation is from the scaled vector. Training
    collects at most ``sample`` vectors, those with the least hashes; encoding covers all.
    """
    # hashes are uniform, so four times as many lie below this share: few rows are ranked, however many there are
    share = min(1.0, 4 * sample / max(vectors.count(), 1))
    place = F.xxhash64("vector")
    rows = vectors.filter(F.pmod(place, F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.pmod(place, F.lit(1 << 30)), "node").limit(sample).select("vector").toArrow()
    x = _unit(_matrix(rows.column(0).combine_chunks(), len(rows))) if len(rows) else np.zeros((0, 1))
    trained = train_codebooks(x, books)
    held = vectors.sparkSession.sparkContext.broadcast(trained)
    at_vector = vectors.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                code, error = encode(_unit(_matrix(part.column(at_vector), len(part))), held.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error, pa.float32())], [*part.schema.names, "code", "error"])

    return vectors.mapInArrow(run, vectors.schema.simpleString()[7:-1] + ",code:binary,error:float"), trained


def shortlist(index: DataFrame, books: np.ndarray, queries: DataFrame, k: int, size: int = SHORTLIST) -> DataFrame:
    """query, node: the ``k`` nearest nodes of each query (columns query, vector), equal scores by vec_id and row.

    ``index`` has node, vec_id, row, vector, code, error. Every block of queries meets every block of codes. In a
    meeting the best ``size`` by table lookup are scored first. The product of a query with an approximation is off by
    the approximation's error at most, so only codes that this puts above the k-th of them can be
    nearer: all of those are scored too. What is left out is thus never among the nearest, whatever
    the vectors are. A limit by rank that starts before the shuffle takes the best of all blocks.
    """
    spark = index.sparkSession
    held, size = spark.sparkContext.broadcast(books), max(size, k)
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    code_blocks = max(1, -(-index.count() // CODE_BLOCK), -(-MEETINGS // query_blocks))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("cb", F.pmod(F.xxhash64("node"), F.lit(code_blocks)).cast("int")).withColumn("qb", spread(query_blocks))
    right = queries.withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int")).withColumn("cb", spread(code_blocks))

    def meet(key: tuple, codes: pa.Table, wanted: pa.Table) -> pa.Table:
        out = {"query": [], "node": [], "score": [], "vec_id": [], "row": []}
        if len(codes) and len(wanted):
            column = lambda c: codes.column(c).combine_chunks()
            node, row, error = (column(c).to_numpy(zero_copy_only=False) for c in ("node", "row", "error"))
            unnamed, name = column("vec_id").is_null().to_numpy(zero_copy_only=False), column("vec_id").fill_null(0).to_numpy(zero_copy_only=False)
            code = np.ascontiguousarray(np.frombuffer(b"".join(column("code").to_pylist()), np.uint8).reshape(len(codes), -1).T)
            there, asked = _matrix(column("vector"), len(codes)), _matrix(wanted.column("vector").combine_chunks(), len(wanted))
            unit, x = _unit(there), _unit(asked)
            tables_of = x.astype(np.float32)
            for i, q in enumerate(wanted.column("query").to_pylist()):
                tables = held.value @ tables_of[i]
                guess = tables[0][code[0]]
                for table, place in zip(tables[1:], code[1:], strict=True):
                    guess += table[place]
                best = _best(guess, size) if len(guess) > size else np.arange(len(guess))
                edge = np.sort(unit[best] @ x[i])[-min(k, len(best))]
                near = np.flatnonzero(guess + error >= edge - SLACK)
                score = unit[near] @ x[i]
                near = near[score >= np.partition(score, -min(k, len(near)))[-min(k, len(near))] - 1e-10]
                score = _as_cosine(there[near], asked[i])
                first = np.lexsort((row[near], name[near], unnamed[near], -score))[:k]
                out["query"].append(np.full(len(first), q))
                for c, v in (("node", node[near[first]]), ("score", score[first]), ("row", row[near[first]])):
                    out[c].append(v)
                out["vec_id"].append(np.where(unnamed[near[first]], None, name[near[first]]))
        kinds = {"query": pa.int64(), "node": pa.int64(), "score": pa.float64(), "vec_id": pa.int64(), "row": pa.int64()}
        return pa.table({c: pa.array(np.concatenate(v) if v else [], kinds[c]) for c, v in out.items()})

    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(meet, "query long, node long, score double, vec_id long, row long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
    return found.withColumn("_rank", rank).filter(F.col("_rank") <= k).select("query", "node")


def _as_cosine(there: np.ndarray, one: np.ndarray) -> np.ndarray:
    """``cosine`` of each row with ``one``: sums run over components in the same order, so the doubles are the same."""
    dot, own, other = np.zeros(len(there)), np.zeros(len(there)), 0.0
    for column, v in zip(there.T, one, strict=True):
        dot, own, other = dot + column * v, own + column * column, other + v * v
    return dot / (np.sqrt(own) * np.sqrt(other))


def _best(score: np.ndarray, size: int) -> np.ndarray:
    """Places of the largest scores, ties to the front."""
    edge = -np.partition(-score, size - 1)[size - 1]
    above = np.flatnonzero(score > edge)
    return np.concatenate([above, np.flatnonzero(score == edge)[: size - len(above)]])


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, size: int = SHORTLIST, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each query among all other rows of ``vectors``.

    ``vectors`` has vec_id and embedding; other columns are ignored. Null, zero and non-finite
    vectors take no part. Vectors of one length are compared with each other. A row is not its
    own candidate; other rows of the same vec_id are, and rows of a null vec_id too. Equal
    vectors are one node with its k + 1 first rows, so a vector with any number of copies
    fills one place of the shortlist. Scores are exact cosines of the original vectors; ties
    go to the smaller vec_id, null last. A query that is there twice is answered twice.
    """
    # a settled table keeps its order, so its row numbers do too
    rows = settle(vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks")).filter(usable(F.col("embedding")))).withColumn("row", F.monotonically_increasing_id())
    lengths = [r["d"] for r in rows.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()]  # one for each length of vectors
    out = None
    for d in lengths or [0]:
        part = _nearest_of_one_length(rows.filter(F.size("embedding") == d), k, size, sample)
        out = part if out is None else out.unionByName(part)
    return out


def _nearest_of_one_length(rows: DataFrame, k: int, size: int, sample: int) -> DataFrame:
    by_vector = Window.partitionBy("embedding")
    place = F.row_number().over(by_vector.orderBy(F.col("vec_id").asc_nulls_last(), "row"))
    # the limit by rank starts before the shuffle, so of a vector with many copies k + 1 rows of each partition move
    copies = rows.withColumn("_n", place).filter(F.col("_n") <= k + 1).select("vec_id", "row", "embedding", "_n")
    copies = settle(copies.withColumn("node", F.min("row").over(by_vector)))
    nodes = copies.filter(F.col("_n") == 1).select("node", "vec_id", "row", F.col("embedding").alias("vector"))
    index, books = build_index(nodes, sample)
    index = settle(index)
    queries = rows.filter("asks").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = shortlist(index, books, queries.select("query", "vector"), k + 1, size)  # one more, as a row is not its own candidate
    exact = found.join(nodes.select("node", F.col("vector").alias("_there")), "node").join(queries, "query").select("query", "query_id", "node", cosine(F.col("vector"), F.col("_there")).alias("score"))
    ids = copies.groupBy("node").agg(F.collect_list(F.struct("vec_id", "row")).alias("_ids"))  # k + 1 at most
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
    each = exact.join(ids, "node").select("query", "query_id", "score", F.explode("_ids").alias("_id")).select("query", "query_id", "score", "_id.vec_id", "_id.row").filter("row <> query")
    return each.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
