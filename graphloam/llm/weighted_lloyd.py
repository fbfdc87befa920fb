"""Centroid clustering of quantised vectors, identical ones as one with a multiplicity.

Vectors become integers, equal ones are grouped and counted, and Lloyd's rounds run over the
distinct vectors alone: a task assigns its vectors, adds up components times multiplicity in
integers, and gives one row for each centroid. Only those sums meet, so a vector that makes up
any share of the rows weighs like any other. Assignments are joined back to the rows at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloam.llm.common import id_text, join_salted, settle

LENGTH, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Components beyond this have squared distances that a long may not hold; such vectors are not kept.
MOST = 500_000
#: Vectors whose distances are worked out at once: the scratch is this times the centroids.
BLOCK = 4096


def quantised(vector: Column, length: int = LENGTH, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null for vectors that are not kept."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= MOST))
    kept = vector.isNotNull() & (F.size(vector) == length) & F.coalesce(fine, F.lit(False))
    return F.when(kept, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def distinct_vectors(vectors: DataFrame, length: int = LENGTH, scale: int = SCALE) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): vec_id and key of every kept row; key, q and weight of every distinct quantised vector.

    The key is the SHA-256 of the components, so that rows move without their vectors.
    """
    q = quantised(F.col("embedding"), length, scale)
    rows = vectors.select("vec_id", q.alias("q")).filter(F.col("q").isNotNull()).withColumn("key", F.unhex(F.sha2(F.array_join(F.transform("q", lambda x: x.cast("string")), ","), 256)))
    return rows, settle(rows.groupBy("key").agg(F.first("q").alias("q"), F.count("*").alias("weight")))


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, ties to the smaller number, and the squared distance; exact."""
    near, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    # doubles hold every sum exactly below 2**53, and multiply faster than integers
    kind = np.float64 if 4 * x.shape[1] * peak * peak < 1 << 52 else np.int64
    c = centroids.astype(kind)
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK].astype(kind)
        gap = (part * part).sum(1)[:, None] - 2 * (part @ c.T) + (c * c).sum(1)
        near[at : at + BLOCK] = best = gap.argmin(axis=1)
        far[at : at + BLOCK] = gap[np.arange(len(part)), best].astype(np.int64)
    return near, far


def _vectors(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _sums(held, length: int):
    """mapInArrow function: for each centroid the weight and the sums of what is nearest to it in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = held.value
        total = np.zeros((len(centroids), length + 1), object)  # integers of any size
        for batch in batches:
            x, weight = _vectors(batch.column(0), length), batch.column(1).to_numpy()
            near, _ = assign(x, centroids)
            big = int(weight.sum()) * max(1, int(np.abs(x).max(initial=0))) >= 1 << 62
            part = np.column_stack([weight, x * weight[:, None]]) if not big else np.column_stack([weight.astype(object), x.astype(object) * weight.astype(object)[:, None]])
            for c in np.unique(near):
                total[c] += part[near == c].sum(axis=0)
        full = [c for c in range(len(centroids)) if total[c, 0]]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([[str(v) for v in total[c]] for c in full], pa.list_(pa.string()))], ["cluster", "sums"])

    return run


def _round(nodes: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid that has vectors replaced by the floor of their mean."""
    held = nodes.sparkSession.sparkContext.broadcast(centroids)
    parts = nodes.select("q", "weight").mapInArrow(_sums(held, centroids.shape[1]), "cluster int, sums array<string>")
    sums = parts.select("cluster", F.posexplode("sums").alias("at", "v")).groupBy("cluster", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out, found = centroids.copy(), {}
    for r in sums.collect():  # centroids times components
        found.setdefault(r["cluster"], {})[r["at"]] = int(r["v"])
    for c, v in found.items():
        out[c] = [v[i + 1] // v[0] for i in range(centroids.shape[1])]
    held.unpersist()
    return out


def first_centroids(rows: DataFrame, nodes: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors of the ``count`` rows with the least SHA-256 of seed and vec_id, in that order."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), id_text(F.col("vec_id"))), 256)
    least = rows.select(draw.alias("draw"), "key").orderBy("draw", "key").limit(count)
    found = F.broadcast(least).join(nodes, "key").orderBy("draw", "key").select("q").collect()
    return np.array([r["q"] for r in found], np.int64)


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, length: int = LENGTH, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia for every kept row of ``vectors``; the final centroids).

    ``vectors`` has vec_id and embedding; other columns are ignored. Null vectors, those of
    another length and those with null, non-finite or huge (beyond ``MOST``) components are
    not kept. A null vec_id draws as the text "null"; a repeated one is a row like any other.
    Fewer vectors than ``count`` are each a centroid; an empty table has no centroids and
    no rows. Equal centroids leave all to the smaller number; the other stays as it is.
    """
    rows, nodes = distinct_vectors(vectors, length, scale)
    centroids = first_centroids(rows, nodes, count, seed)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")]).limit(0), np.zeros((0, length), np.int64)
    for _ in range(rounds):
        centroids = _round(nodes, centroids)
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, far = assign(_vectors(batch.column(1), length), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(near, pa.int32()), pa.array(far, pa.int64())], ["key", "weight", "cluster", "distance"])

    placed = settle(nodes.select("key", "q", "weight").mapInArrow(last, "key binary, weight long, cluster int, distance long"))
    spread = placed.groupBy(F.col("cluster").alias("_c")).agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("weight")).cast("long").alias("cluster_inertia"))
    spread = settle(spread)  # a row for each centroid
    whole = spread.agg(F.sum("cluster_inertia")).first()[0]
    back = join_salted(rows.select("vec_id", F.col("key").alias("_of")), placed.drop("weight"), "_of", "key", F.xxhash64("vec_id"))
    out = back.join(F.broadcast(spread), F.col("cluster") == F.col("_c"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(whole).cast("long").alias("inertia")), centroids


def digest(vectors: DataFrame) -> DataFrame:
    """The rows of ``cluster`` with the sha256 of each one's final centroid."""
    out, centroids = cluster(vectors)
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    sha = F.element_at(F.array(*map(F.lit, names)), F.col("cluster") + 1) if names else F.lit("")
    return out.withColumn("centroid_sha256", sha)
