"""Lloyd's k-means on integer vectors: exact at every step, so that it doesn't depend on how rows are dealt out.

Centroids (k times dim integers) go to the tasks; each task assigns its vectors in NumPy
and sends one sum for each centroid and dimension; a groupBy adds these up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm.common import stored
from seekspark.llm.integer_vectors import integer_vectors, largest

K, ROUNDS, DIM, SEED = 40, 5, 64, 2
#: Scaled components below this have squared distances of 38 digits at most, in up to 64 dimensions.
MOST = float(1 << 59)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, the smaller number of equal ones; in int64 where that holds all sums, else in Python's integers."""
    most = largest(x) + max((abs(v) for c in centroids for v in c), default=0)
    kind = np.int64 if x.shape[1] * most**2 < 1 << 63 else object
    x = x.astype(kind, copy=False)
    best, at = None, np.zeros(len(x), np.int64)
    for k, c in enumerate(centroids):
        d = x - np.array(c, kind)
        far = (d * d).sum(1)
        if best is None:
            best = far
        else:
            closer = far < best
            at[closer], best[closer] = k, far[closer]
    return at, best


def _rows(frame: pd.DataFrame, dim: int) -> np.ndarray:
    return np.stack(frame["x"].to_numpy()).astype(np.int64, copy=False) if len(frame) else np.zeros((0, dim), np.int64)


def _sums(centroids: Broadcast, dim: int):
    """Vectors to one row for each centroid and dimension of the partition: the sum as decimal digits, and how many."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, k = centroids.value, len(centroids.value)
        total, count = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for frame in frames:
            x = _rows(frame, dim)
            at, _ = nearest(x, own)
            for c in np.unique(at):
                mine = x[at == c]
                kind = np.int64 if len(mine) * largest(mine) < 1 << 63 else object
                total[c] += mine.astype(kind, copy=False).sum(0).astype(object)
                count[c] += len(mine)
        if not count.any():
            return
        full = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": np.repeat(full, dim).astype(np.int32), "d": np.tile(np.arange(dim, dtype=np.int32), len(full)), "total": [str(v) for c in full for v in total[c]], "n": np.repeat(count[full], dim)})

    return run


def _assigned(centroids: Broadcast, dim: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at, far = nearest(_rows(frame, dim), centroids.value)
            yield pd.DataFrame({"id": frame["id"], "cluster": at.astype(np.int32), "far": [str(v) for v in far.tolist()]})

    return run


def seeds(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose `seed:vec_id` has the smallest sha256, in that order; rows that repeat an id by their vectors, those without one last."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.x) for r in kept.select(h.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).select("x").collect()]


def cluster_report(vectors: DataFrame, *, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, scale: float = 256.0) -> DataFrame:
    """Each vector of vectors(vec_id, embedding) with its cluster after `rounds` rounds of Lloyd's algorithm.

    Columns: vec_id, cluster, distance (squared), cluster_inertia and inertia (its sums over the cluster
    and over all), centroid_sha256 (of the centroid's components). A round assigns each vector to its
    nearest centroid (ties: the smaller number) and then moves each centroid that has vectors to
    floor(sum / count) of them; vectors are assigned once more at the end.

    Left out: vectors that are null, haven't exactly dim components, or hold a null or non-finite one, or one of
    2^59 or more when scaled. Repeated rows and rows without vec_id are vectors like others. Fewer than k vectors are
    fewer centroids; none give no rows. distance, cluster_inertia and inertia are null where a long can't hold them.
    """
    spark = vectors.sparkSession
    kept = stored(integer_vectors(vectors.where(F.size("embedding") == dim), scale, MOST), "vectors")
    centroids = seeds(kept, k, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centroids)
        part = kept.select("x").mapInPandas(_sums(sent, dim), "cluster int, d int, total string, n long")
        sums = part.groupBy("cluster", "d").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        for r in sums.collect():  # k times dim rows, however many vectors
            centroids[r.cluster][r.d] = int(r.total) // r.n
        sent.unpersist()
    sent = spark.sparkContext.broadcast(centroids)
    named = kept.select(F.col("vec_id").cast("string").alias("id"), "x")  # pandas would turn longs beside nulls into doubles
    found = stored(named.mapInPandas(_assigned(sent, dim), "id string, cluster int, far string").select(F.col("id").cast("long").alias("vec_id"), "cluster", F.col("far").cast("decimal(38,0)").alias("far")), "assigned")
    by_cluster = found.groupBy("cluster").agg(F.try_sum("far").alias("_own")).collect()  # k rows
    long = lambda v: v if v is not None and v < 1 << 63 else None
    sums = {r.cluster: long(None if r._own is None else int(r._own)) for r in by_cluster}
    total = sum(int(r._own) for r in by_cluster) if all(r._own is not None for r in by_cluster) else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, sums.get(c), long(total), digest[c]) for c in range(len(centroids))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", F.expr("try_cast(far as bigint)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
