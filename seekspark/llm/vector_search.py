"""Exact top-k inner products with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. Sorted by that key the
vectors are cut into blocks, each an annulus [lo, hi] around its pivot. For a query at
distance s from the pivot the triangle inequality keeps every vector of the block at
least max(0, s - hi, lo - s) away, and |q - v|^2 = |q|^2 + |v|^2 - 2 q.v turns that into
an upper bound of the inner product. Queries first visit the annulus with the best
bound, and then expand only to annuli whose bound reaches their k-th score. Queries are
sent to groups of annuli, so that what is shuffled is a query for each group, and a task
streams them past the annuli of one group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from seekspark.llm.common import stored

PIVOTS, SAMPLE, BLOCK_ROWS, MOST_BLOCKS, QUERY_ROWS = 32, 2048, 1024, 65_536, 256
#: Annuli of a group at most, and groups from which they have more than one.
GROUP, GROUPS = 64, 64
#: Bounds worked out at once, groups of a batch of visits, and scores that are held before they are cut to the best.
BOUNDS, VISITS, HITS = 1 << 20, 32, 1 << 18
#: Stands for a k-th score that isn't known.
NO_SCORE = -(2**63)


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice from the sample."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T))


def _matrix(column: pa.Array, scale: float, dim: int) -> np.ndarray:
    """floor(scale * x) of each vector as float64; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _assign(pivots: np.ndarray, scale: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), scale, pivots.shape[1])
            d = _distances(x, pivots)
            cell = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())], names=["vec_id", "cell", "dist", "vec"])

    return run


def _cut(rows: int, kind: str):
    """Sorted vectors to blocks of one cell each, numbered in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bid, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= 2 * rows:
                yield _block(held.slice(0, n := _same_cell(held, rows)), bid, kind)
                held, bid = held.slice(n), bid + 1
        while held is not None and held.num_rows:
            yield _block(held.slice(0, n := _same_cell(held, rows)), bid, kind)
            held, bid = held.slice(n), bid + 1

    return run


def _same_cell(t: pa.Table, rows: int) -> int:
    cell = t.column("cell").slice(0, rows).to_numpy()
    return int((cell == cell[0]).sum())


def _block(t: pa.Table, bid: int, kind: str) -> pa.RecordBatch:
    vec = b"".join(t.column("vec").to_pylist())
    x = np.frombuffer(vec, kind).reshape(t.num_rows, -1).astype(np.float64)
    dist = t.column("dist").to_numpy()
    ids = t.column("vec_id").to_numpy().astype(np.int64).tobytes()
    return pa.RecordBatch.from_pydict({"bid": pa.array([bid], pa.int64()), "cell": pa.array([t.column("cell")[0].as_py()], pa.int32()), "lo": [float(dist.min())], "hi": [float(dist.max())], "norm": [float((x**2).sum(1).max())], "ids": pa.array([ids], pa.binary()), "vecs": pa.array([vec], pa.binary())})


def _visits(shared, first: bool, size: int, kind: str):
    """Query rows (vec_id, vec, tau) to a row for each group with an annulus to visit: the queries, their k-th scores, and a bit for each query and annulus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cell, lo, hi, norm = shared.value
        groups = -(-len(cell) // size)
        step = max(1, BOUNDS // len(cell))
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                b = batch.slice(at, QUERY_ROWS)
                ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                q = np.frombuffer(b"".join(b.column(1).to_pylist()), kind).reshape(len(ids), -1)
                tau = b.column(2).fill_null(NO_SCORE).to_numpy(zero_copy_only=False)
                go = np.zeros((len(ids), groups * size), bool)
                for i in range(0, len(ids), step):
                    x = q[i : i + step].astype(np.float64)
                    own = (x**2).sum(1)[:, None]
                    s = _distances(x, pivots)[:, cell]
                    # Distances are rounded in proportion to the vectors' lengths, bounds to their squares.
                    gap = np.maximum(0, np.maximum(s - hi, lo - s) - 1e-6 * (1 + s + np.sqrt(own) + np.sqrt(norm)))
                    bound = (own + norm - gap**2) / 2
                    best = bound.argmax(1)
                    if not first:
                        limit = tau[i : i + step, None]
                        go[i : i + step, : len(cell)] = (limit == NO_SCORE) | (bound + 1e-9 * (own + norm) + 1 >= limit)
                    go[np.arange(i, i + len(x)), best] = first
                bits = np.packbits(go.reshape(len(ids), groups, size), axis=2)
                to = np.flatnonzero(bits.any((0, 2)))
                for some in np.split(to, range(VISITS, len(to), VISITS)):
                    out = []
                    for g in some:
                        rows = bits[:, g].any(1)
                        out.append((ids[rows].tobytes(), q[rows].tobytes(), tau[rows].tobytes(), bits[rows, g].tobytes()))
                    columns = [pa.array(c, pa.binary()) for c in zip(*out, strict=True)] or [pa.array([], pa.binary())] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), size, np.int32)), *columns], names=["grp", "at", "ids", "vecs", "tau", "bits"])

    return run


def _first(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k best."""
    order = np.lexsort((ids, -score, row))
    order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
    return row[order], ids[order], score[order]


def _best(k: int, dim: int, size: int, kind: str, work: str):
    """Rows of groups, a group's annuli before the queries that visit it, to each query's k best of the group. Holds one group's annuli."""
    lowest = np.iinfo(work).min if work == "int64" else -np.inf

    def found(held: dict, q_id: np.ndarray, q: np.ndarray, tau: np.ndarray, go: np.ndarray):
        """(row, vec_id, score) of all that reach a query's k-th score, cut to its k best."""
        hits, n = [], 0
        for j, (v_id, v) in held.items():
            rows = np.flatnonzero(go[:, j])
            if not len(rows):
                continue
            score = q[rows] @ v.T
            limit = tau[rows].astype(work)
            free = np.flatnonzero(tau[rows] == NO_SCORE)
            if len(free):
                own = np.where(q_id[rows[free], None] == v_id, lowest, score[free])
                limit[free] = np.partition(own, len(v_id) - k, 1)[:, len(v_id) - k] if len(v_id) > k else lowest
            r, c = np.nonzero(score >= limit[:, None])
            other = v_id[c] != q_id[rows[r]]
            r, c = r[other], c[other]
            hits.append((rows[r], v_id[c], score[r, c].astype(np.int64)))
            n += len(r)
            if n > HITS:
                hits = [_first(*map(np.concatenate, zip(*hits, strict=True)), k)]
                n = len(hits[0][0])
        return _first(*map(np.concatenate, zip(*hits, strict=True)), k) if hits else (np.zeros(0, np.int64),) * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for b in batches:
            for grp, at, ids, vecs, tau, bits in zip(*b.columns, strict=True):
                if grp.as_py() != group:
                    group, held = grp.as_py(), {}
                x = np.frombuffer(vecs.as_buffer(), kind).reshape(-1, dim).astype(work)
                own = np.frombuffer(ids.as_buffer(), np.int64)
                if at.as_py() < size:
                    held[at.as_py()] = own.copy(), x
                    continue
                go = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8).reshape(len(own), -1), axis=1)
                row, to, score = found(held, own, x, np.frombuffer(tau.as_buffer(), np.int64), go)
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(to), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: float = 256.0, pivots: int = PIVOTS, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each row of vectors(vec_id, embedding) with is_query its k best others: query_id, rank, vec_id, score.

    Scores are integer inner products of floor(scale * x); ties go to the smaller vec_id.
    Vectors (and ids) that are null, empty, or hold a null or non-finite component take
    no part, nor do those with a component so large that a score could leave a long (scaled, the
    root of 2^63 / dimensions: above 2^28 for 64); a shorter vector counts as ending in zeros. Rows that share a query's
    vec_id are its own and aren't candidates; of several query rows with one id the vector with
    the least bytes (little-endian integers) stands. Pivots come from `sample` vectors; the
    index holds every vector, so the result doesn't depend on them.
    """
    spark = vectors.sparkSession
    fine = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("_query"))
    dim = fine.agg(F.max(F.size("embedding"))).first()[0] or 1
    most = math.isqrt(((1 << 63) - 1) // dim)
    fine = fine.where(F.forall("embedding", lambda x: F.abs(x * scale) < most))
    n, top = fine.agg(F.count("*"), F.max(F.array_max(F.transform("embedding", lambda x: F.abs(F.floor(x * scale)))))).first()
    # The narrowest integers that hold all components, and the fastest numbers that hold all scores exactly.
    kind = next(t for t in ("int16", "int32", "int64") if (top or 0) <= np.iinfo(t).max)
    reach = (top or 0) ** 2 * dim
    work = "float32" if reach < 1 << 24 else "float64" if reach < 1 << 53 else "int64"
    picked = fine.orderBy(F.xxhash64("vec_id")).limit(sample).select("embedding").toArrow().column(0)
    piv = _pivots(_matrix(picked, scale, dim), pivots)
    keyed = fine.select("vec_id", "embedding").mapInArrow(_assign(piv, scale, kind), "vec_id long, cell int, dist double, vec binary")
    rows = max(block_rows, -(-n // MOST_BLOCKS))
    parts = max(1, min(n // (4 * rows) + 1, 4096))
    index = stored(keyed.repartitionByRange(parts, "cell", "dist", "vec_id").sortWithinPartitions("cell", "dist", "vec_id").mapInArrow(_cut(rows, kind), "bid long, cell int, lo double, hi double, norm double, ids binary, vecs binary"), "annuli")
    annuli = index.select("bid", "cell", "lo", "hi", "norm").toArrow().sort_by("bid")  # MOST_BLOCKS, and one more for each cell and partition, at most
    asking = fine.where("_query").select("vec_id", "embedding").mapInArrow(_assign(piv, scale, kind), "vec_id long, cell int, dist double, vec binary")
    queries = stored(asking.repartition(max(1, min(64, n // 4096)), "vec_id").groupBy("vec_id").agg(F.min("vec").alias("vec")), "queries")
    if not annuli.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Neighbouring annuli are a group, which is a task's work: at least GROUPS of them, each of GROUP annuli at most. A query is sent to a group once.
    size = max(1, min(GROUP, annuli.num_rows // GROUPS))
    groups = -(-annuli.num_rows // size)
    shared = spark.sparkContext.broadcast((piv, *(annuli.column(c).to_numpy() for c in ("cell", "lo", "hi", "norm"))))
    at = np.arange(annuli.num_rows, dtype=np.int32)
    places = spark.createDataFrame(pa.table({"bid": annuli.column("bid"), "grp": at // size, "at": at % size}))
    held = index.join(F.broadcast(places), "bid").select("grp", "at", "ids", "vecs", F.lit(None).cast("binary").alias("tau"), F.lit(None).cast("binary").alias("bits"))

    def visit(q: DataFrame, first: bool) -> DataFrame:
        to = q.mapInArrow(_visits(shared, first, size, kind), "grp int, at int, ids binary, vecs binary, tau binary, bits binary")
        met = held.union(to).repartition(min(groups, 4096), "grp").sortWithinPartitions("grp", "at")
        return met.mapInArrow(_best(k, dim, size, kind, work), "query_id long, vec_id long, score long")

    seed = stored(visit(queries.withColumn("tau", F.lit(None).cast("long")), True), "seed")
    kth = seed.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(F.col("query_id").alias("vec_id"), F.try_element_at("s", F.lit(k)).alias("tau"))
    rest = visit(queries.join(kth, "vec_id", "left").select("vec_id", "vec", "tau"), False)
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return seed.union(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
