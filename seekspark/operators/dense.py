"""Cosine search over array columns: a readable form, and a block form for bulk scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from seekspark.operators.common import ranked

BRANCH_LIMIT = 50
#: Queries that are sent to every executor at once; more go in blocks. Scores that a task holds at once (8 MB).
QUERY_BLOCK, TILE = 4096, 1 << 20


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def shortened(vector: Column, dim: int) -> Column:
    """The first dim components, scaled to length 1."""
    head = F.transform(F.slice(vector, 1, dim), lambda x: x.cast("double"))
    norm = F.sqrt(inner(head, head))
    return F.transform(head, lambda x: F.try_divide(x, norm))


def _best(queries: np.ndarray, ids: np.ndarray, limit: int):
    """Vectors to each query's best of a batch, so that a batch gives limit rows a query at most.

    Queries are scored in tiles; of a tile only the scores that reach a query's limit are sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.asarray(b.column(1).flatten(), dtype=np.float64).reshape(b.num_rows, -1)
            norm = np.linalg.norm(v, axis=1)
            v = v / np.where(norm, norm, 1)[:, None]
            key = np.asarray(b.column(0), dtype=np.int64)
            tile = max(1, TILE // b.num_rows)
            for q in range(0, len(ids), tile):
                s = np.round(queries[q : q + tile] @ v.T, 9)
                if limit < s.shape[1]:
                    row, at = np.nonzero(s >= -np.partition(-s, limit - 1, axis=1)[:, limit - 1 : limit])
                else:
                    row, at = np.divmod(np.arange(s.size), s.shape[1])
                order = np.lexsort((key[at], -s[row, at], row))
                row, at = row[order], at[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, at = row[place < limit], at[place < limit]
                yield pa.RecordBatch.from_arrays([pa.array(ids[q + row]), pa.array(key[at]), pa.array(s[row, at])], names=["query_id", "doc_id", "score"])

    return run


def _blocks(asked: DataFrame) -> Iterator[list[Row]]:
    """The queries (q, v) in blocks of about QUERY_BLOCK, each of vectors of one length."""
    rows = asked.limit(QUERY_BLOCK + 1).collect()
    if len(rows) <= QUERY_BLOCK:
        for n in sorted({len(r.v) for r in rows}):
            yield [r for r in rows if len(r.v) == n]
        return
    for n, count in asked.groupBy(F.size("v")).count().collect():  # the lengths that queries have
        parts = -(-count // QUERY_BLOCK)
        for k in range(parts):
            if rows := asked.where((F.size("v") == n) & (F.pmod(F.xxhash64("q"), F.lit(parts)) == k)).collect():
                yield rows


def dense_branch(vectors: DataFrame, queries: DataFrame, *, limit: int = BRANCH_LIMIT, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", keep: DataFrame | None = None, dim: int | None = None) -> DataFrame:
    """The best `limit` vectors of each query by cosine: query_key, key, score, rank.

    Queries (query_key, vector) go out in bounded blocks; each batch of vectors is scored
    by matrix products and keeps its best, so no pair leaves a task unranked. keep
    restricts the vectors (hard filters) before they are ranked. A query meets the vectors
    of its own length; null and empty vectors take no part.
    """
    cut = (lambda c: shortened(c, dim)) if dim else (lambda c: c.cast("array<double>"))
    asked = queries.where(F.size(vector) > 0).select(F.col(query_key).alias("q"), cut(F.col(vector)).alias("v"))
    candidates = vectors if keep is None else vectors.join(keep.select(key).distinct(), key, "left_semi")
    parts = []
    for rows in _blocks(asked):
        q = np.array([r.v for r in rows], np.float64)
        length = np.linalg.norm(q, axis=1)
        q /= np.where(length, length, 1)[:, None]
        batch = candidates.select(F.col(key).cast("long"), cut(F.col(vector)).alias("v")).where(F.size("v") == q.shape[1])
        parts.append(batch.mapInArrow(_best(q, np.array([r.q for r in rows], np.int64), limit), "query_id long, doc_id long, score double"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"{query_key} long, {key} long, score double, rank long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return ranked(out.select(F.col("query_id").alias(query_key), F.col("doc_id").alias(key), "score"), [query_key], "score", key, limit=limit)


def cosine_pairs(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """(query_key, key, score) of all queries with all vectors, by higher-order functions: the readable form that tests hold the block form against."""
    unit = lambda c: F.transform(c, lambda x: F.try_divide(x.cast("double"), F.sqrt(inner(c, c))))
    q = queries.select(query_key, unit(F.col(vector)).alias("_q"))
    v = vectors.select(key, unit(F.col(vector)).alias("_v"))
    return v.join(q).select(query_key, key, inner(F.col("_q"), F.col("_v")).alias("score"))
