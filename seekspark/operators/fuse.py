"""Reciprocal-rank fusion of branches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.operators.common import ranked

MODES = {"hybrid": ("dense", "sparse"), "dense": ("dense",), "sparse": ("sparse",)}


def fuse(branches: list[DataFrame], *, limit: int, query_key: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Sum of 1 / (1 + rank) over the branches that have the document: query_key, key, score, rank.

    Scores are made of ranks only, with one branch too; without a branch there is no row.
    """
    rows = reduce(DataFrame.unionAll, [b.select(query_key, key, "rank") for b in branches])
    scored = rows.groupBy(query_key, key).agg(F.sum(F.lit(1.0) / (1 + F.col("rank"))).alias("score"))
    return ranked(scored, [query_key], "score", key, limit=limit)


def branches_of(mode: str, available: dict[str, DataFrame]) -> list[DataFrame]:
    """The branches that a mode uses; a sparse branch without tokens simply has no rows."""
    if mode not in MODES:
        raise ValueError(f"no search mode {mode}")
    return [available[name] for name in MODES[mode]]
