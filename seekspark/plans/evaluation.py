"""Evaluation of configurations over datasets in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.operators.metrics import AGENT_DEPTH, SEARCH_DEPTH, hit_metrics, nearest_rank, per_query, ranks_of
from seekspark.plans.variants import SearchConfig


def evaluate(configs: list[SearchConfig], truth: DataFrame, predict: Callable[[SearchConfig], DataFrame]) -> DataFrame:
    """A row for each configuration and dataset, and for all datasets together (dataset null).

    truth(query_id, dataset, answer_id); predict(config) gives (query_id, id, rank).
    Search results count to rank 10, an agent's answers to rank 5.
    """
    parts = []
    for c in configs:
        depth = AGENT_DEPTH if c.agent else SEARCH_DEPTH
        parts.append(ranks_of(predict(c), truth, depth).select(F.lit(c.experiment).alias("experiment"), F.lit(c.name).alias("name"), "dataset", "query_id", "rank"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    sets = rows.groupBy("experiment", "name", "dataset").agg(F.count("*").alias("n"), *hit_metrics())
    total = rows.groupBy("experiment", "name").agg(F.count("*").alias("n"), *hit_metrics()).withColumn("dataset", F.lit(None).cast("string"))
    return sets.unionByName(total)


def latency_and_cost(results: DataFrame, *, agent: bool) -> DataFrame:
    """p95_latency_ms and cost_per_query_usd by dataset; an agent's latency is that of a request, a search's that of a query."""
    costs = results.groupBy("dataset").agg(per_query("cost_usd").alias("cost_per_query_usd"))
    times = results.select("dataset", F.explode("request_latencies_ms").alias("latency_ms")) if agent else results.select("dataset", "latency_ms")
    return costs.join(times.groupBy("dataset").agg(nearest_rank("latency_ms", 95).alias("p95_latency_ms")), "dataset", "left")
