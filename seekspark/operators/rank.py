"""From scene hits to ranked movies, verification scores and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from seekspark.operators.common import ranked
from seekspark.operators.filters import any_soft_match

W_SECOND, W_PLOT, BOOST, TOP_MOVIES, EVIDENCE = 0.3, 0.5, 1.1, 20, 3
#: Weight of the best score, of the lead over the second, and the lead that counts in full.
W_BEST, W_LEAD, FULL_LEAD = 0.6, 0.4, 0.3


def aggregate(scenes: DataFrame, plots: DataFrame, soft_filters: DataFrame | None = None, attrs: DataFrame | None = None, *, w_second: float = W_SECOND, w_plot: float = W_PLOT, boost: float = BOOST, top: int = TOP_MOVIES) -> DataFrame:
    """Movie candidates of each query from scenes(query_id, movie_id, scene_id, score) and plots(query_id, movie_id, score).

    score = (s1 + w_second s2 + w_plot plot), times boost once if any soft filter of the
    query (query_id, filters map) matches the movie's attrs. Evidence is the three best
    scenes. Ties go to the smaller movie_id.
    """
    order = W.Window.partitionBy("query_id", "movie_id").orderBy(F.desc(F.round("score", 9)), "scene_id")
    by_movie = (
        scenes.withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= EVIDENCE)
        .groupBy("query_id", "movie_id")
        .agg(F.max(F.when(F.col("r") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("s2"), F.transform(F.array_sort(F.collect_list(F.struct("r", "scene_id"))), lambda x: x["scene_id"]).alias("evidence"))
    )
    plot = plots.groupBy("query_id", "movie_id").agg(F.max("score").alias("plot"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = by_movie.join(plot, ["query_id", "movie_id"], "full_outer").select("query_id", "movie_id", zero("s1").alias("s1"), zero("s2").alias("s2"), zero("plot").alias("plot_score"), F.coalesce("evidence", F.array().cast(by_movie.schema["evidence"].dataType)).alias("evidence"))
    boosted = F.lit(False)
    if soft_filters is not None and attrs is not None:
        both = both.join(attrs, "movie_id", "left").join(soft_filters, "query_id", "left")
        boosted = any_soft_match(F.col("filters"))
    base = F.col("s1") + w_second * F.col("s2") + w_plot * F.col("plot_score")
    out = both.withColumn("boosted", boosted).withColumn("score", F.when(F.col("boosted"), base * boost).otherwise(base))
    return ranked(out, ["query_id"], "score", "movie_id", limit=top).select("query_id", "movie_id", "score", "s1", "s2", "plot_score", "boosted", "evidence", "rank")


def clamped(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def rerank(candidates: DataFrame, verified: DataFrame) -> DataFrame:
    """candidates(query_id, movie_id, rank) in the order of verified(query_id, movie_id, pos, score, reason).

    Scores are clamped to [0, 1]; a movie that wasn't verified has 0, one that isn't a
    candidate is ignored, of repeated ones the last counts; ties keep their order.
    """
    last = verified.groupBy("query_id", "movie_id").agg(F.max_by(F.struct("score", "reason"), "pos").alias("v"))
    joined = candidates.join(last, ["query_id", "movie_id"], "left").select(*candidates.columns, clamped(F.coalesce("v.score", F.lit(0.0))).alias("verified"), F.col("v.reason").alias("reason"))
    return ranked(joined, ["query_id"], "verified", "rank", name="new_rank")


def confidence(reranked: DataFrame, *, score: str = "verified", rank: str = "new_rank") -> DataFrame:
    """(query_id, confidence) from the two best scores; a single one has no rival."""
    best = reranked.groupBy("query_id").agg(F.max(F.when(F.col(rank) == 1, clamped(F.col(score)))).alias("v1"), F.max(F.when(F.col(rank) == 2, clamped(F.col(score)))).alias("v2"))
    v1, v2 = F.coalesce("v1", F.lit(0.0)), F.coalesce("v2", F.lit(0.0))
    return best.select("query_id", clamped(W_BEST * v1 + W_LEAD * F.least(F.lit(1.0), F.greatest(v1 - v2, F.lit(0.0)) / FULL_LEAD)).alias("confidence"))
