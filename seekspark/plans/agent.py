"""The question loop, for all queries at once: retrieve, verify, answer or ask, until every query is decided."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.functions.text import thumb_key, thumb_url
from seekspark.operators.clarify import MAX_TURNS, apply_answer, choose, should_ask, simulated_answer
from seekspark.operators.filters import ATTRIBUTES, attribute_value
from seekspark.operators.rank import confidence, rerank
from seekspark.sources.shared import materialised

ANSWERS = 5

#: queries(query_id, filters map) to candidates(query_id, movie_id, score, rank, decade, country, genres, is_animation).
Retriever = Callable[[DataFrame], DataFrame]
#: candidates to verified(query_id, movie_id, pos, score, reason).
Verifier = Callable[[DataFrame], DataFrame]


def decide(candidates: DataFrame, verified: DataFrame, state: DataFrame) -> DataFrame:
    """(query_id, confidence, attr, options, ask) for state(query_id, turns, asked)."""
    order = rerank(candidates, verified)
    sure = state.select("query_id", "turns", "asked").join(confidence(order), "query_id", "left")
    items = order.select("query_id", F.col("new_rank").alias("rank"), F.col("verified").alias("weight"), "decade", "country", "genres", "is_animation")
    question = choose(items, state.select("query_id", "asked"))
    ask = should_ask(F.coalesce("confidence", F.lit(0.0)), F.col("turns"), F.col("entropy"))
    return sure.join(question, "query_id", "left").select("query_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "attr", "options", F.coalesce(ask, F.lit(False)).alias("ask"))


def answers(order: DataFrame, movies: DataFrame | None = None, scenes: DataFrame | None = None, *, base: str | None = None, n: int = ANSWERS) -> DataFrame:
    """The best n of each query. With movies and scenes: title, year, poster, score, reason, and each evidence scene with its picture's address and caption.

    order has evidence(array of scene ids), verified and reason; movies(id, title_ko, year,
    poster_url), scenes(id, caption_ko). A movie that isn't in the catalogue has nulls, an
    unverified one the score 0 and no reason; evidence keeps its order.
    """
    best = order.where(F.col("new_rank") <= n)
    if movies is None or scenes is None:
        return best
    shown = best.select("query_id", "movie_id", "new_rank", F.posexplode_outer("evidence").alias("pos", "scene_id"))
    shown = shown.join(scenes.select(F.col("id").alias("scene_id"), "caption_ko"), "scene_id", "left")
    one = F.struct("pos", "scene_id", thumb_url(base, thumb_key(F.col("scene_id"))).alias("thumb_url"), F.coalesce("caption_ko", F.lit("")).alias("caption_ko"))
    listed = shown.groupBy("query_id", "movie_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("scene_id").isNotNull(), one))), lambda x: x.dropFields("pos")).alias("evidence"))
    info = movies.select(F.col("id").alias("movie_id"), "title_ko", "year", "poster_url")
    out = best.drop("evidence").join(listed, ["query_id", "movie_id"]).join(info, "movie_id", "left")
    return out.select("query_id", F.col("new_rank").alias("rank"), "movie_id", "title_ko", "year", "poster_url", F.col("verified").alias("score"), F.coalesce("reason", F.lit("")).alias("reason"), "evidence")


def run(queries: DataFrame, retrieve: Retriever, verify: Verifier, truth: DataFrame, *, max_turns: int = MAX_TURNS, save: Callable[[DataFrame], DataFrame] = materialised) -> tuple[DataFrame, DataFrame]:
    """Final candidates, and state(query_id, turns, filters, confidence), of queries(query_id).

    The simulated user answers from truth(query_id, decade, country, genres, is_animation).
    Each round works on the queries that are still open; there are max_turns + 1 at most.
    save materialises a round's state.
    """
    state = queries.select("query_id", F.expr("cast(map() as map<string,string>)").alias("filters"), F.expr("cast(array() as array<string>)").alias("asked"), F.lit(0).alias("turns"))
    decided, results = None, None
    for turn in range(max_turns + 1):
        candidates = save(retrieve(state.select("query_id", "filters")))
        verified = save(verify(candidates))
        step = save(state.join(decide(candidates, verified, state), "query_id"))
        closing = ~F.col("ask") if turn < max_turns else F.lit(True)
        done = step.where(closing).select("query_id", "turns", "filters", "confidence")
        final = save(rerank(candidates, verified)).join(done.select("query_id"), "query_id", "left_semi")
        decided = done if decided is None else decided.unionByName(done)
        results = final if results is None else results.unionByName(final)
        if turn == max_turns:
            break
        value = F.coalesce(*(F.when(F.col("attr") == a, attribute_value(a)) for a in ATTRIBUTES))
        answered = step.where("ask").join(truth, "query_id", "left").withColumn("value", simulated_answer(value, F.col("options")))
        state = save(answered.select("query_id", apply_answer(F.col("filters"), F.col("attr"), F.col("value"), F.col("options")).alias("filters"), F.array_append("asked", F.col("attr")).alias("asked"), (F.col("turns") + 1).alias("turns")))
        if state.isEmpty():
            break
    return results, decided
