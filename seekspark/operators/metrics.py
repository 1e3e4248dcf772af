"""Retrieval metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.functions.text import tokens
from seekspark.operators.index import BROADCAST_TERMS, Index, asked, build, read_blocks
from seekspark.sources.shared import materialised, spread

# The metrics that every report has, and how many ranks count.
SEARCH_DEPTH, AGENT_DEPTH = 10, 5


def ranks_of(predictions: DataFrame, truth: DataFrame, depth: int = SEARCH_DEPTH) -> DataFrame:
    """truth(query_id, answer_id) with the answer's rank in predictions(query_id, id, rank); null beyond depth."""
    found = predictions.where(F.col("rank") <= depth).select("query_id", F.col("id").alias("answer_id"), "rank")
    return truth.join(found, ["query_id", "answer_id"], "left")


#: Passages (those without an inner word, or all where there is no index) that one pass over the documents looks for, and characters of all of them up to which no index is made.
SHORT_PASSAGES, SCANNED_CHARS = 10_000, 1 << 22


def containing(docs: DataFrame, passages: DataFrame, index: Index | None = None, *, key: str = "doc_id", passage_key: str = "query_id") -> DataFrame:
    """(passage_key, key): docs(key, text) whose text contains that of passages(passage_key, text).

    A text that contains a passage has the passage's inner words (but the first and last,
    which may be parts of words there). Of each passage the rarest inner word is looked up in the
    index of docs by words, and the documents that have it are compared whole. Passages without an inner
    word are looked for in all documents, many in one pass. Without an index, one pass looks for all passages
    (SHORT_PASSAGES and SCANNED_CHARS at most; for more an index is made here). Empty and null passages are in nothing.
    """
    words = tokens(F.col("text"))
    cut = passages.where("text != ''").select(passage_key, F.col("text").alias("_passage"), F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))).alias("_inner"))
    own = index if index is not None and index.tokenizer == "word" else None
    if own is None:
        n, chars = cut.agg(F.count("*"), F.coalesce(F.sum(F.length("_passage")), F.lit(0))).first()
        if n <= SHORT_PASSAGES and chars <= SCANNED_CHARS:
            return _walked(docs, F.broadcast(cut.select(passage_key, "_passage")), key, passage_key)
        own = build(docs, key)
    inner = cut.where(F.size("_inner") > 0).select(passage_key, F.array_join(F.array_distinct("_inner"), " ").alias("text"))
    terms = asked(own, inner, passage_key)
    rarest = terms.rows.groupBy(passage_key).agg(F.count("*").alias("_found"), F.min_by("term", F.struct("df", "term")).alias("term"))
    # A passage with an inner word that no document has is in none.
    rarest = inner.select(passage_key, F.size(F.split("text", " ")).alias("_asked")).join(rarest, passage_key).where("_asked = _found").select(passage_key, "term")
    n = rarest.limit(BROADCAST_TERMS + 1).count()
    met = read_blocks(own, terms).join(F.broadcast(rarest) if n <= BROADCAST_TERMS else rarest, "term").select(passage_key, F.explode("posts.key").alias(key))
    found = met.join(cut.select(passage_key, "_passage"), passage_key).join(docs.select(key, "text"), key).where(F.contains("text", F.col("_passage"))).select(passage_key, key)
    short = cut.where(F.size("_inner") == 0).select(passage_key, "_passage")
    k = short.count()
    if not k:
        return found
    parts = -(-k // SHORT_PASSAGES)
    short = materialised(short.withColumn("_part", F.pmod(F.xxhash64("_passage"), F.lit(parts))), "short")
    for part in range(parts):
        found = found.unionAll(_walked(docs, short.where(F.col("_part") == part), key, passage_key))
    return found


def _walked(docs: DataFrame, passages: DataFrame, key: str, passage_key: str) -> DataFrame:
    """(passage_key, key) of passages(passage_key, _passage), about SHORT_PASSAGES, looked for in every document."""
    texts = [r[0] for r in passages.select("_passage").distinct().collect()]
    hits = spread(docs.select(key, "text")).mapInArrow(_with_any(texts), T.StructType([docs.schema[key], T.StructField("_passage", T.StringType())]))
    return hits.join(passages, "_passage").select(passage_key, key)


def _with_any(texts: list[str]):
    """Rows (key, text) to (key, passage) for each of the texts that the text contains: one walk through it for all, by a trie with links back."""

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        trie = ahocorasick.Automaton()
        for t in texts:
            trie.add_word(t, t)
        trie.make_automaton()
        for batch in batches:
            keys, found = [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                own = {t for _, t in trie.iter(text)} if text and texts else ()
                keys += [at] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(found, pa.string())], names=[batch.schema.names[0], "_passage"])

    return run


def hit_metrics(rank: Column | str = "rank") -> list[Column]:
    """recall_at_1, recall_at_5 and mrr of a group; a missing rank counts 0, no row gives 0."""
    r = F.col(rank) if isinstance(rank, str) else rank
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [mean(flag(r == 1)).alias("recall_at_1"), mean(flag(r <= 5)).alias("recall_at_5"), mean(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr")]


def metrics_by_dataset(results: DataFrame, dataset: str = "dataset") -> DataFrame:
    """A row for each dataset and one for all (dataset null), with how many queries."""
    return results.rollup(dataset).agg(F.count("*").alias("n"), *hit_metrics())


def nearest_rank(value: str, percent: float) -> Column:
    """Nearest-rank percentile of a group: an observed value; 0 for no rows."""
    return F.coalesce(F.expr(f"percentile_disc({percent / 100}) within group (order by {value})"), F.lit(0))


def clarify_metrics(turns: str = "turns", rank: str = "rank") -> list[Column]:
    """Share of first ranks among the queries that were asked (null if none), and questions a query."""
    asked = F.when(F.col(turns) > 0, F.when(F.col(rank) == 1, 1.0).otherwise(0.0))
    return [F.avg(asked).alias("clarify_success"), F.coalesce(F.avg(F.col(turns).cast("double")), F.lit(0.0)).alias("avg_clarify")]


def per_query(total: str) -> Column:
    """A sum by the number of rows, 0 for none."""
    return F.coalesce(F.sum(total), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))


def call_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls(model, input_tokens, output_tokens) with cost_usd by prices(model, usd_in, usd_out) a million tokens; 0 for a model without a price."""
    priced = calls.join(F.broadcast(prices), "model", "left")  # a price list
    return priced.withColumn("cost_usd", F.coalesce((F.col("input_tokens") * F.col("usd_in") + F.col("output_tokens") * F.col("usd_out")) / 1e6, F.lit(0.0))).drop("usd_in", "usd_out")


def run_counters(calls: DataFrame) -> DataFrame:
    """One row of a run: ok, failed, tokens, cost, failure rate."""
    failed = F.count_if(F.col("error").isNotNull())
    return calls.agg(F.count_if(F.col("error").isNull()).alias("ok"), failed.alias("failed"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), (failed / F.greatest(F.count("*"), F.lit(1))).alias("failure_rate"))


def online_accuracy(feedback: DataFrame) -> DataFrame:
    """Share of results that users confirmed, and of how many."""
    return feedback.agg(F.avg(F.when(F.col("is_correct"), 1.0).otherwise(0.0)).alias("accuracy"), F.count("is_correct").alias("n"))
