"""Inverted index with BM25 weights: built once, stored in directories by term, searched with upper bounds.

A stored index has four tables in one folder. `documents` holds each document's length and its
counted terms. `blocks` holds the postings: up to BLOCK of one term in a row, heaviest first,
with the largest weight in it, in a directory for each bucket of term hashes. `terms` holds each
term's document frequency and largest weight, in the same directories. `stats` is one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from seekspark.functions import dictionary as _dictionary  # noqa: F401  its tokenizer is one of TOKENIZERS
from seekspark.functions.text import TOKENIZERS, Tokenizer
from seekspark.operators.common import let, ranked
from seekspark.sources.shared import made_folder, materialised, spread

K1, B = 1.2, 0.75
BRANCH_LIMIT = 50
#: Distinct terms of queries (with their query) up to which they are sent to every executor; more are shuffled.
BROADCAST_TERMS = 200_000
#: Postings of a block, tokens for which there is a further bucket, and buckets at least and at most.
BLOCK, BUCKET_TOKENS, FEWEST, MOST = 128, 200_000, 16, 4096
#: Documents of which one task sorts the postings of a term: a hash deals them, so a list has about as many at most.
SALT_DOCS = 1 << 18
#: Pairs of a query and a posting up to which all are added up; beyond that bounds are worked out first.
DIRECT_PAIRS = 1 << 22
#: Postings of each query's heaviest terms from which the first bound is taken, times the limit.
SEED = 20
#: Scores are rounded to nine digits before they are ranked; what a bound may be short of by then.
SLACK = 1e-8


@dataclass(frozen=True)
class Index:
    """A stored collection: its tables (see the module), n_docs (with those that have no token), the average length, and how it was cut."""

    documents: DataFrame
    blocks: DataFrame
    terms: DataFrame
    n_docs: int
    avgdl: float
    buckets: int
    key: str = "doc_id"
    tokenizer: str | Tokenizer = "word"
    path: str = ""

    @property
    def postings(self) -> DataFrame:
        """(key, term, tf, dl)"""
        return _exploded(self.documents, self.key)


def cut(tokenizer: str | Tokenizer, text: Column) -> Column:
    """The tokens of a text by a tokenizer or the name of one."""
    return (TOKENIZERS[tokenizer] if isinstance(tokenizer, str) else tokenizer)(text)


def counted(tokens: Column) -> Column:
    """array<struct<term, tf>> of an array of tokens: sorted, and each run of equal ones counted. A row's terms never leave it."""

    def runs(sorted_: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: (i == 0) | (F.get(sorted_, i) != F.get(sorted_, i - 1)))
        return let(starts, lambda st: F.transform(st, lambda b, j: F.struct(F.get(sorted_, b).alias("term"), (F.coalesce(F.get(st, j + 1), F.size(sorted_)) - b).cast("long").alias("tf"))))

    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs))


def forward(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | Tokenizer = "word") -> DataFrame:
    """(key, dl, terms): each document's length with repeated tokens, and its terms with their frequencies (null for none)."""
    made = let(cut(tokenizer, F.col(text)), lambda t: F.struct(F.size(t).cast("long").alias("dl"), counted(t).alias("terms")))
    return docs.select(key, made.alias("_made")).select(key, "_made.dl", "_made.terms")


def _exploded(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "dl", F.explode("terms").alias("x")).select(key, F.col("x.term").alias("term"), F.col("x.tf").alias("tf"), "dl")


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | Tokenizer = "word") -> DataFrame:
    """(key, term, tf, dl): term frequency, and the document's length with repeated tokens."""
    return _exploded(forward(docs, key, text, tokenizer), key)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | Tokenizer = "word", *, path: str | None = None, buckets: int | None = None) -> Index:
    """Tokenises the documents once and stores the index in a new folder (of the shared one, unless path names it).

    Postings are shuffled once, by bucket and by a hash of the document, so no task has all documents of a very frequent term.
    """
    spark = docs.sparkSession
    path = path or made_folder(spark, "index")
    made = forward(spread(docs.select(key, text)), key, text, tokenizer)
    made.write.parquet(f"{path}/documents")
    rows = spark.read.schema(made.schema).parquet(f"{path}/documents")
    stats = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
    buckets = buckets or max(FEWEST, min(MOST, stats.total // BUCKET_TOKENS))
    avgdl = stats.total / max(1, stats.n)
    salts = max(1, stats.n // SALT_DOCS)
    weighed = _exploded(rows, key).select(_bucket(F.col("term"), buckets).alias("bucket"), F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("salt"), "term", key, bm25_weight(F.col("tf"), F.col("dl"), F.lit(avgdl)).alias("weight"))
    posts = F.sort_array(F.collect_list(F.struct("weight", F.col(key).alias("key"))), asc=False)
    lists = weighed.repartition("bucket", "salt").groupBy("bucket", "salt", "term").agg(posts.alias("posts"))
    pieces = F.transform(F.sequence(F.lit(1), F.size("posts"), F.lit(BLOCK)), lambda i: F.slice("posts", i, F.lit(BLOCK)))
    blocks = lists.select("bucket", "term", F.explode(pieces).alias("posts")).select("bucket", "term", F.get("posts", F.lit(0))["weight"].alias("most"), F.size("posts").cast("long").alias("n"), "posts")
    blocks.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/blocks")
    terms = spark.read.schema("term string, most double, n long, bucket int").parquet(f"{path}/blocks").groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.max("most").alias("most"))
    terms.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/terms")
    spark.range(1).coalesce(1).select(F.lit(stats.n).alias("n_docs"), F.lit(avgdl).cast("double").alias("avgdl"), F.lit(buckets).alias("buckets"), F.lit(key).alias("key")).write.parquet(f"{path}/stats")
    return opened(spark, path, tokenizer)


def opened(spark: SparkSession, path: str, tokenizer: str | Tokenizer = "word") -> Index:
    """The index stored at path; its queries have to be cut as its documents were."""
    s = spark.read.parquet(f"{path}/stats").first()
    documents = spark.read.parquet(f"{path}/documents")
    post = f"array<struct<weight:double,key:{documents.schema[s.key].dataType.simpleString()}>>"
    blocks = spark.read.schema(f"term string, most double, n long, posts {post}, bucket int").parquet(f"{path}/blocks")
    terms = spark.read.schema("term string, df long, most double, bucket int").parquet(f"{path}/terms")
    return Index(documents, blocks, terms, s.n_docs, s.avgdl, s.buckets, s.key, tokenizer, path)


def statistics(docs: DataFrame, text: str = "text", tokenizer: str | Tokenizer = "word") -> DataFrame:
    """One row: n_docs and the average length (0 for no documents)."""
    dl = F.size(cut(tokenizer, F.col(text))).cast("long")
    total = docs.select(dl.alias("dl")).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
    return total.select("n_docs", (F.col("total").cast("double") / F.greatest("n_docs", F.lit(1))).alias("avgdl"))


def term_frequencies(docs: DataFrame, text: str = "text", tokenizer: str | Tokenizer = "word") -> DataFrame:
    """(term, df) of a collection that has no stored index: counted where the documents are read, so that a task sends each of its terms once."""
    return spread(docs.select(text)).select(F.explode(F.array_distinct(cut(tokenizer, F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def total_weights(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | Tokenizer = "word") -> DataFrame:
    """(key, n_terms, total): the number and the sum of each document's weights (see document_weights), for documents with a token.

    Nothing is stored or exploded: documents are cut once for the average length, and once for their weights.
    """
    avgdl = F.lit(statistics(docs, text, tokenizer).first().avgdl)
    weighed = F.aggregate("terms", F.lit(0.0), lambda total, x: total + bm25_weight(x["tf"], F.col("dl"), avgdl))
    rows = forward(spread(docs.select(key, text)), key, text, tokenizer).where(F.size("terms") > 0)
    return rows.select(key, F.size("terms").cast("long").alias("n_terms"), weighed.alias("total"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """(term, df) of postings, which have a row for each document and term. A stored index has them in its terms."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    """Robertson and Sparck Jones weight, kept above 0. Taken over the whole collection, whatever is filtered."""
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (F.lit(1.0) - b + b * dl / avgdl))


def document_weights(index: Index, key: str = "doc_id") -> DataFrame:
    """(key, term, weight): the sparse vector of each document, without the query-time idf."""
    return index.postings.select(key, "term", bm25_weight(F.col("tf"), F.col("dl"), F.lit(index.avgdl)).alias("weight"))


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "text", tokenizer: str | Tokenizer = "word") -> DataFrame:
    """(key, term): distinct terms, each of weight 1."""
    return queries.select(key, F.explode(F.array_distinct(cut(tokenizer, F.col(text)))).alias("term")).distinct()


# ---- search --------------------------------------------------------------------------


@dataclass(frozen=True)
class Asked:
    """The queries' terms that the index has: rows(query_key, term, df, idf, ub), how many, and the buckets that hold them."""

    rows: DataFrame
    n: int
    pairs: int
    buckets: list[int]
    query_key: str

    def sent(self) -> DataFrame:
        return F.broadcast(self.rows) if self.n <= BROADCAST_TERMS else self.rows


def asked(index: Index, queries: DataFrame, query_key: str = "query_id", query_text: str = "text") -> Asked:
    """What the queries ask of the index. Of the stored terms only the directories of the queries' terms are read, however many terms there are."""
    own = query_terms(queries.where(F.col(query_key).isNotNull()), query_key, query_text, index.tokenizer).withColumn("bucket", _bucket(F.col("term"), index.buckets))
    own = materialised(own, "query_terms")
    found = own.groupBy("bucket").agg(F.count("*").alias("n")).collect()  # a row for each bucket at most
    buckets = sorted(r.bucket for r in found)
    n = sum(r.n for r in found)
    own = F.broadcast(own) if n <= BROADCAST_TERMS else own
    weight = idf(F.lit(index.n_docs), F.col("df"))
    rows = index.terms.where(F.col("bucket").isin(buckets)).join(own, ["bucket", "term"]).select(query_key, "term", "df", weight.alias("idf"), (weight * F.col("most")).alias("ub"))
    rows = materialised(rows, "asked")
    n, pairs = rows.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    return Asked(rows, n, pairs, buckets, query_key)


def read_blocks(index: Index, q: Asked) -> DataFrame:
    """The stored blocks in the directories of the queries' terms."""
    return index.blocks.where(F.col("bucket").isin(q.buckets))


def _added(index: Index, met: DataFrame, q: Asked, key: str, keep: DataFrame | None) -> DataFrame:
    """(query_key, key, score) of blocks that have met the queries that ask for them."""
    pairs = met.select(q.query_key, "idf", F.explode("posts").alias("x")).select(q.query_key, F.col("x.key").alias(key), (F.col("idf") * F.col("x.weight")).alias("w"))
    if keep is not None:
        pairs = pairs.join(keep.select(key).distinct(), key, "left_semi")
    return pairs.groupBy(q.query_key, key).agg(F.sum("w").alias("score"))


def sparse_scores(index: Index, queries: DataFrame, *, key: str = "doc_id", query_key: str = "query_id", query_text: str = "text", keep: DataFrame | None = None) -> DataFrame:
    """(query_key, key, score): sum of idf times weight over shared terms, for every document that shares any.

    keep restricts the documents that may be returned (hard filters) before anything is
    ranked; frequencies and lengths are those of the whole collection.
    """
    q = asked(index, queries, query_key, query_text)
    return _added(index, read_blocks(index, q).join(q.sent(), "term"), q, key, keep)


def _kth(scores: DataFrame, query_key: str, key: str, limit: int) -> DataFrame:
    """(query_key, theta): the limit-th best score of each query; none for a query with fewer."""
    best = ranked(scores, [query_key], "score", key, limit=limit)
    return best.groupBy(query_key).agg(F.count("*").alias("n"), F.min("score").alias("theta")).where(F.col("n") == limit).select(query_key, "theta")


def bounded(index: Index, q: Asked, limit: int, key: str, keep: DataFrame | None = None) -> DataFrame:
    """(query_key, term, idf, theta, below): the queries' terms, each query's bound, and what its lighter terms can add at most.

    theta is the limit-th best partial score over the heaviest blocks of a query's heaviest terms, so at
    least `limit` documents score that much, 0 if there are fewer. Terms are ordered by the most
    they can add. A document's heaviest term, in a block with the largest weight `most`, lets it
    score idf * most + below at most: blocks for which that is less than theta hold no document of the best by their heaviest term.
    """
    up = W.Window.partitionBy(q.query_key).orderBy("ub", "term")
    down = W.Window.partitionBy(q.query_key).orderBy(F.desc("ub"), F.desc("term"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    rows = q.rows.withColumns({"below": before(up, "ub").cast("double"), "ahead": before(down, "df")})
    heavy = rows.where(F.col("ahead") < SEED * limit)
    heavy = F.broadcast(heavy) if q.n <= BROADCAST_TERMS else heavy
    seeds = read_blocks(index, q).join(heavy, "term").where(F.col("idf") * F.col("most") >= F.col("ub") / 2)
    theta = _kth(_added(index, seeds, q, key, keep), q.query_key, key, limit)
    return materialised(rows.join(theta, q.query_key, "left").select(q.query_key, "term", "idf", "ub", "below", F.coalesce("theta", F.lit(0.0)).alias("theta")), "bounds")


def _live() -> Column:
    return F.col("idf") * F.col("most") + F.col("below") >= F.col("theta") - SLACK


def postings_in_reach(index: Index, q: Asked, bounds: DataFrame) -> int:
    """Pairs of a query and a posting in blocks that the query's bound doesn't rule out. Reads no postings."""
    sent = F.broadcast(bounds) if q.n <= BROADCAST_TERMS else bounds
    return read_blocks(index, q).select("term", "most", "n").join(sent, "term").where(_live()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def sparse_branch(index: Index, queries: DataFrame, *, limit: int = BRANCH_LIMIT, key: str = "doc_id", query_key: str = "query_id", query_text: str = "text", keep: DataFrame | None = None, direct_pairs: int = DIRECT_PAIRS) -> DataFrame:
    """The best `limit` documents of each query by BM25: query_key, key, score, rank.

    Few pairs of queries and postings (direct_pairs) are simply added up. For more, each query gets a bound that its
    best documents reach, and only blocks in reach of it make candidates: the bound then rises to the limit-th best
    candidate, and those left get their whole scores from their own rows in `documents`. Where the
    blocks in reach hold most pairs anyway, or candidates have more terms than there are pairs, all are added up after all. The result is the same.
    """
    q = asked(index, queries, query_key, query_text)
    best = lambda scores: ranked(scores, [query_key], "score", key, limit=limit)
    everything = lambda: best(_added(index, read_blocks(index, q).join(q.sent(), "term"), q, key, keep))
    if q.pairs <= direct_pairs:
        return everything()
    bounds = bounded(index, q, limit, key, keep)
    if postings_in_reach(index, q, bounds) * 2 > q.pairs:
        return everything()
    sent = F.broadcast(bounds) if q.n <= BROADCAST_TERMS else bounds
    partial = materialised(_added(index, read_blocks(index, q).join(sent, "term").where(_live()), q, key, keep), "partial")
    # What blocks out of reach can still add: of each term less than theta - below, and no more than the term at all.
    rest = bounds.groupBy(query_key).agg(F.sum(F.least("ub", F.greatest(F.lit(0.0), F.col("theta") - F.col("below")))).alias("rest"))
    raised = _kth(partial, query_key, key, limit)
    left = partial.join(rest, query_key).join(raised, query_key, "left").where(F.col("score") + F.col("rest") >= F.coalesce("theta", F.lit(0.0)) - SLACK).select(query_key, key)
    left = materialised(left, "candidates")
    n = left.count()
    if n * index.avgdl > q.pairs:
        return everything()
    candidates = F.broadcast(left) if n <= BROADCAST_TERMS else left
    rows = index.documents.withColumnRenamed(index.key, key).join(candidates, key).select(query_key, key, "dl", F.explode("terms").alias("x")).select(query_key, key, F.col("x.term").alias("term"), bm25_weight(F.col("x.tf"), F.col("dl"), F.lit(index.avgdl)).alias("weight"))
    return best(rows.join(q.sent(), [query_key, "term"]).groupBy(query_key, key).agg(F.sum(F.col("idf") * F.col("weight")).alias("score")))
