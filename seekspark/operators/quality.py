"""Checks of captions and of generated examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from seekspark.functions.text import overlap, tokens
from seekspark.operators.common import placed
from seekspark.schema import CAPTION, TIMES_OF_DAY

# Allowed caption lengths in code points (both ends included), the shortest
# words that count as a giveaway, and the overlap that a rewritten query may have.
MIN_CAPTION, MAX_CAPTION = 40, 120
MIN_TITLE_KO, MIN_TITLE_EN, MIN_NAME, MIN_NAME_PART = 2, 4, 2, 3
MAX_OVERLAP = 0.5
HANGUL = "[가-힣]"


def schema_problem(raw: Column) -> Column:
    """Why a caption's JSON can't be read back as a caption, or null."""
    parsed = F.from_json(raw, CAPTION, {"mode": "PERMISSIVE"})
    return F.when(parsed.isNull() | parsed["caption_ko"].isNull() | parsed["setting"].isNull(), "schema").when(~F.coalesce(parsed["time_of_day"].isin(*TIMES_OF_DAY), F.lit(False)), "time_of_day")


def forbidden_words(movies: DataFrame, names: DataFrame) -> DataFrame:
    """(movie_id, word) that would give a movie away: titles, and names(movie_id, name) with their parts."""
    titles = movies.select(F.col("id").alias("movie_id"), F.explode(F.array(F.struct(F.col("title_ko").alias("w"), F.lit(MIN_TITLE_KO).alias("least")), F.struct(F.col("title_en").alias("w"), F.lit(MIN_TITLE_EN).alias("least")))).alias("x"))
    whole = names.select("movie_id", F.struct(F.col("name").alias("w"), F.lit(MIN_NAME).alias("least")).alias("x"))
    parts = names.select("movie_id", F.explode(F.split("name", r"[\s.\-]+")).alias("p")).select("movie_id", F.struct(F.col("p").alias("w"), F.lit(MIN_NAME_PART).alias("least")).alias("x"))
    rows = titles.union(whole).union(parts).select("movie_id", F.trim("x.w").alias("word"), "x.least")
    return rows.where(F.length("word") >= F.col("least")).select("movie_id", "word").distinct()


def forbidden_hits(captions: DataFrame, words: DataFrame) -> DataFrame:
    """captions(movie_id, scene_id, text) with the giveaway words in them: whole words but for Korean endings, any case."""
    pattern = F.concat(F.lit(r"(?iuU)(?<!\w)\Q"), F.col("word"), F.lit(r"\E(?![a-z])"))
    hits = captions.join(words, "movie_id").where(F.rlike("text", pattern))
    return hits.groupBy("scene_id").agg(F.array_sort(F.collect_set("word")).alias("words"))


def caption_problems(caption: Column, giveaways: Column | None = None) -> Column:
    """The rules that a caption breaks: length, language, giveaway words."""
    n = F.length(F.coalesce(caption, F.lit("")))
    found = [F.when(~n.between(MIN_CAPTION, MAX_CAPTION), "length"), F.when(~F.coalesce(caption.rlike(HANGUL), F.lit(False)), "hangul")]
    if giveaways is not None:
        found.append(F.when(F.size(F.coalesce(giveaways, F.array().cast("array<string>"))) > 0, "forbidden"))
    return F.array_compact(F.array(*found))


def user_words(titles: DataFrame, names: DataFrame) -> DataFrame:
    """Words for a tokenizer's dictionary: one-word Hangul titles, and the Hangul parts of names (two syllables or more)."""
    hangul = r"^[가-힣]{2,}$"
    own = titles.select(F.trim("title").alias("word")).where(F.col("word").rlike(hangul))
    parts = names.select(F.explode(F.split("name", r"[\s.·\-]+")).alias("word")).where(F.col("word").rlike(hangul))
    return own.union(parts).distinct().orderBy("word")


def best_attempts(attempts: DataFrame) -> DataFrame:
    """Of attempts(item_id, attempt, source, text) the first whose overlap with its source is allowed, else the least overlapping."""
    scored = attempts.withColumn("overlap", overlap(tokens(F.col("source")), tokens(F.col("text"))))
    fine = F.col("overlap") <= MAX_OVERLAP
    order = W.Window.partitionBy("item_id").orderBy(F.desc(fine), F.when(fine, F.col("attempt").cast("double")).otherwise(F.round("overlap", 9)), "attempt")
    return scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def sampled(rows: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """n rows that look random and are the same in every run."""
    return rows.orderBy(F.sha1(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def split_examples(scenes: DataFrame, *, dev: int = 200, seed: str = "0") -> DataFrame:
    """One scene a movie by hash order, shuffled; the first `dev` are dev, the rest test; numbered ids."""
    h = F.sha1(F.concat_ws("|", F.col("scene_id").cast("string"), F.lit(seed)))
    per_movie = scenes.withColumn("_h", h).groupBy("movie_id").agg(F.min_by(F.struct("scene_id", "_h"), F.struct("_h", "scene_id")).alias("x"))
    rows = per_movie.select("movie_id", F.col("x.scene_id").alias("scene_id"), F.col("x._h").alias("_h"))
    k = placed(rows, "_h", "scene_id")
    return k.select("movie_id", "scene_id", F.when(F.col("k") <= dev, "dev").otherwise("test").alias("split"), F.format_string("syn-%04d", "k").alias("id"))


def alternating_split(items: DataFrame, key: str, kind: str) -> DataFrame:
    """Every other item of a kind is test, the first is dev."""
    k = F.row_number().over(W.Window.partitionBy(kind).orderBy(key)) - 1
    return items.withColumn("split", F.when(k % 2 == 0, "dev").otherwise("test"))
