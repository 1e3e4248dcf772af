"""Which attribute to ask about, with which options, and what an answer changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from seekspark.operators.filters import ATTRIBUTES, HOME, attribute_value

UNKNOWN = "unknown"
TOP_ITEMS, OPTIONS = 5, 3
MIN_CONFIDENCE, MAX_TURNS = 0.7, 2
#: Entropy that counts as none, in bits.
NO_ENTROPY = 1e-9

# What a question calls the options; of an attribute with two the first stands for the value beside it.
UNKNOWN_LABEL = "모르겠어요"
COUNTRY_LABELS = ("한국 영화", "외국 영화")
ANIMATION_LABELS = ("애니메이션", "실사 영화")


def distributions(items: DataFrame, home: str = HOME, top: int = TOP_ITEMS) -> DataFrame:
    """(query_id, attr, pos, value, w) of items(query_id, rank, weight, decade, country, genres, is_animation).

    The best `top` items count. If none of a query's items has a weight above 0, known
    value or not, all weigh 1; unknown values and weightless ones drop out.
    """
    best = items.where(F.col("rank") <= top)
    uniform = F.max("weight").over(W.Window.partitionBy("query_id")) <= 0
    weighed = best.withColumn("w", F.when(uniform, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("weight").cast("double"))))
    values = F.array(*(F.struct(F.lit(name).alias("attr"), F.lit(k).alias("pos"), attribute_value(name, home).alias("value")) for k, name in enumerate(ATTRIBUTES)))
    rows = weighed.select("query_id", "w", F.explode(values).alias("x")).select("query_id", "x.attr", "x.pos", "x.value", "w")
    return rows.where("value is not null").groupBy("query_id", "attr", "pos", "value").agg(F.sum("w").alias("w")).where("w > 0")


def entropies(dist: DataFrame) -> DataFrame:
    """(query_id, attr, pos, entropy) in bits."""
    share = F.col("w") / F.sum("w").over(W.Window.partitionBy("query_id", "attr"))
    return dist.withColumn("p", share).groupBy("query_id", "attr", "pos").agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"))


def options(dist: DataFrame) -> DataFrame:
    """(query_id, attr, options): the heaviest values, then unknown."""
    order = W.Window.partitionBy("query_id", "attr").orderBy(F.desc(F.round("w", 9)), "value")
    heavy = dist.withColumn("r", F.row_number().over(order)).where(F.col("r") <= OPTIONS)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"])
    return heavy.groupBy("query_id", "attr").agg(F.array_append(listed, UNKNOWN).alias("options"))


def choose(items: DataFrame, asked: DataFrame | None = None, home: str = HOME) -> DataFrame:
    """(query_id, attr, entropy, options) of the attribute with the largest entropy that wasn't asked.

    asked has (query_id, asked array). Ties go to the earlier attribute; a query without
    entropy in any has no row.
    """
    dist = distributions(items, home)
    e = entropies(dist).where(F.col("entropy") > NO_ENTROPY)
    if asked is not None:
        e = e.join(asked, "query_id", "left").where(~F.coalesce(F.array_contains("asked", F.col("attr")), F.lit(False)))
    best = W.Window.partitionBy("query_id").orderBy(F.desc(F.round("entropy", 9)), "pos")
    chosen = e.withColumn("r", F.row_number().over(best)).where("r = 1").select("query_id", "attr", "entropy")
    return chosen.join(options(dist), ["query_id", "attr"])


def option_label(attr: Column, value: Column, home: str = HOME) -> Column:
    """How an option reads: decades with their suffix, two labels for country and animation, else the value."""
    two = lambda first, labels: F.when(value == first, labels[0]).otherwise(labels[1])
    return (
        F.when(value == UNKNOWN, UNKNOWN_LABEL)
        .when((attr == "decade") & value.rlike(r"^\d+s$"), F.concat(F.regexp_extract(value, r"^(\d+)", 1), F.lit("년대")))
        .when(attr == "country", two(home, COUNTRY_LABELS))
        .when(attr == "is_animation", two("true", ANIMATION_LABELS))
        .otherwise(value)
    )


def should_ask(confidence: Column, turns: Column, entropy: Column) -> Column:
    """Ask while the result isn't sure, turns are left, and some attribute tells candidates apart."""
    return (confidence < MIN_CONFIDENCE) & (turns < MAX_TURNS) & (F.coalesce(entropy, F.lit(0.0)) > NO_ENTROPY)


def apply_answer(filters: Column, attr: Column, value: Column, offered: Column) -> Column:
    """The hard filters with the answer; unknown, or a value that wasn't offered, adds nothing."""
    counts = (value != UNKNOWN) & F.array_contains(offered, value)
    without = F.map_filter(filters, lambda k, v: k != attr)
    return F.when(counts, F.map_concat(without, F.create_map(attr, value))).otherwise(filters)


def simulated_answer(truth: Column, offered: Column) -> Column:
    """What a user who knows the movie says: its value if that is offered, else unknown."""
    return F.when(F.array_contains(offered, truth), truth).otherwise(F.lit(UNKNOWN))
