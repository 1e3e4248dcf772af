"""Ranking with a defined order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from seekspark.sources.shared import materialised


def ranked(df: DataFrame, keys: Sequence[str], score: str, tie: str, *, limit: int | None = None, name: str = "rank") -> DataFrame:
    """df with the rank (from 1) by descending score and ascending tie within keys, cut at limit.

    Scores are rounded to 9 digits first, so sums that differ in their last bits tie.
    A limit reaches the shuffle's near side as a window group limit.
    """
    order = W.Window.partitionBy(*keys).orderBy(F.desc(F.round(score, 9)), F.asc(tie))
    out = df.withColumn(name, F.row_number().over(order).cast("long"))
    return out if limit is None else out.where(F.col(name) <= limit)


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_first", F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))).where("_first = 1").drop("_first")


def placed(df: DataFrame, *order: Column | str, name: str = "k") -> DataFrame:
    """df numbered from 1 in the order, which has to tell all rows apart.

    Rows are sorted in ranges and written with their place in their range; what comes before a range is a sum of
    the ranges' counts, which are as many as there are partitions. No task sorts or counts all rows.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the place in the partition, which is in the bits above
    rows = materialised(ranges.withColumns({"_range": F.spark_partition_id(), "_at": at}), "placed")
    before, offsets = 0, []
    for r in rows.groupBy("_range").count().orderBy("_range").collect():
        offsets.append((r["_range"], before))
        before += r["count"]
    known = df.sparkSession.createDataFrame(offsets, "_range int, _before long")
    return rows.join(F.broadcast(known), "_range").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once, however often (in lambdas too) then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def in_cells(rows: DataFrame, group: str, key: str, cell_rows: int) -> DataFrame:
    """rows with block, x and y: a group's rows are dealt into blocks of about cell_rows by their key, and each two blocks meet in a cell (x, y).

    Each pair of a group's rows is together in one cell: of their blocks if those differ,
    else of their block with itself. So a large group is many tasks' work.
    """
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("_blocks"))
    dealt = rows.join(sizes, group).withColumn("block", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumns({"x": F.least("block", "_other"), "y": F.greatest("block", "_other")}).drop("_blocks", "_other")
