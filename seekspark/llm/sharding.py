"""Minimax contiguous partition of atomic groups into shards of near equal bytes.

Groups are equal texts, in the order of their 64-bit hash. The smallest feasible capacity
is binary-searched; a greedy pass over the ordered sizes checks each candidate, and the
shards are cut where that pass cuts at the smallest one. The list that is searched stays
bounded: it starts with ranges of hashes, and only those ranges in which a cut can lie are
divided further, until each of them is one group. A group above a fair share has a shard
of its own, and the rest is searched and cut without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from seekspark.llm.common import discard, stored

SHARDS = 16
#: The first ranges are of so many bits of the hash; each further round divides by so many more.
RANGE_BITS, MORE_BITS = 14, 6


def _greedy(sizes: Column, capacity: Column) -> Column:
    """Shards that the ordered sizes take when each is filled up to capacity."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(1).alias("n"))
    step = lambda s, x: F.when(s["used"] + x <= capacity, F.struct((s["used"] + x).alias("used"), s["n"].alias("n"))).otherwise(F.struct(x.alias("used"), (s["n"] + 1).alias("n")))
    return F.aggregate(sizes, start, step)["n"]


def _capacity(sizes: Column, shards: int) -> Column:
    """Binary search between what any partition needs and what is always enough."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    most = F.array_max(sizes)
    least = F.greatest(most, F.ceil(total / shards).cast("long"))
    start = F.struct(least.alias("lo"), (least + most).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        fits = _greedy(sizes, mid) <= shards
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.when(fits, F.struct(s["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, halve)["hi"]


def _cuts(cells: Column, capacity: Column, past: bool) -> Column:
    """Where a greedy pass begins its shards, but for the first: positions in the ordered cells.

    It stops before the cell that doesn't fit; with past after it, so that no pass over
    finer cells gets further.
    """
    start = F.expr("named_struct('used', 0L, 'at', 0, 'cuts', cast(array() as array<int>))")

    def step(s: Column, x: Column) -> Column:
        at = (s["at"] + 1).alias("at")
        fits = F.struct((s["used"] + x["bytes"]).alias("used"), at, s["cuts"].alias("cuts"))
        used, cut = (F.lit(0).cast("long"), s["at"] + 1) if past else (x["bytes"], s["at"])
        return F.when(s["used"] + x["bytes"] <= capacity, fits).otherwise(F.struct(used.alias("used"), at, F.array_append(s["cuts"], cut).alias("cuts")))

    return F.aggregate(cells, start, step)["cuts"]


def _ranges(groups: DataFrame, bits: int) -> DataFrame:
    """(first, key, bytes, one): the ranges of the hash's leading bits that have groups, and whether they have one only."""
    return groups.groupBy(F.shiftright("h", 64 - bits).alias("key")).agg(F.min("h").alias("first"), F.sum("bytes").alias("bytes"), (F.count("*") == 1).alias("one")).select("first", "key", "bytes", "one")


def _search(groups: DataFrame, shards: int, total: int, range_bits: int) -> list[int]:
    """The hashes with which the shards but the first begin, at the smallest feasible capacity."""
    spark, bits = groups.sparkSession, range_bits
    cells, fresh = stored(_ranges(groups, bits), "ranges"), F.lit(True)  # 2^range_bits rows at most
    while True:
        ordered = cells.agg(F.array_sort(F.collect_list(F.struct("first", "bytes", "key", "one", fresh.alias("fresh")))).alias("x")).where("size(x) > 0")
        open_bytes = F.transform(F.filter("x", lambda c: ~c["one"] & c["fresh"]), lambda c: c["bytes"])
        sized = ordered.select("x", _capacity(F.col("x.bytes"), shards).alias("most"), F.coalesce(F.array_max(open_bytes), F.lit(0)).alias("slack"))
        # The capacity of whole groups is less by the largest range that a cut may divide, at most.
        least = F.greatest(F.col("most") - F.col("slack"), F.lit(-(-total // shards)))
        row = sized.select("slack", _cuts(F.col("x"), F.col("most"), False).alias("cuts"), _cuts(F.col("x"), least, False).alias("lo"), _cuts(F.col("x"), F.col("most"), True).alias("hi"), F.col("x.first").alias("first")).first()
        if row is None or not row.slack or bits == 64:
            discard(cells)
            return [row.first[k] for k in row.cuts] if row else []
        # A cut lies at or behind the greedy pass that rounds down at the least capacity, and before the one that rounds up at the most.
        hi = [*row.hi, *[len(row["first"])] * len(row.lo)]
        reach = [(a, min(b, len(row["first"]) - 1)) for a, b in zip(row.lo[: shards - 1], hi)]
        within = sorted({k for a, b in reach for k in range(a, b + 1)})  # some hundreds
        chosen = spark.createDataFrame([(row["first"][k],) for k in within], "first long")
        divided = stored(cells.join(F.broadcast(chosen), "first", "left_semi").where("not one"), "divided")
        finer = min(64, bits + MORE_BITS)
        inside = groups.withColumn("key", F.shiftright("h", 64 - bits)).join(F.broadcast(divided.select("key")), "key", "left_semi").drop("key")
        kept = cells.join(F.broadcast(divided.select("first")), "first", "left_anti")
        old, cells = cells, stored(kept.select("first", "key", "bytes", "one", F.lit(False).alias("now")).union(_ranges(inside, finer).withColumn("now", F.lit(True))), "ranges")
        discard(old, divided)
        bits, fresh = finer, F.col("now")


def shard(docs: DataFrame, *, shards: int = SHARDS, range_bits: int = RANGE_BITS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1; a null text counts as an empty one, is in one
    group with it, and has the checksum 0. slot numbers a shard's rows from 0 without a
    gap; repeated rows each have a slot. Equal texts are one group and in one shard. A group larger than
    a fair share stays whole in a shard of its own (the last numbers), and the other
    shards share what is left evenly: none is larger than the best contiguous partition allows.
    """
    text = F.coalesce("text", F.lit(""))
    light = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("r"))
    light = stored(light, "sizes")  # from here on r tells repeated rows apart
    groups = stored(light.groupBy("h").agg(F.sum("size").alias("bytes")), "groups")
    left, free, hot = groups.agg(F.sum("bytes")).first()[0] or 0, shards, []
    for h, size in groups.orderBy(F.desc("bytes"), "h").limit(shards).collect():
        if size * free > left:
            left, free, hot = left - size, free - 1, [*hot, h]
    cuts = _search(groups.where(~F.col("h").isin(hot)) if hot else groups, free, left, range_bits)  # shards - 1 numbers at most
    discard(groups)

    # Slots: a range's rows are numbered in cells, so that no range or group is sorted by one task.
    at = sum((F.when(F.col("h") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    for k, h in enumerate(hot, len(cuts) + 1):
        at = F.when(F.col("h") == h, k).otherwise(at)
    placed = light.withColumns({"shard": at, "g": F.shiftright("h", 64 - RANGE_BITS)})
    of = stored(placed.groupBy("shard", "g").agg(F.count("*").alias("rows")), "rows")  # 2^RANGE_BITS rows at most, and one more for each cut and hot group
    total = of.agg(F.sum("rows")).first()[0] or 0
    cell_rows = max(256, total // 2048)
    of = of.select("shard", "g", F.ceil(F.col("rows") / cell_rows).cast("int").alias("cells"))
    seated = placed.join(F.broadcast(of), ["shard", "g"]).withColumn("cell", F.pmod(F.xxhash64("doc_id", "size", "r"), F.col("cells")).cast("int"))
    cells = seated.groupBy("shard", "g", "cell").agg(F.count("*").alias("rows"))  # 2048 rows more at most
    before = W.Window.partitionBy("shard").orderBy("g", "cell").rowsBetween(W.Window.unboundedPreceding, -1)
    cells = cells.select("shard", "g", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(W.Window.partitionBy("shard", "g", "cell").orderBy("doc_id", "size", "text_crc32", "r"))
    return seated.join(F.broadcast(cells), ["shard", "g", "cell"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + rank - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
