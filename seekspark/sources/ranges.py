"""Tables in files by ranges of their key: a change rewrites the ranges that it touches, and no other file.

A manifest for each state of the table says which folder holds each range. Readers take the newest; a
writer claims the next number, so that of two writers from one state the second is refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.sources import tables
from seekspark.sources.versions import claimed, deleted, names_in, written_whole

#: Rows of a range, and ranges at most: their bounds are in the manifest.
RANGE_ROWS, MOST_RANGES = 1_000_000, 10_000


def _manifest(spark: SparkSession, root: str) -> tuple[int, dict]:
    found = sorted(int(m[1]) for m in (re.fullmatch(r"state_(\d+)\.json", n) for n in names_in(spark, root)) if m)
    if not found:
        raise LookupError(f"no table in {root}")
    return found[-1], json.loads(spark.read.text(f"{root}/state_{found[-1]}.json", wholetext=True).first()[0])


def _placed(df: DataFrame, key: str, bounds: list) -> DataFrame:
    """df with the number of each row's range: how many of the bounds its key has reached (0 for a null key)."""
    if not bounds:
        return df.withColumn("_range", F.lit(0))
    return df.withColumn("_range", F.coalesce(F.expr(f"size(filter(array({', '.join(map(repr, bounds))}), b -> b <= `{key}`))") if len(bounds) <= 8 else _searched(key, bounds), F.lit(0)))


def _searched(key: str, bounds: list):
    """The same by halving: few comparisons for many bounds."""

    def part(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) < F.lit(bounds[mid]), part(lo, mid)).otherwise(part(mid + 1, hi))

    return part(0, len(bounds))


def created(df: DataFrame, root: str, key: str, *, range_rows: int = RANGE_ROWS) -> None:
    """A new table of df, whose key is a whole number, in ranges of about range_rows rows."""
    spark = df.sparkSession
    n = min(MOST_RANGES, df.count() // range_rows + 1)
    bounds = sorted({*df.agg(F.percentile_approx(key, [k / n for k in range(1, n)], max(10_000, 8 * n))).first()[0]}) if n > 1 else []
    placed = _placed(df, key, bounds)
    placed.repartition("_range").write.partitionBy("_range").parquet(f"{root}/data_0")
    folders = {str(k): f"data_0/_range={k}" for k in range(len(bounds) + 1) if f"_range={k}" in names_in(spark, f"{root}/data_0")}
    if not claimed(spark, f"{root}/state_0.claim"):
        raise RuntimeError(f"{root} has a table")
    written_whole(spark, f"{root}/state_0.json", json.dumps({"key": key, "bounds": bounds, "folders": folders, "schema": df.schema.json()}))


def read(spark: SparkSession, root: str, numbers: list[int] | None = None) -> DataFrame:
    """The table's newest state, or some of its ranges."""
    from pyspark.sql.types import StructType

    _, m = _manifest(spark, root)
    paths = [f"{root}/{f}" for k, f in m["folders"].items() if numbers is None or int(k) in numbers]
    schema = StructType.fromJson(json.loads(m["schema"]))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def changed(spark: SparkSession, root: str, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Writes apply(rows, changes) over the ranges that hold keys of changes, as a new state; the numbers of these ranges.

    apply gets the rows of those ranges only: tables.upsert, patched, and deletions by key fit. It has to keep the keys of rows in
    their ranges. RuntimeError if another writer has made the next state meanwhile.
    """
    state, m = _manifest(spark, root)
    key, bounds = m["key"], m["bounds"]
    touched = sorted(r[0] for r in _placed(changes.select(key), key, bounds).select("_range").distinct().collect())  # the table's ranges at most
    if not touched:
        return []
    if not claimed(spark, f"{root}/state_{state + 1}.claim"):
        raise RuntimeError(f"state {state + 1} of {root} is another writer's")
    out = f"data_{state + 1}"
    own = _placed(apply(read(spark, root, touched), changes), key, bounds)
    own.repartition("_range").write.partitionBy("_range").parquet(f"{root}/{out}")
    there = {*names_in(spark, f"{root}/{out}")}
    folders = {k: f for k, f in m["folders"].items() if int(k) not in touched} | {str(k): f"{out}/_range={k}" for k in touched if f"_range={k}" in there}
    written_whole(spark, f"{root}/state_{state + 1}.json", json.dumps(m | {"folders": folders}))
    return touched


def upserted(spark: SparkSession, root: str, new: DataFrame) -> list[int]:
    """new's rows take the place of those with their key, or are added; of repeated keys the least row stands."""
    key = _manifest(spark, root)[1]["key"]
    return changed(spark, root, new, lambda old, n: tables.upsert(old, n, [key]))


def removed(spark: SparkSession, root: str, gone: DataFrame) -> list[int]:
    """Rows whose key is in gone are left out."""
    key = _manifest(spark, root)[1]["key"]
    return changed(spark, root, gone, lambda old, g: old.join(g.select(key).distinct(), key, "left_anti").select(*old.columns))


def vacuumed(spark: SparkSession, root: str) -> int:
    """Deletes the folders and manifests that the newest state doesn't use; how many. For when no reader is left of an older one."""
    state, m = _manifest(spark, root)
    used, n = {*m["folders"].values()}, 0
    for name in names_in(spark, root):
        if name.startswith("data_"):
            for part in names_in(spark, f"{root}/{name}"):
                if part.startswith("_range=") and f"{name}/{part}" not in used:
                    deleted(spark, f"{root}/{name}/{part}")
                    n += 1
        elif (k := re.fullmatch(r"state_(\d+)\.(json|claim)", name)) and int(k[1]) < state:
            deleted(spark, f"{root}/{name}")
            n += 1
    return n
