"""Near-identical pictures by the distance of their 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.operators.common import in_cells
from seekspark.sources.shared import discarded, materialised

MAX_DISTANCE = 20
#: Bands that are narrower find more chance pairs than they save comparisons.
BAND_BITS = 8
#: Fingerprints of one block; two blocks are compared by one task.
CELL_ROWS = 2048
#: Near pairs of a group that one task settles at most.
TASK_PAIRS = 1_000_000


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(rows: DataFrame, max_distance: int, *, key: str = "n", group: str = "movie_id", fingerprint: str = "h") -> DataFrame:
    """(group, a, b, distance) of fingerprints within max_distance in one group, a before b.

    Two fingerprints within d bits agree on one of d + 1 bands (pigeonhole). While those are
    wide enough to tell fingerprints apart, pairs meet by equi-joins on bands. For larger
    distances every pair of a group has to be compared: blocks of fingerprints are, two by
    two, and only the near pairs leave a task.
    """
    named = rows.select(F.col(group).alias("_g"), F.col(key).alias("k"), F.col(fingerprint).alias("f")).where("f is not null")
    if 64 // (max_distance + 1) >= BAND_BITS:
        pairs = _by_bands(named, max_distance + 1)
    else:
        kinds = dict(named.dtypes)
        cells = in_cells(named, "_g", "k", CELL_ROWS).groupBy("_g", "x", "y")
        pairs = cells.applyInPandas(_compared(max_distance), f"_g {kinds['_g']}, a {kinds['k']}, b {kinds['k']}, distance long")
    return pairs.where(F.col("distance") <= max_distance).select(F.col("_g").alias(group), "a", "b", "distance")


def _by_bands(named: DataFrame, bands: int) -> DataFrame:
    cuts = [64 * k // bands for k in range(bands + 1)]
    piece = lambda k: F.shiftrightunsigned(F.shiftleft("f", 64 - cuts[k + 1]), 64 - (cuts[k + 1] - cuts[k]))
    keyed = named.select("_g", "k", "f", F.posexplode(F.array(*(piece(k) for k in range(bands)))).alias("band", "bits"))
    met = keyed.alias("a").join(keyed.alias("b"), F.expr("a._g = b._g and a.band = b.band and a.bits = b.bits and a.k < b.k"))
    return met.select(F.col("a._g").alias("_g"), F.col("a.k").alias("a"), F.col("b.k").alias("b"), hamming(F.col("a.f"), F.col("b.f")).cast("long").alias("distance")).distinct()


def _compared(most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        x, y = int(cell["x"].iloc[0]), int(cell["y"].iloc[0])
        cell = cell.sort_values("k", kind="stable")
        one, two = cell[cell["block"] == x], cell[cell["block"] == y]
        f, g = (t["f"].to_numpy(np.int64).view(np.uint64) for t in (one, two))
        p, q = one["k"].to_numpy(), two["k"].to_numpy()
        found = []
        for i in range(0, len(f), 256):
            d = np.bitwise_count(f[i : i + 256, None] ^ g[None, :])
            r, c = np.nonzero(d <= most)
            keep = p[i + r] < q[c] if x == y else p[i + r] != q[c]
            found.append((p[i + r[keep]], q[c[keep]], d[r[keep], c[keep]]))
        a, b, d = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (p[:0], q[:0], np.zeros(0, np.int64))
        return pd.DataFrame({"_g": pd.Series([cell["_g"].iloc[0]] * len(a), dtype=object), "a": np.minimum(a, b), "b": np.maximum(a, b), "distance": d.astype(np.int64)})

    return run


def representatives(rows: DataFrame, max_distance: int = MAX_DISTANCE, *, key: str = "n", group: str = "movie_id", fingerprint: str = "h", save: Callable[[DataFrame], DataFrame] = materialised, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(group, key) kept when each row, in key order, stays unless it is near one kept before.

    The choice depends on order and isn't transitive. Of equal fingerprints the first stands
    for all. A group of no more than task_pairs near pairs is settled in one pass over them,
    in a task; larger ones are settled together in rounds of joins, as many as the longest
    chain of near rows in them. Null fingerprints take no part.
    """
    first = rows.where(F.col(fingerprint).isNotNull()).groupBy(group, fingerprint).agg(F.min(key).alias(key))
    first = save(first)
    pairs = save(near_pairs(first, max_distance, key=key, group=group, fingerprint=fingerprint).select(F.col(group).alias("_g"), "a", "b"))
    large = save(pairs.groupBy("_g").count().where(F.col("count") > task_pairs).select("_g"))
    all_rows, kinds = first.select(F.col(group).alias("_g"), F.col(key).alias("k")), dict(pairs.dtypes)
    dropped = pairs.join(large, "_g", "left_anti").groupBy("_g").applyInPandas(_dropped, f"_g {kinds['_g']}, k {kinds['b']}")
    out = all_rows.join(large, "_g", "left_anti").join(dropped, ["_g", "k"], "left_anti")
    parts = [] if large.isEmpty() else _in_rounds(all_rows.join(large, "_g", "left_semi"), pairs.join(large, "_g", "left_semi"), save)
    for p in parts:
        out = out.unionAll(p)
    out = save(out.select(F.col("_g").alias(group), F.col("k").alias(key)))
    discarded(first, pairs, large, *parts)
    return out


def _dropped(key: tuple, pairs: pd.DataFrame) -> pd.DataFrame:
    """The rows of one group that are near a row kept before them: by b, each pair's a is settled when its b is met."""
    gone: dict = {}
    pairs = pairs.sort_values("b", kind="stable")
    for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True):
        if a not in gone:
            gone[b] = True
    return pd.DataFrame({"_g": pd.Series([key[0]] * len(gone), dtype=object), "k": pd.Series(list(gone), dtype=pairs["b"].dtype)})


def _in_rounds(rows: DataFrame, pairs: DataFrame, save: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """The rows(_g, k) that stay, in parts. In a round a row stays once every earlier row near it is dropped, and is dropped once one of them stays: the first open row of every chain, at least, is settled."""
    open_pairs = save(pairs)
    fresh = save(rows.join(open_pairs.select("_g", F.col("b").alias("k")).distinct(), ["_g", "k"], "left_anti"))
    parts = [fresh]
    while True:
        dropped = save(open_pairs.join(fresh.select("_g", F.col("k").alias("a")), ["_g", "a"], "left_semi").select("_g", F.col("b").alias("k")).distinct())
        if dropped.isEmpty():
            discarded(dropped, open_pairs)
            return parts
        # Pairs of dropped rows are settled; rows that only they held back now stay.
        held = open_pairs.join(dropped.select("_g", F.col("k").alias("b")), ["_g", "b"], "left_anti")
        freed = held.join(dropped.select("_g", F.col("k").alias("a")), ["_g", "a"], "left_semi").select("_g", F.col("b").alias("k")).distinct()
        rest = save(held.join(dropped.select("_g", F.col("k").alias("a")), ["_g", "a"], "left_anti"))
        fresh = save(freed.join(rest.select("_g", F.col("b").alias("k")).distinct(), ["_g", "k"], "left_anti"))
        parts.append(fresh)
        discarded(dropped, open_pairs)
        open_pairs = rest


def keep_representatives(scenes: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """scenes after a new choice: losers deleted, what is known of the kept ones preserved, new ones added with nulls."""
    return found.join(scenes, keys, "left").select(*scenes.columns)
