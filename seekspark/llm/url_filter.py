"""URL rules in a trie over reversed host labels and then path segments."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.llm.common import by_partition, lower_ascii

#: Rules that are sent to the executors as a trie, and the characters of their hosts and paths; more are joined instead.
TRIE_RULES, TRIE_CHARS = 100_000, 8 << 20
DEFAULT = "allow"

RULE = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())])


class Trie:
    """node = [children by label or segment, {} or paths below this host, rules that end inside a segment]"""

    def __init__(self, rules: Sequence[tuple[str, str, str]]) -> None:
        self.hosts: dict = {}
        for host, path, verdict in rules:
            node = self.hosts
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, last = path.split("/")
            place = node.setdefault("/", {})
            for segment in whole:
                place = place.setdefault(segment, {})
            # The last piece may be a segment's beginning; "" fits any. The later of two equal rules holds, block before allow.
            ends = place.setdefault("/", {})
            if ends.get(last, ("", ""))[1] != "block":
                ends[last] = (f"{host}{path}", verdict)

    @staticmethod
    def _path(place: dict, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            ends = place.get("/")
            if ends:
                for n in range(len(segment), -1, -1):
                    if segment[:n] in ends:
                        best = ends[segment[:n]]
                        break
            place = place.get(segment) if segment != "/" else None
            if place is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits: the most host labels, then the longest path."""
        best, node = None, self.hosts
        for label in reversed(host.split(".")):
            node = node.get(label) if label != "/" else None
            if node is None:
                break
            if "/" in node:
                best = self._path(node["/"], path) or best
        return best


def _matcher(shared):
    def make():
        trie: Trie = shared.value

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [trie.find(h, p) if h else None for h, p in zip(batch.column("_host").to_pylist(), batch.column("_path").to_pylist(), strict=True)]
            return [pa.array([f and f[0] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.string())]

        return step

    return make


def _joined(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by joins, for rule tables that are too large to send: hosts are looked up by each of their suffixes."""
    labels = F.split("_host", r"\.")
    pairs = parts.where("_host != ''").select("_host", "_path").distinct()
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hits = pairs.withColumn("host", F.explode(suffix)).join(rules, "host").where("startswith(_path, path)")
    best = hits.groupBy("_host", "_path").agg(F.max(F.struct(F.size(F.split("host", r"\.")).alias("a"), F.length("path").alias("b"), "verdict", F.concat("host", "path").alias("rule"))).alias("x"))
    return parts.join(best, ["_host", "_path"], "left").select(*parts.columns, F.col("x.rule").alias("_rule"), F.col("x.verdict").alias("_verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], *, default: str = DEFAULT, trie_rules: int = TRIE_RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    rules are (host, path, verdict) with the verdict allow or block. A rule fits its host
    and all hosts below it if the path begins with the rule's path; the one with the most
    host labels wins, then the longest path, and of equal rules block. The host reaches
    from the first :// to /, ? or #, lower-cased A-Z; the path from there to ? or #. A
    null url, or one without ://, has neither and no rule; the verdict is then default's.
    """
    spark = pages.sparkSession
    url = F.coalesce("url", F.lit(""))
    pattern = "(?s)://([^/?#]*)([^?#]*)"
    parts = pages.select("page_id", lower_ascii(F.regexp_extract(url, pattern, 1)).alias("_host"), F.regexp_extract(url, pattern, 2).alias("_path"))
    known = None
    if isinstance(rules, DataFrame):
        rules = rules.select("host", "path", "verdict")
        n, chars = rules.agg(F.count("*"), F.coalesce(F.sum(F.char_length("host") + F.char_length("path")), F.lit(0))).first()
        if n <= trie_rules and chars <= TRIE_CHARS:
            known = [tuple(r) for r in rules.collect()]
    elif len(rules) <= trie_rules and sum(len(h) + len(p) for h, p, _ in rules) <= TRIE_CHARS:
        known = list(rules)
    if known is not None:
        shared = spark.sparkContext.broadcast(Trie(known))
        out = by_partition(parts, _matcher(shared), T.StructType([T.StructField("_rule", T.StringType()), T.StructField("_verdict", T.StringType())]))
    else:
        out = _joined(parts, rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), RULE))
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.coalesce("_verdict", F.lit(default)).alias("verdict"))
