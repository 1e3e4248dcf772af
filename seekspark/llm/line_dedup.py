"""Repeated lines, found with levelled sorted runs of line hashes.

A run is a sorted table of (h1, h2, n_docs, keeper): the 128-bit hash of a line's key, in
how many documents it is, and the largest doc_id among them. Batches of documents come
in descending doc_id. Each batch is merge-anti-joined with the runs: a key that a run
shows to be repeated already is settled (its keeper can't change any more) and adds
nothing. What is left becomes the batch's own run on level 0, and whenever a level has
`fanout` runs they are compacted into one run of the next level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.llm.common import NO_ID, discard, fresh_name, let, lower_ascii, small_lists, small_side, sorted_buckets, stored, stored_buckets

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 2

_STRIP = "\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(_STRIP)))


class LineRuns:
    """The levels of runs; add() takes a batch of (h1, h2, id) with a row for each document and key.

    A run is a table in buckets of its key, each one sorted file, so that runs meet each other and a batch
    by merging: neither side is shuffled or sorted again.
    """

    def __init__(self, min_docs: int, fanout: int = FANOUT) -> None:
        self.min_docs, self.fanout, self.levels = min_docs, fanout, [[]]

    def _all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """The runs as one. They are joined, not put end to end: this Spark takes a union of bucketed scans for partitioned by their key, which it isn't."""

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            other = b.select("h1", "h2", F.col("n_docs").alias("_n"), F.col("keeper").alias("_keeper")).hint("merge")
            n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))
            return a.join(other, ["h1", "h2"], "full_outer").select("h1", "h2", n.alias("n_docs"), F.greatest("keeper", "_keeper").alias("keeper"))

        return reduce(both, runs)

    @staticmethod
    def _run(rows: DataFrame, dealt: bool = False) -> DataFrame:
        """The rows as a run; dealt if they are in its buckets' partitions already."""
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return stored_buckets(rows if dealt else rows.repartition(n, "h1", "h2"), "run", n, "h1", "h2")

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch's own run whose keys no run shows to be repeated."""
        for run in self._all():
            batch = batch.join(run.where(F.col("n_docs") >= self.min_docs).hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        # Stored before runs are taken from it: the planner would move anti joins below the aggregation, to each line.
        own = self._run(batch.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper")))
        if self._all():
            with sorted_buckets(own.sparkSession):
                left = self._run(self.unsettled(own), dealt=True)
            discard(own)
            own = left
        self.levels[0].append(own)
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                with sorted_buckets(level[0].sparkSession):
                    self.levels[k + 1].append(self._run(self._merged(level)))
                discard(*level)
                self.levels[k] = []

    def discard(self) -> None:
        """Deletes the runs' files."""
        discard(*self._all())
        self.levels = [[]]

    def repeated(self) -> DataFrame:
        """(h1, h2, keeper) of the keys that min_docs documents or more have."""
        return self._merged(self._all()).where(F.col("n_docs") >= self.min_docs).select("h1", "h2", "keeper")


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, t, at, h1, h2) of each line whose key is long enough; t tells apart texts under one id."""
    long_enough = docs.where(F.octet_length("text") >= min_chars)
    lines = long_enough.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    # Lower-casing doesn't change a line's length, so only lines that count are lower-cased.
    counted = lines.where(F.octet_length("line") >= min_chars).where(F.char_length(F.btrim("line", F.lit(_STRIP))) >= min_chars)
    key = line_key(F.col("line"))
    return counted.select("id", "t", "at", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


def _ranges(docs: DataFrame, n: int) -> list[Column]:
    """Conditions on id that cut the documents into n batches of descending doc_id."""
    at = [x for x in docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 1000)).first()[0] or []] if n > 1 else []
    cuts = sorted({*at}, reverse=True)
    if not cuts:
        return [F.lit(True)]
    inner = [(F.col("id") > lo) & (F.col("id") <= hi) for hi, lo in zip(cuts, cuts[1:])]
    return [F.col("id") > cuts[0], *inner, F.col("id") <= cuts[-1]]


def dropped_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(id, t, dropped): the numbers (from 0) of the lines that each changed document loses.

    Texts are read, split and hashed once; batches and the last join read the hashes.
    """
    lines = stored(_lines(docs.select("doc_id", "text"), min_chars), "lines")
    runs = LineRuns(min_docs, fanout)
    for part in _ranges(docs, batches):
        # A line that a document repeats counts once: its first place stands for it.
        runs.add(lines.where(part).groupBy("h1", "h2", "id", "t").agg(F.count("*")).select("h1", "h2", "id"))
    repeated = stored(runs.repeated(), "repeated")
    runs.discard()
    lost = lines.join(small_side(repeated, repeated.count()), ["h1", "h2"]).where("id != keeper")
    lost = stored(lost.groupBy("id", "t").agg(F.collect_set("at").alias("dropped")), "lost")
    discard(lines, repeated)
    return lost


def dedup_lines(docs: DataFrame, **options) -> tuple[DataFrame, str]:
    """docs with the repeated lines gone from text, and one struct column more (its name is returned too): n_lines, n_dropped.

    A key of at least min_chars code points that min_docs documents have keeps its lines
    only in the largest doc_id that has it. A null or empty text is one empty line; null
    stays null. Rows that repeat a doc_id with the same text are one document and are
    treated alike; a null doc_id counts as smaller than any other. Columns pass through.
    """
    name = fresh_name(docs, "lines")
    lost = dropped_lines(docs, **options).select(F.col("id").alias("_id"), F.col("t").alias("_t"), F.col("dropped").alias("_dropped"))
    on = (F.coalesce(docs["doc_id"], F.lit(NO_ID)) == F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_t"))
    joined = docs.join(small_lists(lost, "_dropped"), on, "left")
    split = F.struct(F.split(docs["text"], "\n").alias("lines"), F.col("_dropped").alias("dropped"))
    stay = lambda s: F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["dropped"])
    kept = let(split, lambda s: F.array_join(F.transform(stay(s), lambda i: F.get(s["lines"], i)), "\n"))
    text = F.when(F.col("_dropped").isNotNull(), kept).otherwise(docs["text"])
    n_lines = F.octet_length(docs["text"]) - F.octet_length(F.replace(docs["text"], F.lit("\n"), F.lit(""))) + 1
    result = F.struct(F.coalesce(n_lines, F.lit(1)).cast("long").alias("n_lines"), F.when(F.col("_dropped").isNotNull(), F.size("_dropped")).otherwise(0).cast("long").alias("n_dropped"))
    return joined.select(*(text.alias(c) if c == "text" else docs[c] for c in docs.columns), result.alias(name)), name


def line_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_lines (before dropping), n_dropped, kept_sha256."""
    out, lines = dedup_lines(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", F.col(lines)["n_lines"].alias("n_lines"), F.col(lines)["n_dropped"].alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated lines gone, columns as in docs."""
    out, lines = dedup_lines(docs, **options)
    return out.drop(lines)
