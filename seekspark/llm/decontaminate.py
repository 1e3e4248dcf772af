"""Benchmark decontamination as a prefix-filtered set join.

Every window of ten consecutive item words is a set of three-word shingles. Containment
of the whole window needs every shingle, so its necessary prefix is the single shingle
that is rarest in the corpus. Documents are probed with those prefixes, the shingle's
offset gives the only possible start of the window (positional bound), the document's
ends bound its length, and the words are compared before a hit counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.llm.common import ALNUM, Prefix, by_partition, chunks, expand, fresh_name, lookup, lowered, runs, shingles, utf8, word_spans

WINDOW, SHINGLE = 10, 3
#: Bytes of item texts that are indexed and sent to the executors at once; more items are handled in blocks.
BLOCK_BYTES = 4 << 20

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])


class Words:
    """The words of a chunk of texts and their hashes."""

    def __init__(self, raw: np.ndarray, off: np.ndarray) -> None:
        self.raw = lowered(raw)
        self.start, self.end, self.doc = word_spans(self.raw, off, ALNUM)
        self.hash = Prefix(self.raw).of(self.start, self.end)
        self.first = np.searchsorted(self.doc, np.arange(len(off)))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Word positions from which n words follow in the same text, and the shingles there."""
        h = shingles(self.hash, n)
        ok = np.flatnonzero(self.doc[: len(h)] == self.doc[n - 1 :]) if len(h) else np.zeros(0, np.int64)
        return ok, h[ok]

    def bytes(self, a: int, b: int) -> bytes:
        return b" ".join(self.raw[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def _nulls_last(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


class Index:
    """The windows of a block of items; after choose(), the prefix shingle of each."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        raw, off = utf8(pa.array([t for _, t in items], pa.large_string()))
        w = Words(raw, off)
        seen: dict[bytes, int] = {}
        owners: list[set[str | None]] = []
        texts, starts, sizes = [], [], []
        for k, (item, _) in enumerate(items):
            a, b = int(w.first[k]), int(w.first[k + 1])
            n = min(window, b - a)
            for s in range(a, b - n + 1) if n else ():
                text = w.bytes(s, s + n)
                if text not in seen:
                    seen[text] = len(texts)
                    texts.append(text)
                    starts.append(s)
                    sizes.append(n)
                    owners.append(set())
                owners[seen[text]].add(item)
        self.texts, self.owners = texts, [sorted(x, key=_nulls_last) for x in owners]
        self.size = np.array(sizes, np.int64)
        start = np.array(starts, np.int64)
        self.words = np.zeros((len(texts), window), np.uint64)
        for j in range(window):
            has = self.size > j
            self.words[has, j] = w.hash[start[has] + j]
        # each window's shingles: (shingle, length, window, offset)
        parts = []
        for n in range(1, SHINGLE + 1):
            own = np.flatnonzero(np.minimum(self.size, SHINGLE) == n)
            h = shingles(w.hash, n)
            at, owner = expand(np.zeros(len(own), np.int64), self.size[own] - n + 1)
            parts.append((h[start[own][owner] + at], np.full(len(at), n), own[owner], at))
        self.sh, self.sh_len, self.sh_win, self.sh_off = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.keys = {n: np.unique(self.sh[self.sh_len == n]) for n in range(1, SHINGLE + 1)}

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Keeps each window's rarest shingle; windows with a shingle that no document has are dropped."""
        n_of = np.zeros(len(self.sh), np.int64)
        for n, keys in self.keys.items():
            own = self.sh_len == n
            n_of[own] = counts[n][np.searchsorted(keys, self.sh[own])]
        order = np.lexsort((self.sh_off, n_of, self.sh_win))
        first = order[np.r_[True, self.sh_win[order][1:] != self.sh_win[order][:-1]]] if len(order) else order
        first = first[n_of[first] > 0]
        self.prefix = {}
        for n in self.keys:
            own = first[self.sh_len[first] == n]
            own = own[np.argsort(self.sh[own], kind="stable")]
            keys, at, size = np.unique(self.sh[own], return_index=True, return_counts=True)
            self.prefix[n] = (keys, at, size, self.sh_win[own], self.sh_off[own])

    def matches(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers, and the word positions at which they occur."""
        found = []
        for n, (keys, at, size, wins, offs) in self.prefix.items():
            if not len(keys):
                continue
            pos, h = w.shingles(n)
            hit, key = lookup(keys, h)
            entry, owner = expand(at[key], size[key])
            win, begin = wins[entry], pos[hit][owner] - offs[entry]
            doc = w.doc[pos[hit][owner]]
            ok = (begin >= w.first[doc]) & (begin + self.size[win] <= w.first[doc + 1])
            win, begin = win[ok], begin[ok]
            for j in range(self.words.shape[1]):
                reach = self.size[win] > j
                ok = ~reach
                ok[reach] = w.hash[begin[reach] + j] == self.words[win[reach], j]
                win, begin = win[ok], begin[ok]
            found += [(k, b) for k, b in zip(win.tolist(), begin.tolist(), strict=True) if w.bytes(b, b + int(self.size[k])) == self.texts[k]]
        both = np.array(found, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _rarity(docs: DataFrame, shared) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value.keys
        total = {n: np.zeros(len(k), np.int64) for n, k in keys.items()}
        for batch in batches:
            raw, off = utf8(batch.column(0))
            for a, b in chunks(off):
                w = Words(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                for n, k in keys.items():
                    if len(k):
                        _, key = lookup(k, w.shingles(n)[1])
                        total[n] += np.bincount(key, minlength=len(k))
        for n, t in total.items():
            some = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int32)), pa.array(some), pa.array(t[some])], names=["n", "k", "c"])

    counted = docs.select("text").mapInArrow(count, "n int, k long, c long").groupBy("n", "k").agg(F.sum("c").alias("c")).collect()  # at most one row for each shingle of the block
    out = {n: np.zeros(len(k), np.int64) for n, k in shared.value.keys.items()}
    for n, k, c in counted:
        out[n][k] = c
    return out


def _probe(shared, text_at: int):
    def make():
        index: Index = shared.value

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            raw, off = utf8(batch.column(text_at))
            n_words, spans, items = np.zeros(len(off) - 1, np.int64), [[] for _ in off[1:]], [[] for _ in off[1:]]
            for a, b in chunks(off):
                w = Words(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                n_words[a:b] = np.diff(w.first)
                win, begin = index.matches(w)
                if not len(win):
                    continue
                cover = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + index.size[win], -1)
                covered = np.cumsum(cover)[:-1] > 0
                docs = w.doc[begin]
                for d in np.unique(docs).tolist():
                    lo, hi = int(w.first[d]), int(w.first[d + 1])
                    spans[a + d] = [{"start": s, "end": e} for s, e in zip(*(x.tolist() for x in runs(covered[lo:hi])), strict=True)]
                for d, k in {*zip(docs.tolist(), win.tolist(), strict=True)}:
                    items[a + d] += index.owners[k]
            return [pa.array([{"n_words": int(n), "spans": s, "items": sorted({*i}, key=_nulls_last)} for n, s, i in zip(n_words, spans, items, strict=True)], pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))]))]

        return step

    return make


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        yield [(r.item, r.text) for r in (items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items).collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """docs with one struct column more (its name is returned too): n_words, spans of hit words, and items.

    Null or empty texts, and texts without a word, have no words and no hits; items with a
    null text, or without a word, have no window. The windows of items with a null id count
    as hits, and all of these items are one null in items (as in SQL). Repeated documents and items each
    count; other columns pass through, and the struct takes a name that docs doesn't have.
    Items above block_bytes are handled in blocks of all their windows, one pass over the
    documents each; the spans of all blocks are united, so no window is lost.
    """
    spark, name = docs.sparkSession, fresh_name(docs, "contamination")
    text_at = docs.columns.index("text")
    out = docs
    parts: list[str] = []
    for items in _blocks(benchmark, block_bytes):
        index = Index(items, window)
        shared = spark.sparkContext.broadcast(index)
        counts = _rarity(docs, shared)
        index = Index(items, window)
        index.choose(counts)
        part = fresh_name(out, "contamination")
        out = by_partition(out, _probe(spark.sparkContext.broadcast(index), text_at), T.StructType([T.StructField(part, RESULT)]))
        parts.append(part)
    if not parts:
        empty = Index([], window)
        empty.choose({n: np.zeros(0, np.int64) for n in empty.keys})
        out = by_partition(out, _probe(spark.sparkContext.broadcast(empty), text_at), T.StructType([T.StructField(name, RESULT)]))
        parts = [name]
    if len(parts) > 1:
        united = F.struct(
            F.col(parts[0])["n_words"].alias("n_words"),
            _united(F.flatten(F.array(*(F.col(p)["spans"] for p in parts)))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(p)["items"] for p in parts))))).alias("items"),
        )
        out = out.withColumn(parts[0], united).drop(*parts[1:])
    return out, parts[0]


def _united(spans):
    """Overlapping or touching spans made one."""
    add = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.expr("cast(array() as array<struct<start:int,end:int>>)"), add)


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out, c = find_contamination(docs.select("doc_id", "text"), benchmark, **options)
    n_hit = F.aggregate(F.col(c)["spans"], F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select(
        "doc_id",
        F.col(c)["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(F.col(c)["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col(c)["items"]), ","), 256).alias("items_sha256"),
        (F.size(F.col(c)["spans"]) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with the columns of docs."""
    out, c = find_contamination(docs, benchmark, **options)
    return out.where(F.size(F.col(c)["spans"]) == 0).select(*docs.columns)
