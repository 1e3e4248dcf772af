"""Near-duplicate documents by fast similarity sketching.

Dahlgaard, Knudsen and Thorup's sketch ("Fast Similarity Sketching", FOCS 2017): in
round i every element is thrown into one random bin and leaves i + its random fraction
there if that is less; from round t on all elements go to bin i - t. A set stops when
each of its t bins has a value, which 2t rounds guarantee, and the sketch has the
concentration bounds of t independent min-hashes. Bands of the sketch propose pairs;
pairs are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.llm.common import SOLID, Prefix, by_partition, chunks, discard, give_back, lowered, mix, shingles, small_side, stored, utf8, word_spans
from seekspark.llm.components import components

#: A pair at similarity 0.8 shares none of the 32 bands of 5 with probability 3e-6.
BANDS, ROWS = 32, 5
#: Bits of the one-bit sketch that pairs behind the bucket's lead are screened with, and the standard deviations that a pair may lie below the threshold (a pair at the threshold is lost with probability 3e-6).
SCREEN_BITS, SCREEN_SIGMA = 2048, 4.5

#: Rows of one block of a large bucket; the pairs of two blocks are one cell of the join behind the lead.
CELL_ROWS = 2000

_U = np.uint64
_EMPTY = _U(2**64 - 1)


def shingle_sets(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text end to end, and where each text's begin.

    A text of fewer than n words, but not none, has its whole sequence as the one shingle.
    """
    low = lowered(raw)
    start, end, doc = word_spans(low, off, SOLID)
    word = Prefix(low).of(start, end)
    first = np.searchsorted(doc, np.arange(len(off)))
    all_n = shingles(word, n)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            sets.append(np.unique(all_n[a : b - n + 1]))
        else:
            sets.append(shingles(word[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    size = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(size)])


def sketch(elements: np.ndarray, begin: np.ndarray, t: int) -> np.ndarray:
    """t values for each set (a row; sets without elements stay empty)."""
    n_sets = len(begin) - 1
    bins = np.full((n_sets, t), _EMPTY)
    flat = bins.reshape(-1)
    owner = np.repeat(np.arange(n_sets), np.diff(begin))
    for i in range(2 * t):
        if not len(elements):
            break
        h = mix(elements ^ mix(np.full(1, i + 1, np.uint64)))
        at = owner * t + ((h >> _U(40)) % _U(t)).astype(np.int64) if i < t else owner * t + (i - t)
        np.minimum.at(flat, at, (_U(i) << _U(54)) | (h & _U((1 << 40) - 1)))
        if i >= 1 or len(elements) > 4 * t * n_sets:
            open_sets = (bins == _EMPTY).any(axis=1)
            if not open_sets.all():
                left = open_sets[owner]
                elements, owner = elements[left], owner[left]
    return bins


def band_keys(bins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(bins), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(bins), _U(b + 1))
        for r in range(rows):
            h = mix(h * _U(0x9FB21C651E98DF25) + bins[:, b * rows + r])
        out[:, b] = h
    return out


def _sketches(n: int, bands: int, rows: int):
    def make():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            raw, off = utf8(batch.column(1))
            size, h1, h2, keys = [], [], [], []
            for a, b in chunks(off):
                s, begin = shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], n)
                size.append(np.diff(begin))
                for h, salt in ((h1, 0x1234567), (h2, 0x89ABCDE)):
                    total = np.zeros(len(s) + 1, np.uint64)
                    np.cumsum(mix(s + _U(salt)), out=total[1:], dtype=np.uint64)
                    h.append(total[begin[1:]] - total[begin[:-1]])
                keys.append(band_keys(sketch(s, begin, bands * rows), bands, rows))
            join = lambda x, kind=np.uint64: np.concatenate(x) if x else np.zeros(0, kind)
            n_docs = len(off) - 1
            flat = join([k.reshape(-1) for k in keys]).view(np.int64)
            return [pa.array(join(size, np.int64)), pa.array(join(h1).view(np.int64)), pa.array(join(h2).view(np.int64)), pa.ListArray.from_arrays(np.arange(n_docs + 1, dtype=np.int32) * bands, pa.array(flat))]

        return step

    return make


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(1))
            for a, b in chunks(off):
                s, begin = shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(begin.astype(np.int32), pa.array(s.view(np.int64)))], names=["id", "s"])
        give_back()

    return run


def _screens(n: int):
    """The least bit of each of SCREEN_BITS sketch values: equal with probability (1 + similarity) / 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(1))
            for a, b in chunks(off, most=1000):
                s, begin = shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], n)
                words = np.packbits((sketch(s, begin, SCREEN_BITS) & _U(1)).astype(bool), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(words.shape[1]))], names=["id", *(f"b{k}" for k in range(words.shape[1]))])
        give_back()

    return run


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").join(small_side(ids, ids.count()), "doc_id", "left_semi")


def _confirmed(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough."""
    pairs = stored(pairs, "pairs")
    ids = stored(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "ids")
    sets = stored(_texts_of(docs, ids).mapInArrow(_sets(n), "id long, s array<long>"), "sets")
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    out = stored(both.withColumn("c", common).where(F.expr(f"100L * c >= {percent}L * (size(a) + size(b) - c)")).select("u", "v"), "confirmed")
    discard(pairs, ids, sets)
    return out


def _alike(percent: int) -> str:
    return f"100L * least(m, n) >= {percent}L * greatest(m, n)"


def _buckets(base: DataFrame, copied: DataFrame, n_copied: int) -> DataFrame:
    """(k, band, id, n, size, u, m): the members of each band's bucket of two or more, with the bucket's lead u and its set size m.

    Of equal sets the representative alone is a member. Only band keys are counted over all
    documents; members are shuffled where their key repeats. The lead is the text with the
    most copies (of several one by hash).
    """
    reps = base.where("doc_id is not null and n_shingles > 0").join(small_side(copied, n_copied), ["h1", "h2"], "left").where("rep is null or rep = doc_id")
    keys = stored(reps.select(F.explode("bands").alias("k")).groupBy("k").count().where("count > 1").select("k"), "keys")
    members = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.coalesce("copies", F.lit(1)).alias("copies"), F.posexplode("bands").alias("band", "k"))
    members = stored(members.join(small_side(keys, keys.count()), "k").distinct(), "members")
    order = F.shiftleft("copies", 32) + F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    leads = members.groupBy("k").agg(F.max_by("id", order).alias("u"), F.max_by("n", order).alias("m"), F.count("*").alias("size")).where("size > 1")
    out = stored(members.drop("copies").join(leads, "k").select("k", "band", "id", "n", "size", "u", "m"), "buckets")
    discard(keys, members)
    return out


def _met(rest: DataFrame, percent: int, cell_rows: int) -> DataFrame:
    """(u, v): pairs of one bucket and two components that may be similar, by set sizes and the screen.

    A bucket's rows are dealt into blocks of about cell_rows, and each two blocks meet in a
    cell of their own, so that no task holds a whole large bucket.
    """
    n_words = SCREEN_BITS // 64
    far = (1 - percent / 100) / 2
    most = int(SCREEN_BITS * far + SCREEN_SIGMA * (SCREEN_BITS * far * (1 - far)) ** 0.5)
    sizes = stored(rest.groupBy("k").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("blocks")), "sizes")
    dealt = rest.join(small_side(sizes, sizes.count()), "k").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    seats = stored(dealt.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("blocks", "other"), "seats")
    apart = " + ".join(f"bit_count(a.b{k} ^ b.b{k})" for k in range(n_words))
    shared = "array_position(zip_with(a.bands, b.bands, (x, y) -> x = y), true) = a.band + 1"  # a pair counts in the first bucket that it shares
    on = f"a.k = b.k and a.x = b.x and a.y = b.y and (a.block = b.block) = (a.x = a.y) and a.id < b.id and a.c != b.c and 100L * least(a.n, b.n) >= {percent}L * greatest(a.n, b.n) and {apart} <= {most} and {shared}"
    return seats.alias("a").join(seats.alias("b"), F.expr(on)).select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()


def _same_document(base: DataFrame, copied: DataFrame, n_copied: int) -> DataFrame:
    """(u, v): the classes of equal sets that the rows of one repeated doc_id are in, each linked with that doc_id."""
    real = base.where("doc_id is not null and n_shingles > 0").select("doc_id", "h1", "h2")
    again = stored(base.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    n = again.count()
    rows = real.join(small_side(again, n), "doc_id", "left_semi").join(small_side(copied, n_copied), ["h1", "h2"])
    out = stored(rows.where("rep != doc_id").select(F.col("rep").alias("u"), F.col("doc_id").alias("v")).distinct(), "same")
    discard(again)
    return out


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Documents are linked where 100 * intersection >= percent * union of their sets of
    distinct word shingles; component_id is the least doc_id that can be reached. Texts
    that are null, empty or white space have no shingle and no link. Equal sets make one
    class before any pair is looked at. Rows that repeat a doc_id are one document, with the
    links of each of its texts, though each row has its own n_shingles;
    a row with a null doc_id is linked with nothing and has a null component_id.
    """
    base = stored(by_partition(docs.select("doc_id", "text"), _sketches(words, bands, rows), T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])).drop("text"), "sketches")
    real = base.where("doc_id is not null and n_shingles > 0")
    copied = stored(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "copied")
    n_copied = copied.count()

    # Each member of a bucket against the bucket's lead.
    bucket = _buckets(base, copied, n_copied)
    star = stored(bucket.where("id != u").where(_alike(percent)).select(F.least("u", "id").alias("u"), F.greatest("u", "id").alias("v")).distinct(), "star")
    real_docs = docs.where("doc_id is not null")
    same = _same_document(base, copied, n_copied)
    links = stored(_confirmed(real_docs, star, words, percent).unionAll(same), "links_and_ids")
    discard(same)
    labels = components(links)

    # The others of a bucket, where more than one component is left: pairs across components that pass the screen.
    open_rows = bucket.where("size > 2").join(labels, "id", "left").select("k", "band", "id", "n", "u", F.coalesce("component", "id").alias("c"))
    open_rows = stored(open_rows, "open")
    mixed = open_rows.groupBy("k").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 != c2").select("k")
    rest = stored(open_rows.join(mixed, "k", "left_semi").where("id != u").drop("u"), "rest")
    ids = stored(rest.select(F.col("id").alias("doc_id")).distinct(), "ids")
    screens = _texts_of(real_docs, ids).mapInArrow(_screens(words), "id long, " + ", ".join(f"b{k} long" for k in range(SCREEN_BITS // 64)))
    own_bands = real.select(F.col("doc_id").alias("id"), "bands").join(small_side(ids.select(F.col("doc_id").alias("id")), ids.count()), "id", "left_semi")
    screens = stored(screens.dropDuplicates(["id"]).join(own_bands.dropDuplicates(["id"]), "id"), "screens")
    more = _met(rest.join(screens, "id"), percent, cell_rows).join(star, ["u", "v"], "left_anti")
    more_links = _confirmed(real_docs, more, words, percent)
    if not more_links.isEmpty():
        labels = components(links.union(more_links))
    discard(bucket, star, links, open_rows, rest, ids, screens, more_links)

    out = base.drop("bands").join(small_side(copied.select("h1", "h2", "rep"), n_copied), ["h1", "h2"], "left")
    out = out.withColumn("rep", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    labels = labels.select(F.col("id").alias("rep"), "component")
    out = out.join(small_side(labels, labels.count()), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def near_duplicate_report(docs: DataFrame, **options) -> DataFrame:
    """near_duplicates() with kept: whether the document is the one of its component that stays."""
    return near_duplicates(docs, **options).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that stand behind a smaller doc_id of their component; columns as in docs."""
    gone = stored(near_duplicates(docs, **options).where("doc_id != component_id").select("doc_id").distinct(), "gone")
    return docs.join(small_side(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
