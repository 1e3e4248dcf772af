"""Fingerprints of documents: threshold-scaled sketches of their character shingles.

A fingerprint keeps every shingle hash below a fixed fraction of all hashes, so it grows
with its text, fingerprints merge, and the containment of a short text in a long one can
be read off. A text with few such hashes keeps its LEAST smallest instead, so short texts
can be compared too. In either case it is complete up to a limit that follows from the
hashes alone, and two fingerprints are compared up to the lower limit of the two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.llm.common import NO_ID, Prefix, by_partition, chunks, fresh_name, lowered, utf8

#: Code points of a shingle; a shorter text is one shingle.
SHINGLE = 12
#: One hash in SCALE is kept, and at least LEAST if there are so many.
SCALE, LEAST = 64, 64
#: Documents of a range of ids that one task puts in order, and ranges at most (their bounds are sent to the tasks).
RANGE_ROWS, MOST_RANGES = 1024, 20_000

_BELOW = np.uint64((1 << 64) // SCALE)
_ALL = np.uint64(2**64 - 1)


def kept_hashes(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a text's shingle hashes: sorted, distinct."""
    below = np.unique(hashes[hashes < _BELOW])
    if len(below) >= LEAST:
        return below
    few = np.unique(np.partition(hashes, 4 * LEAST)[: 4 * LEAST]) if len(hashes) > 4 * LEAST else hashes
    return few[:LEAST] if len(few) >= LEAST and few is not hashes else np.unique(hashes)[:LEAST]


def limit(kept: np.ndarray) -> np.uint64:
    """The hash up to which a fingerprint has all of its text's: any, if it has fewer than LEAST."""
    return _ALL if len(kept) < LEAST else max(kept[-1], _BELOW - np.uint64(1))


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of two texts' shingles together, as far as theirs tell."""
    top = min(limit(a), limit(b))
    both = np.union1d(a, b)
    return both[: max(LEAST, int(np.searchsorted(both, _BELOW)))] if top == _ALL else both[both <= top]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the lesser fingerprint's hashes that the other has, up to where both are complete; equal ones have 1, else an empty one has 0."""
    if np.array_equal(a, b):
        return 1.0
    top = min(limit(a), limit(b))
    a, b = a[: np.searchsorted(a, top, "right")], b[: np.searchsorted(b, top, "right")]
    if not len(a) or not len(b):
        return 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def written(kept: np.ndarray) -> str:
    """16 hexadecimal digits for each hash, in their order."""
    return kept.astype(">u8").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def _points(raw: np.ndarray) -> np.ndarray:
    """Where code points start."""
    return np.flatnonzero((raw & 0xC0) != 0x80)


def sketches(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The fingerprint of each text (A-Z lower-cased) of bytes that lie end to end."""
    prefix, points = Prefix(lowered(raw)), _points(raw)
    first = np.searchsorted(points, off)  # the first code point of each text
    out = []
    for k in range(len(off) - 1):
        own = points[first[k] : first[k + 1]]
        if not len(own):
            out.append(np.zeros(0, np.uint64))
            continue
        n = max(1, len(own) - SHINGLE + 1)
        ends = np.append(own[SHINGLE:], off[k + 1])[:n] if len(own) > SHINGLE else off[k + 1 : k + 2]
        out.append(kept_hashes(prefix.of(own[:n], ends)))
    return out


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column fingerprint (fingerprint_1 ..., if there is one) of each whole text; null and empty texts have the empty one."""
    at = docs.columns.index(text)

    def make():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            raw, off = utf8(batch.column(at))
            return [pa.array([written(s) for a, b in chunks(off) for s in sketches(raw[off[a] : off[b]], off[a : b + 1] - off[a])], pa.string())]

        return step

    return by_partition(docs, make, T.StructType([T.StructField(fresh_name(docs, "fingerprint"), T.StringType())]))


# ---- documents beside the next one ----------------------------------------------------


def _dealt(bounds: np.ndarray, first: int):
    """Rows (key, doc_id, text) to their range of ids; a range's first document, and the first of all, goes to the range before (to the last one) as a guest too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy()
            part = np.searchsorted(bounds, key, "right")
            leads = np.flatnonzero((part > 0) & (key == bounds[part - 1])) if len(bounds) else np.zeros(0, np.int64)
            heads = np.flatnonzero(key == first)
            rows = np.concatenate([np.arange(len(key)), leads, heads])
            to = np.concatenate([part, part[leads] - 1, np.full(len(heads), len(bounds))]).astype(np.int32)
            guest = np.arange(len(rows)) >= len(key)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(guest), *(c.take(pa.array(rows)) for c in b.columns)], names=["part", "guest", *b.schema.names])

    return run


def _beside_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges in order, each ended by its guests, to a row for each document that isn't a guest: the next row is the next document."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        held = table.slice(table.num_rows - 1)
        own, guest = table.column("doc_id"), table.column("guest").to_numpy()
        raw, off = utf8(table.column("text"))
        for a, b in chunks(off[:-1]):
            keep = [k for k in range(a, b) if not guest[k]]
            if not keep:
                continue
            piece, at = raw[off[a] : off[b + 1]], off[a : b + 2] - off[a]
            points = _points(piece)
            first = np.searchsorted(points, at)
            prints = sketches(piece, at)
            edited = []
            for k in keep:
                i = k - a
                n, there = first[i + 1] - first[i], first[i + 2] - first[i + 1]
                cut = n // 4
                stop = points[first[i + 1] - cut] if cut else at[i + 1]
                more = points[first[i + 1] + cut] if cut < there else at[i + 2]
                edited.append(piece[at[i] : stop].tobytes() + piece[at[i + 1] : more].tobytes())
            changed = sketches(np.frombuffer(b"".join(edited), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in edited])]))
            yield pa.RecordBatch.from_arrays(
                [
                    own.take(pa.array(keep)).combine_chunks(),
                    pa.array([int(first[k - a + 1] - first[k - a]) for k in keep], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                    pa.array([written(prints[k - a]) for k in keep]),
                    pa.array([written(c) for c in changed]),
                    pa.array([likeness(prints[k - a], c) for k, c in zip(keep, changed, strict=True)], pa.float64()),
                    pa.array([likeness(prints[k - a], prints[k - a + 1]) for k in keep], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def fingerprint_report(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each document of docs(doc_id, text) with its fingerprint, that of its edited text, and how like they are.

    The edited text has the last quarter (rounded down) of the code points replaced by as many of the next
    document's first (all, if it has fewer); the next is that of the next doc_id, after the last the first.
    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited
    (likeness to the edited text's fingerprint), near_next (to the next document's).

    Null texts are empty, and an empty text has the empty fingerprint, which is like itself (1) and nothing else (0).
    Rows without doc_id come first; rows that repeat one are ordered by text, and each has its own row. A single
    document is its own next. No documents give no rows. Other columns are left out.

    Texts are shuffled once, into ranges of ids that are put in order; each range also gets the document that follows it.
    """
    spark = docs.sparkSession
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, first = rows.agg(F.count("*"), F.min("key")).first()
    if not n:
        return spark.createDataFrame([], schema)
    ranges = max(1, min(n // range_rows, MOST_RANGES))
    bounds = rows.agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)], max(10_000, 8 * ranges))).first()[0] if ranges > 1 else []
    bounds = np.array(sorted({*bounds} - {first}), np.int64)
    dealt = rows.mapInArrow(_dealt(bounds, first), "part int, guest boolean, key long, doc_id long, text string")
    ordered = dealt.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "guest", "key", "text")
    return ordered.select("guest", "doc_id", "text").mapInArrow(_beside_next, schema)
