"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step handles; a longer text is handled alone.
CHUNK_BYTES = 1 << 20
#: Bytes of one Arrow batch, so that a Python worker's memory doesn't follow the length of texts.
ARROW_BYTES = 4 << 20
#: Rows that may be sent to every executor; beyond that a join shuffles both sides.
BROADCAST_ROWS = 1_000_000
#: Bytes that rows with lists may have to be sent to every executor.
BROADCAST_BYTES = 32 << 20
#: Takes the place of a null doc_id where ids are ordered: such rows come first.
NO_ID = -(2**63)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session (they may have no copy of it), and bounds the bytes of Arrow batches.

    The bound has to be set while a plan runs, and plans run after they are returned: it stays in the session, unless that has a smaller one.
    """
    sc = spark.sparkContext
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if not getattr(sc, "_seekspark_shipped", False):
        import tempfile
        import zipfile
        from pathlib import Path

        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="seekspark-code-")) / "seekspark_code.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
        sc._seekspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one, a local session gets a temporary folder; a cluster has to name one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="seekspark-"))
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read back: cuts the lineage and survives lost executors.

    Inputs of results stay until `clear` takes them; what an operator has no more use for it discards itself.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made(spark).append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_buckets(df: DataFrame, name: str, n: int, *keys: str) -> DataFrame:
    """stored(), in n buckets of the keys, each sorted by them: one file of each where df is partitioned so. Plans on it join by merging inside `sorted_buckets`."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    made(spark).append(path)
    df.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._stored_at, out._table = path, table
    return out


@contextlib.contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Inside, a scan of a bucket that is one file is known to be sorted; the session's setting returns afterwards."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def made(spark: SparkSession) -> list[str]:
    """The folders that this session has stored and not deleted."""
    sc = spark.sparkContext
    if not hasattr(sc, "_seekspark_made"):
        sc._seekspark_made = []
    return sc._seekspark_made


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        made(spark).remove(path)


def discard(*frames: DataFrame) -> None:
    """Deletes stored rows of which no later plan reads."""
    for df in frames:
        if table := getattr(df, "_table", None):
            df.sparkSession.sql(f"drop table {table}")
        _delete(df.sparkSession, [df._stored_at])


def clear(spark: SparkSession, since: int = 0) -> None:
    """Deletes all that was stored after the first `since` folders. For callers that have written their results."""
    _delete(spark, made(spark)[since:])


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if its counted rows (of a fixed width) are within the limit; else joins shuffle it."""
    return F.broadcast(df) if rows <= limit else df


def small_lists(df: DataFrame, lists: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if its rows and the entries of its lists, 16 bytes each, are within the limit of bytes; else joins shuffle it."""
    rows, entries = df.agg(F.count("*"), F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()
    return F.broadcast(df) if 48 * rows + 16 * entries <= limit else df


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once, however often (in lambdas too) then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fresh_name(df: DataFrame, base: str) -> str:
    """base, or base_1, base_2 ..., whichever df has no column of (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (base, *(f"{base}_{k}" for k in range(1, len(taken) + 2))) if n.lower() not in taken)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased; in a text of ASCII alone that is what lower() does, and faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def by_partition(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], fields: T.StructType) -> DataFrame:
    """df with columns added batch by batch; make() runs once a partition and returns the function for a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*df.schema.fields, *fields.fields])
    added = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            new = [a.cast(f.type) if a.type != f.type else a for a, f in zip(step(batch), added, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added.names])
        del step
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Freed memory goes back to the machine: Python processes are used again, and would hold what their largest task took."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of GNU's C library only
    if trim is not None:
        trim(0)


# ---- texts as byte arrays -------------------------------------------------------------

_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def word_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the ranges (both ends included)."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Bytes of words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing, of words that ASCII white space divides, and of letters with all beyond ASCII.
ALNUM = word_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
SOLID = ~word_table((0x20, 0x20), (0x09, 0x0D))
LETTER = word_table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, and where each text starts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES, most: int = 10_000) -> Iterator[tuple[int, int]]:
    """Runs of at most `most` whole texts of at most limit bytes together, or one longer text."""
    n, a = len(off) - 1, 0
    while a < n:
        b = min(n, a + most, max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1))
        yield a, b
        a = b


def lowered(raw: np.ndarray) -> np.ndarray:
    return _TO_LOWER[raw]


def word_spans(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of table's bytes; runs end where texts end."""
    inside = table[raw]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = off[1:-1]
    before[edges[edges < len(raw)]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base & (2**64 - 1)))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Prefix:
    """Polynomial prefix sums (mod 2^64) of bytes: the hash of any slice in constant time."""

    _up = _down = np.zeros(0, np.uint64)

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw) + 1
        if len(Prefix._up) < n:
            Prefix._up, Prefix._down = _powers(_BASE, max(n, 1 << 20)), _powers(_INVERSE, max(n, 1 << 20))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_VALUES[raw] * Prefix._up[: n - 1], out=self.sums[1:], dtype=np.uint64)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * Prefix._down[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes, over text ends too (callers drop those)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = np.full(m, _U(n))
    for k in range(n):
        out = mix(out * _U(0x9FB21C651E98DF25) + words[k : k + m])
    return out


class Known:
    """Sorted distinct keys (unsigned integers), with a bitmap that most others fail at."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.mask = _U((1 << max(16, min(26, int(np.log2(max(1, len(keys)))) + 5))) - 1)
        self.likely = np.zeros(int(self.mask) + 1, bool)
        self.likely[keys & self.mask] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where values are among the keys: positions in values, and in keys."""
        if not len(self.keys) or not len(values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.likely[values & self.mask])
        where = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        same = self.keys[where] == values[at]
        return at[same], where[same]


def lookup(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values are among the sorted distinct keys: positions in values, and in keys."""
    return Known(keys).find(values) if len(keys) and len(values) else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers starts[i], starts[i] + 1, ... (counts[i] of them), and the i of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts[owner] + inner, owner


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
