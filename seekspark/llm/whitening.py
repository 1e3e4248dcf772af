"""Whitening of vectors by exact covariances: GEMM on digit slices, big integers, eigenvectors.

Components are split into limbs of LIMB bits, so that every product that a float64 BLAS
adds up, and every sum of them, is an integer below 2^53 and exact. The products of limbs
are put together as Python's integers, a partition's sums go out as 32-bit digits and meet
in a groupBy, and the covariance is rounded once, when it is divided.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm.common import stored
from seekspark.llm.integer_vectors import as_longs, integer_vectors, largest, matrix, padded

#: Bits of a limb, and rows of a product: 2 * 20 + 12 bits stay below 53.
LIMB, ROWS = 20, 1 << 12
#: Bits of the digits that partitions send.
DIGIT = 32

_SUMS = "i int, j int, digit int, value long"


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x = sum of limb k times 2^(LIMB k): all but the last are in [0, 2^LIMB), the last is signed."""
    out = []
    while largest(x) >= 1 << LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def gram(x: np.ndarray) -> dict[int, np.ndarray]:
    """The exact x^T x of at most ROWS rows: int64 matrices by the power of 2 that each is to be multiplied by."""
    parts, out = limbs(x), {}
    for a, p in enumerate(parts):
        for b, q in enumerate(parts):
            product = (p.T @ q).astype(np.int64)
            shift = LIMB * (a + b)
            out[shift] = out[shift] + product if shift in out else product
    return out


def _sums(dim: int):
    """Vectors to digits of the sums over the partition of (1, x)^T (1, x), upper triangle: n, S and the products in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        upper, rows = np.triu_indices(dim + 1), 0
        for batch in batches:
            x = matrix(batch.column(0), dim)
            for at in range(0, len(x), ROWS):
                own = np.hstack([np.ones((len(x[at : at + ROWS]), 1), np.int64), x[at : at + ROWS]])
                rows += len(own)
                for shift, m in gram(own).items():
                    # int64 holds 2^10 products of 2^53; they go over into Python's integers before that
                    total[shift] = total.get(shift, 0) + (m[upper] if rows < ROWS << 8 else m[upper].astype(object))
        if not rows:
            return
        digits: Counter = Counter()
        for shift, values in total.items():
            for at, value in enumerate(values.tolist()):
                value <<= shift % DIGIT
                digit = shift // DIGIT
                while value not in (0, -1):
                    digits[at, digit] += value & ((1 << DIGIT) - 1)
                    value, digit = value >> DIGIT, digit + 1
                digits[at, digit] += value
        at, digit = (np.array(c, np.int32) for c in zip(*digits, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(upper[0][at].astype(np.int32)), pa.array(upper[1][at].astype(np.int32)), pa.array(digit), pa.array(list(digits.values()), pa.int64())], names=["i", "j", "digit", "value"])

    return run


def moments(fit: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """Of fit(x) exactly: the number of vectors, the sums by dimension, and the sums of products (Python's integers)."""
    sums = fit.mapInArrow(_sums(dim), _SUMS).groupBy("i", "j", "digit").agg(F.sum("value").alias("value"))
    full = np.zeros((dim + 1, dim + 1), object)
    for r in sums.collect():  # a few digits for each pair of dimensions, however many vectors
        full[r.i, r.j] += r.value << (DIGIT * r.digit)
    full = full + np.triu(full, 1).T
    return int(full[0, 0]), [int(v) for v in full[0, 1:]], full[1:, 1:]


def covariance(n: int, sums: list[int], products: np.ndarray) -> np.ndarray:
    """The covariance (divisor n) in doubles: exact integers, equal to those of centred vectors, each rounded once as it is divided."""
    s = np.array(sums, object)
    centred = products * n - np.outer(s, s)
    return np.array([[int(v) / (n * n) for v in row] for row in centred], np.float64).reshape(len(sums), len(sums))


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns; each vector's largest entry is positive. An eigenvalue that rounding can't tell from 0 is 0."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    floor = len(v) * np.finfo(np.float64).eps * max(float(values[0]), 0.0)
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return np.where(values > floor, values, 0.0), vectors * signs


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S exactly: in int64 where that holds it, else in Python's integers."""
    if n * largest(x) + max(map(abs, sums), default=0) < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(y: np.ndarray) -> np.ndarray:
    """Each row's sum of squares, exactly."""
    if y.dtype == np.int64 and y.shape[1] * largest(y) ** 2 >= 1 << 63:
        y = y.astype(object)
    return (y * y).sum(1)


class Whitener:
    """What was learned from a fit list; small, and sent to the tasks."""

    def __init__(self, n: int, sums: list[int], v: np.ndarray, k: int) -> None:
        self.n, self.sums, self.dim = n, sums, len(sums)
        self.values, self.vectors = components(v, min(k, self.dim))
        trace = float(np.trace(v))
        self.explained = [float(e) / trace if trace > 0 else 0.0 for e in self.values]

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened components of rows n x - S; NaN where the eigenvalue is 0."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (y.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values), np.nan)


def _projected(w: Whitener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = w.project(centred(matrix(b.column(0), w.dim), w.n, w.sums))
            yield pa.RecordBatch.from_arrays([pa.array(out[:, c]) for c in range(out.shape[1])], names=[f"w{c}" for c in range(out.shape[1])])

    return run


def _whitened(w: Whitener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        for b in batches:
            y = centred(matrix(b.column(1), w.dim), w.n, w.sums)
            far, z = _squares(y), w.project(y)
            times = lambda a: a.take(pa.array(np.repeat(np.arange(len(y)), k)))
            flat = z.reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [times(b.column(0)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), times(as_longs(far)), times(pa.array(list(map(str, far.tolist())), pa.string())), pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(w.explained, len(y)))],
                names=["vec_id", "component", "deviation", "deviation_digits", "whitened", "explained"],
            )

    return run


def identity_error(fit: DataFrame, w: Whitener) -> float | None:
    """The largest absolute entry of the covariance (divisor n, centred) of the fit list's whitened components less the identity; None without components."""
    real = [c for c in range(len(w.values)) if w.values[c] > 0]
    if not real:
        return None
    rows = fit.mapInArrow(_projected(w), ", ".join(f"w{c} double" for c in range(len(w.values))))
    pairs = [(a, b) for a in real for b in real if a <= b]
    found = rows.agg(*(F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(value - (a == b)) for (a, b), value in zip(pairs, found, strict=True))


def whitening_report(vectors: DataFrame, *, k: int = 4, scale: float = 256.0) -> DataFrame:
    """Each vector of vectors(vec_id, embedding) in the k leading whitened components: a row for each vector and component.

    The fit list is each distinct integer vector once, so copies don't weigh. Columns: vec_id,
    component (from 1), n (of the fit list), deviation (exact sum of squares of n x - S; null where a
    long can't hold it), whitened (null for a component without variance), explained (share of the
    variance), identity_error (see there; null without components), deviation_digits (the same sum in decimal, always whole).

    Left out: vectors that are null, hold a null or non-finite component, or one of 2^62 or more when
    scaled. Shorter vectors, empty ones too, end in zeros. Rows that repeat a vec_id, or have none, each
    get their own rows. There are as many components as dimensions, if that is less than k; no vectors give no rows.
    """
    spark = vectors.sparkSession
    x = integer_vectors(vectors, scale)
    dim = x.agg(F.max(F.size("x"))).first()[0]
    if not dim:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string")
    x = padded(x, dim)
    fit = stored(x.select("x").distinct(), "fit_list")
    n, sums, products = moments(fit, dim)
    w = Whitener(n, sums, covariance(n, sums, products), k)
    error = identity_error(fit, w)
    out = x.mapInArrow(_whitened(w), "vec_id long, component int, deviation long, deviation_digits string, whitened double, explained double")
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"), "deviation_digits")
