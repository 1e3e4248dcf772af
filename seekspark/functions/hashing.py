"""32-bit ids of terms: MurmurHash3 (x86, 32 bits) of their UTF-8 bytes, as a Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.operators.common import let

_MASK = 0xFFFFFFFF
# The hash's constants.
_C1, _C2, _ADD, _MIX1, _MIX2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def _low(c: Column) -> Column:
    return c.bitwiseAND(F.lit(_MASK))


def _times(a: Column, factor: int) -> Column:
    """a * factor modulo 2^32, in two halves, so that no product leaves a long."""
    return let(a, lambda x: _low(x.bitwiseAND(0xFFFF) * F.lit(factor) + F.shiftleft((F.shiftright(x, 16) * F.lit(factor)).bitwiseAND(0xFFFF), 16)))


def _turned(a: Column, by: int) -> Column:
    return let(a, lambda x: _low(F.shiftleft(x, by)).bitwiseOR(F.shiftright(x, 32 - by)))


def _scrambled(block: Column) -> Column:
    return _times(_turned(_times(block, _C1), 15), _C2)


def _folded(a: Column, by: int) -> Column:
    return let(a, lambda x: x.bitwiseXOR(F.shiftright(x, by)))


def murmur3(text: Column, seed: int = 0) -> Column:
    """The hash as an unsigned number in a long; null for null.

    Spark's own hash() treats the last bytes differently, and its numbers are signed.
    """
    digits = F.hex(F.encode(text, "UTF-8"))
    pair = lambda h, at: F.substr(h, at, F.lit(2))
    number = lambda h: F.conv(h, 16, 10).cast("long")

    def of(h: Column) -> Column:
        n = F.floor(F.length(h) / 2).cast("int")
        whole = F.floor(n / 4).cast("int")
        block = lambda i: number(F.concat(*(pair(h, i * 8 + k) for k in (7, 5, 3, 1))))
        blocks = F.transform(F.filter(F.sequence(F.lit(0), whole), lambda i: i < whole), block)
        body = F.aggregate(blocks, F.lit(seed).cast("long"), lambda a, b: _low(_turned(a.bitwiseXOR(_scrambled(b)), 13) * 5 + F.lit(_ADD)))
        rest = F.substr(h, whole * 8 + 1, F.lit(6))
        tail = number(F.concat(F.lit("0"), pair(rest, F.lit(5)), pair(rest, F.lit(3)), pair(rest, F.lit(1))))
        mixed = body.bitwiseXOR(_scrambled(tail)).bitwiseXOR(n.cast("long"))
        return _folded(_times(_folded(_times(_folded(mixed, 16), _MIX1), 13), _MIX2), 16)

    return let(digits, of)


def with_term_ids(postings: DataFrame, key: str = "doc_id", bits: int = 32) -> DataFrame:
    """(key, term_id, tf, dl) of postings(key, term, tf, dl): terms by the low bits of their hash; those of a document that share an id are one, their frequencies added.

    Each distinct term is hashed once, and the ids are joined to the postings.
    """
    ids = postings.select("term").distinct().select("term", murmur3(F.col("term")).bitwiseAND(F.lit((1 << bits) - 1)).alias("term_id"))
    return postings.join(ids, "term").groupBy(key, "term_id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
