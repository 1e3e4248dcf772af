"""Stored indexes of the attributes that hard filters use: each filter is answered by files of its own values.

`rows` has a directory for each decade and animation flag; in it rows are sorted by country, whose row groups
Parquet's statistics and dictionaries tell apart, and have a Bloom filter of their keys. `genres` has the keys of each genre, in a directory for each
bucket of genre hashes, since no statistics can tell what an array holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seekspark.operators.filters import HOME, hard_filter
from seekspark.sources.shared import made_folder

#: Buckets of genre hashes.
GENRE_BUCKETS = 16
#: Rows of one file at most: a frequent decade is several files, and a country is in few of them.
FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class Payload:
    """Where the indexes are, the key, and the columns of both tables (an empty one has no file to tell them)."""

    path: str
    key: str
    rows: StructType
    genres: StructType


def indexed(attrs: DataFrame, key: str, path: str | None = None, *, file_rows: int = FILE_ROWS) -> Payload:
    """Stores attrs(key, decade, country, genres, is_animation, ...). Rows are shuffled once, into ranges of (decade, flag, country)."""
    path = path or made_folder(attrs.sparkSession, "payload")
    cut = ["decade", "is_animation", "country"]
    (
        attrs.repartitionByRange(*cut, key)
        .sortWithinPartitions(*cut, key)
        .write.partitionBy("decade", "is_animation")
        .option("maxRecordsPerFile", file_rows)
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.enable.dictionary#{key}", "false")  # a column with a dictionary gets no Bloom filter
        .parquet(f"{path}/rows")
    )
    genres = attrs.select(F.explode("genres").alias("genre"), key).where("genre is not null").distinct()
    genres = genres.withColumn("bucket", _bucket("genre"))
    genres.repartitionByRange("bucket", "genre", key).sortWithinPartitions("bucket", "genre", key).write.partitionBy("bucket").option("maxRecordsPerFile", file_rows).parquet(f"{path}/genres")
    return Payload(path, key, attrs.schema, genres.schema)


def _bucket(genre):
    return F.pmod(F.xxhash64(genre), F.lit(GENRE_BUCKETS)).cast("int")


def keys_of(spark: SparkSession, payload: Payload, filters: dict[str, str], home: str = HOME) -> DataFrame:
    """(key) of the rows that pass a hard filter (see filters.hard_filter), from the files that can hold them.

    A genre is looked up among the keys of its bucket; the other attributes choose directories, and row groups by country. A genre alone reads no rows.
    """
    rest = {k: v for k, v in filters.items() if k != "genre"}
    keys = None
    if "genre" in filters:
        found = spark.read.schema(payload.genres).parquet(f"{payload.path}/genres")
        bucket = spark.range(1).select(_bucket(F.lit(filters["genre"])).alias("b")).first().b
        keys = found.where((F.col("bucket") == bucket) & (F.col("genre") == filters["genre"])).select(payload.key)
        if not rest:
            return keys
    rows = spark.read.schema(payload.rows).parquet(f"{payload.path}/rows")
    rows = rows.where(hard_filter(rest, home)).select(payload.key)
    return rows if keys is None else rows.join(keys, payload.key, "left_semi")


def of_key(spark: SparkSession, payload: Payload, value) -> DataFrame:
    """The rows with a key: row groups whose Bloom filter doesn't have it are skipped."""
    return spark.read.schema(payload.rows).parquet(f"{payload.path}/rows").where(F.col(payload.key) == value)
