"""Training-data pipeline over the documents table: each stage works on all that the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seekspark.llm.common import clear, made, shared_dir, ship
from seekspark.llm.decontaminate import drop_contaminated
from seekspark.llm.language_id import keep_identified
from seekspark.llm.line_dedup import drop_repeated_lines
from seekspark.llm.near_dedup import drop_near_duplicates
from seekspark.llm.sentencepiece_lattice import load_pieces, with_ids

#: The public model whose ids the last stage adds.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null, no letter, or words of no learned language. The field is fitted on the rows that aren't held out."""
    ship(spark)
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more that 5 documents have stay only in the largest doc_id."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 on five-word shingles the smallest doc_id stays."""
    ship(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of a benchmark item go."""
    ship(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, how many they are, and whether decoding gives the text back."""
    ship(spark)
    return with_ids(docs, load_pieces(MODEL))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The stages learn models, sketch and spell with a vocabulary file, which SQL doesn't express; tests use a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read by the next.

    What a stage has stored, and the result of the stage before, are deleted once its own result is there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", len(made(spark))
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        clear(spark, before)
        made(spark).append(path)
        docs = spark.read.parquet(path)
    return docs
