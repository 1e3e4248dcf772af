"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Without one, a local session gets a temporary folder; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="seekspark-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def made(spark: SparkSession) -> list[str]:
    """The folders that the library has made in this session and not deleted, oldest first; those of the training-data operators are apart."""
    sc = spark.sparkContext
    if not hasattr(sc, "_seekspark_folders"):
        sc._seekspark_folders = []
    return sc._seekspark_folders


def made_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, to be written by the caller and deleted by `clear`."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    made(spark).append(path)
    return path


def materialised(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows written as Parquet and read back: the plan starts anew, and lost executors cost nothing."""
    path = made_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._materialised_at = path
    return out


def discarded_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that the library has made."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in made(spark):
        made(spark).remove(path)


def discarded(*frames: DataFrame) -> None:
    """Deletes materialised rows of which no later plan reads; others are left alone."""
    for df in frames:
        if path := getattr(df, "_materialised_at", None):
            discarded_folder(df.sparkSession, path)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Deletes what was made after the first `since` folders. For callers that have written their results: plans that read these folders fail afterwards."""
    for path in made(spark)[since:]:
        discarded_folder(spark, path)


#: Bytes a core below which rows are dealt out anew: a table so small may be one row group, which is one task.
SMALL_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores before costly work, if by its plan it is small enough for that to be cheap; larger tables have splits enough. Runs nothing."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_BYTES else df
