"""Versions of a table by manifest: a number is claimed, rows are written, and the version is there when its manifest is.

The current version is the newest one with a manifest, so there is no pointer that two publishers could
move against each other: each claims a number of its own by an exclusive create.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def claimed(spark: SparkSession, path: str) -> bool:
    """Creates an empty file unless it is there; of several callers one has True. On the local file system, whose Hadoop client looks before it creates, Java's own exclusive create is used."""
    fs, p = file_system(spark, path)
    jvm = spark._jvm
    try:
        fs.mkdirs(p.getParent())
        if fs.getScheme() == "file":
            jvm.java.nio.file.Files.createFile(jvm.java.io.File(p.toUri().getPath()).toPath(), spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            fs.create(p, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def written_whole(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there with all of its text or not at all."""
    fs, p = file_system(spark, path)
    _, hidden = file_system(spark, f"{path.rpartition('/')[0]}/.{path.rpartition('/')[2]}")
    out = fs.create(hidden, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(hidden, p):
        raise RuntimeError(f"{path} could not be put in place")


def names_in(spark: SparkSession, root: str) -> list[str]:
    fs, p = file_system(spark, root)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def deleted(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def row_hash(df: DataFrame, *columns: str) -> Column:
    """sha1 of a row's columns (all, in the order of their names, unless some are named); null and the empty string differ."""
    own = columns or sorted(df.columns)
    text = lambda c: F.col(c) if df.schema[c].dataType.simpleString() == "string" else F.to_json(F.struct(c)) if df.schema[c].dataType.simpleString().startswith(("array", "map", "struct")) else F.col(c).cast("string")
    return F.sha1(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), text(c)), F.lit("0")) for c in own)))


def rows_fingerprint(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, fingerprint) of the rows of each key, or of all: the same for the same rows in any order and partitioning."""
    parts = [F.sum(F.conv(F.substring("_hash", k, 8), 16, 10).cast("decimal(38,0)")) for k in (1, 9, 17, 25, 33)]
    total = df.withColumn("_hash", row_hash(df)).groupBy(*keys).agg(F.count("*").alias("n"), F.concat_ws("-", *parts).alias("fingerprint"))
    return total


@dataclass(frozen=True)
class Version:
    number: int
    path: str
    rows: int
    fingerprint: str


def versions_of(spark: SparkSession, root: str, name: str) -> list[Version]:
    """The versions that are whole, oldest first."""
    found = [n for n in names_in(spark, root) if re.fullmatch(rf"{re.escape(name)}_v\d+\.json", n)]
    if not found:
        return []
    rows = spark.read.schema("number long, path string, rows long, fingerprint string").json([f"{root}/{n}" for n in found]).collect()  # one row for each kept version
    return sorted((Version(r.number, r.path, r.rows, r.fingerprint) for r in rows), key=lambda v: v.number)


def publish(df: DataFrame, root: str, name: str, *, keep: int = 2, force: bool = False) -> Version:
    """df as the next version, unless the current one has the same rows (force writes it all the same); the newest `keep` stay.

    The rows are counted as they are read back, and a version that has lost some is never shown.
    Versions that were claimed and not finished before the oldest kept one are deleted too.
    """
    spark = df.sparkSession
    own = rows_fingerprint(df).first()
    print_ = f"{own.n}:{own.fingerprint}"
    there = versions_of(spark, root, name)
    if there and there[-1].fingerprint == print_ and not force:
        return there[-1]
    number = max((int(m[1]) for m in (re.fullmatch(rf"{re.escape(name)}_v(\d+)\.(?:claim|json)", n) for n in names_in(spark, root)) if m), default=0) + 1
    while not claimed(spark, f"{root}/{name}_v{number}.claim"):
        number += 1
    path = f"{root}/{name}_v{number}"
    df.write.mode("errorifexists").parquet(path)
    n = spark.read.parquet(path).count()
    if n != own.n:
        raise RuntimeError(f"{n} rows of {own.n} in {path}")
    version = Version(number, path, n, print_)
    written_whole(spark, f"{path}.json", json.dumps(asdict(version)))
    oldest = [v.number for v in versions_of(spark, root, name)][-keep:][0]
    for other in names_in(spark, root):
        m = re.fullmatch(rf"{re.escape(name)}_v(\d+)(\.claim|\.json)?", other)
        if m and int(m[1]) < oldest:
            deleted(spark, f"{root}/{other}")
    return version


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of the newest version; LookupError without one."""
    there = versions_of(spark, root, name)
    if not there:
        raise LookupError(f"no version of {name} in {root}")
    return spark.read.parquet(there[-1].path)
