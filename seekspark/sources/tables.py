"""Readers and writers: explicit schemas, whole-directory commits, versions by manifest."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from seekspark.sources import versions as manifests

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def state_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and time of the last change of a table: what is derived from it holds while they stay."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()


def one(df: DataFrame, key: str, value) -> DataFrame:
    """The row with the key; raises LookupError without one."""
    found = df.where(F.col(key) == value)
    if found.isEmpty():
        raise LookupError(f"{key} {value}")
    return found


def children(df: DataFrame, key: str, value, order: str) -> DataFrame:
    return df.where(F.col(key) == value).orderBy(order)


def first_n(df: DataFrame, parents: DataFrame, key: str, parent_key: str, n: int) -> DataFrame:
    """Rows of the n parents with the smallest keys."""
    return df.join(parents.select(F.col(parent_key).alias(key)).orderBy(key).limit(n), key, "left_semi")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header, in UTF-8 (with or without a mark) or else in Korean code page 949.

    The bytes of its lines decide. Spark reads code page 949 only while all of Java's
    charsets may be used, which the caller has to allow (spark.sql.legacy.javaCharsets).
    """
    read = lambda encoding: spark.read.csv(path, header=True, schema=schema, encoding=encoding, multiLine=True, enforceSchema=True, escape='"')
    other = spark.read.text(path).where(~F.is_valid_utf8("value"))
    if other.isEmpty():
        return read("UTF-8")
    if spark.conf.get("spark.sql.legacy.javaCharsets") != "true":
        raise ValueError(f"{path} is not in UTF-8; set spark.sql.legacy.javaCharsets to read it in code page 949")
    return read("MS949")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, and the mark before it by which spreadsheets know UTF-8; quotes are doubled and blanks kept."""
    first, *rest = df.columns
    df.select(F.col(f"`{first}`").alias("\ufeff" + first), *(F.col(f"`{c}`") for c in rest)).write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_vectors(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Parquet with the columns and types of schema; the job's commit makes it visible as a whole.

    A column that is missing, or of a type that isn't the schema's, is an error before anything is written.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if wrong := [f"{f.name} {f.dataType.simpleString()}" for f in schema.fields if kinds.get(f.name) != f.dataType]:
        raise TypeError(f"not in the rows: {', '.join(wrong)}")
    df.select(*schema.fieldNames()).write.mode("errorifexists").parquet(path)


def list_images(spark: SparkSession, folder: str, source: str = "backdrop") -> DataFrame:
    """(movie, n, path, length) of the files {folder}/{movie}/{source}_{n}.jpg; files with other names are left out, and no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    part = lambda k: F.regexp_extract("path", rf"([^/]+)/{source}_(\d+)\.jpg$", k)
    return found.select(part(1).alias("movie"), F.nullif(part(2), F.lit("")).cast("long").alias("n"), "path", "length").where("n is not null")


def write_counted(df: DataFrame, path: str) -> int:
    """Writes and checks that as many rows are there as were sent."""
    from pyspark.sql import Observation

    sent = Observation()
    df.observe(sent, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    there = df.sparkSession.read.parquet(path).count()
    if there != sent.get["n"]:
        raise RuntimeError(f"{there} rows of {sent.get['n']} in {path}")
    return there


def fingerprint(df: DataFrame) -> str:
    """The same for the same rows in any order or partitioning: sums of row hashes, and the count."""
    row = F.to_json(F.struct(*sorted(df.columns)))
    parts = [F.sum(F.conv(F.substring(F.sha1(row), k, 8), 16, 10).cast("decimal(38,0)")) for k in (1, 9, 17, 25, 33)]
    return "-".join(str(x) for x in df.agg(F.count("*"), *parts).first())


# ---- versions ------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    fs, p = _fs(spark, root)
    found = [re.fullmatch(rf"{re.escape(name)}_v(\d+)", s.getPath().getName()) for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(m[1]) for m in found if m)


def publish(df: DataFrame, root: str, name: str, *, keep: int = 2) -> str:
    """The path of df's version: a new one, or the current one if its rows are the same. See versions.publish."""
    return manifests.publish(df, root, name, keep=keep).path


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    return manifests.current(spark, root, name)


def version_plan(names: DataFrame, keep: int = 2) -> DataFrame:
    """(collection, version, newest, dropped) of versioned names like scenes_v3."""
    v = names.select(F.regexp_extract("name", r"^(.*)_v(\d+)$", 1).alias("collection"), F.regexp_extract("name", r"^(.*)_v(\d+)$", 2).alias("v")).where("v != ''").select("collection", F.col("v").cast("long").alias("version"))
    k = F.row_number().over(W.Window.partitionBy("collection").orderBy(F.desc("version")))
    return v.withColumn("k", k).select("collection", "version", (F.col("k") == 1).alias("newest"), (F.col("k") > keep).alias("dropped"))


# ---- changes -------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """old with new's rows: for a key in both, the columns (all of new's by default) come from new; a null in new is a value.

    Of rows of new that repeat a key one is taken, the least in the order of their columns.
    """
    columns = columns if columns is not None else [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_new")).select(*keys, "_new.*") if columns else new.select(*keys).distinct()
    n = once.select(*keys, F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in columns))
    take = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return old.join(n, keys, "full_outer").select(*(take(c) if c in columns else F.col(c) for c in old.columns))


def patched(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """df with the non-null values of changes; rows of unknown keys are ignored."""
    columns = [c for c in changes.columns if c not in keys]
    c = changes.select(*keys, *(F.col(x).alias(f"_{x}") for x in columns))
    return df.join(c, keys, "left").select(*(F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in df.columns))


def kept_only(df: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(kept.select(*keys).distinct(), keys, "left_semi")


def merged_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def with_references(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """rows whose key is one of the parents', and those whose isn't (a null key has no parent)."""
    there = parents.select(F.col(parent_key).alias(key)).distinct()
    return rows.join(there, key, "left_semi"), rows.join(there, key, "left_anti")


def created_sessions(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """sessions with new(id, query_text, image_key): ids that are there already stay as they are."""
    fresh = new.dropDuplicates(["id"]).join(sessions, "id", "left_anti").withColumn("created_at", F.current_timestamp())
    return sessions.unionByName(fresh, allowMissingColumns=True)


def finished_sessions(sessions: DataFrame, ends: DataFrame) -> DataFrame:
    """sessions with the outcome in ends(id, rewritten, hard_filters, clarify_turns, results, confidence, timings, cost_usd, trace_run_id).

    results is an array of structs with movie_id, timings a map of milliseconds by step,
    whose sum is the latency; costs are rounded to six digits. Ends of unknown sessions are ignored.
    """
    spent = F.aggregate(F.map_values(F.coalesce("timings", F.expr("cast(map() as map<string,bigint>)"))), F.lit(0).cast("long"), lambda a, x: a + x)
    row = ends.select(
        "id", "rewritten", F.coalesce("hard_filters", F.expr("cast(map() as map<string,string>)")).alias("hard_filters"), F.coalesce("clarify_turns", F.lit(0)).alias("clarify_turns"),
        F.coalesce(F.transform("results", lambda r: r["movie_id"].cast("long")), F.expr("cast(array() as array<bigint>)")).alias("result_movie_ids"), "confidence", spent.cast("int").alias("latency_ms"),
        F.round(F.coalesce("cost_usd", F.lit(0.0)), 6).cast("decimal(10,6)").alias("cost_usd"), "trace_run_id",
    )
    n = row.select("id", F.struct(*(c for c in row.columns if c != "id")).alias("_end"))
    return sessions.join(n, "id", "left").select(*(F.when(F.col("_end").isNotNull(), F.col("_end")[c]).otherwise(F.col(c)).alias(c) if c in row.columns and c != "id" else F.col(c) for c in sessions.columns))


def pending(items: DataFrame, ledger: DataFrame, step: str, version: str, key: str = "item_id") -> DataFrame:
    """Items that the ledger doesn't have as done for the step and version."""
    done = ledger.where((F.col("step") == step) & (F.col("model_version") == version)).select(F.col("item_id").alias(key))
    return items.join(done, key, "left_anti")


def marked_done(ledger: DataFrame, items: DataFrame, step: str, version: str, key: str = "item_id") -> DataFrame:
    """The ledger with the items; those already there keep their time."""
    own = pending(items, ledger, step, version, key).select(F.lit(step).alias("step"), F.col(key).cast("string").alias("item_id"), F.lit(version).alias("model_version"), F.current_timestamp().alias("done_at")).distinct()
    return ledger.unionByName(own)


def cached_vectors(docs: DataFrame, known: DataFrame, key: str = "text_hash") -> tuple[DataFrame, DataFrame]:
    """docs with the vectors that are known by hash, and the distinct hashes and texts to embed."""
    unique = known.groupBy(key).agg(F.first("dense").alias("dense"))
    return docs.join(unique, key), docs.join(unique, key, "left_anti").dropDuplicates([key])


def copied(df: DataFrame, path: str, *, replace: bool = False) -> None:
    """A table written elsewhere; refuses to touch one that is there unless told to replace it."""
    df.write.mode("overwrite" if replace else "errorifexists").parquet(path)


def missing(wanted: list[str], there: list[str]) -> list[str]:
    return sorted({*wanted} - {*there})
