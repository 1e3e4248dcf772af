"""Event-time streams: repeats dropped and sessions of activity closed as the watermark passes; the same plans run over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: How late a row may come, and the pause that ends a session of activity.
LATENESS, GAP = "1 hour", "30 minutes"


def _timed(events: DataFrame, lateness: str) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", lateness) if events.isStreaming else rows


def without_repeats(events: DataFrame, key: str = "event_id", lateness: str = LATENESS) -> DataFrame:
    """One row of each key: in a stream the first to come, and repeats that come while the watermark can still tell; in a table the earliest."""
    rows = _timed(events, lateness)
    if events.isStreaming:
        return rows.dropDuplicatesWithinWatermark([key])
    rest = [c for c in rows.columns if c not in (key, "ts")]
    first = rows.groupBy(key).agg(F.min(F.struct("ts", *rest)).alias("_first"))
    return first.select(key, "_first.*").select(*rows.columns)


def activity(events: DataFrame, gap: str = GAP, lateness: str = LATENESS, key: str = "user_id", value: str = "value") -> DataFrame:
    """(key, start, finish, n, total): runs of a user's events no further apart than gap; finish is gap after the last.

    A stream gives a run when the watermark has passed its finish; rows that come later than lateness are left out (see late_rows).
    """
    rows = _timed(events, lateness)
    runs = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return runs.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n", "total")


def finished(runs: DataFrame, events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Of a table's runs those that a stream of the same rows would have given: the watermark of the latest row has passed their finish."""
    mark = events.agg((F.max(F.col("ts").cast("timestamp")) - F.expr(f"interval {lateness}")).alias("_mark"))
    return runs.join(F.broadcast(mark), F.col("finish") <= F.col("_mark")).drop("_mark")  # one row


def late_rows(query: StreamingQuery) -> int:
    """Rows that operators with state left out because they came behind the watermark. Of the progress that the query still holds."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def replayed(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over all that is there, and writes each batch's rows once to a folder of its own; ends when the last watermark has been applied."""
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{sink}/batch={n}")
    query = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
