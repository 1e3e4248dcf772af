"""Streams of requests: rate limits, and question sessions that pause until an answer comes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAILY_LIMIT = 30
#: How long a question waits for its answer, and how long a session that has ended is remembered.
TIMEOUT_MS, KEPT_MS = 30_000, 600_000

EVENTS = "session_id string, event string, detail string"
_STATE = "attr string, options array<string>, turns int, closed boolean"


def rate_limited(requests: DataFrame, limit: int = DAILY_LIMIT, lateness: str = "1 hour") -> DataFrame:
    """(day, ip, n, limited) of requests(ts, ip): how many an address sent on a day, and whether that is too many."""
    ts = requests.withColumn("ts", F.col("ts").cast("timestamp"))
    if requests.isStreaming:
        ts = ts.withWatermark("ts", lateness)
    days = ts.groupBy(F.window("ts", "1 day"), "ip").agg(F.count("*").alias("n"))
    return days.select(F.col("window.start").alias("day"), "ip", "n", (F.col("n") > limit).alias("limited"))


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (session,) = key
    attr, options, turns, closed = state.get if state.exists else (None, None, 0, False)
    if state.hasTimedOut:
        state.remove()
        if not closed:
            yield pd.DataFrame({"session_id": [session], "event": ["error"], "detail": ["timeout"]})
        return
    out: list[tuple[str, str]] = []
    # Frames are parts of a batch; the session's messages are ordered over all of them.
    rows = sorted((r for f in frames for r in f.to_dict("records")), key=lambda r: r["seq"])
    for r in rows:
        if r["kind"] == "question" and not closed:
            attr, options, turns = r["attr"], list(r["options"]), turns + 1
            out.append(("question", attr))
        elif r["kind"] == "answer":
            if attr is None or closed:
                out.append(("error", "409"))
            elif r["value"] not in options:
                out.append(("error", "400"))
            else:
                out.append(("answer", f"{attr}={r['value']}"))
                attr, options = None, None
        elif r["kind"] == "result" and not closed:
            attr, options, closed = None, None, True
            out.append(("result", r["value"] or ""))
    if attr is None and not closed and not turns:
        if state.exists:
            state.remove()  # nothing was ever asked: there is nothing to remember
    else:
        state.update((attr, options, turns, closed))
        state.setTimeoutDuration(TIMEOUT_MS if attr is not None else KEPT_MS)
    yield pd.DataFrame({"session_id": [session] * len(out), "event": [e for e, _ in out], "detail": [d for _, d in out]})


def session_events(messages: DataFrame) -> DataFrame:
    """Events of messages(session_id, seq, kind, attr, options, value): questions, answers and results in order.

    An answer that nothing waits for is an error 409, one that wasn't offered an error
    400 (the question stays open); a question without an answer in time ends the session.
    The state of a session goes when that happens, and KEPT_MS after its last message if
    nothing is asked, so state doesn't grow with the sessions that ever were.
    """
    return messages.groupBy("session_id").applyInPandasWithState(_step, EVENTS, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Runs a batch plan on each micro-batch and writes its rows to a folder of their own batch: a batch that is run again replaces its rows.

    Ends when all that was there is done; timeouts are seen with the next messages.
    """

    def write(batch: DataFrame, n: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    # Else timeouts by the clock ask for empty batches without end. The stream takes the setting as it starts.
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
