"""Question sessions on typed state: values, maps and timers of their own in RocksDB, kept over restarts.

A session holds its open question, the answers so far and a count of its events. A timer
ends a question that nobody answers and clears a session that has been quiet, without
any further message; a session's answers also carry a time to live.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from seekspark.streaming.sessions import KEPT_MS, TIMEOUT_MS

EVENTS = "session_id string, n long, event string, detail string"
_OPEN = "attr string, options array<string>"
_SEEN = "turns int, closed boolean, events long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class QuestionSession(StatefulProcessor):
    """Messages (seq, kind, attr, options, value) of a session to its numbered events.

    A question waits timeout_ms for its answer: an answer that was offered is kept, one that wasn't
    is an error 400 and the question stays open, one that nothing waits for is an error 409. A result
    closes the session. An unanswered question is an error "timeout", which ends the session; any other
    is forgotten kept_ms after its last message.
    """

    def __init__(self, timeout_ms: int = TIMEOUT_MS, kept_ms: int = KEPT_MS) -> None:
        self.timeout_ms, self.kept_ms = timeout_ms, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.seen = handle.getValueState("seen", _SEEN)
        self.answers = handle.getMapState("answers", "attr string", "value string", ttlDurationMs=2 * self.kept_ms)

    def _again_at(self, when: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(when)

    def _forget(self) -> None:
        for state in (self.open, self.seen, self.answers):
            state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        turns, closed, events = self.seen.get() if self.seen.exists() else (0, False, 0)
        attr, options = self.open.get() if self.open.exists() else (None, [])
        out: list[tuple[str, str]] = []
        # Frames are parts of a batch; the session's messages are ordered over all of them.
        for r in sorted((r for f in rows for r in f.to_dict("records")), key=lambda r: r["seq"]):
            if r["kind"] == "question" and not closed:
                attr, options, turns = r["attr"], list(r["options"]), turns + 1
                out.append(("question", attr))
            elif r["kind"] == "answer":
                if attr is None or closed:
                    out.append(("error", "409"))
                elif r["value"] not in options:
                    out.append(("error", "400"))
                else:
                    self.answers.updateValue((attr,), (r["value"],))
                    out.append(("answer", f"{attr}={r['value']}"))
                    attr, options = None, []
            elif r["kind"] == "result" and not closed:
                attr, options, closed = None, [], True
                given = ",".join(sorted(f"{a}={v}" for (a,), (v,) in self.answers.iterator()))
                out.append(("result", f"{r['value'] or ''}|{given}"))
        if turns or closed:  # else nothing was ever asked: there is nothing to remember
            self.seen.update((turns, closed, events + len(out)))
            if attr is None:
                self.open.clear()
            else:
                self.open.update((attr, options))
            self._again_at(timerValues.getCurrentProcessingTimeInMs() + (self.kept_ms if attr is None else self.timeout_ms))
        yield self._events(key, events, out)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting, (_, _, events) = self.open.exists(), self.seen.get() if self.seen.exists() else (0, False, 0)
        self._forget()
        yield self._events(key, events, [("error", "timeout")] if waiting else [])

    def close(self) -> None:
        pass

    @staticmethod
    def _events(key: Any, before: int, out: list[tuple[str, str]]) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]] * len(out), "n": range(before + 1, before + len(out) + 1), "event": [e for e, _ in out], "detail": [d for _, d in out]}).astype({"session_id": str, "n": "int64", "event": str, "detail": str})


def session_events(messages: DataFrame, timeout_ms: int = TIMEOUT_MS, kept_ms: int = KEPT_MS) -> DataFrame:
    """(session_id, n, event, detail) of a stream of messages(session_id, seq, kind, attr, options, value); n counts a session's events. Needs the state store that `with_rocksdb` sets."""
    return messages.groupBy("session_id").transformWithStateInPandas(QuestionSession(timeout_ms, kept_ms), EVENTS, "append", "processingTime")


class with_rocksdb:
    """Streams that start inside keep their state in RocksDB, with a log of changes between snapshots; the session's own settings return afterwards."""

    SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}

    def __init__(self, spark: SparkSession) -> None:
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = {k: self.conf.get(k, None) for k in self.SETTINGS}
        for k, v in self.SETTINGS.items():
            self.conf.set(k, v)

    def __exit__(self, *_) -> None:
        for k, v in self.before.items():
            self.conf.unset(k) if v is None else self.conf.set(k, v)


def state_rows(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """The rows of one of the sessions' state variables (open, seen or answers), as the last batch left them."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
