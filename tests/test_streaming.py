"""Streams: sessions with state and timers, event time with late rows, and a sink that shows a batch once."""

import time

import pytest
from pyspark.sql import functions as F

from seekspark.sources import tables
from seekspark.streaming import event_sink, stateful, windows

MESSAGES = "session_id string, seq long, kind string, attr string, options array<string>, value string"


def question(session, seq, attr="decade", options=("1990s", "unknown")):
    return (session, seq, "question", attr, list(options), None)


def say(session, seq, kind, value):
    return (session, seq, kind, None, None, value)


class Sessions:
    """A session stream over a folder of messages; its events are in out."""

    def __init__(self, spark, root, **times):
        self.spark, self.root, self.times = spark, root, times

    def put(self, *rows):
        self.spark.createDataFrame(list(rows), MESSAGES).coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def run(self, **trigger):
        stream = stateful.session_events(self.spark.readStream.schema(MESSAGES).parquet(f"{self.root}/in"), **self.times)
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{self.root}/out/batch={n}")
        with stateful.with_rocksdb(self.spark):
            return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{self.root}/state").trigger(**trigger).start()

    def events(self):
        try:
            rows = self.spark.read.schema(stateful.EVENTS).parquet(f"{self.root}/out").collect()
        except Exception:
            return []  # nothing written yet
        return sorted((r.session_id, r.n, r.event, r.detail) for r in rows)

    def until(self, query, done, seconds=90):
        end = time.time() + seconds
        while time.time() < end and query.isActive and not done():
            time.sleep(0.5)
        assert query.exception() is None


def test_sessions_keep_typed_state_over_restarts(spark, tmp_path):
    s = Sessions(spark, tmp_path, timeout_ms=10**9, kept_ms=10**9)
    s.put(question("s", 1), say("t", 1, "answer", "x"))
    q = s.run(processingTime="1 second")
    s.until(q, lambda: len(s.events()) == 2)
    q.stop()
    assert s.events() == [("s", 1, "question", "decade"), ("t", 1, "error", "409")]
    s.put(say("s", 3, "answer", "1990s"), say("s", 2, "answer", "1800s"), question("s", 4, "genre", ["a"]), say("s", 5, "answer", "a"), say("s", 6, "result", "7"), say("s", 7, "result", "8"), question("s", 8))
    q = s.run(processingTime="1 second")  # a new run over the same state
    s.until(q, lambda: len(s.events()) == 7)
    q.stop()
    assert s.events()[1:6] == [("s", 2, "error", "400"), ("s", 3, "answer", "decade=1990s"), ("s", 4, "question", "genre"), ("s", 5, "answer", "genre=a"), ("s", 6, "result", "7|decade=1990s,genre=a")]
    left = {name: stateful.state_rows(spark, f"{tmp_path}/state", name).count() for name in ("open", "seen", "answers")}
    assert left == {"open": 0, "seen": 1, "answers": 2}  # of t, which was never asked, nothing is kept


def test_a_question_times_out_without_a_further_message(spark, tmp_path):
    s = Sessions(spark, tmp_path, timeout_ms=2000, kept_ms=3000)
    s.put(question("s", 1), question("d", 1), say("d", 2, "result", "5"))
    q = s.run(processingTime="1 second")
    s.until(q, lambda: ("s", 2, "error", "timeout") in s.events() and stateful.state_rows(spark, f"{tmp_path}/state", "seen").count() == 0)
    q.stop()
    assert s.events() == [("d", 1, "question", "decade"), ("d", 2, "result", "5|"), ("s", 1, "question", "decade"), ("s", 2, "error", "timeout")]
    assert [stateful.state_rows(spark, f"{tmp_path}/state", name).count() for name in ("open", "seen", "answers")] == [0, 0, 0]


def replay(spark, sf, root, late):
    """events in four files by time, then `late` rows of the first in a fifth."""
    events = tables.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.orderBy("ts", "event_id").collect()
    step = len(rows) // 4 + 1
    files = [rows[k : k + step] for k in range(0, len(rows), step)] + ([rows[:late]] if late else [])
    for f in files:
        spark.createDataFrame(f, events.schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        time.sleep(1.1)  # files are taken in the order of their times
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def test_a_replay_in_files_equals_the_table_and_counts_late_rows(spark, sf, tmp_path):
    events, stream = replay(spark, sf, tmp_path, 9)
    query = windows.replayed(windows.activity(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    assert windows.late_rows(query) > 0
    got = spark.read.parquet(f"{tmp_path}/out").select("user_id", "start", "finish", "n", F.round("total", 6).alias("total"))
    want = windows.finished(windows.activity(events), events).select("user_id", "start", "finish", "n", F.round("total", 6).alias("total"))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 100


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    ts = lambda m: f"2026-01-01 10:{m:02d}:00"
    schema = "event_id long, ts timestamp, user_id long, value double"
    frame = lambda *r: spark.createDataFrame(r, "event_id long, ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    for f in (frame((1, ts(0), 1, 1.0), (2, ts(1), 1, 2.0), (1, ts(2), 1, 9.0)), frame((2, ts(3), 1, 9.0), (3, ts(4), 2, 3.0))):
        f.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    windows.replayed(windows.without_repeats(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [1, 2, 3]
    table = windows.without_repeats(spark.read.parquet(f"{tmp_path}/in"))
    assert sorted((r.event_id, r.value) for r in table.collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_event_sink_shows_each_batch_once(spark, tmp_path):
    schema = "session_id string, n long, event string"
    put = lambda rows: spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
    put([("s", k, "é") for k in range(5)])

    def run(state):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        event_sink.event_stream(stream, f"{tmp_path}/sink", f"{tmp_path}/{state}").trigger(availableNow=True).start().awaitTermination()

    run("state")
    put([("t", 1, "x")])
    run("state")
    read = lambda: sorted((r.batch, r.session_id, r.n, r.event) for r in event_sink.read_events(spark, f"{tmp_path}/sink", schema).collect())
    want = [(0, "s", k, "é") for k in range(5)] + [(1, "t", 1, "x")]
    assert read() == want
    files = len(list((tmp_path / "sink/staged").iterdir()))
    run("lost")  # a checkpoint that was lost: batch 0 is run again with all rows, and isn't seen twice
    assert read() == want and len(list((tmp_path / "sink/staged").iterdir())) == files


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    writer = event_sink.EventWriter(StructType([StructField("n", LongType())]), str(tmp_path))

    def rows():
        yield (1,)
        raise ValueError("lost")

    with pytest.raises(ValueError):
        writer.write(rows())
    assert list((tmp_path / "staged").iterdir()) == []
    done = [writer.write(iter([(1,)])), writer.write(iter([(2,), (3,)])), None]
    writer.abort(done, 4)
    assert list((tmp_path / "staged").iterdir()) == [] and not (tmp_path / "batches").exists()
    done = [writer.write(iter([(1,)])), None]
    writer.commit(done, 4)
    (tmp_path / "staged/left-over.json").write_text('{"n": 99}\n')
    assert [(r.n, r.batch) for r in event_sink.read_events(spark, str(tmp_path), "n long").collect()] == [(1, 4)]
