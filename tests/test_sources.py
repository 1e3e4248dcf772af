import pytest
from pyspark.sql import functions as F

from seekspark import schema
from seekspark.sources import tables
from seekspark.streaming import sessions


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, a string, b string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_changes(spark):
    old, new = frame(spark, [(1, "x", "y"), (2, "p", "q")]), frame(spark, [(2, "P", None), (3, "n", "m")])
    assert rows(tables.upsert(old, new, ["k"]).na.fill("-")) == [(1, "x", "y"), (2, "P", "-"), (3, "n", "m")]
    assert rows(tables.upsert(old, new, ["k"], ["a"]).na.fill("-")) == [(1, "x", "y"), (2, "P", "q"), (3, "n", "-")]
    assert rows(tables.patched(old, new, ["k"])) == [(1, "x", "y"), (2, "P", "q")]
    assert rows(tables.kept_only(old, new, ["k"])) == [(2, "p", "q")]
    assert [r[0] for r in rows(tables.merged_by_key(old, new, "k").select("k"))] == [1, 2, 3]


def test_ledger(spark):
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    ledger = spark.createDataFrame([("s", "a", "v1", None)], schema.LEDGER)
    assert rows(tables.pending(items, ledger, "s", "v1")) == [("b",)]
    assert tables.pending(items, ledger, "s", "v2").count() == 2
    again = tables.marked_done(tables.marked_done(ledger, items, "s", "v1"), items, "s", "v1")
    assert again.count() == 2


def test_publishing(spark, tmp_path):
    root = f"file://{tmp_path}"
    for n in range(1, 5):
        tables.publish(spark.range(n).toDF("x"), root, "scenes", keep=2)
    assert tables.versions(spark, root, "scenes") == [3, 4]
    assert tables.published(spark, root, "scenes").count() == 4
    manifest = tmp_path / "scenes_v4.json"
    assert manifest.is_file() and '"rows": 4' in manifest.read_text() and not (tmp_path / ".scenes_v4.json").exists()
    assert tables.publish(spark.range(4).toDF("x"), root, "scenes").endswith("scenes_v4")


def test_upsert_takes_a_repeated_key_once(spark):
    old, new = frame(spark, [(1, "x", "y")]), frame(spark, [(1, "b", "c"), (1, "a", "z"), (2, "n", "m"), (2, "n", "m")])
    assert rows(tables.upsert(old, new, ["k"])) == [(1, "a", "z"), (2, "n", "m")]


def test_typed_writes_and_pictures(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5])], "id long, dense array<float>")
    tables.write_vectors(df, f"{tmp_path}/v", df.schema)
    with pytest.raises(TypeError):
        tables.write_vectors(df.selectExpr("id", "cast(dense as array<double>) dense"), f"{tmp_path}/w", df.schema)
    (tmp_path / "images" / "42").mkdir(parents=True)
    for name in ("backdrop_03.jpg", "backdrop_11.jpg", "still_1.jpg", "backdrop_x.jpg", "notes.txt"):
        (tmp_path / "images" / "42" / name).write_bytes(b"abc")
    got = sorted((r.movie, r.n, r.length) for r in tables.list_images(spark, f"{tmp_path}/images").collect())
    assert got == [("42", 3, 3), ("42", 11, 3)]


def test_references(spark):
    good, bad = tables.with_references(frame(spark, [(1, "x", "a"), (2, "z", "a"), (3, None, "a")]), frame(spark, [(9, "x", ""), (8, "x", "")]), "a", "a")
    assert [r.k for r in good.collect()] == [1] and sorted(r.k for r in bad.collect()) == [2, 3]


class State:
    """As much of a group's state as a step uses."""

    def __init__(self, value=None, timed_out=False):
        self.get, self.exists, self.hasTimedOut, self.timeout = value, value is not None, timed_out, None

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_session_state_goes_and_frames_are_ordered_together():
    import pandas as pd

    message = lambda seq, kind, **x: {"seq": seq, "kind": kind, "attr": None, "options": None, "value": None} | x
    step = lambda state, *frames: [tuple(r) for f in sessions._step(("s",), iter([pd.DataFrame(x) for x in frames]), state) for r in f[["event", "detail"]].values]
    state = State()
    assert step(state, [message(2, "answer", value="a")], [message(1, "question", attr="x", options=["a"])]) == [("question", "x"), ("answer", "x=a")]
    assert state.exists and state.timeout == sessions.KEPT_MS
    assert step(state, [message(3, "question", attr="y", options=["b"])]) == [("question", "y")] and state.timeout == sessions.TIMEOUT_MS
    state.hasTimedOut = True
    assert step(state) == [("error", "timeout")] and not state.exists
    state = State(("x", ["a"], 1, False))
    assert step(state, [message(4, "result", value="7")]) == [("result", "7")] and state.exists
    state.hasTimedOut = True
    assert step(state) == [] and not state.exists
    state = State()
    assert step(state, [message(1, "answer", value="a")]) == [("error", "409")] and not state.exists


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("작가", "질문")], "writer string, query string")
    tables.write_csv(df, f"{tmp_path}/out")
    assert rows(tables.read_csv(spark, f"{tmp_path}/out", df.schema)) == [("작가", "질문")]
    part = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv").read_bytes()
    assert part.startswith(b"\xef\xbb\xbfwriter,query")
    (tmp_path / "k.csv").write_bytes("writer,query\n작가,질문\n".encode("cp949"))
    with pytest.raises(ValueError):
        tables.read_csv(spark, f"{tmp_path}/k.csv", df.schema)
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    assert rows(tables.read_csv(spark, f"{tmp_path}/k.csv", df.schema)) == [("작가", "질문")]
    spark.conf.unset("spark.sql.legacy.javaCharsets")
    tables.write_json_lines(df, f"{tmp_path}/j")
    assert rows(tables.read_json_lines(spark, f"{tmp_path}/j", df.schema)) == [("작가", "질문")]
    assert tables.write_counted(df, f"{tmp_path}/p") == 1
    tables.copied(df, f"{tmp_path}/c")
    with pytest.raises(Exception):
        tables.copied(df, f"{tmp_path}/c")
    tables.copied(df, f"{tmp_path}/c", replace=True)
    assert tables.missing(["a", "b"], ["b"]) == ["a"]
    with pytest.raises(LookupError):
        tables.one(df, "writer", "none")


def test_fingerprint_ignores_order(spark):
    a = frame(spark, [(1, "x", "y"), (2, "p", None)])
    assert tables.fingerprint(a) == tables.fingerprint(a.orderBy(F.desc("k")).repartition(3).select("b", "k", "a"))
    assert tables.fingerprint(a) != tables.fingerprint(frame(spark, [(1, "x", "y"), (2, "p", "")]))


MESSAGES = "session_id string, seq long, kind string, attr string, options array<string>, value string"


def test_sessions_pause_and_resume(spark, tmp_path):
    src = f"{tmp_path}/in"
    put = lambda *r: spark.createDataFrame(list(r), MESSAGES).coalesce(1).write.mode("append").parquet(src)
    put(("s", 1, "question", "decade", ["1990s", "unknown"], None), ("t", 1, "answer", None, None, "x"))

    def run():
        stream = sessions.session_events(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src))
        sessions.for_each_batch(stream, lambda df: df, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)

    run()
    put(("s", 2, "answer", None, None, "1800s"), ("s", 3, "answer", None, None, "1990s"), ("s", 4, "result", None, None, "7"))
    run()
    got = [(r.session_id, r.event, r.detail) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted([("s", "question", "decade"), ("t", "error", "409"), ("s", "error", "400"), ("s", "answer", "decade=1990s"), ("s", "result", "7")])


def test_rate_limit(spark):
    df = spark.createDataFrame([("2026-01-01 10:00:00", "a")] * 3 + [("2026-01-02 10:00:00", "a")], "ts string, ip string")
    assert sorted((r.n, r.limited) for r in sessions.rate_limited(df, limit=2).collect()) == [(1, False), (3, True)]


def test_reads_are_pruned_and_filters_pushed(spark, sf):
    plan = tables.table(spark, sf, "documents").where("doc_id > 5").select("lang")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan and "GreaterThan(doc_id,5)" in plan
