"""Stored tables: filters that read few files, versions that publishers can't share, changes that leave other files alone."""

import threading

import pytest
from pyspark.sql import functions as F

from seekspark.operators import filters, report
from seekspark.sources import payload, ranges, shared, versions

ATTRS = "movie_id long, decade string, country string, genres array<string>, is_animation boolean"


def scanned(df):
    """(files, rows) that the scans of a plan have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan

    def leaves(p):
        kids = p.children()
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            yield from leaves(p.plan())
        elif kids.isEmpty():
            yield p
        for k in range(kids.size()):
            yield from leaves(kids.apply(k))

    own = [p.metrics() for p in leaves(plan) if p.metrics().contains("numFiles")]
    return sum(m.apply("numFiles").value() for m in own), sum(m.apply("numOutputRows").value() for m in own)


@pytest.fixture(scope="module")
def attrs(spark):
    countries = ["KR", "US", None, "FR", "JP"]
    rows = [(k, f"{1950 + k % 7 * 10}s" if k % 11 else None, countries[k % 5], [f"g{k % 6}", f"g{k % 4}"] if k % 9 else [None], None if k % 8 == 0 else k % 3 == 0) for k in range(3000)]
    return spark.createDataFrame(rows, ATTRS).cache()


@pytest.mark.parametrize("wanted", [{"decade": "1970s"}, {"country": "US"}, {"country": "other"}, {"country": "KR"}, {"genre": "g5"}, {"is_animation": "true"}, {"is_animation": "false", "decade": "1950s", "country": "FR", "genre": "g2"}, {"genre": "none"}, {}])
def test_payload_keys_are_those_of_the_filter(spark, attrs, wanted):
    own = payload.indexed(attrs, "movie_id")
    got = [r.movie_id for r in payload.keys_of(spark, own, wanted).collect()]
    assert sorted(got) == sorted(r.movie_id for r in attrs.where(filters.hard_filter(wanted)).collect())


def test_each_attribute_reads_its_own_files(spark, attrs):
    own = payload.indexed(attrs, "movie_id", file_rows=20)
    all_files, all_rows = scanned(spark.read.parquet(f"{own.path}/rows").select("movie_id"))
    assert all_rows == 3000 and all_files > 100
    files, rows = scanned(payload.keys_of(spark, own, {"decade": "1970s"}))
    assert files < all_files / 4 and rows == attrs.where("decade = '1970s'").count()
    files, rows = scanned(payload.keys_of(spark, own, {"is_animation": "true"}))
    assert files < all_files / 2 and rows == attrs.where("is_animation").count()
    _, rows = scanned(payload.keys_of(spark, own, {"country": "US"}))
    assert rows <= 2 * attrs.where("country = 'US'").count()  # row groups without it are skipped by their statistics
    genres, genre_rows = scanned(spark.read.parquet(f"{own.path}/genres").select("movie_id"))
    files, rows = scanned(payload.keys_of(spark, own, {"genre": "g5"}))
    assert files < genres and rows < genre_rows / 3
    with pytest.raises(ValueError):
        payload.keys_of(spark, own, {"mood": "sad"})
    assert payload.keys_of(spark, payload.indexed(attrs.where("false"), "movie_id", None), {"genre": "g1"}).collect() == []


def test_bloom_filters_are_written(spark, attrs):
    own = payload.indexed(attrs, "movie_id")
    import pathlib

    files = [p for p in pathlib.Path(own.path.removeprefix("file:")).rglob("rows/**/*.parquet")]
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(str(files[0]))
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, spark._jsc.hadoopConfiguration()))
    try:
        columns = reader.getFooter().getBlocks().get(0).getColumns()
        have = {columns.get(k).getPath().toDotString(): columns.get(k).getBloomFilterOffset() for k in range(columns.size())}
    finally:
        reader.close()
    assert have["movie_id"] > 0
    assert [r.movie_id for r in payload.of_key(spark, own, 77).collect()] == [77] and scanned(payload.of_key(spark, own, 10**9))[1] == 0


def test_versions_skip_what_is_unchanged_and_keep_the_newest(spark, tmp_path):
    root, df = str(tmp_path), spark.range(5).toDF("x")
    assert versions.publish(df, root, "s").number == 1
    assert versions.publish(df.orderBy(F.desc("x")).repartition(3), root, "s").number == 1  # the same rows: nothing is written
    assert versions.publish(df, root, "s", force=True).number == 2
    for n in (6, 7):
        versions.publish(spark.range(n).toDF("x"), root, "s")
    assert [(v.number, v.rows) for v in versions.versions_of(spark, root, "s")] == [(3, 6), (4, 7)]
    assert versions.current(spark, root, "s").count() == 7
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["s_v3", "s_v3.claim", "s_v3.json", "s_v4", "s_v4.claim", "s_v4.json"]
    with pytest.raises(LookupError):
        versions.current(spark, root, "other")
    assert versions.publish(spark.createDataFrame([], "x long"), root, "empty").rows == 0 and versions.current(spark, root, "empty").count() == 0


def test_publishers_never_share_a_number(spark, tmp_path):
    root, got = str(tmp_path), []

    def work(n):
        got.append(versions.publish(spark.range(n).toDF("x"), root, "s", keep=99))

    threads = [threading.Thread(target=work, args=(n,)) for n in range(1, 7)]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    assert sorted(v.number for v in got) == [1, 2, 3, 4, 5, 6]
    for v in got:
        assert spark.read.parquet(v.path).count() == v.rows
    # A version that was claimed and never finished is not seen.
    assert versions.claimed(spark, f"{root}/s_v7.claim") and not versions.claimed(spark, f"{root}/s_v7.claim")
    assert versions.versions_of(spark, root, "s")[-1].number == 6
    assert versions.publish(spark.range(50).toDF("x"), root, "s").number == 8


def test_fingerprints_tell_null_from_empty_and_follow_all_types(spark):
    schema = "k long, a string, b array<string>, c double"
    f = lambda *rows: {r.k: (r.n, r.fingerprint) for r in versions.rows_fingerprint(spark.createDataFrame(rows, schema), "k").collect()}
    one = f((1, "x", ["p"], 1.5), (1, None, None, None), (2, "", [], 0.0))
    assert one == f((2, "", [], 0.0), (1, None, None, None), (1, "x", ["p"], 1.5))
    assert one[1] != f((1, "x", ["p"], 1.5), (1, "", None, None))[1] and one[1] != f((1, "x", ["q"], 1.5), (1, None, None, None))[1]
    assert f((1, "x", ["p"], 1.5))[1] != f((1, "x", ["p"], 1.5), (1, "x", ["p"], 1.5))[1]


def test_changes_rewrite_the_ranges_they_touch_only(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"), F.lit(None).cast("string").alias("w"))
    df = spark.createDataFrame(df.collect(), "k long, v string, w string")
    ranges.created(df.repartition(5), root, "k", range_rows=100)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    of_state = lambda: {f.split("file:")[-1] for f in ranges.read(spark, root).inputFiles()}
    before, used = files(), of_state()
    assert len(used) == 11
    touched = ranges.upserted(spark, root, spark.createDataFrame([(5, "new", None), (5, "newer", None), (-3, "first", "w"), (205, None, "x")], "k long, v string, w string"))
    assert touched == [0, 2]
    assert len(of_state() & used) == 9 and {k: v for k, v in files().items() if k in before} == before
    rows = {r.k: (r.v, r.w) for r in ranges.read(spark, root).collect()}
    assert len(rows) == 1001 and rows[5] == ("new", None) and rows[-3] == ("first", "w") and rows[205] == (None, "x") and rows[6] == ("v6", None)
    assert ranges.removed(spark, root, spark.range(100, 200).toDF("k")) == [1, 2]
    gone = {r.k for r in ranges.read(spark, root).collect()}
    assert not gone & {*range(100, 200)} and len(gone) == 901
    assert ranges.upserted(spark, root, df.where("false")) == []
    assert ranges.upserted(spark, root, spark.createDataFrame([(150, "back", None), (10**9, "last", None), (None, "none", None)], "k long, v string, w string"))[-1] == 10
    assert ranges.vacuumed(spark, root) > 0 and ranges.read(spark, root).count() == 904
    with pytest.raises(LookupError):
        ranges.read(spark, f"{root}/none")


def test_a_second_writer_of_a_state_is_refused(spark, tmp_path):
    root = str(tmp_path)
    ranges.created(spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v")), root, "k")
    versions.claimed(spark, f"{root}/state_1.claim")  # another writer is at work
    with pytest.raises(RuntimeError):
        ranges.removed(spark, root, spark.range(3).toDF("k"))
    assert ranges.read(spark, root).count() == 10


def test_variant_configs_keep_malformed_rows(spark, tmp_path):
    configs = ['{"experiment":"E1","name":"a","agent":true,"commit":"c"}', '{"experiment":"E1","name":3,"agent":"true"}', '{"experiment":', "", None, "[1]", '{"experiment":null}']
    rows = report.with_variant(spark.createDataFrame(list(enumerate(configs)), "id long, config string"))
    rows.write.parquet(f"{tmp_path}/v")
    own = spark.read.parquet(f"{tmp_path}/v")
    assert own.schema["config"].dataType.simpleString() == "variant"
    got = {r.id: (r.experiment, r.name, r.commit, r.agent, r.malformed) for r in report.flattened_variant(own).drop("config").collect()}
    none = ("", "", "", False)
    assert got == {0: ("E1", "a", "c", True, False), 1: ("E1", "", "", False, False), 2: (*none, True), 3: (*none, True), 4: (*none, False), 5: (*none, False), 6: (*none, False)}
    assert sorted(r.id for r in report.of_experiment_variant(own, "E1").select("id").collect()) == [0, 1]


def test_what_the_library_makes_can_be_cleared(spark):
    before = len(shared.made(spark))
    own = shared.materialised(spark.range(3), "clearing")
    assert own.count() == 3 and len(shared.made(spark)) == before + 1
    shared.clear(spark, before)
    assert len(shared.made(spark)) == before
    with pytest.raises(Exception):
        spark.read.parquet(own._materialised_at).count()
