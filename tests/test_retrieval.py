"""Formulas on hand-made values, semantics of filters, and the shape of plans."""

import hashlib
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seekspark.functions import text as X
from seekspark.operators import clarify, dedup, filters, index, metrics, quality, rank, report, resolve
from seekspark.operators.dense import cosine_pairs, dense_branch
from seekspark.operators.fuse import branches_of, fuse
from seekspark.plans import agent, evaluation, search, variants
from seekspark.sources.shared import materialised

ATTRS = "movie_id long, decade string, country string, genres array<string>, is_animation boolean"


def scenes(spark, rows):
    return spark.createDataFrame(rows, "query_id long, movie_id long, scene_id string, score double")


def plots(spark, rows):
    return spark.createDataFrame(rows, "query_id long, movie_id long, score double")


def test_aggregate_formula_and_evidence(spark):
    s = scenes(spark, [(1, 7, "a", 0.5), (1, 7, "b", 0.25), (1, 7, "c", 0.1), (1, 7, "d", 0.05)])
    out = {r.movie_id: r for r in rank.aggregate(s, plots(spark, [(1, 7, 0.4), (1, 8, 0.5)])).collect()}
    assert out[7].score == pytest.approx(0.775) and out[7].evidence == ["a", "b", "c"]
    assert out[8].score == pytest.approx(0.25) and out[8].s1 == 0 and out[8].evidence == []


def test_aggregate_boosts_once_and_breaks_ties_by_id(spark):
    s = scenes(spark, [(1, m, f"s{m}", x) for m, x in ((2, 0.5), (1, 0.5), (3, 0.2), (4, 0.1))])
    none = plots(spark, [])
    assert [r.movie_id for r in rank.aggregate(s, none, top=3).orderBy("rank").collect()] == [1, 2, 3]
    soft = spark.createDataFrame([(1, {"country": "KR", "decade": "1990s"})], "query_id long, filters map<string,string>")
    attrs = spark.createDataFrame([(1, "1990s", "KR", [], False), (2, None, None, None, None)], ATTRS)
    got = {r.movie_id: r for r in rank.aggregate(s, none, soft, attrs).collect()}
    assert got[1].score == pytest.approx(0.55) and got[1].boosted and got[2].score == 0.5 and not got[2].boosted


@pytest.mark.parametrize("scores,want", [([0.9, 0.3], 0.94), ([0.8, 0.7], 0.48 + 0.4 / 3), ([0.5, 0.5], 0.3), ([0.7], 0.82), ([1.4, -0.2], 1.0)])
def test_confidence(spark, scores, want):
    df = spark.createDataFrame([(1, s, k + 1) for k, s in enumerate(scores)], "query_id long, verified double, new_rank long")
    assert rank.confidence(df).first().confidence == pytest.approx(want)


def test_rerank_clamps_ignores_and_takes_the_last(spark):
    c = spark.createDataFrame([(1, m, m) for m in (1, 2, 3)], "query_id long, movie_id long, rank long")
    v = spark.createDataFrame([(1, 3, 0, 0.1, "x"), (1, 3, 1, 1.5, "y"), (1, 99, 2, 1.0, ""), (1, 1, 3, 0.0, "")], "query_id long, movie_id long, pos int, score double, reason string")
    out = rank.rerank(c, v).orderBy("new_rank").collect()
    assert [r.movie_id for r in out] == [3, 1, 2] and out[0].verified == 1.0 and out[0].reason == "y"


def items(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank long, weight double, decade string, country string, genres array<string>, is_animation boolean")


def test_questions(spark):
    df = items(spark, [(1, 1, 0.5, "2000s", "KR", ["a"], None), (1, 2, 0.5, "2010s", None, ["a", "b"], None), (2, 1, 0.0, "1990s", "KR", ["x"], True), (2, 2, 0.0, "1980s", "US", ["x"], True), (2, 6, 9.0, "1970s", "US", ["x"], True), (3, 1, 1.0, "1990s", "KR", None, None)])
    got = {r.query_id: r for r in clarify.choose(df).collect()}
    assert got[1].attr == "decade" and got[1].entropy == pytest.approx(1) and got[1].options == ["2000s", "2010s", "unknown"]
    assert got[2].attr == "decade" and got[2].entropy == pytest.approx(1) and 3 not in got
    asked = spark.createDataFrame([(2, ["decade"])], "query_id long, asked array<string>")
    assert {r.query_id: r.attr for r in clarify.choose(df, asked).collect()} == {1: "decade", 2: "country"}
    four = items(spark, [(1, k + 1, w, d, None, None, None) for k, (w, d) in enumerate([(0.1, "a"), (0.4, "b"), (0.3, "c"), (0.2, "d")])])
    assert clarify.options(clarify.distributions(four)).first().options == ["b", "c", "d", "unknown"]


def test_answers(spark):
    df = spark.createDataFrame([({"country": "KR"}, "decade", v, ["1990s", "unknown"]) for v in ("1990s", "unknown", "other")], "f map<string,string>, a string, v string, o array<string>")
    got = [r[0] for r in df.select(clarify.apply_answer(F.col("f"), F.col("a"), F.col("v"), F.col("o"))).collect()]
    assert got == [{"country": "KR", "decade": "1990s"}, {"country": "KR"}, {"country": "KR"}]
    labels = spark.createDataFrame([("decade", "1990s"), ("country", "other"), ("genre", "true"), ("genre", "unknown")], "a string, v string").select(clarify.option_label(F.col("a"), F.col("v"))).collect()
    assert [r[0] for r in labels] == ["1990년대", "외국 영화", "true", "모르겠어요"]
    more = spark.createDataFrame([("country", "KR"), ("is_animation", "true"), ("is_animation", "false"), ("decade", "old"), ("genre", "drama")], "a string, v string").select(clarify.option_label(F.col("a"), F.col("v"))).collect()
    assert [r[0] for r in more] == ["한국 영화", "애니메이션", "실사 영화", "old", "drama"]


def test_unknown_country_passes_the_hard_filter_only(spark):
    df = spark.createDataFrame([(1, None, None, ["a"], None), (2, "1990s", "KR", ["a"], True), (3, "1990s", "US", None, False)], ATTRS)
    assert [r.movie_id for r in df.where(filters.hard_filter({"country": "other"})).orderBy("movie_id").collect()] == [1, 3]
    assert [r.movie_id for r in df.where(filters.soft_match("country", F.lit("other"))).collect()] == [3]
    assert df.where(filters.hard_filter({})).count() == 3
    assert [r.movie_id for r in df.where(filters.hard_filter({"decade": "1990s", "genre": "a", "is_animation": "true"})).collect()] == [2]
    with pytest.raises(ValueError):
        filters.hard_filter({"mood": "sad"})


def test_bm25_weight_and_bigrams(spark):
    docs = spark.createDataFrame([(1, "a A b"), (2, ""), (3, None), (4, "a b c d e f g h i")], "doc_id long, text string")
    stats = index.statistics(docs).first()
    assert stats.n_docs == 4 and stats.avgdl == 3
    own = index.build(docs)
    assert (own.n_docs, own.avgdl) == (4, 3)
    assert sorted(map(tuple, own.postings.where("doc_id = 1").collect())) == [(1, "a", 2, 3), (1, "b", 1, 3)]
    w = {(r.doc_id, r.term): r.weight for r in index.document_weights(own).collect()}
    assert w[1, "a"] == pytest.approx(4.4 / 3.2) and w[1, "b"] == pytest.approx(1.0) and not any(k[0] in (2, 3) for k in w)
    assert spark.range(1).select(X.char_bigrams(F.lit("Élan x 기차표"))).first()[0] == ["él", "la", "an", "x", "기차", "차표"]


def test_filter_is_applied_before_the_cut(spark):
    docs = spark.createDataFrame([(k, f"w filler{k}" if k < 60 else "w other other other") for k in range(61)], "item_id long, text string")
    q = spark.createDataFrame([(1, "w")], "query_id long, text string")
    keep = spark.createDataFrame([(60,)], "item_id long")
    own = index.build(docs, "item_id")
    assert [r.item_id for r in index.sparse_branch(own, q, key="item_id", keep=keep).collect()] == [60]
    plan = index.sparse_branch(own, q, key="item_id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan and "NestedLoop" not in plan and "PartitionFilters: [isnotnull(bucket" in plan
    found = {r.item_id: round(r.score, 9) for r in index.sparse_scores(own, q, key="item_id").collect()}
    assert len(found) == 61 and found[60] < found[0]


@pytest.mark.parametrize("block", [4096, 3])
def test_dense_blocks_equal_the_readable_form(spark, sf, block, monkeypatch):
    import seekspark.operators.dense as D

    monkeypatch.setattr(D, "QUERY_BLOCK", block)
    monkeypatch.setattr(D, "TILE", 4096 * block)
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.where("vec_id < 8").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 6)) for r in dense_branch(v, q, limit=5).collect()}
    from seekspark.operators.common import ranked

    want = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 6)) for r in ranked(cosine_pairs(v, q), ["query_id"], "score", "vec_id", limit=5).collect()}
    assert got == want and len(got) == 40
    assert dense_branch(v, q.limit(0)).count() == 0
    short = q.limit(1).select((F.col("query_id") + 100).alias("query_id"), F.slice("embedding", 1, 3).alias("embedding"))
    mixed = dense_branch(v.union(v.limit(2).select("vec_id", F.slice("embedding", 1, 3), "label")), q.union(short).union(spark.createDataFrame([(7, None)], q.schema)), limit=5)
    assert mixed.where("query_id < 100").count() == 40 and mixed.where("query_id >= 100").count() == 2


def test_fusion(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, doc_id long, rank long")
    got = {r.doc_id: r.score for r in fuse([a, a.where("doc_id = 5")], limit=9).collect()}
    assert got == {5: pytest.approx(1.0), 6: pytest.approx(1 / 3)}
    with pytest.raises(ValueError):
        branches_of("fuzzy", {})


def test_search_modes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("item_id"), (F.col("doc_id") % 9).alias("movie_id"), "text")
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), "embedding")
    q = docs.where("item_id < 3").join(v, "item_id").select(F.col("item_id").alias("query_id"), "text", "embedding")
    c = search.Collection(docs, v, 10)
    for mode in ("hybrid", "dense", "sparse"):
        first = {r.query_id: r.item_id for r in search.search(c, q, mode=mode).where("rank = 1").collect()}
        assert first[1] == 1
    keep = spark.createDataFrame([(2,)], "movie_id long")
    assert {r.item_id % 9 for r in search.search(c, q, mode="sparse", keep=keep).collect()} == {2}
    none = q.select("query_id", F.lit("").alias("text"), F.lit(None).cast("array<float>").alias("embedding"))
    assert search.search(c, none).count() == 0


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 6), ("b", None)], "dataset string, rank long")
    r = df.agg(*metrics.hit_metrics()).first()
    assert (r.recall_at_1, r.recall_at_5) == (0.25, 0.5) and r.mrr == pytest.approx((1 + 1 / 2 + 1 / 6) / 4)
    assert df.limit(0).agg(*metrics.hit_metrics()).first().mrr == 0
    p = lambda xs: spark.createDataFrame([(x,) for x in xs], "x long").agg(metrics.nearest_rank("x", 95)).first()[0]
    assert (p(range(1, 101)), p([7]), p([])) == (95, 7, 0)
    c = spark.createDataFrame([(1, 0), (1, 1), (3, 2), (None, 1)], "rank long, turns int").agg(*metrics.clarify_metrics()).first()
    assert c.clarify_success == pytest.approx(1 / 3) and c.avg_clarify == 1.0


def test_reports(spark):
    runs = spark.createDataFrame([(1, "hybrid", 0.1), (2, "dense", 0.2), (3, "hybrid", 0.3)], "id long, name string, mrr double")
    assert {r.name: (r.id, r.runs) for r in report.latest(runs, "name").collect()} == {"dense": (2, 1), "hybrid": (3, 2)}
    names = spark.createDataFrame([("E10",), ("E2",), ("KW",)], "n string").orderBy(*X.natural_order(F.col("n"))).collect()
    assert [r.n for r in names] == ["E2", "E10", "KW"]
    timings = spark.createDataFrame([(1, {"a": 1, "b": 2}), (1, {"a": 5})], "k long, t map<string,long>")
    assert report.merged_timings(timings, "k", "t").first().t == {"a": 6, "b": 2}
    assert [r[0] for r in spark.createDataFrame([(0.0123456,), (0.0,), (1234.0,)], "v double").select(X.significant(F.col("v"))).collect()] == [0.012, 0.0, 1200.0]


def test_evaluation_of_configurations(spark):
    truth = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "query_id long, dataset string, answer_id long")
    predicted = spark.createDataFrame([(1, 5, 1), (2, 6, 7)], "query_id long, id long, rank long")
    configs = [variants.SearchConfig("E", "search"), variants.SearchConfig("E", "agent", agent=True)]
    got = {(r.name, r.dataset): r.mrr for r in evaluation.evaluate(configs, truth, lambda c: predicted).collect()}
    assert got["search", "y"] == pytest.approx(1 / 7) and got["agent", "y"] == 0 and got["agent", None] == 0.5
    with pytest.raises(ValueError):
        variants.config_from({"experiment": "E", "name": "n", "colour": 1})
    assert variants.config_table(spark, variants.matrix()).where("experiment = 'E5'").count() == 5


def test_agent_asks_once_then_answers(spark):
    movies = [(1, "1990s", "KR"), (2, "2000s", "KR"), (3, "2000s", "KR")]
    attrs = spark.createDataFrame([(m, d, c, [], False) for m, d, c in movies], ATTRS)

    def retrieve(q):
        x = F.try_element_at(F.col("filters"), F.lit("decade"))
        return attrs.crossJoin(q).where(x.isNull() | (x == F.col("decade"))).select("query_id", "movie_id", (1.0 / F.col("movie_id")).alias("score"), F.col("movie_id").alias("rank"), "decade", "country", "genres", "is_animation", F.size("filters").alias("known"))

    def verify(c):
        sure = F.when((F.col("movie_id") == 1) & (F.col("known") > 0), 0.9).otherwise(0.6 - F.col("movie_id") * 0.01)
        return c.select("query_id", "movie_id", F.lit(0).alias("pos"), sure.alias("score"), F.lit("").alias("reason"))

    truth = attrs.where("movie_id = 1").select(F.lit(4).cast("long").alias("query_id"), "decade", "country", "genres", "is_animation")
    results, state = agent.run(truth.select("query_id"), retrieve, verify, truth)
    row = state.first()
    assert row.turns == 1 and row.filters == {"decade": "1990s"} and [r.movie_id for r in agent.answers(results).collect()] == [1]


def greedy(hashes, most):
    kept = []
    for k, h in enumerate(hashes):
        if all(bin((h ^ hashes[j]) & (2**64 - 1)).count("1") > most for j in kept):
            kept.append(k)
    return kept


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-(2**63), 2**63 - 1) | st.integers(0, 4095), max_size=25), st.integers(0, 40), st.sampled_from([0, 5, dedup.TASK_PAIRS]))
def test_greedy_choice(spark, hashes, most, task_pairs):
    df = spark.createDataFrame([(1, k, h) for k, h in enumerate(hashes)], "movie_id long, n long, h long")
    assert sorted(r.n for r in dedup.representatives(df, most, task_pairs=task_pairs).collect()) == greedy(hashes, most)
    near = {(r.a, r.b) for r in dedup.near_pairs(df, most).collect()}
    assert near == {(a, b) for a in range(len(hashes)) for b in range(a + 1, len(hashes)) if bin((hashes[a] ^ hashes[b]) & (2**64 - 1)).count("1") <= most}


@pytest.mark.parametrize("k,m", [(3, 7), (7, 3), (0, 4), (5, 0), (10, 10)])
def test_interleaving_keeps_the_ratio(spark, k, m):
    side = lambda tag, n: spark.createDataFrame([(f"{tag}{i}", i) for i in range(1, n + 1)], "id string, pos long")
    got = [r.id for r in resolve.interleaved(side("k", k), side("m", m)).orderBy("place").collect()]
    want, i, j = [], 0, 0
    for p in range(1, k + m + 1):
        if i < round(p * k / (k + m)):
            i += 1
            want.append(f"k{i}")
        else:
            j += 1
            want.append(f"m{j}")
    assert got == want


def test_titles_and_keys(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.normalized_title(F.lit(" !HS 아바타!HE: The Volume 2 "))) == "아바타thevol2"
    assert one(X.title_variants(F.lit("A b (감독판)"), F.lit(None).cast("string"), others=F.lit("C^d"))) == ["ab감독판", "c", "d", "ab"]
    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert one(X.uuid5(ns, F.lit("scène-1"))) == str(uuid.uuid5(uuid.UUID(ns), "scène-1"))
    assert one(X.text_hash("m", 3, F.lit("é"))) == hashlib.sha1("m|3|é".encode()).hexdigest()
    assert one(X.hex64(X.hash64(F.lit("ff00000000000001")))) == "ff00000000000001"
    assert one(X.decade(F.lit(1994))) == "1990s" and one(X.decade(F.lit(0))) is None
    assert one(X.search_document(F.lit("가"), F.lit(" "), F.lit("집"), F.array(F.lit(" 컵 "), F.lit("")), F.lit(None).cast("array<string>"), F.lit(1994))) == "가\n장소: 집\n물건: 컵\n연대: 1990년대"
    assert one(X.keyword_list(F.lit("b, a,,b"))) == ["b", "a"]
    assert one(X.years_of(F.lit("19990101"), F.lit(""), F.lit("1999"), F.lit("2001"))) == [1999, 2001]
    assert one(X.overlap(X.tokens(F.lit("a b b")), X.tokens(F.lit("b c")))) == 0.5
    assert one(X.redacted_images(F.lit('{"u":"data:image/png;base64,AA=="}'))) == '{"u":"[image]"}'
    assert one(X.thumb_url("http://t/", F.lit("k"))) == "http://t/k" and one(X.thumb_url("", F.lit("k"))) is None


def test_entity_resolution(spark):
    home, both, other = [resolve.HOME_NATION], [resolve.HOME_NATION, "US"], ["US"]
    movies = spark.createDataFrame([(1, ["a"], 2000, True), (2, ["b"], 2010, False), (3, ["c"], 2000, True), (4, ["d"], 2000, None), (5, ["e"], 2000, False), (6, ["f"], None, True)], "id long, variants array<string>, year int, home boolean")
    records = spark.createDataFrame(
        [("r1", 1, ["a"], [2001], home, 90), ("r2", 2, ["a", "z"], [2000], home, 90), ("r3", 3, ["a"], [2000], other, 90), ("r4", 4, ["b"], [2010], other, 20), ("r5", 5, ["b"], [2012], other, 90)]
        + [("c1", 6, ["c"], [1990, 2001], both, None), ("d1", 7, ["d"], [2000], home, 90), ("d2", 8, ["d"], [2001], None, 90), ("e1", 9, ["e"], [1999], both, 90), ("f1", 10, ["f"], [2000], home, 90)],
        "record_id string, pos long, variants array<string>, years array<int>, nations array<string>, runtime int",
    )
    assert sorted((r.id, r.record_id, r.year_diff) for r in resolve.match_records(movies, records).collect()) == [(1, "r2", 0), (3, "c1", 1), (4, "d2", 1), (5, "e1", 1)]
    catalogue = spark.createDataFrame([(1, "가", "One", 1999), (2, "가", None, 2005)], "id long, title_ko string, title_en string, year int")
    rows = spark.createDataFrame([(1, "w", "q", "가", 2005), (2, "w", "q", "one!", None), (3, "w", "q", "가", None), (4, "w", "", "one", None), (5, "w", "q", "zz", None)], "row_id long, writer string, query string, title string, year int")
    got = {r.row_id: (r.movie_id, r.problem) for r in resolve.checked_examples(rows, catalogue).collect()}
    assert got == {1: (2, None), 2: (1, None), 3: (None, "several matches"), 4: (None, "no query"), 5: (None, "no match")}


def test_catalogue_details_to_movies(spark):
    schema = "id long, title string, original_title string, original_language string, titles array<struct<lang:string,title:string>>, origin_country array<string>, production_countries array<string>, release_date string, genres array<struct<id:int,name:string>>"
    raw = spark.createDataFrame([(1, "가", "Ga", "ko", [("fr", "x"), ("en", ""), ("en", "Ga En")], [], ["KR"], "1999-01-02", [(16, "anim")]), (2, "나", "Na", "en", [], ["US"], [], "", None)], schema)
    a, b = resolve.to_movie(raw).orderBy("tmdb_id").collect()
    assert (a.title_en, a.year, a.country, a.is_animation) == ("Ga En", 1999, "KR", True)
    assert (b.title_en, b.year, b.country, b.is_animation) == ("Na", None, "US", False)


def test_caption_checks(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    good = "가나다라 마바사 " * 6
    assert one(quality.caption_problems(F.lit(good))) == [] and one(quality.caption_problems(F.lit("short"))) == ["length", "hangul"]
    assert one(quality.caption_problems(F.lit(None).cast("string"), F.array(F.lit("x")))) == ["length", "hangul", "forbidden"]
    assert one(quality.schema_problem(F.lit("{broken"))) == "schema" and one(quality.schema_problem(F.lit('{"caption_ko":"a","setting":"b","time_of_day":"noon"}'))) == "time_of_day"
    movies = spark.createDataFrame([(1, "기생충", "Hope")], "id long, title_ko string, title_en string")
    words = quality.forbidden_words(movies, spark.createDataFrame([(1, "송강호"), (1, "Al Pac")], "movie_id long, name string"))
    captions = spark.createDataFrame([(1, 1, "hopeful"), (1, 2, "a HOPE."), (1, 3, "송강호가 걷는다"), (2, 4, "hope")], "movie_id long, scene_id long, text string")
    assert {r.scene_id: r.words for r in quality.forbidden_hits(captions, words).collect()} == {2: ["Hope"], 3: ["송강호"]}
    dictionary = quality.user_words(spark.createDataFrame([("기생충",), ("두 단어",)], "title string"), spark.createDataFrame([("송 강호",), ("a",)], "name string"))
    assert [r.word for r in dictionary.collect()] == ["강호", "기생충"]


@pytest.mark.parametrize("most", [3, 20])
def test_near_pairs_of_blocks(spark, most, monkeypatch):
    import random

    monkeypatch.setattr(dedup, "CELL_ROWS", 10)
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    hashes = [b ^ sum(1 << rng.randrange(64) for _ in range(k % 12)) & (2**64 - 1) for k, b in enumerate(base * 4)]
    signed = [h - 2**64 if h >= 2**63 else h for h in hashes]
    df = spark.createDataFrame([(k % 2, k, h) for k, h in enumerate(signed)] + [(0, 999, None)], "movie_id long, n long, h long")
    want = {(a, b) for a in range(80) for b in range(a + 1, 80) if a % 2 == b % 2 and bin(hashes[a] ^ hashes[b]).count("1") <= most}
    assert {(r.a, r.b) for r in dedup.near_pairs(df, most).collect()} == want
    few = sum(a % 2 for a, _ in want)  # the odd rows' pairs; where the even rows have more, one group is settled in a task and one in rounds
    for task_pairs in (0, few, dedup.TASK_PAIRS):
        kept = {r.n for r in dedup.representatives(df, most, task_pairs=task_pairs).collect()}
        assert kept == {2 * k + m for m in (0, 1) for k in greedy(signed[m::2], most)}


def test_a_chain_is_settled_without_rounds(spark):
    saved = []

    def save(df, name="rows"):
        saved.append(1)
        return materialised(df, name)

    # Each fingerprint is near the one before it only: every second stays, whichever way it is settled.
    chain = [(1, k, (1 << k + 1) - 1) for k in range(12)]
    df = spark.createDataFrame(chain, "movie_id long, n long, h long")
    assert sorted(r.n for r in dedup.representatives(df, 1, save=save).collect()) == list(range(0, 12, 2))
    assert len(saved) == 4
    assert sorted(r.n for r in dedup.representatives(df, 1, task_pairs=10).collect()) == list(range(0, 12, 2))


def test_texts_that_contain_passages(spark):
    long = "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame([(1, f"x {long} y"), (2, f"Xalpha beta gamma delta epsilon zetaY {long}"), (3, "alpha beta gamma delta"), (4, None), (5, ""), (6, long.upper())], "doc_id long, text string")
    q = spark.createDataFrame([(1, long), (2, "beta gam"), (3, ""), (4, None), (5, "beta gamma delta"), (6, "?!")], "query_id long, text string")
    got = sorted(map(tuple, metrics.containing(docs, q).collect()))
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (5, 1), (5, 2), (5, 3)]


def test_passages_are_found_without_an_index_as_with_one(spark, monkeypatch):
    def none(*a, **k):
        raise AssertionError("an index is built")

    long = "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame([(1, f"x {long} y"), (2, f"Xalpha beta gamma delta epsilon zetaY {long} {long}"), (3, "alpha beta gamma delta"), (4, None), (5, ""), (6, long.upper())], "doc_id long, text string")
    q = spark.createDataFrame([(1, long), (7, long), (2, "beta gam"), (3, ""), (4, None), (5, "beta gamma delta"), (6, "alpha omega delta")], "query_id long, text string")
    rows = lambda *a: sorted(map(tuple, metrics.containing(*a).collect()))
    want = rows(docs, q, index.build(docs))
    assert len(want) == 10
    with monkeypatch.context() as m:
        m.setattr(metrics, "build", none)
        assert rows(docs, q) == want and rows(docs, q.where("query_id in (3, 4)")) == []
    monkeypatch.setattr(metrics, "SCANNED_CHARS", 10)
    assert rows(docs, q) == want


def test_marked_words(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.query_terms(F.lit("기차 안에서 사람들이 좀비를 피해 문을 막고 버티던 장면"))) == ["기차", "사람들", "좀비", "피해", "문을", "막고", "버티던"]
    assert one(X.query_terms(F.lit("물에 잠긴 집으로"))) == ["물에", "잠긴", "집으로"]
    seg = lambda t, *terms: [tuple(x) for x in one(X.highlighted(F.lit(t), F.array(*map(F.lit, terms)).cast("array<string>")))]
    assert seg("물에 잠긴 반지하 계단", "물에", "잠긴", "계단") == [("물에", True), (" ", False), ("잠긴", True), (" 반지하 ", False), ("계단", True)]
    assert seg("밤의 골목") == [("밤의 골목", False)] == seg("밤의 골목", "기차")
    assert seg("a+b 장면", "a+b")[0] == ("a+b", True) and seg("기차역", "기차", "기차역") == [("기차역", True)] and seg("x\\Ey", "x\\E") == [("x\\E", True), ("y", False)]


def test_queries_out_of_captions(spark):
    caption = "struct<caption_ko:string,caption_en:string,setting:string,objects:array<string>>"
    df = spark.createDataFrame([(1, " ", ("가", "a", "집", ["컵", ""])), (2, "글", None), (3, None, None), (4, "", ("가", None, None, None))], f"k long, t string, c {caption}")
    got = {r.k: r for r in df.select("k", X.has_query(F.col("t"), F.col("c")).alias("q"), X.from_caption(F.col("c")).alias("f"), X.rewritten_or_raw(F.lit(None).cast("struct<scene_ko:string,keywords_ko:array<string>,soft_filters:map<string,string>>"), F.col("t"), F.col("c.caption_ko")).alias("r")).collect()}
    assert [got[k].q for k in (1, 2, 3, 4)] == [True, True, False, True]
    assert got[1].f.scene_ko == "가 a" and got[1].f.keywords_ko == ["집", "컵"] and got[4].f.scene_ko == "가" and got[4].f.keywords_ko == []
    assert [got[k].r.scene_ko for k in (2, 3, 4)] == ["글", "", "가"] and got[2].r.keywords_ko == [] and got[2].r.soft_filters == {}


def test_answers_show_evidence(spark):
    order = spark.createDataFrame([(1, 7, 1, 0.9, "why", ["7_b_2", "7_b_1"]), (1, 8, 2, 0.0, None, []), (1, 9, 9, 0.0, None, [])], "query_id long, movie_id long, new_rank long, verified double, reason string, evidence array<string>")
    movies = spark.createDataFrame([(7, "칠", 1999, "p")], "id long, title_ko string, year int, poster_url string")
    scenes = spark.createDataFrame([("7_b_1", "일"), ("7_b_2", None)], "id string, caption_ko string")
    a, b = agent.answers(order, movies, scenes, base="http://t/").orderBy("rank").collect()
    assert (a.title_ko, a.score, a.reason) == ("칠", 0.9, "why") and [tuple(e) for e in a.evidence] == [("7_b_2", "http://t/thumbs/7_b_2.jpg", ""), ("7_b_1", "http://t/thumbs/7_b_1.jpg", "일")]
    assert (b.title_ko, b.score, b.reason, b.evidence) == (None, 0.0, "", [])


def test_titles_of_many_rows_and_movies_meet_as_groups(spark):
    """2,000 rows and 2,000 movies of one title are four million pairs; no join makes them."""
    movies = spark.range(2000).select("id", F.lit("One").alias("title_ko"), F.when(F.col("id") % 2 == 0, "ONE!").alias("title_en"), (F.col("id") % 500).cast("int").alias("year"))
    more = spark.createDataFrame([(5000, "Two", None, 7), (5001, None, "three", 1), (5001, "Three", None, 1), (5002, "three", None, None)], "id long, title_ko string, title_en string, year int")
    movies = movies.union(more)
    rows = spark.range(2000).select(F.col("id").alias("row_id"), F.lit("one").alias("title"), (F.col("id") % 501).cast("int").alias("year"))
    rows = rows.union(spark.createDataFrame([(9000, "two", 8), (9001, "Three", None), (9002, "three", 1), (9003, "three", 2), (9004, "", 1), (9005, None, 1)], "row_id long, title string, year int"))
    got = resolve.count_titles(rows, movies)
    assert _most_rows_of_joins(got) <= 3 * 2010
    found = {r.row_id: (r.n, r.first_id) for r in got.collect()}
    listed = {r.row_id: r.movie_ids for r in resolve.match_titles(rows, movies).collect()}
    assert found == {k: (len(v), v[0]) for k, v in listed.items()}
    assert listed[3] == [3, 503, 1003, 1503] and 500 not in listed and len(listed) == 2000 - 3 + 3
    assert (listed[9000], listed[9001], listed[9002]) == ([5000], [5001, 5002], [5001])


def _most_rows_of_joins(df) -> int:
    """The most rows that a join of the plan puts out, once it has run."""
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        if "Join" in name and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        children = p.children()
        todo += [children.apply(k) for k in range(children.size())]
    assert most
    return most


def test_records_are_repeated_for_years_after_the_first_is_taken(spark):
    """3,000 records of one title and year are one row before it is repeated for the years near it."""
    nations = F.array(F.lit("US"))
    records = spark.range(3000).select(F.col("id").alias("record_id"), F.col("id").alias("pos"), F.array(F.lit("t")).alias("variants"), F.array(F.lit(1999), F.lit(2000)).alias("years"), nations.alias("nations"), F.lit(90).alias("runtime"))
    movies = spark.range(3).select("id", F.array(F.lit("t")).alias("variants"), (F.col("id") + 1998).cast("int").alias("year"), F.lit(False).alias("home"))
    got = resolve.match_records(movies, records)
    assert _most_rows_of_generate(got) <= 3000
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, 1), (1, 0, 0), (2, 0, 0)]


def _most_rows_of_generate(df) -> int:
    """The most rows that an explode of the plan puts out, once it has run."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        if name == "Generate":
            most = max(most, p.metrics().apply("numOutputRows").value())
        children = p.children()
        todo += [children.apply(k) for k in range(children.size())]
    assert most
    return most
