"""The stored index: what it reads, what bounds leave out, and that results stay those of adding all up; tokens by a dictionary and ids of terms."""

import math
import random
import re
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seekspark.functions import text as X
from seekspark.functions.dictionary import Dictionary, trie_pattern
from seekspark.functions.hashing import murmur3, with_term_ids
from seekspark.operators import index
from seekspark.plans import search
from seekspark.plans.variants import IndexVariant


@pytest.fixture(scope="module")
def docs(spark):
    """600 documents of words by rank: frequent ones everywhere, rare ones in few documents; some copies."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(2000)]
    weight = [1 / (k + 1) for k in range(2000)]
    texts = [" ".join(rng.choices(words, weight, k=rng.randrange(5, 120))) for _ in range(560)]
    texts += [texts[k % 7] for k in range(37)] + ["", None, "w0"]
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(12)
    texts = [f"w{rng.randrange(300, 1500)} w{rng.randrange(50)} w0 w1 w{rng.randrange(900)}" for _ in range(20)] + ["", None, "nothing", "w0", "w0 w0 w1 W1"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def brute(docs, queries, limit):
    cut = lambda t: re.findall(r"\w+", (t or "").lower())
    d = {r.doc_id: cut(r.text) for r in docs.collect()}
    avgdl, df = sum(map(len, d.values())) / len(d), Counter(t for ts in d.values() for t in set(ts))
    out = {}
    for q in queries.collect():
        scores = {}
        for k, ts in d.items():
            tf = Counter(ts)
            own = [math.log(1 + (len(d) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ts) / avgdl)) for t in set(cut(q.text)) if tf[t]]
            if own:
                scores[k] = sum(own)
        best = sorted(scores, key=lambda k: (-round(scores[k], 9), k))[:limit]
        out |= {(q.query_id, k): (round(scores[k], 6), n) for n, k in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("limit", [1, 7])
@pytest.mark.parametrize("block", [4, 128])
def test_bounded_search_equals_brute_force(docs, queries, limit, block, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", block)
    monkeypatch.setattr(index, "SALT_DOCS", 100)  # postings of a term in several runs
    own = index.build(docs, buckets=32)
    want = brute(docs, queries, limit)
    for pairs in (0, 1 << 40):
        got = index.sparse_branch(own, queries, limit=limit, direct_pairs=pairs).collect()
        assert {(r.query_id, r.doc_id): (round(r.score, 6), r.rank) for r in got} == want
    monkeypatch.setattr(index, "BROADCAST_TERMS", 0)  # nothing is sent, all is shuffled
    got = index.sparse_branch(own, queries, limit=limit, direct_pairs=0).collect()
    assert {(r.query_id, r.doc_id): (round(r.score, 6), r.rank) for r in got} == want


def test_bounds_leave_out_most_postings_and_keep_filters_apply_first(docs, queries, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 4)
    own = index.build(docs)
    q = index.asked(own, queries.where("query_id < 20"))
    bounds = index.bounded(own, q, 3, "doc_id")
    read = index.postings_in_reach(own, q, bounds)
    assert 0 < read < q.pairs / 3, (read, q.pairs)
    assert bounds.where("theta > 0").select("query_id").distinct().count() == 20
    keep = docs.where("doc_id % 5 = 0").select("doc_id")
    one, other = (index.sparse_branch(own, queries, limit=5, keep=keep, direct_pairs=p).collect() for p in (0, 1 << 40))
    assert [(r.query_id, r.doc_id, r.rank) for r in sorted(one)] == [(r.query_id, r.doc_id, r.rank) for r in sorted(other)] and {r.doc_id % 5 for r in one} == {0}


@pytest.mark.parametrize("n", [5, 40, 400])
def test_a_search_reads_the_directories_of_its_terms_only(spark, docs, n):
    own = index.build(docs, buckets=512)
    q = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(0, 3 * n, 3)))], "query_id long, text string")
    asked = index.asked(own, q)
    read = index.read_blocks(own, asked)
    dirs = {f.split("bucket=")[1].split("/")[0] for f in (r.f for r in read.select(F.input_file_name().alias("f")).distinct().collect())}
    assert {int(d) for d in dirs} == set(asked.buckets) and len(dirs) <= min(n, asked.n)
    scan = read.select("term", "most", "n")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<term:string,most:double,n:bigint>" in scan and "PartitionFilters: [bucket" in scan  # bounds read no postings


def test_an_index_is_opened_again_and_has_frequencies(spark, docs):
    own = index.build(docs)
    again = index.opened(spark, own.path)
    assert (again.n_docs, again.avgdl, again.buckets, again.key) == (own.n_docs, own.avgdl, own.buckets, "doc_id")
    assert {tuple(r) for r in again.terms.select("term", "df").collect()} == {tuple(r) for r in index.document_frequency(own.postings).collect()}
    assert again.blocks.agg(F.sum("n")).first()[0] == own.postings.count()


def test_an_empty_collection_has_an_index(spark, queries):
    own = index.build(spark.createDataFrame([], "doc_id long, text string"))
    assert own.n_docs == 0 and index.sparse_branch(own, queries).collect() == []
    blank = index.build(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert blank.n_docs == 2 and index.sparse_branch(blank, queries, direct_pairs=0).collect() == []


# ---- dictionary


def cut_by(words, text):
    """Longest match by hand."""
    out = []
    for run in re.findall(r"\w+", text.lower()):
        at, rest = 0, ""
        while at < len(run):
            w = max((x for x in words if run.startswith(x, at)), key=len, default="")
            if w:
                out += [rest, w]
                rest, at = "", at + len(w)
            else:
                rest, at = rest + run[at], at + 1
        out.append(rest)
    return [x for x in out if x]


def test_dictionary_cuts_by_longest_match(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abcé가나", k=rng.randrange(1, 5))) for _ in range(120)} | {"송강호", "기생충", "기생", "a_b"}
    texts = ["".join(rng.choices("abcé가나 _-", k=rng.randrange(0, 60))) for _ in range(200)] + ["송강호가 기생충에서", "기생충", "", "ABC"]
    d = Dictionary.of([*words, "two words", " ", "", "x-y", "Ab"])
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", d(F.col("t")).alias("w")).collect()
    assert {r.k: r.w for r in rows} == {k: cut_by(words | {"ab"}, t) for k, t in enumerate(texts)}
    assert spark.range(1).select(d(F.lit(None).cast("string"))).first()[0] == []


def test_a_large_dictionary_and_an_empty_one(spark, monkeypatch):
    rng = random.Random(4)
    words = {"".join(chr(rng.randrange(0xAC00, 0xD7A3)) for _ in range(rng.randrange(2, 5))) for _ in range(2400)}
    d, some = Dictionary.of(words), sorted(words)[::300]
    text = "".join(some) + " x"
    assert spark.range(1).select(d(F.lit(text))).first()[0] == cut_by(words, text)
    assert Dictionary.of([]) == Dictionary() and spark.range(1).select(Dictionary()(F.lit("A bc"))).first()[0] == ["a", "bc"]
    monkeypatch.setattr("seekspark.functions.dictionary.MOST_WORDS", 10)
    with pytest.raises(ValueError):
        trie_pattern(words)


def test_documents_and_queries_are_cut_by_the_same_dictionary(spark):
    docs = spark.createDataFrame([(1, 1, "기생충에서 본 장면"), (2, 2, "다른 이야기")], "item_id long, movie_id long, text string")
    q = spark.createDataFrame([(9, "기생충")], "query_id long, text string")
    d = Dictionary.of(["기생충"])
    found = lambda **k: [r.item_id for r in search.search(search.Collection(docs, None, 50), q, mode="sparse", **k).collect()]
    assert found() == [] and found(tokenizer=d) == [1]
    own = search.Collection(docs, None, 50, index.build(docs, "item_id", tokenizer=d))
    assert [r.item_id for r in search.search(own, q, mode="sparse", tokenizer=Dictionary.of(["기생충"])).collect()] == [1]
    assert IndexVariant(tokenizer="dictionary").name.endswith("dictionary_1536_plot") and X.TOKENIZERS["dictionary"] == Dictionary()
    with pytest.raises(ValueError):
        IndexVariant(tokenizer="mecab")


# ---- term ids


def murmur(data, seed=0):
    h, mask = seed, 0xFFFFFFFF
    turn = lambda x, r: (x << r | x >> 32 - r) & mask
    scramble = lambda k: turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    whole = len(data) // 4 * 4
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        h = (turn(h ^ scramble(k), 13) * 5 + 0xE6546B64) & mask
    h ^= scramble(int.from_bytes(data[whole:], "little")) ^ len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def test_known_hashes(spark):
    known = {"": 0, "hello": 0x248BFA47, "hello, world": 0x149BBB7F, "The quick brown fox jumps over the lazy dog": 0x2E4FF723}
    texts = [*known, "a", "ab", "abc", "abcd", "abcde", "기생충", "é", "\U0001f600x", "x" * 1000]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", murmur3(F.col("t")).alias("h"), murmur3(F.col("t"), 7).alias("s")).collect()
    assert {r.t: r.h for r in rows} == {t: murmur(t.encode()) for t in texts} | {None: None}
    assert {r.t: r.s for r in rows if r.t is not None} == {t: murmur(t.encode(), 7) for t in texts}
    assert {t: murmur(t.encode()) for t in known} == known


def test_terms_that_share_an_id_are_one(spark):
    seen = {}
    pair = next((seen[h], f"t{k}") for k in range(1_000_000) if seen.setdefault(h := murmur(f"t{k}".encode()), f"t{k}") != f"t{k}")
    docs = spark.createDataFrame([(1, f"{pair[0]} {pair[1]} {pair[1]} other"), (2, pair[0])], "doc_id long, text string")
    got = {(r.doc_id, r.term_id): (r.tf, r.dl) for r in with_term_ids(index.postings(docs)).collect()}
    shared = murmur(pair[0].encode())
    assert got == {(1, shared): (3, 4), (1, murmur(b"other")): (1, 4), (2, shared): (1, 1)}


def test_frequencies_and_weights_need_no_stored_index(spark, sf, monkeypatch):
    """Queries on whole documents and on vectors alone neither build nor write an index."""
    from seekspark import queries as Q

    def none(*a, **k):
        raise AssertionError("an index is built")

    monkeypatch.setattr(Q, "_INDEXES", {})
    monkeypatch.setattr(index, "build", none)
    for name in ("term_df", "bm25_doc_weights", "rrf_dense_only"):
        assert Q.queries()[name](spark, sf).count()


def test_a_scan_finds_what_the_index_finds(spark, sf, monkeypatch):
    from seekspark import queries as Q
    from seekspark.operators import scan

    docs, asked = Q._items(spark, sf), Q._queries(spark, sf)
    keep = docs.where("item_id % 3 = 1").select("item_id")
    own = index.build(docs, "item_id")
    rows = lambda df: sorted((r.query_id, r["rank"], r.item_id, round(r.score, 6)) for r in df.collect())
    for k in (None, keep):
        want = rows(index.sparse_branch(own, asked, key="item_id", keep=k, limit=7))
        assert want and rows(scan.scanned_branch(docs, asked, key="item_id", keep=k, limit=7)) == want
    assert rows(scan.scanned_branch(docs, asked, key="item_id", keep=keep, limit=7, matrix=0)) == want
    monkeypatch.setattr(index, "build", None)
    monkeypatch.setattr(Q, "_INDEXES", {})
    assert Q.queries()["hard_filter_topk"](spark, sf).count()


def test_searches_by_few_queries_build_no_index_and_search_a_branch_once(spark, sf, monkeypatch):
    """evaluated_configs has three modes of two branches; it and the other searches by the benchmark's texts need no index."""
    from seekspark import queries as Q
    from seekspark import queries_stored
    from seekspark.operators import metrics, scan

    def none(*a, **k):
        raise AssertionError("an index is built")

    def noted(module, name):
        f = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: calls.append(name) or f(*a, **k))

    calls = []
    monkeypatch.setattr(Q, "_INDEXES", {})
    for module in (index, metrics, scan, search):
        monkeypatch.setattr(module, "build", none)
    noted(search, "scanned_branch")
    noted(search, "dense_branch")
    assert queries_stored.queries()["evaluated_configs"](spark, sf).count() == 9
    assert sorted(calls) == ["dense_branch", "scanned_branch"]
    for name in ("bm25_topk", "rrf_hybrid", "movie_aggregate", "hybrid_movies", "eval_metrics"):
        assert Q.queries()[name](spark, sf).count()


def test_a_scan_keeps_a_null_key_and_other_keys_take_an_index(spark):
    docs = spark.createDataFrame([(None, "red fox"), (5, "red red dog"), (6, "cat"), (7, None)], "item_id long, text string").withColumn("movie_id", F.lit(1))
    q = spark.createDataFrame([(1, "red fox"), (2, "bird"), (3, None)], "query_id long, text string")
    found = lambda d, **k: [(r.query_id, r.item_id, r["rank"]) for r in search.search(search.Collection(d, None, 50, **k), q, mode="sparse").orderBy("rank").collect()]
    assert found(docs) == found(docs, index=index.build(docs, "item_id")) == [(1, None, 1), (1, 5, 2)]
    named = docs.withColumn("item_id", F.concat(F.lit("s"), F.coalesce("item_id", F.lit(0)).cast("string")))
    assert found(named) == [(1, "s0", 1), (1, "s5", 2)]
