"""Each operator against a brute-force version, and on awkward rows: nulls, empty and long texts, ties, repeats, no rows, clashing names."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seekspark.llm import clustering, common, decontaminate, fingerprint, language_id, line_dedup, near_dedup, sentencepiece_lattice, sharding, suffix_dedup, toxicity, url_filter, vector_search, whitening
from seekspark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words_text(rng, rng.randrange(30, 90)) for _ in range(25)]
    texts = [None, "", " \n\t", "\n\n", "x", "A b\nC d", "long " * 4000]
    for b in base:
        texts.append(b)
        w = b.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    shared = "This Line Is Long Enough To Count As A Repeated Line"
    texts += [f"{words_text(rng, 8)}\n {shared if k % 2 else shared.upper()}\t\nend {k}" for k in range(7)]
    texts += [base[0], base[0], base[1] + "\n" + base[2]]
    return [(k, t, "en" if k % 3 else None, f"src{k % 4}", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(docs, *names):
    return docs.withColumns({n: F.lit("own") for n in names})


# ---- 5


def brute_contamination(rows, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = {}
    for item, t in items:
        w = word.findall(lower(t))
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = {}
    for d, t, *_ in rows:
        w = word.findall(lower(t))
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= {*range(k, k + n)}
                    found |= wins[tuple(w[k : k + n])]
        ids = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [4 << 20, 150])
def test_decontamination(spark, docs, rows, block):
    items = [(1, " ".join(rows[8][1].split(" ")[5:25]).upper()), (2, "changed"), (10, rows[9][1]), (3, None), (4, "?!"), (5, "nowhere to be found"), (1, "w1é w2é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in decontaminate.contamination_report(docs, bench, block_bytes=block).collect()}
    assert got == brute_contamination(rows, items)
    kept = decontaminate.drop_contaminated(clashing(docs, "contamination"), bench, block_bytes=block)
    assert kept.columns == [*docs.columns, "contamination"]
    assert {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if not v[-1]}


@pytest.mark.parametrize("block", [4 << 20, 30])
def test_decontamination_with_null_ids(spark, block):
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "e f g h"), (3, "a b c d e f g h"), (4, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "A b c d"), (None, "e f g h"), (7, "e f g h")], "item_id long, text string")
    got = {r.doc_id: tuple(r)[2:] for r in decontaminate.contamination_report(docs, bench, block_bytes=block).collect()}
    sha = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
    assert got == {1: (4, 1, sha(""), True), 2: (4, 2, sha("7"), True), 3: (8, 2, sha("7"), True), 4: (0, 0, sha(""), False)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench, block_bytes=block).collect()] == [4]


def test_decontamination_without_rows(spark, docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination_report(docs, none).where("contaminated").count() == 0
    assert decontaminate.contamination_report(empty(spark), none).count() == 0


# ---- 9


def brute_components(rows, n=4, percent=80):
    sets = {}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def test_near_duplicates(spark, docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicate_report(docs, words=4).collect()}
    assert got == brute_components(rows)
    assert {r.doc_id for r in near_dedup.drop_near_duplicates(clashing(docs, "component_id", "kept", "n_shingles"), words=4).collect()} == {d for d, x in got.items() if x[2]}
    assert near_dedup.near_duplicate_report(empty(spark)).count() == 0


def test_near_duplicates_of_one_large_group(spark):
    """Edited copies, of which many are linked only through others than the bucket's lead."""
    rng = random.Random(3)
    base = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(w), "en", "s", 0))
    rows += [(100 + k, rows[k][1], "en", "s", 0) for k in range(10)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicate_report(spark.createDataFrame(rows, DOCS), words=4).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("cell_rows", [2000, 7])
def test_near_duplicates_of_a_hot_bucket(spark, cell_rows):
    """Many texts in common buckets, few of them linked: bands of one row meet in large buckets, which are dealt into cells."""
    rng = random.Random(11)
    head = [f"h{k}" for k in range(25)]
    rows = []
    for k in range(90):
        tail = [f"t{k // 2}x{j}" for j in range(40)]
        if k % 2:
            tail[rng.randrange(40)] = "edit"
        rows.append((k, " ".join(head + tail), "en", "s", 0))
    rows.append((500, "word " * 100_000, "en", "s", 0))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicate_report(spark.createDataFrame(rows, DOCS), words=4, bands=40, rows=1, cell_rows=cell_rows).collect()}
    assert got == brute_components(rows) and sum(x[2] for x in got.values()) < 60


def test_null_ids_are_linked_with_nothing(spark):
    rows = [(None, "a b c d e", "en", "s", 0), (4, "a b c d e", "en", "s", 0), (4, "a b c d e", "en", "s", 0), (7, "A b c d e", "en", "s", 0)]
    got = sorted(near_dedup.near_duplicate_report(spark.createDataFrame(rows, DOCS)).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [(4, 4, True), (4, 4, True), (7, 4, False), (None, None, True)]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.r_[a[:240], rng.integers(0, 2**63, 60, dtype=np.uint64)]
    s = near_dedup.sketch(np.r_[a, b, a[:2]], np.array([0, 300, 600, 602]), 512)
    assert (s != near_dedup._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.08


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (105, 101), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 105: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 7


def brute_lines(rows, least=40, docs=5):
    strip = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    keys = {}
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(strip(x)) >= least:
                keys.setdefault(strip(x), set()).add(d)
    out = {}
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(keys.get(strip(x), ())) >= docs and max(keys[strip(x)]) != d)]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"batches": 1}, {"batches": 7, "fanout": 3}])
def test_line_dedup(spark, docs, rows, options):
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.line_report(docs, **options).collect()}
    want = brute_lines(rows)
    assert got == want and any(x[1] for x in want.values())


def test_line_dedup_keeps_columns_and_nulls(spark, docs):
    out = line_dedup.drop_repeated_lines(clashing(docs, "lines", "dropped"))
    assert out.columns == [*docs.columns, "lines", "dropped"]
    assert out.where("text is null").count() == 1
    assert line_dedup.line_report(empty(spark)).count() == 0
    line = "z" * 50
    same = spark.createDataFrame([(None, line), (1, line), (1, line), (2, line), (3, line), (9, line + "\n" + line)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup.line_report(same).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (9, 0)]


def test_line_dedup_of_many_lines(spark):
    """A text is split once, not once a line; a repeated row is one document."""
    import time

    shared = [f"a line that is repeated in every document, number {k}" for k in range(15_000)]
    rows = [(d, "\n".join(x for pair in zip(shared, [f"own {d} {k}" for k in range(15_000)]) for x in pair)) for d in range(5)] + [(0, None)]
    rows += [(7, "x" * 300_000), (8, shared[0]), (8, shared[0])]
    start = time.monotonic()
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.line_report(spark.createDataFrame(rows[:5] + rows[6:], "doc_id long, text string")).collect()}
    assert time.monotonic() - start < 60
    assert got == brute_lines(rows[:5] + rows[6:-1]) and got[4][1] == 1 and got[0][1] == 15_000


# ---- 8


def minimax(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, used, n = (lo + hi) // 2, 0, 1
        for x in sizes:
            if used + x > mid:
                used, n = 0, n + 1
            used += x
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("range_bits", [14, 2])
def test_sharding(spark, docs, rows, range_bits):
    got = sharding.shard(clashing(docs, "size", "shard", "h"), shards=4, range_bits=range_bits).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows} and len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    of = {}
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None
        assert of.setdefault(text[r.doc_id], r.shard) == r.shard
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(empty(spark)).count() == 0


def best_of(spark, rows, shards, hot=()):
    """The least maximum of contiguous partitions of the equal texts in the order of their hash, without the hot ones."""
    groups = {}
    for r in spark.createDataFrame(rows, "doc_id long, text string").select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect():
        if r.text not in hot:
            groups[r.h] = groups.get(r.h, 0) + len(r.text.encode()) + 1
    return minimax([groups[h] for h in sorted(groups)], shards)


@pytest.mark.parametrize("range_bits,n", [(14, 3000), (3, 3000), (6, 40), (2, 5)])
def test_sharding_is_the_best_partition(spark, range_bits, n):
    rng = random.Random(n)
    rows = [(k, words_text(rng, rng.randrange(1, 40), 30)) for k in range(n)]
    rows += [(k, rows[k][1]) for k in range(0, n, 3)] + [(7, rows[0][1])] * 3
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), range_bits=range_bits).collect()
    load = [sum(r.size for r in got if r.shard == s) for s in range(16)]
    of, text = {}, dict(rows)
    for r in got:
        assert of.setdefault(text[r.doc_id] if r.doc_id != 7 else (r.doc_id, r.text_crc32), r.shard) == r.shard
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    total, free, hot = sum(load), 16, []
    sizes = {}
    for _, t in rows:
        sizes[t] = sizes.get(t, 0) + len(t.encode()) + 1
    for t, x in sorted(sizes.items(), key=lambda p: -p[1])[:16]:
        if x * free > total:
            total, free, hot = total - x, free - 1, [*hot, t]
    own = {of[t] for t in hot if t in of}
    if n > 5:
        assert max(x for s, x in enumerate(load) if s not in own) == best_of(spark, rows, free, hot)


def test_sharding_with_hot_groups(spark):
    rng = random.Random(8)
    rows = [(k, words_text(rng, 20)) for k in range(3000)]
    rest = sum(len(t.encode()) + 1 for _, t in rows)
    hot = {"a" * 199: rest // 2 // 200, "b" * 199: rest // 8 // 200}  # about a third of all bytes, and a twelfth
    rows += [(len(rows) + k, t) for k, t in enumerate(t for t, n in hot.items() for _ in range(n))]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    text, load, of = dict(rows), [0] * 16, {}
    for r in got:
        load[r.shard] += r.size
        assert of.setdefault(text[r.doc_id], r.shard) == r.shard
    own = [of[t] for t in hot]
    assert len(got) == len(rows) and len({*own}) == 2
    assert max(x for s, x in enumerate(load) if s not in own) == best_of(spark, rows, 14, hot)
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


# ---- 10


def test_url_filters(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("com", "", "block")]
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/en/12?x", "https://example.org/en/2#y", "http://example.org/es", "http://x.example.org/es/1", "http://badexample.org/es/1", "http://b.com/de/", "http://b.com", "http://com/fr/", "u://é.net/a://b", "http://b.com/de\n/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("own"))

    def brute(u):
        rest = (u or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: (r[0].count("."), len(r[1])), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    want = {k: brute(u) for k, u in enumerate(urls)}
    for n in (100, 0):
        got = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(pages, rules, trie_rules=n).collect()}
        assert got == want
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    for n in (100, 5):
        assert {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(pages, frame, trie_rules=n).collect()} == want
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


# ---- 2


def test_top_k(spark):
    rng = np.random.default_rng(4)
    v = [(k, rng.normal(size=8).tolist()) for k in range(300)]
    v += [(400 + k, v[7][1]) for k in range(40)] + [(500, None), (501, [1.0, None]), (502, [float("nan")]), (503, []), (504, [0.5])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    for frame in (df, df.withColumn("score", F.lit(1))):
        got = {}
        for r in vector_search.top_k(frame, F.col("vec_id") % 50 == 0, block_rows=16, pivots=5).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
        fine = {k: np.floor(256 * np.array(x + [0.0] * (8 - len(x)))).astype(int) for k, x in v if x and all(y is not None and np.isfinite(y) for y in x)}
        for q in fine:
            if q % 50 == 0:
                best = sorted(((-int(fine[q] @ x), k) for k, x in fine.items() if k != q))[:5]
                assert [got[q][i + 1] for i in range(5)] == [(k, -s) for s, k in best]
    assert vector_search.top_k(df.limit(0), F.lit(True)).count() == 0
    assert vector_search.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [-1.0, 0.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=5).collect())
    assert got == [(0, 1, 7, 65536), (0, 2, 7, 65536), (0, 3, 8, -65536)]  # 256 has lesser bytes than 128


# ---- 6


def brute_repeats(rows, n):
    seen, out = {}, {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if b[i : i + n] in seen:
                gone[i : i + n] = True
            seen.setdefault(b[i : i + n], 1)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("way", ["sent", "joined", "split"])
def test_suffix_dedup(spark, docs, rows, way, monkeypatch):
    if way == "joined":
        monkeypatch.setattr(suffix_dedup, "SENT_ANCHORS", 0)
    if way == "split":
        monkeypatch.setattr(suffix_dedup, "SHARD_ROWS", 2)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeat_report(docs).collect()}
    want = brute_repeats(rows, 100)
    assert got == want and sum(x[1] for x in want.values()) > 1000


def test_suffix_dedup_edges(spark, docs):
    out, name = suffix_dedup.remove_repeats(clashing(docs, "repeats"))
    assert name == "repeats_1" and out.columns == [*docs.columns, "repeats", "repeats_1"]
    assert suffix_dedup.repeat_report(empty(spark)).count() == 0


@pytest.mark.parametrize("shard_rows,sent", [(2, 10**6), (50, 10**6), (50, 0), (10**6, 10**6)])
def test_suffix_dedup_of_hot_anchors(spark, shard_rows, sent, monkeypatch):
    """One text with many occurrences of an anchor, many copies, texts without an id, short texts near two anchors."""
    monkeypatch.setattr(suffix_dedup, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(suffix_dedup, "SENT_ANCHORS", sent)
    monkeypatch.setattr(suffix_dedup, "MERGE_ROWS", 300)
    rng = random.Random(4)
    unit = "".join(rng.choice("abcdefgh ") for _ in range(130))
    rows = [(0, "".join(unit + f"{k % 7}" for k in range(200))), (1, "z" * 20_000)]
    rows += [(10 + k, f"{k} {unit} {unit[:60]}{k}") for k in range(60)]
    rows += [(200 + k, unit[:105] + ("x" if k % 2 else "y")) for k in range(20)]
    rows += [(300 + k, "".join(rng.choice("ab") for _ in range(400))) for k in range(10)]
    rows += [(400, "\x00" * 150), (401, "\x00" * 149 + "a"), (402, "é" * 99 + "\x00" * 3)]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeat_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_repeats(rows, 100)
    nulls = [(None, f"{unit}{chr(33 + k)}") for k in range(40)] + [(5, unit)]
    out = suffix_dedup.repeat_report(spark.createDataFrame(nulls, "doc_id long, text string").repartition(4)).collect()
    removed = sorted(r.n_removed for r in out if r.doc_id is None)
    assert sum(r.n_removed == 130 for r in out if r.doc_id == 5) == 1 and removed.count(0) == 1 and all(x == 130 for x in removed[1:])


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for parts in (1, 5):
        x = rng.integers(97, 99, 400).astype(np.uint8)
        x[150:260] = x[20:130]
        size = 400 // parts
        left = size - np.arange(400) % size
        sa = suffix_dedup.suffix_array(x, left)
        assert sa.tolist() == sorted(range(400), key=lambda i: (x[i : i + left[i]].tolist(), i))

        def common(i, j, most):
            n = 0
            while n < most and x[i + n] == x[j + n]:
                n += 1
            return n

        most = 60
        own = sa[left[sa] >= most]
        assert suffix_dedup.common_prefixes(x, own, left, most)[1:].tolist() == [common(own[k], own[k - 1], most) for k in range(1, len(own))]


# ---- 1


def test_sentencepiece(spark, docs, rows):
    from seekspark.llm.queries import MODEL

    pieces = sentencepiece_lattice.load_pieces(MODEL)
    with pytest.raises(FileNotFoundError):
        sentencepiece_lattice.load_pieces("/nowhere.model")
    awkward = docs.union(spark.createDataFrame([(900, " a  ▁b\x00 漢字😀 \n\n z", None, None, 0), (901, "y" * 5000, None, None, 0), (901, "y" * 5000, None, None, 0)], DOCS))
    for size in (10, 200_000):
        got = sentencepiece_lattice.round_trip(awkward, pieces, vocabulary=size).collect()
        assert len(got) == len(rows) + 3 and all(r.same for r in got)
    out = sentencepiece_lattice.with_ids(clashing(docs, "ids"), pieces)
    assert out.columns == [*docs.columns, "ids", "ids_1", "n_ids", "same"]
    assert sentencepiece_lattice.round_trip(empty(spark), pieces).count() == 0


def test_viterbi_finds_the_best_path(spark):
    pieces = sentencepiece_lattice.Pieces(("▁", "a", "b", "ab", "ba", "aba"), (0, 1, 2, 3, 4, 5), (-1.0, -2.0, -2.0, -2.5, -2.5, -4.0), (), tuple(b"" for _ in range(6)), 9)
    words = ["▁", "a", "abab", "▁abaab", "bbab", "xab", "▁xx"]

    def brute(w):
        best = {0: (0.0, ())}
        for j in range(1, len(w) + 1):
            options = []
            for i in range(j):
                p = w[i:j]
                if p in pieces.text:
                    k = pieces.text.index(p)
                    options.append((best[i][0] + pieces.scores[k], -i, best[i][1] + (pieces.ids[k],)))
            if w[j - 1] not in pieces.text:
                options.append((best[j - 1][0] + pieces.fallback, -(j - 1), best[j - 1][1] + (9,)))
            s, _, path = max(options)
            best[j] = (s, path)
        return list(best[len(w)][1])

    df = sentencepiece_lattice.lattice(spark.createDataFrame([(w,) for w in words], "word string"), pieces).cache()
    got = {r.word: r.ids for r in df.select("word", sentencepiece_lattice.viterbi(F.col("edges"), F.char_length("word")).alias("ids")).collect()}
    speller = sentencepiece_lattice.Speller((), pieces)
    for w in words:
        assert got[w] == brute(w) == np.frombuffer(speller[w.replace("▁", " ").encode()], np.int32).tolist()


def test_sentencepiece_equals_the_best_path_of_a_real_model(spark, docs, rows):
    """The ids of every text, by a slow best path over its words, with the vocabulary's lattice and without it."""
    from seekspark.llm.queries import MODEL

    pieces = sentencepiece_lattice.load_pieces(MODEL)
    score = dict(zip(pieces.text, zip(pieces.scores, pieces.ids)))

    def best(word):
        found = [(0.0, 0, ())]
        for j in range(1, len(word) + 1):
            options = [(found[i][0] + score[word[i:j]][0], -i, found[i][2] + (score[word[i:j]][1],)) for i in range(max(0, j - pieces.longest), j) if word[i:j] in score]
            if word[j - 1] not in score:
                options.append((found[j - 1][0] + pieces.fallback, 1 - j, found[j - 1][2] + pieces.spelled(word[j - 1])))
            found.append(max(options, key=lambda o: (o[0], o[1])))
        return list(found[-1][2])

    def slow(text):
        return None if text is None else [i for w in re.findall("▁+[^▁\n]*|\n|[^▁\n]+", "▁" + text.replace(" ", "▁")) for i in best(w)] if text else []

    some = [(d, t) for d, t, *_ in rows if len(t or "") < 5000] + [(910, "Über  ▁▁ naïve\n漢字😀 x" * 3), (911, "a" * 70), (912, " ")]
    frame = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    want = {d: slow(t) for d, t in some}
    for size in (0, 300_000):
        assert {r.doc_id: r.ids for r in sentencepiece_lattice.round_trip(frame, pieces, vocabulary=size).collect()} == want


# ---- 4 and 3


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language_id.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) >= 0.9
    assert all(0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ?!"), (4, "٣"), (5, "the and of that"), (None, "the the")], "doc_id long, text string").withColumn("language", F.lit("own"))
    labelled, name = language_id.identify(odd, language_id.fit(docs))
    got = [r[name].lang for r in labelled.collect()]
    assert got[:4] == ["und"] * 4 and got[4] == "en" and name == "language_1"
    unlearned, name = language_id.identify(odd, language_id.fit(docs.limit(0)))
    assert {r[name].lang for r in unlearned.collect()} == {"und"}


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    e, start, trans = rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    g, pairs = language_id.forward_backward(e, start, trans, np.array([0, 3]), np.array([3, 2]), True)
    for lo, n in ((0, 3), (3, 2)):
        w = {p: np.exp(start[p[0]] + sum(e[lo + i, k] for i, k in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product(range(3), repeat=n)}
        z = sum(w.values())
        for i in range(n):
            assert np.allclose(g[lo + i], [sum(x for p, x in w.items() if p[i] == k) / z for k in range(3)])
    assert np.isclose(pairs.sum(), 3)


def test_toxicity(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = toxicity.toxicity_report(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in scored]), np.array([r.score for r in scored])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert auc > 0.75 and np.mean((s >= 0.5) == y) > 0.95
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "you stupid moron, you stupjd idiot " * 3), (3, "x" * 100_000)], "doc_id long, text string")
    got = [r.predicted for r in toxicity.toxicity_report(odd, labels.limit(0)).collect()]
    assert got == [0, 0, 1, 0]


def test_automaton_is_edit_distance_one():
    terms = ["idiot", "scum", "worthless", "stam*"]
    a = toxicity.Automaton([t.encode() for t in terms])
    words = ["idiot", "idiott", "idot", "idxot", "diot", "idoit", "scum", "scom", "worthles", "stammer", "stxmmer", "stam", "x"]
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    w, t, e = a.match(raw, end - [len(x) for x in words], end)
    got = {words[i]: (terms[k], n) for i, k, n in zip(w, t, e)}
    assert got == {"idiot": ("idiot", 0), "idiott": ("idiot", 1), "idot": ("idiot", 1), "idxot": ("idiot", 1), "diot": ("idiot", 1), "scum": ("scum", 0), "worthles": ("worthless", 1), "stammer": ("stam*", 0), "stam": ("stam*", 0)}


def test_automaton_prefers_exact_terms_and_longer_stems():
    terms = ["stam*", "stamm*", "stammer", "stam", "stamina", "sta*"]
    a = toxicity.Automaton([t.encode() for t in terms])
    words = ["stam", "stamp", "stammer", "stammers", "stamina", "staminb", "stay", "stxmmer"]
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    w, t, e = a.match(raw, end - [len(x) for x in words], end)
    got = {words[i]: (terms[k], n) for i, k, n in zip(w, t, e)}
    assert got == {"stam": ("stam", 0), "stamp": ("stam*", 0), "stammer": ("stammer", 0), "stammers": ("stamm*", 0), "stamina": ("stamina", 0), "staminb": ("stam*", 0), "stay": ("sta*", 0), "stxmmer": ("stammer", 1)}


def test_toxic_terms_are_all_learned_and_reached(spark):
    rng = random.Random(3)
    insults = [f"bomen{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(120)]
    rows, labels = [], []
    for k in range(1080):
        toxic = k % 3 == 0
        middle = [insults[k // 3 % 120], "vejuat" + rng.choice("abcdefghijk")] if toxic else [rng.choice(["bomenlijk", "bomenpark"])]
        rows.append((k, " ".join([words_text(rng, 10), *middle, words_text(rng, 10)])))
        labels.append((k, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    s = toxicity.fit(docs, labels)
    assert "bomen*" not in s.terms and "vejua*" in s.terms and not any(t.startswith("vejuat") and t.endswith("*") for t in s.terms)
    counts = toxicity._learned([set(t.split(" ")) for _, t in rows for _ in range(4)], np.repeat([r[0] % 3 == 0 for r in rows], 4).astype(float), 1440.0, 2880.0)
    assert set(insults) <= set(counts[0])
    a = toxicity.Automaton([t.encode() for t in sorted(counts[0])])
    raw = np.frombuffer("".join(insults).encode(), np.uint8)
    end = np.cumsum([len(w) for w in insults])
    _, t, e = a.match(raw, end - 8, end)
    assert sorted(sorted(counts[0])[k] for k in t) == sorted(insults) and not e.any()


# ---- 4 and 3 against slow versions


M64 = 2**64 - 1


def slow_mix(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M64
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M64
    return h ^ (h >> 31)


def slow_hash(b):
    """The polynomial hash of a byte string."""
    total, power = 0, 1
    for c in b:
        total = (total + int(common._VALUES[c]) * power) & M64
        power = (power * common._BASE) & M64
    return slow_mix((total + len(b)) & M64)


def slow_language(model, text):
    """lang, score and the words' languages, by loops over features, words and lines."""
    n = len(model.langs)
    mass, labels = np.zeros(n), []
    word = re.compile(rb"[A-Za-z\x80-\xff]+")
    move, first = np.exp(model.trans), np.exp(model.start)
    for line in (text or "").split("\n"):
        found = [m[0].lower() for m in word.finditer(line.encode())]
        e = []
        for w in found:
            f = [slow_hash(w)]
            for k in range(1, min(3, len(w)) + 1):
                f += [slow_mix((slow_hash(w[:k]) + k) & M64), slow_mix((slow_hash(w[-k:]) + 8 + k) & M64)]
            f += [slow_mix((slow_hash(w[i : i + 3]) + 16) & M64) for i in range(len(w) - 2)]
            e.append(np.exp(sum(model.weights[x >> (64 - language_id.FEATURE_BITS)].astype(float) for x in f) / np.sqrt(len(f))))
        a = []
        for p in e:
            a.append(p * (a[-1] @ move if a else first))
            a[-1] /= a[-1].sum()
        b = np.ones(n)
        for i in range(len(e) - 1, -1, -1):
            g = a[i] * b / (a[i] * b).sum()
            mass += g
            labels.append((i, model.langs[int(g.argmax())]))
            b = move @ (e[i] * b)
            b /= b.sum()
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0, []
    return model.langs[int(mass.argmax())], mass.max() / mass.sum(), labels


@pytest.mark.parametrize("piece", [256, 3])
def test_language_id_equals_a_slow_field(spark, sf, piece, monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", piece)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 6000][:60]
    rows += [(-1, None), (-2, ""), (-3, " 12 "), (-4, "É"), (-5, "\n\nthe\n"), (-5, "\n\nthe\n"), (-6, rows[0][1].replace("\n", " ") + rows[1][1].replace("\n", " "))]
    slow = {d: slow_language(model, t) for d, t in rows}
    raw, off = common.utf8(pa.array([t for _, t in rows], pa.large_string()))
    w = language_id.Words(raw, off)
    g, _ = model.words(w)
    step = language_id._labeller(type("Shared", (), {"value": model}), 0)()
    out = step(pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], names=["text"]))[0].to_pylist()
    for (d, _), r in zip(rows, out):
        lang, score, _ = slow[d]
        assert r["lang"] == lang and r["score"] == pytest.approx(score, abs=2e-3), d
    for k, (d, _) in enumerate(rows):
        got = [model.langs[x] for x in g[w.doc == k].argmax(1)]
        assert sorted(x for _, x in slow[d][2]) == sorted(got)


def test_forward_backward_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    e, start, trans = rng.normal(size=(60, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    chain, length = np.array([0, 41, 42, 52]), np.array([41, 1, 10, 8])
    whole, pairs = language_id.forward_backward(e, start, trans, chain, length, True)
    for n in (1, 2, 7, 10):
        monkeypatch.setattr(language_id, "PIECE", n)
        g, p = language_id.forward_backward(e, start, trans, chain, length, True)
        assert np.allclose(g, whole) and np.allclose(p, pairs)


def test_words_of_switched_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs)
    part = {}
    for r in docs.where("lang in ('en', 'de')").orderBy("doc_id").collect():
        if not language_id_held(r.doc_id) and len(part.get(r.lang, "").split()) < 60:
            part[r.lang] = f"{part.get(r.lang, '')} {' '.join(r.text.split())}"
    en, de = (" ".join(part[x].split()[:40]) for x in ("en", "de"))
    odd = spark.createDataFrame([(1, f"{en} {de}"), (2, None), (3, " 1 "), (4, (en + " ") * 4000)], "doc_id long, text string").withColumn("words", F.lit("own"))
    out, name = language_id.label_words(odd, model)
    got = {r.doc_id: r[name] for r in out.collect()}
    half = len(en.encode())
    assert name == "words_1" and got[2] == got[3] == [] and len(got[4]) == 4000 * sum(x.end <= half for x in got[1])
    right = [x.lang == ("en" if x.end <= half else "de") for x in got[1]]
    assert np.mean(right) > 0.85
    labelled, n = language_id.identify(odd, model)
    share = {r.doc_id: (r[n].lang, r[n].score) for r in labelled.collect()}
    assert share[4][0] == "en" and share[4][1] > share[1][1]


def language_id_held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def slow_toxicity(scorer, text):
    """The score by edit distances of every word to every term, and a look at the words and marks around each hit."""
    raw = (text or "").encode()
    plain = re.sub("[\xa0-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\u2000-\u200b\u200e-\u206f\u3000-\u303f]", lambda m: " " * len(m[0].encode()), text or "").encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in plain)
    words = [(m.start(), m.end()) for m in re.finditer(rb"[0-9a-z\x80-\xff]+", low)]
    terms = [t.encode() for t in scorer.terms]
    clean = set(scorer.clean.tolist())
    meant, quoted, fuzzy, best = 0, 0, 0, 0.0
    for k, (a, b) in enumerate(words):
        w = low[a:b]
        hit = next(((0, i) for i, t in enumerate(terms) if t == w), None)
        if hit is None:
            stems = [(len(t), i) for i, t in enumerate(terms) if t.endswith(b"*") and w.startswith(t[:-1])]
            if stems:
                hit = (0, max(stems)[1])
            else:
                near = [i for i, t in enumerate(terms) if not t.endswith(b"*") and len(t) >= toxicity.FUZZY_LENGTH and abs(len(t) - len(w)) <= 1 and edit_distance(t, w) == 1]
                hit = (1, near[0]) if near and slow_hash(w) not in clean else None
        if hit is None:
            continue
        n = toxicity.CONTEXT
        lo = words[k - n - 1][1] if k > n else 0
        hi = words[k + n + 1][0] if k + n + 1 < len(words) else len(raw)
        has = lambda part: any(q.encode() in part for q in toxicity.QUOTES)
        said = any(low[x:y].decode() in toxicity.SAYING for x, y in words[max(0, k - n) : k])
        if has(raw[lo:a]) and has(raw[b:hi]) or said:
            quoted += 1
        else:
            meant, fuzzy = meant + (hit[0] == 0), fuzzy + (hit[0] == 1)
            best = max(best, scorer.weight[hit[1]] / (1 + hit[0]))
    x = np.array([1, np.log1p(meant), np.log1p(quoted), np.log1p(fuzzy), best, np.log1p(100 * (meant + fuzzy) / max(1, len(words)))])
    return 1 / (1 + np.exp(-np.clip(x @ scorer.coef, -30, 30)))


def test_toxicity_equals_a_slow_scorer(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scorer = toxicity.fit(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id").collect() if len(r.text) < 3000][:25]
    rows += [(-1, None), (-2, ""), (-3, "They said: “you stupid idiot”"), (-4, "you stupid idiot"), (-5, "“stupid”—idiot…moron"), (-6, "idiott stupjd"), (-7, 'a "' + "x " * 7 + 'idiot "'), (-8, "idiot" + "z" * 50_000 + " scum")]
    long_stem = next((t[:-1] for t in scorer.terms if t.endswith("*")), None)
    rows += [(-9, f"{long_stem}{'q' * 100}")] if long_stem else []
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out, name = toxicity.score_toxicity(frame, scorer)
    for r in out.collect():
        text = dict(rows)[r.doc_id]
        if len(text or "") < 10_000:
            assert r[name].score == pytest.approx(slow_toxicity(scorer, text), abs=1e-6), r.doc_id
    if long_stem:
        assert {r.doc_id: r[name].meant for r in out.collect()}[-9] == 1


def test_toxicity_of_quotation_and_abuse(spark):
    scorer = toxicity.Scorer({"idiot": 1.0, "scum": 1.0}, set())
    said = "He called them “scum” and wrote"
    long_quote = '"idiot" ' + "w" * 300 + ' "'
    rows = [(1, said), (2, "you scum"), (3, "“" + "idiot " * 3 + "”"), (4, "scum"), (5, '"a b c d e f g h i scum j k l m n o p q"'), (6, 'first "idiot ' + "w" * 500 + '" end'), (7, long_quote), (8, None), (2, "you scum")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"toxicity": F.lit("own"), "score": F.lit(1)})
    out, name = toxicity.score_toxicity(frame, scorer)
    got = {r.doc_id: (r[name].meant, r[name].quoted) for r in out.collect()}
    assert name == "toxicity_1" and got == {1: (0, 1), 2: (1, 0), 3: (0, 3), 4: (1, 0), 5: (1, 0), 6: (0, 1), 7: (0, 1), 8: (0, 0)}
    assert toxicity.toxicity_report(frame.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, f"idiot {k} " * 50) for k in range(400)] + [(1, "idiot again")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    seen = []
    learned = toxicity._learned
    toxicity._learned = lambda words, y, *a: seen.append(len(y)) or learned(words, y, *a)
    try:
        toxicity.fit(docs, labels, fit_bytes=20_000)
        toxicity.fit(docs, labels, per_label=30)
    finally:
        toxicity._learned = learned
    assert seen[0] < 100 and seen[1] == 60


# ---- pipeline


def test_pipeline_keeps_texts_of_many_languages(spark):
    import corpus_pipeline

    rng = random.Random(6)
    line = lambda k: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwx"[4 * k : 4 * k + 4]) for _ in range(6)) for _ in range(12))
    rows = [(k, line(k % 6), f"l{k % 6}") for k in range(240)]
    rows += [(1000, "\n".join(line(k) for k in range(6)), None), (1001, None, None), (1002, "12 !", None)]
    rows += [(1003, " ".join("".join(rng.choice("αβγδεζηθικλμ") for _ in range(7)) for _ in range(40)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {*range(240), 1000}


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(9)
    junk = " ".join("".join(rng.choice("абвгдежзик") for _ in range(8)) for _ in range(50))
    first = docs.orderBy("doc_id").first()
    odd = [(900_001, None, None, None, None), (900_002, "", "en", "s", 0), (900_003, junk, None, "s", 0), (900_004, first.text, None, "s", 0), (first.doc_id, first.text, first.lang, first.source, first.n_chars), (None, "the and of", None, None, 0)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("ids", F.lit("own"))
    sf, old = f"{tmp_path}", sf
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{old}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns[-3:] == ["ids_1", "n_ids", "same"]
    gone = {900_001, 900_002, 900_003}
    docs = docs.where(F.coalesce(~F.col("doc_id").isin(*gone), F.lit(True)))
    source = {r.doc_id: r.text for r in docs.collect()}
    assert out.where("doc_id is null").count() == 1 and 900_004 not in got
    source.pop(None), got.pop(None)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    lines = [(d, t) for d, t in source.items()]
    keep = {k for k, x in brute_lines(lines).items()}
    changed = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()}
    alive = brute_components([(d, changed[d]) for d in keep], n=5)
    want = {d for d, x in alive.items() if x[2]}
    leaks = brute_contamination([(d, changed[d]) for d in want], bench)
    want = {d for d in want if not leaks[d][-1]}
    assert {*got} == want and all(got[d].text == changed[d] and got[d].same for d in want)


def test_pipeline_without_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = len(common.made(spark))
    assert corpus_pipeline.run(spark, f"{tmp_path}").count() == 0
    assert len(common.made(spark)) <= before + 1


# ---- 11


def brute_sketch(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    grams = {t[k : k + fingerprint.SHINGLE].encode() for k in range(max(1, len(t) - fingerprint.SHINGLE + 1))} if t else set()
    hashes = sorted(int(common.Prefix(np.frombuffer(g, np.uint8)).of(np.array([0]), np.array([len(g)]))[0]) for g in grams)
    below = [h for h in hashes if h < (1 << 64) // fingerprint.SCALE]
    return below if len(below) >= fingerprint.LEAST else hashes[: fingerprint.LEAST]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    top = min(max(x[-1], (1 << 64) // fingerprint.SCALE - 1) if len(x) >= fingerprint.LEAST else 1 << 64 for x in (a, b))
    a, b = ({h for h in x if h <= top} for x in (a, b))
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def brute_fingerprints(rows):
    rows = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] or ""))
    out = []
    for k, (d, t, *_) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        e = t[: len(t) - cut] + after[:cut]
        own, changed, then = (brute_sketch(x) for x in (t, e, after))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(f"{h:016x}" for h in own), "".join(f"{h:016x}" for h in changed), brute_likeness(own, changed), brute_likeness(own, then)))
    return sorted(out, key=repr)


def got_fingerprints(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_fingerprints_are_those_of_brute_force(docs, rows, size):
    assert got_fingerprints(fingerprint.fingerprint_report(clashing(docs, "fingerprint", "part", "guest", "key"), size)) == brute_fingerprints(rows)


def test_fingerprints_of_awkward_documents(spark):
    rng = random.Random(3)
    long = " ".join(words_text(rng, 5, 30_000) for _ in range(3000))
    rows = [(None, "no id é"), (None, None), (7, "seven 😀😀😀😀 eight"), (7, None), (7, "seven 😀😀😀😀 eight"), (9, long), (10, long), (11, ""), (2**62, "the LAST one"), (-4, "ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (2, 100):
        assert got_fingerprints(fingerprint.fingerprint_report(df, size)) == brute_fingerprints(rows)
    alone = [(3, "a single document is its own next")]
    assert got_fingerprints(fingerprint.fingerprint_report(spark.createDataFrame(alone, "doc_id long, text string"))) == brute_fingerprints(alone)
    assert fingerprint.fingerprint_report(empty(spark)).collect() == []


def test_fingerprint_column_keeps_columns_and_empty_texts(docs, rows):
    out = fingerprint.with_fingerprint(clashing(docs, "fingerprint"))
    assert out.columns[-2:] == ["fingerprint", "fingerprint_1"]
    found = {r.doc_id: r.fingerprint_1 for r in out.collect()}
    assert found == {d: "".join(f"{h:016x}" for h in brute_sketch(t or "")) for d, t, *_ in rows}


def test_merged_fingerprints_are_those_of_both_texts_and_tell_containment():
    rng = np.random.default_rng(8)
    few, many, other = (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for n in (30, 40_000, 50_000))
    kept = fingerprint.kept_hashes
    for a, b in ((few, many), (many, other), (few, few[:5]), (few, other[:50])):
        whole = kept(np.concatenate([a, b]))
        top = min(fingerprint.limit(kept(a)), fingerprint.limit(kept(b)))
        assert np.array_equal(fingerprint.merged(kept(a), kept(b))[: fingerprint.LEAST], whole[whole <= top][: fingerprint.LEAST])
    assert np.array_equal(fingerprint.read(fingerprint.written(kept(many))), kept(many))
    part = many[:4000]
    assert fingerprint.likeness(kept(part), kept(many)) == 1.0
    half = np.concatenate([many[:4000], other[:4000]])
    assert 0.35 < fingerprint.likeness(kept(half), kept(many)) < 0.65
    assert fingerprint.likeness(kept(many), kept(other)) < 0.02


# ---- 12

VEC = "vec_id long, embedding array<double>"


def brute_whitening(rows, k=4):
    ok = [(i, [int(math.floor(256 * c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) and abs(256 * c) < 2**62 for c in v)]
    dim = max((len(x) for _, x in ok), default=0)
    ok = [(i, (*x, *[0] * (dim - len(x)))) for i, x in ok]
    fit = sorted({x for _, x in ok})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = [[Fraction(sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit), n**3) for b in range(dim)] for a in range(dim)]
    e, q = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]).reshape(dim, dim))
    far = [(i, sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)), [float(c - Fraction(t, n)) for c, t in zip(x, s, strict=True)]) for i, x in ok]
    return n, e[::-1][:k], q[:, ::-1][:, :k], float(sum(cov[a][a] for a in range(dim))), far


def check_whitening(df, rows, tolerance=1e-9):
    n, e, q, trace, far = brute_whitening(rows)
    got = df.collect()
    assert len(got) == len(far) * len(e) and {r.n for r in got} <= {n}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation_digits), {})[r.component] = r
    for i, d, c in far:
        own = by[i, str(d)]
        assert sorted(own) == list(range(1, len(e) + 1))
        for k in range(len(e)):
            r = own[k + 1]
            assert r.deviation == (d if d < 2**63 else None)
            assert math.isclose(r.explained, e[k] / trace if trace else 0.0, rel_tol=1e-6, abs_tol=1e-9)
            if e[k] > 1e-9 * e[0]:
                assert math.isclose(abs(r.whitened), abs(np.dot(c, q[:, k])) / math.sqrt(e[k]), rel_tol=1e-6, abs_tol=tolerance)
                assert r.identity_error < 1e-4
    return got


def test_whitening_is_that_of_exact_fractions(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(c) for c in rng.normal(3, [2.0, 1.0, 0.5, 0.3, 0.1, 0.05])]) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(50)] + [(None, rows[1][1]), (5, rows[2][1])]
    got = check_whitening(whitening.whitening_report(clashing(spark.createDataFrame(rows, VEC).repartition(5), "component", "x", "n", "whitened")), rows)
    copies = {(r.component, r.whitened) for r in got if r.vec_id is not None and r.vec_id >= 100}
    assert len(copies) == 4  # equal vectors, equal rows


def test_whitening_of_large_components_is_exact(spark):
    rng = np.random.default_rng(5)
    base = 2.0**45
    rows = [(k, [base + float(a), -base * 3 + float(b), float(c)]) for k, (a, b, c) in enumerate(rng.normal(0, [900, 90, 9], (40, 3)))]
    rows += [(90, [float("nan"), 0.0, 0.0]), (91, [2.0**60, 0.0, 0.0]), (92, None), (93, [None, 1.0, 1.0])]
    check_whitening(whitening.whitening_report(spark.createDataFrame(rows, VEC).repartition(3)), rows, 1e-6)


def test_whitening_of_awkward_vectors(spark):
    report = lambda rows: whitening.whitening_report(spark.createDataFrame(rows, VEC))
    assert report([]).collect() == []
    assert report([(1, None), (2, [float("inf")]), (3, [])]).collect() == []
    rows = [(1, [1.0, 2.0]), (2, [0.5]), (3, []), (4, [-0.001, 0.0])]
    check_whitening(report(rows), rows)
    one = report([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, 0.0, None)} and len(one) == 4
    line = report([(k, [float(k), 2.0 * k]) for k in range(9)]).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line)


def test_limb_products_are_exact():
    rng = np.random.default_rng(6)
    x = rng.integers(-(2**62) + 1, 2**62, (300, 3))
    total = sum(m.astype(object) << s for s, m in whitening.gram(x).items())
    big = x.astype(object)
    assert (total == big.T @ big).all()


# ---- 13


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) and abs(256 * c) < 2**59 for c in v)]
    ordered = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(x) for _, x in ordered[:k]]
    assign = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = {}
        for _, x in kept:
            own.setdefault(assign(x)[1], []).append(x)
        for j, xs in own.items():
            centres[j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    last = [(i, *assign(x)[::-1]) for i, x in kept]
    inertia = {j: sum(d for _, c, d in last if c == j) for j in range(len(centres))}
    fit = lambda v: v if v < 2**63 else None
    return sorted(((i, j, fit(d), fit(inertia[j]), fit(sum(inertia.values())), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, j, d in last), key=repr)


def check_clusters(spark, rows, k=6, rounds=4, dim=3):
    df = clashing(spark.createDataFrame(rows, VEC).repartition(4), "cluster", "x", "distance")
    got = clustering.cluster_report(df, k=k, rounds=rounds, dim=dim)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows, k, rounds, dim)


def test_clusters_are_those_of_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(k, [float(c) for c in rng.normal(k % 4, 0.4, 3)]) for k in range(120)]
    rows += [(200 + k, [1.0, 1.0, 1.0]) for k in range(70)]  # a hot vector
    check_clusters(spark, rows)


def test_clusters_of_awkward_vectors(spark):
    rows = [(1, [0.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 0.0, 0.0]), (5, [None, 0.0, 0.0]), (6, [-1.0, 0.25, 0.001]), (2**61 + 1, [5.0, -5.0, 5.0])]
    check_clusters(spark, rows)
    check_clusters(spark, [(1, [2.0**48, 0.0, -(2.0**48)]), (2, [-(2.0**48), 3.0, 1.0]), (3, [2.0**49, 1.0, 0.0]), (4, [2.0**51, 0.0, 0.0])], k=2)
    check_clusters(spark, [(1, [2.0**31, 0.0, -(2.0**31)]), (2, [-(2.0**31), 3.0, 1.0]), (3, [2.0**32, 1.0, 0.0])], k=2)
    check_clusters(spark, [])


def test_nearest_centroid_of_equal_ones_is_the_first():
    at, far = clustering.nearest(np.array([[0, 0], [4, 0]]), [[1, 0], [-1, 0], [1, 0]])
    assert at.tolist() == [0, 0] and far.tolist() == [1, 9]


# ---- what the reports found


def test_rows_that_repeat_a_doc_id_are_one_document(spark):
    rng = random.Random(21)
    a, b, c = (words_text(rng, 40, 4000) for _ in range(3))
    near = a.split(" ")
    near[3] = "changed"
    rows = [(1, a), (5, a), (5, b), (2, b), (7, c), (8, " ".join(near)), (9, None), (9, c), (10, ""), (10, "x y"), (None, a), (11, "alone here with five words")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=5).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 5: 1, 2: 1, 8: 1, 7: 7, 9: 7, 10: 10, None: None, 11: 11}
    assert len(got) == len(rows)


def test_line_runs_meet_without_a_shuffle_or_a_sort(spark):
    runs = line_dedup.LineRuns(2, fanout=3)
    frame = lambda *r: spark.createDataFrame(r, "h1 long, h2 long, id long")
    runs.add(frame((1, 1, 9), (1, 1, 8), (2, 2, 9)))
    runs.add(frame((1, 1, 5), (2, 2, 4), (3, 3, 4)))
    with common.sorted_buckets(spark):
        batch = runs._run(frame((1, 1, 1), (3, 3, 1)).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper")))
        plan = runs.unsettled(batch)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan and "Sort [" not in plan and "Aggregate" not in plan
    assert {tuple(r) for r in runs.repeated().collect()} == {(1, 1, 9), (2, 2, 9)}
    common.discard(batch)
    runs.discard()


def test_relabelling_stops_at_the_ends_of_texts():
    texts = [f"der die das {k}" if k % 2 else f"the of and {k}" for k in range(200)]
    model = language_id.Model(["de", "en"]).fit(texts, [0 if k % 2 else 1 for k in range(200)])
    w = language_id.Words(*common.utf8(pa.array(["the", "die", "of and", "das der"])))
    got = model.words(w)[0].argmax(1)
    assert got.tolist() == [1, 0, 1, 1, 0, 0]


def test_vectors_whose_scores_could_leave_a_long_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (50, [2.0**22, -(2.0**22)]), (1, [1e18, 0.0]), (2, [0.5, 0.5]), (3, [1.5 * 2.0**22, 1.0]), (4, [2.0**24, 0.0])]
    got = vector_search.top_k(spark.createDataFrame(rows, VEC), F.col("vec_id") % 50 == 0, k=3).collect()
    assert {r.vec_id for r in got} == {0, 2, 3, 50}
    assert {(r.query_id, r.vec_id): r.score for r in got}[50, 3] == 2**30 * 3 * 2**29 - 2**30 * 256


def test_top_k_broadcasts_no_visits(spark, monkeypatch):
    """Queries visit most annuli when vectors are spread out; groups of annuli get each query once, by a shuffle."""
    monkeypatch.setattr(vector_search, "GROUPS", 4, raising=False)
    monkeypatch.setattr(vector_search, "HITS", 64, raising=False)
    rng = np.random.default_rng(5)
    v = [(k, rng.normal(size=6).tolist()) for k in range(400)]
    v += [(1000 + k, v[k % 3][1]) for k in range(60)]
    df = vector_search.top_k(spark.createDataFrame(v, VEC), F.col("vec_id") % 50 == 0, block_rows=8, pivots=3)
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, x in enumerate(lines):
        below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        assert "BroadcastExchange" not in x or not any("MapInArrow" in y for y in lines[i:below])
    x = {k: np.floor(256 * np.array(c)).astype(int) for k, c in v}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in df.collect()}
    want = {(q, i + 1): (k, -s) for q in x if q % 50 == 0 for i, (s, k) in enumerate(sorted((-int(x[q] @ y), k) for k, y in x.items() if k != q)[:5])}
    assert got == want
