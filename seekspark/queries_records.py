"""Operators on records, files, sessions and texts as queries over the test tables, each beside the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark import schema
from seekspark.functions import text as X
from seekspark.operators import clarify, dedup, quality, report, resolve
from seekspark.operators.common import placed
from seekspark.plans import agent, variants
from seekspark.queries import _HYBRID_SQL, _t, hybrid_candidates, query_registry
from seekspark.sources import tables
from seekspark.sources.shared import shared_folder

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
query = query_registry(_Q, _SQL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _scene_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as scenes: every fifth has no caption, every seventh one of an old model, every third no English."""
    k = F.col("doc_id")
    return _t(spark, d, "documents").select(
        k.cast("string").alias("id"),
        F.substring("source", 4, 9).cast("long").alias("movie_id"),
        F.when(k % 5 != 0, F.col("text")).alias("caption_ko"),
        F.when(k % 3 != 0, F.upper("lang")).alias("caption_en"),
        F.when(k % 11 != 0, F.col("lang")).alias("tags"),
        F.when(k % 7 == 0, "v1").otherwise("v2").alias("model_version"),
    )


_SCENES_SQL = "scenes as (select doc_id::varchar id, substr(source, 4)::bigint movie_id, case when doc_id % 5 <> 0 then text end caption_ko, case when doc_id % 3 <> 0 then upper(lang) end caption_en, case when doc_id % 11 <> 0 then lang end tags, case when doc_id % 7 = 0 then 'v1' else 'v2' end model_version from documents)"


# ---- texts ---------------------------------------------------------------------------


@query(f"with {_SCENES_SQL} select id, movie_id, md5(text) h from (select *, concat_ws(chr(10), nullif(trim(caption_ko), ''), nullif(trim(caption_en), '')) text from scenes where caption_ko is not null and tags is not null and model_version = 'v2') where text <> ''")
def scene_texts_both(spark, d):
    s = variants.scene_texts(_scene_rows(spark, d), variants.IndexVariant(doc_lang="both"), "v2")
    return s.select(F.col("item_id").alias("id"), "movie_id", F.md5("text").alias("h"))


@query(f"with {_SCENES_SQL} select id, coalesce(nullif(trim(caption_en), ''), caption_ko) = caption_en english, caption_ko is null no_ko from scenes")
def caption_by_language(spark, d):
    s = _scene_rows(spark, d)
    return s.select("id", (X.caption_for("en", F.col("caption_ko"), F.col("caption_en")) == F.col("caption_en")).alias("english"), X.caption_for("ko", F.col("caption_ko"), F.col("caption_en")).isNull().alias("no_ko"))


@query("select p_partkey, trim(concat_ws(' ', p_name, case when p_partkey % 3 <> 0 then p_brand || ' ' || p_type else '' end)) q from part")
def retrieval_text(spark, d):
    words = F.when(F.col("p_partkey") % 3 != 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>"))
    return _t(spark, d, "part").select("p_partkey", X.retrieval_text(F.col("p_name"), words).alias("q"))


_REWRITE = "select p_partkey k, case when p_partkey % 4 <> 0 then case when p_partkey % 3 = 0 then '  ' else p_name end end query_text, case when p_partkey % 2 = 0 then p_brand end caption, case when p_partkey % 5 < 3 then case when p_partkey % 5 = 0 then '' else p_type end end scene from part"


def _rewrites(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    caption = F.when(k % 2 == 0, F.struct(F.col("p_brand").alias("caption_ko"), F.lit("").alias("caption_en"), F.col("p_type").alias("setting"), F.array("p_name", F.lit("")).alias("objects")))
    scene = F.when(k % 5 < 3, F.struct(F.when(k % 5 == 0, "").otherwise(F.col("p_type")).alias("scene_ko"), F.array("p_brand").alias("keywords_ko"), F.create_map(F.lit("decade"), F.lit("1990s")).alias("soft_filters")))
    return _t(spark, d, "part").select(k.alias("k"), F.when(k % 4 != 0, F.when(k % 3 == 0, "  ").otherwise(F.col("p_name"))).alias("query_text"), caption.alias("caption"), scene.alias("rewritten"))


@query(f"with r as ({_REWRITE}) select k, (trim(coalesce(query_text, '')) <> '' or caption is not null) asked, coalesce(nullif(scene, ''), nullif(query_text, ''), caption, '') scene, (scene is not null)::int::bigint n_filters from r")
def rewritten_or_raw(spark, d):
    r = _rewrites(spark, d)
    out = X.rewritten_or_raw(F.col("rewritten"), F.col("query_text"), F.col("caption.caption_ko"))
    return r.select("k", X.has_query(F.col("query_text"), F.col("caption")).alias("asked"), out["scene_ko"].alias("scene"), F.size(out["soft_filters"]).cast("long").alias("n_filters"))


@query("select p_partkey k, p_brand scene, p_type || ',' || p_name keywords from part where p_partkey % 2 = 0")
def query_from_caption(spark, d):
    out = X.from_caption(F.col("caption"))
    return _rewrites(spark, d).where("caption is not null").select("k", out["scene_ko"].alias("scene"), F.array_join(out["keywords_ko"], ",").alias("keywords"))


_MARKED = (("에서", 1), ("은", 2), ("으로는", 3), ("이랑", 4), ("", 5))


@query(r"""with w as (select item_id, regexp_extract_all(text, '\p{L}+')[1:5] w from benchmark),
p as (select item_id, list_transform(list_zip(w, ['에서', '은', '으로는', '이랑', '']), lambda z: case when length(z[1]) >= 2 then z[1] else z[1] || z[2] end) terms from w where len(w) = 5)
select item_id, array_to_string(list_sort(list_distinct(list_filter(terms, lambda x: length(x) >= 2))), ' ') terms from p""")
def marked_terms(spark, d):
    """The first words of each item with particles at their ends, between words that nearly every query has."""
    words = F.slice(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1)), 1, 5)
    rows = _t(spark, d, "benchmark").select("item_id", words.alias("w")).where("size(w) = 5")
    said = F.concat_ws(" ", F.lit("영화 장면,"), *(F.concat(F.get("w", F.lit(k - 1)), F.lit(p)) for p, k in _MARKED), F.lit("그리고 나오던... 장면에서"))
    return rows.select("item_id", F.array_join(F.array_sort(X.query_terms(said)), " ").alias("terms"))


@query("select p_partkey, (length(p_name) - length(replace(p_name, split_part(p_name, ' ', 1), ''))) // length(split_part(p_name, ' ', 1)) n_marked, md5(p_name) whole from part")
def highlighted_names(spark, d):
    parts = X.highlighted(F.col("p_name"), F.array(F.split("p_name", " ")[0]))
    p = _t(spark, d, "part").select("p_partkey", parts.alias("parts"))
    return p.select("p_partkey", F.size(F.filter("parts", lambda x: x["match"])).cast("long").alias("n_marked"), F.md5(F.array_join(F.transform("parts", lambda x: x["text"]), "")).alias("whole"))


@query("select p_partkey k, case when p_partkey % 3 = 0 then '모르겠어요' when p_partkey % 3 = 1 then (1950 + p_size) || '년대' else p_name end as decade, case when p_partkey % 2 = 0 then '한국 영화' else '외국 영화' end country, case when p_partkey % 2 = 0 then '애니메이션' else '실사 영화' end animation from part")
def option_labels(spark, d):
    k = F.col("p_partkey")
    value = F.when(k % 3 == 0, "unknown").when(k % 3 == 1, F.concat((1950 + F.col("p_size")).cast("string"), F.lit("s"))).otherwise(F.col("p_name"))
    return _t(spark, d, "part").select(
        k.alias("k"), clarify.option_label(F.lit("decade"), value).alias("decade"), clarify.option_label(F.lit("country"), F.when(k % 2 == 0, "KR").otherwise("other")).alias("country"), clarify.option_label(F.lit("is_animation"), (k % 2 == 0).cast("string")).alias("animation")
    )


@query("select doc_id, case when doc_id % 4 <> 0 then 'http://x/thumbs/' || doc_id || '.jpg' end url, '{\"u\":\"[image]\",\"l\":\"' || lang || '\"}' redacted from documents")
def thumbs_and_redaction(spark, d):
    doc = F.col("doc_id").cast("string")
    url = F.when(F.col("doc_id") % 4 != 0, X.thumb_url("http://x/", X.thumb_key(doc)))
    json = F.concat(F.lit('{"u":"data:image/png;base64,'), F.base64(F.encode(doc, "UTF-8")), F.lit('","l":"'), "lang", F.lit('"}'))
    return _t(spark, d, "documents").select("doc_id", url.alias("url"), X.redacted_images(json).alias("redacted"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then [year(o_orderdate)] when o_orderkey % 3 = 1 then [year(o_orderdate), 1901] else [1901] end::int[] as years from orders")
def years_of_dates(spark, d):
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    made, shown = F.when(k % 3 != 2, day).otherwise(""), F.when(k % 3 == 0, F.substring(day, 1, 4)).otherwise("19010101")
    return _t(spark, d, "orders").select("o_orderkey", X.years_of(made, shown).alias("years"))


@query("select p_partkey k, case when p_partkey % 3 = 0 then null when p_partkey % 3 = 1 then p_name else p_brand end plot from part")
def korean_plots(spark, d):
    one = lambda lang, t: F.struct(F.lit(lang).alias("plotLang"), t.alias("plotText"))
    name, brand = F.col("p_name"), F.col("p_brand")
    k = F.col("p_partkey") % 3
    plots = F.when(k == 0, F.array(one("English", name), one("한국어", F.lit(" ")))).when(k == 1, F.array(one("English", brand), one("한국어", F.concat(F.lit(" "), name)), one("한국어", brand))).otherwise(F.array(one("한국어", F.lit(None).cast("string")), one("한국어", brand)))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), X.korean_plot(plots).alias("plot"))


@query("select user_id, case when v = 0 then 0 else round(v / pow(10, floor(log10(v)) - 1)) * pow(10, floor(log10(v)) - 1) end usd from (select user_id, round(sum(value), 4) v from events group by 1)")
def significant_cost(spark, d):
    total = _t(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("v"))
    return total.select("user_id", X.significant(F.col("v")).alias("usd"))


# ---- movies and scenes ---------------------------------------------------------------


@query("select p_partkey tmdb_id, p_name title_ko, case when p_partkey % 3 = 0 then p_brand when p_partkey % 2 = 0 then p_type end title_en, case when p_partkey % 4 <> 0 then 1950 + p_size end::int as year, case when p_partkey % 3 = 0 then 'KR' else 'US' end country, p_partkey % 5 = 0 is_animation from part")
def catalogue_movies(spark, d):
    k = F.col("p_partkey")
    title = lambda lang, t: F.struct(F.lit(lang).alias("lang"), t.alias("title"))
    genre = lambda n: F.struct(F.lit(n).alias("id"), F.lit("g").alias("name"))
    raw = _t(spark, d, "part").select(
        k.alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("original_title"), F.when(k % 2 == 0, "en").otherwise("ko").alias("original_language"),
        F.when(k % 3 == 0, F.array(title("fr", F.col("p_type")), title("en", F.lit("")), title("en", F.col("p_brand")))).otherwise(F.array(title("fr", F.col("p_type")))).alias("titles"),
        F.when(k % 3 == 0, F.array(F.lit("KR"), F.lit("FR"))).otherwise(F.array().cast("array<string>")).alias("origin_country"), F.array(F.lit("US")).alias("production_countries"),
        F.when(k % 4 != 0, F.concat((1950 + F.col("p_size")).cast("string"), F.lit("-01-02"))).otherwise("").alias("release_date"), F.when(k % 5 == 0, F.array(genre(1), genre(16))).otherwise(F.array(genre(2))).alias("genres"),
    )
    return resolve.to_movie(raw).drop("genres")


@query("select p_partkey movie_id, case when p_partkey % 2 = 0 then (((1950 + p_size) // 10) * 10) || 's' end as decade, coalesce(p_partkey % 3 = 0, false) and p_partkey % 2 = 0 is_animation, (p_partkey % 2 = 0)::int::bigint n_genres from part")
def movie_payloads(spark, d):
    even = F.col("p_partkey") % 2 == 0
    movies = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("tmdb_id"), F.when(even, 1950 + F.col("p_size")).cast("int").alias("year"), F.lit("KR").alias("country"), F.when(even, F.array("p_type")).alias("genres"), F.when(even, F.col("p_partkey") % 3 == 0).alias("is_animation"))
    return resolve.movie_payload(movies).select("movie_id", "decade", "is_animation", F.size("genres").cast("long").alias("n_genres"))


@query("select doc_id id, case when doc_id % 3 = 0 then 'schema' when doc_id % 3 = 1 then 'time_of_day' end problem, case when doc_id % 3 = 2 then lang end setting, case when doc_id % 3 = 2 then 'v9' end model_version from documents")
def scene_values(spark, d):
    """Captions out of JSON: what doesn't fit the schema is told, the rest becomes scene values."""
    k = F.col("doc_id") % 3
    json = F.when(k == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.lit("가").alias("caption_ko"), F.lit("x").alias("caption_en"), F.col("lang").alias("setting"), F.when(k == 1, "noon").otherwise("night").alias("time_of_day"))))
    raw = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), json.alias("json")).withColumn("problem", quality.schema_problem(F.col("json")))
    fine = raw.where("problem is null").select("id", F.from_json("json", schema.CAPTION).alias("caption"))
    values = resolve.scene_values(fine, "v9").select("id", F.col("tags.setting").alias("setting"), "model_version")
    return raw.select("id", "problem").join(values, "id", "left")


@query(r"""with w as (select p_partkey movie_id, p_name w, 2 least from part union all select p_partkey, p_brand, 4 from part union all select p_partkey, s_name, 2 from part join supplier on s_suppkey = p_partkey
 union all select p_partkey, unnest(string_split_regex(s_name, '[\s.\-]+')), 3 from part join supplier on s_suppkey = p_partkey)
select movie_id, trim(w) word from w where length(trim(w)) >= least group by 1, 2""")
def giveaway_words(spark, d):
    p = _t(spark, d, "part")
    movies = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title_ko"), F.col("p_brand").alias("title_en"))
    return quality.forbidden_words(movies, _t(spark, d, "supplier").join(p.select(F.col("p_partkey").alias("s_suppkey")), "s_suppkey").select(F.col("s_suppkey").alias("movie_id"), F.col("s_name").alias("name")))


@query("select word from (select case when s_suppkey % 2 = 0 then '가나' || chr((44032 + s_suppkey % 1000)::int) else s_name end word from supplier) where regexp_full_match(word, '[가-힣]{2,}') group by 1")
def dictionary_words(spark, d):
    s = _t(spark, d, "supplier")
    hangul = F.concat(F.lit("가나"), F.element_at(F.split(F.lit(",".join(chr(44032 + k) for k in range(1000))), ","), (F.col("s_suppkey") % 1000 + 1).cast("int")))
    titles = s.select(F.when(F.col("s_suppkey") % 2 == 0, hangul).otherwise(F.col("s_name")).alias("title"))
    return quality.user_words(titles, s.select(F.col("s_name").alias("name")))


@query(r"""with m as (select p_partkey id, regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', '', 'g') key, 1950 + p_size yr from part),
h as (select r.id row_id, m.id, r.yr ry, m.yr my, count(*) over (partition by r.id) n from m r join m using (key)),
f as (select row_id, list(id order by id) ids from h where n = 1 or ry = my group by 1),
e as (select id row_id, case when id % 7 = 0 then 'no writer' when id % 11 = 0 then 'no query' when coalesce(len(ids), 0) = 0 then 'no match' when len(ids) > 1 then 'several matches' end problem, ids from m left join f on row_id = id)
select row_id, problem, case when problem is null then ids[1] end movie_id from e""")
def checked_examples(spark, d):
    p = _t(spark, d, "part")
    k, year = F.col("p_partkey"), (1950 + F.col("p_size")).cast("int").alias("year")
    rows = p.select(k.alias("row_id"), F.when(k % 7 == 0, " ").otherwise("w").alias("writer"), F.when(k % 11 != 0, "q").alias("query"), F.col("p_name").alias("title"), year)
    movies = p.select(k.alias("id"), F.col("p_name").alias("title_ko"), F.lit(None).cast("string").alias("title_en"), year)
    return resolve.checked_examples(rows, movies).select("row_id", "problem", "movie_id")


@query(f"with {_SCENES_SQL} select id, movie_id, caption_ko is not null known from scenes where movie_id % 2 = 0 and id::bigint % 2 = 0 union all select 'new' || n_nationkey, n_nationkey::bigint, false from nation")
def kept_representatives(spark, d):
    """Of the scenes that were chosen before some are chosen again and keep their captions; new ones have none."""
    s = _scene_rows(spark, d)
    chosen = s.where((F.col("movie_id") % 2 == 0) & (F.col("id").cast("long") % 2 == 0)).select("id", "movie_id")
    new = _t(spark, d, "nation").select(F.concat(F.lit("new"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").cast("long").alias("movie_id"))
    return dedup.keep_representatives(s, chosen.union(new), ["id", "movie_id"]).select("id", "movie_id", F.col("caption_ko").isNotNull().alias("known"))


# ---- answers and reports -------------------------------------------------------------


@query(f"""with {_HYBRID_SQL}, ev as (select query_id, movie_id, rank, unnest(evidence) scene, unnest(range(1, len(evidence) + 1)) pos from hybrid where rank <= 5),
sh as (select query_id, movie_id, string_agg('http://x/thumbs/' || scene || '.jpg' || ':' || coalesce(lang, ''), ' ' order by pos) evidence from ev left join documents on doc_id = scene group by 1, 2)
select query_id, rank, h.movie_id, n_name title_ko, case when h.movie_id % 3 = 0 then 'seen' else '' end reason, coalesce(sh.evidence, '') evidence from hybrid h left join sh using (query_id, movie_id) left join nation on n_nationkey = h.movie_id where rank <= 5""")
def answers_with_evidence(spark, d):
    c = hybrid_candidates(spark, d)
    order = c.select("query_id", "movie_id", "evidence", F.col("rank").alias("new_rank"), F.lit(0.5).alias("verified"), F.when(F.col("movie_id") % 3 == 0, "seen").alias("reason"))
    movies = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title_ko"), F.lit(1999).alias("year"), F.lit(None).cast("string").alias("poster_url"))
    scenes = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("caption_ko"))
    out = agent.answers(order, movies, scenes, base="http://x")
    return out.select("query_id", "rank", "movie_id", "title_ko", "reason", F.array_join(F.transform("evidence", lambda e: F.concat(e["thumb_url"], F.lit(":"), e["caption_ko"])), " ").alias("evidence"))


@query("select event_id id from events where coalesce(json_extract_string(props, '$.k'), '') = '3'")
def runs_of_experiment(spark, d):
    runs = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.to_json(F.struct(F.get_json_object("props", "$.k").alias("experiment"))).alias("config"))
    return report.of_experiment(runs, "3").select("id")


@query("with r as (select event_id id, case when event_id % 4 <> 0 then event_id % 9 end rank from events) select id, row_number() over (order by coalesce(rank, 999) desc, id desc) place from r")
def failed_first(spark, d):
    """The report's order as a number."""
    rows = report.failed_first(_t(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 9).alias("rank")))
    return placed(rows, F.desc(F.coalesce("rank", F.lit(999))), F.desc("id"), name="place").select("id", "place")


@query(r"with n as (select distinct substr(source, 1, 3) || (substr(source, 4)::bigint * 7 % 13) as name from documents) select name, row_number() over (order by regexp_extract(name, '^(\D*)', 1), regexp_extract(name, '^\D*(\d+)', 1)::bigint, name) place from n")
def natural_order(spark, d):
    """A few distinct names in the order of their numbers."""
    from pyspark.sql import window as W

    names = _t(spark, d, "documents").select(F.concat(F.substring("source", 1, 3), (F.substring("source", 4, 9).cast("long") * 7 % 13).cast("string")).alias("name")).distinct()
    first, *rest = X.natural_order(F.col("name"))
    return names.withColumn("p", first).withColumn("place", F.row_number().over(W.Window.partitionBy("p").orderBy(*rest)).cast("long")).select("name", "place")


# ---- files and sessions --------------------------------------------------------------


@query("select c_custkey, c_name, c_acctbal from customer")
def json_lines(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = _new_path(spark, "json")
    tables.write_json_lines(rows, path)
    return tables.read_json_lines(spark, path, rows.schema)


@query("select c_custkey, '질문, \"' || c_name || '\"' || chr(10) as query from customer")
def csv_round_trip(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", F.concat(F.lit('질문, "'), "c_name", F.lit('"\n')).alias("query"))
    path = _new_path(spark, "csv")
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, rows.schema)


@query("select o_orderstatus status, count(*)::bigint n from orders group by 1")
def counted_and_copied(spark, d):
    """Orders written and counted, copied, and read from the copy."""
    rows = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    path, copy = _new_path(spark, "counted"), _new_path(spark, "copy")
    tables.write_counted(rows, path)
    tables.copied(spark.read.parquet(path), copy)
    return spark.read.parquet(copy).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("select count(*)::bigint n from (select vec_id from embeddings where embedding is not null)")
def typed_vectors(spark, d):
    rows = _t(spark, d, "embeddings").where("embedding is not null").select("vec_id", "embedding")
    path = _new_path(spark, "vectors")
    tables.write_vectors(rows, path, rows.schema)
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("select true same, false changed")
def fingerprints(spark, d):
    rows = _t(spark, d, "customer")
    own = tables.fingerprint(rows)
    again = tables.fingerprint(rows.repartition(3).select(*reversed(rows.columns)))
    other = tables.fingerprint(rows.withColumn("c_name", F.upper("c_name")).union(rows.limit(1)))
    return spark.createDataFrame([(own == again, own == other)], "same boolean, changed boolean")


@query("""with c as (select conv_id, count(*) n, sum(turn * 10)::int ms from conversations group by 1)
select 's' || conv_id id, 'q' || conv_id query_text, case when conv_id % 3 = 0 then n end::int clarify_turns, case when conv_id % 3 = 0 then ms end latency_ms, case when conv_id % 3 = 0 then round(n / 3.0, 6) end::decimal(10, 6) cost_usd, case when conv_id % 3 = 0 then (conv_id || ',' || (conv_id + 1)) end result_movies from c""")
def session_store(spark, d):
    """Sessions are created, some of them twice, and every third is finished."""
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("t"), F.col("turn").cast("string")).alias("step"), (F.col("turn") * 10).alias("ms")))).alias("timings"))
    new = c.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("id"), F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("query_text"), F.lit(None).cast("string").alias("image_key"))
    sessions = tables.created_sessions(spark.createDataFrame([], schema.SESSIONS), new)
    sessions = tables.created_sessions(sessions, new.where("id like '%1'").withColumn("query_text", F.lit("again")))
    movie = lambda k: F.struct((F.col("conv_id") + k).alias("movie_id"))
    ends = c.where("conv_id % 3 = 0").select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("id"), F.lit(None).cast(schema.REWRITTEN).alias("rewritten"), F.lit(None).cast("map<string,string>").alias("hard_filters"), F.col("n").cast("int").alias("clarify_turns"), F.array(movie(0), movie(1)).alias("results"), F.lit(0.5).alias("confidence"), "timings", (F.col("n") / 3).alias("cost_usd"), F.lit(None).cast("string").alias("trace_run_id"))
    done = tables.finished_sessions(sessions, ends)
    return done.select("id", "query_text", "clarify_turns", "latency_ms", "cost_usd", F.array_join(F.col("result_movie_ids").cast("array<string>"), ",").alias("result_movies"))


@query("select o_orderkey, o_custkey in (select c_custkey from customer where c_custkey % 10 <> 3) ok from orders")
def feedback_references(spark, d):
    """Rows with a parent and those without one, told apart."""
    parents = _t(spark, d, "customer").where("c_custkey % 10 != 3")
    good, bad = tables.with_references(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), parents, "o_custkey", "c_custkey")
    return good.select("o_orderkey", F.lit(True).alias("ok")).union(bad.select("o_orderkey", F.lit(False)))
