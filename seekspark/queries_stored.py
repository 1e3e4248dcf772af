"""Operators on stored tables and streams as queries over the test tables, each beside the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.operators import filters, index, report
from seekspark.plans import evaluation, variants
from seekspark.plans import search as S
from seekspark.queries import _ATTRS_SQL, _DENSE_BRANCH_SQL, _DOCS_SQL, _METRICS, _QUERIES_SQL, _SPARSE_SQL, _TRUTH_SQL, HOME, _attrs, _bm25_sql, _index, _items, _queries, _rank_sql, _rounded, _rrf_sql, _scenes, _t, _truth, query_registry
from seekspark.sources import payload, ranges, versions
from seekspark.sources.shared import made_folder, materialised
from seekspark.streaming import stateful, windows
from seekspark.streaming.sessions import for_each_batch

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
query = query_registry(_Q, _SQL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- filters by stored indexes -------------------------------------------------------

_FILTERS = ({"decade": "1990s"}, {"country": "en"}, {"country": "other"}, {"genre": "g1"}, {"is_animation": "true"}, {"country": "en", "genre": "g1", "decade": "1960s"})


@query(f"""with {_ATTRS_SQL}, f as (select 0 k, doc_id from attrs where decade = '1990s' union all select 1, doc_id from attrs where country = 'en' union all select 2, doc_id from attrs where country is distinct from 'en'
union all select 3, doc_id from attrs where list_contains(genres, 'g1') union all select 4, doc_id from attrs where is_animation union all select 5, doc_id from attrs where country = 'en' and list_contains(genres, 'g1') and decade = '1960s')
select k::int k, doc_id from f""")
def payload_filters(spark, d):
    """Six hard filters, each answered by the files of its values."""
    own = payload.indexed(_attrs(spark, d).drop("text", "source", "year"), "doc_id")
    found = [payload.keys_of(spark, own, f, HOME).select(F.lit(k).alias("k"), "doc_id") for k, f in enumerate(_FILTERS)]
    out = found[0]
    for other in found[1:]:
        out = out.unionAll(other)
    return out


@query(f"with {_ATTRS_SQL}, {_bm25_sql(_DOCS_SQL, _QUERIES_SQL)}, kept as (select query_id, item_id, score from scores join attrs on doc_id = item_id where is_animation is not true and decade = '1990s' and list_contains(genres, 'h1')), {_rank_sql('kept', 'r', 50)} select query_id, item_id, round(score, 6) score, rank from r".replace("is_animation is not true", "is_animation = false"))
def payload_filter_topk(spark, d):
    """Search among the documents that stored indexes let through, bounds and all."""
    own = payload.indexed(_attrs(spark, d).drop("text", "source", "year"), "doc_id")
    keep = payload.keys_of(spark, own, {"is_animation": "false", "decade": "1990s", "genre": "h1"}, HOME).withColumnRenamed("doc_id", "item_id")
    return _rounded(index.sparse_branch(_index(spark, d, _items), _queries(spark, d), key="item_id", keep=keep, direct_pairs=0), "score")


# ---- configurations ------------------------------------------------------------------

_MODES = ("sparse", "dense", "hybrid")


@query(f"""with {_SPARSE_SQL}, {_DENSE_BRANCH_SQL}, {_rrf_sql('sb', limit=50, name='f_sparse')}, {_rrf_sql('db', limit=50, name='f_dense')}, {_rrf_sql('sb', 'db', limit=50, name='f_hybrid')}, {_TRUTH_SQL},
found as ({" union all ".join(f"select '{m}' as name, query_id, item_id, rank from f_{m}" for m in _MODES)}),
res as (select c.name, t.query_id, t.dataset, f.rank from truth t cross join (values ('sparse'), ('dense'), ('hybrid')) c(name) left join found f on f.name = c.name and f.query_id = t.query_id and f.item_id = answer_id and f.rank <= 10)
select 'E1' experiment, name, dataset, count(*)::bigint n, {_METRICS} from res group by grouping sets ((name, dataset), (name))""")
def evaluated_configs(spark, d):
    """The modes of search as configurations, evaluated over both datasets; modes share branches, so each branch is searched once."""
    scenes = _scenes(spark, d)
    truth = materialised(_truth(spark, d), "truth")
    found = {name: materialised(b, name) for name, b in S.branches(scenes, _queries(spark, d)).items()}
    predict = lambda c: S.fused(scenes, found, c.mode).withColumnRenamed("item_id", "id")
    rows = evaluation.evaluate([variants.config_from({"experiment": "E1", "name": m, "mode": m}) for m in _MODES], truth, predict)
    return _rounded(rows, "recall_at_1", "recall_at_5", "mrr")


# ---- runs with a VARIANT -------------------------------------------------------------

_CONFIGS_SQL = """configs as (select event_id id, event_type dataset_version, event_id % 13 = 0 malformed,
  case when event_id % 13 <> 0 then coalesce('E' || (event_id % 11), '') else '' end experiment,
  case when event_id % 13 <> 0 and event_id % 5 <> 0 then coalesce(json_extract_string(props, '$.k'), '') else '' end name,
  event_id % 13 <> 0 and event_id % 2 = 0 agent from events where event_id % 17 <> 0)"""


def _variant_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with a stored VARIANT: some configs are cut off, some names are numbers."""
    k = F.col("event_id")
    name = F.when(k % 5 == 0, F.lit('"name":7')).otherwise(F.concat(F.lit('"name":"'), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")), F.lit('"')))
    config = F.concat(F.lit('{"experiment":"E'), (k % 11).cast("string"), F.lit('",'), name, F.lit(',"agent":'), F.when(k % 2 == 0, "true").otherwise("false"), F.lit("}"))
    config = F.when(k % 13 == 0, F.left(config, F.lit(9))).otherwise(config)
    rows = _t(spark, d, "events").where("event_id % 17 != 0").select(k.alias("id"), F.col("event_type").alias("dataset_version"), config.alias("config"))
    return materialised(report.with_variant(rows), "runs")


@query(f"with {_CONFIGS_SQL} select experiment, dataset_version, agent, name, max(id) id, count(*)::bigint runs, count(*) filter (malformed)::bigint n_malformed from configs group by all")
def run_groups_variant(spark, d):
    flat = report.flattened_variant(_variant_runs(spark, d))
    bad = flat.groupBy("experiment", "dataset_version", "agent", "name").agg(F.count_if("malformed").alias("n_malformed"))
    groups = report.groups(flat.drop("config")).select("experiment", "dataset_version", "agent", "name", "id", "runs")
    return groups.join(bad, ["experiment", "dataset_version", "agent", "name"])


@query(f"with {_CONFIGS_SQL} select id from configs where experiment = 'E3'")
def runs_of_experiment_variant(spark, d):
    return report.of_experiment_variant(_variant_runs(spark, d), "E3").select("id")


# ---- versions and ranges -------------------------------------------------------------


@query("select c_custkey, case when c_custkey % 10 = 0 then upper(c_name) || '*' else c_name end c_name, 2::bigint as version, (select count(*) from customer)::bigint n from customer")
def published_versions(spark, d):
    """Customers published, published again unchanged (which writes nothing), changed and published, and read back."""
    root, c = made_folder(spark, "published"), _t(spark, d, "customer").select("c_custkey", "c_name")
    for rows in (c, c.repartition(3).select("c_name", "c_custkey"), c.withColumn("c_name", F.when(F.col("c_custkey") % 10 == 0, F.concat(F.upper("c_name"), F.lit("*"))).otherwise(F.col("c_name")))):
        last = versions.publish(rows, root, "customers")
    return versions.current(spark, root, "customers").select("c_custkey", "c_name", F.lit(last.number).cast("long").alias("version"), F.lit(last.rows).cast("long").alias("n"))


_PIECES = " || '-' || ".join(f"sum(('0x' || substr(h, {k}, 8))::ubigint)" for k in (1, 9, 17, 25, 33))


@query(f"with r as (select c_nationkey, sha1(coalesce('=' || c_custkey, '0') || chr(31) || coalesce('=' || c_name, '0') || chr(31) || coalesce('=' || c_nationkey, '0')) h from customer) select c_nationkey, count(*)::bigint n, {_PIECES} fingerprint from r group by 1")
def rows_fingerprint(spark, d):
    """The fingerprint of each nation's customers, by which an unchanged part is known."""
    return versions.rows_fingerprint(_t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_nationkey")


@query("""with o as (select o_orderkey, o_totalprice from orders), k as (select quantile_disc(o_orderkey, 0.3) lo from orders)
select o_orderkey, case when o_orderkey <= lo and o_orderkey % 3 = 0 then o_totalprice + 1 else o_totalprice end o_totalprice from o, k where not (o_orderkey <= lo and o_orderkey % 3 = 1)
union all select -o_orderkey, o_totalprice from o, k where o_orderkey <= lo and o_orderkey % 100 = 2""")
def range_changes(spark, d):
    """Orders in ranges of keys: changes, new and removed rows among the first ones, which leave the files of the others alone."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    root = made_folder(spark, "ranges")
    ranges.created(o, root, "o_orderkey", range_rows=max(1, o.count() // 10))
    low = o.where(F.col("o_orderkey") <= o.agg(F.expr("percentile_disc(0.3) within group (order by o_orderkey)")).first()[0])
    ranges.upserted(spark, root, low.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).union(low.where("o_orderkey % 100 = 2").select(-F.col("o_orderkey"), "o_totalprice")))
    ranges.removed(spark, root, low.where("o_orderkey % 3 = 1"))
    return ranges.read(spark, root)


# ---- streams -------------------------------------------------------------------------

_ACTIVITY_SQL = """e as (select user_id, ts::timestamp ts, value, coalesce(ts::timestamp - lag(ts::timestamp) over (partition by user_id order by ts) > interval 30 minutes, true) opens from events),
r as (select *, sum(opens::int) over (partition by user_id order by ts rows unbounded preceding) run from e),
runs as (select user_id, min(ts) as start, max(ts) + interval 30 minutes finish, count(*)::bigint n, round(sum(value), 6) total from r group by user_id, run)"""


def _plain(runs: DataFrame) -> DataFrame:
    return runs.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("finish").cast("timestamp_ntz").alias("finish"), "n", F.round("total", 6).alias("total"))


@query(f"with {_ACTIVITY_SQL} select * from runs")
def activity_runs(spark, d):
    return _plain(windows.activity(_t(spark, d, "events")))


@query(f"with {_ACTIVITY_SQL} select runs.* from runs, (select max(ts::timestamp) - interval 1 hour mark from events) where finish <= mark")
def activity_replayed(spark, d):
    """events as a stream of files: the runs that its last watermark has closed."""
    folder, events = made_folder(spark, "replay"), _t(spark, d, "events")
    events.repartition(4).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    windows.replayed(windows.activity(stream), f"{folder}/out", f"{folder}/state")
    return _plain(spark.read.schema("user_id long, start timestamp, finish timestamp, n long, total double").parquet(f"{folder}/out"))


@query("""with m as (select conv_id, turn, role, lag(role) over w before, bool_or(role = 'system') over (partition by conv_id) ended from conversations window w as (partition by conv_id order by turn)),
e as (select *, case when role = 'system' then 'result' when role = 'assistant' then case when not ended then 'question' end when ended or before is distinct from 'assistant' then '409' when conv_id % 5 = 0 then '400' else 'answer' end kind from m)
select 'c' || conv_id session_id, row_number() over (partition by conv_id order by turn) n, case when kind in ('400', '409') then 'error' else kind end as event,
       case kind when 'result' then 's|' when 'question' then 't' || turn when 'answer' then 't' || (turn - 1) || '=t' || turn else kind end detail from e where kind is not null""")
def question_sessions(spark, d):
    """Conversations as sessions that come in two files: assistants ask, users answer, a system's word ends a session. Open questions are carried from one batch to the next."""
    folder, c = made_folder(spark, "sessions"), _t(spark, d, "conversations")
    said = lambda k: F.concat(F.lit("t"), (F.col("turn") + k).cast("string"))
    asks, ends = F.col("role") == "assistant", F.col("role") == "system"
    messages = c.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.col("turn").cast("long").alias("seq"), F.when(asks, "question").when(ends, "result").otherwise("answer").alias("kind"),
        F.when(asks, said(0)).alias("attr"), F.when(asks, F.array(said(1), F.lit("unknown"))).alias("options"), F.when(ends, "s").when(~asks, F.when(F.col("conv_id") % 5 == 0, "else").otherwise(said(0))).alias("value"),
    )
    for part in (messages.where("seq < 2"), messages.where("seq >= 2")):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with stateful.with_rocksdb(spark):
        for_each_batch(stateful.session_events(stream, 10**9, 10**9), lambda batch: batch, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(stateful.EVENTS).parquet(f"{folder}/out").select("session_id", "n", "event", "detail")
