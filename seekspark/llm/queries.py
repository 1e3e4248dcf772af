"""Each operator over its whole table, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.llm.clustering import cluster_report
from seekspark.llm.common import ship
from seekspark.llm.decontaminate import contamination_report
from seekspark.llm.fingerprint import fingerprint_report
from seekspark.llm.language_id import language_report
from seekspark.llm.line_dedup import line_report
from seekspark.llm.near_dedup import near_duplicate_report
from seekspark.llm.sentencepiece_lattice import load_pieces, round_trip
from seekspark.llm.sharding import shard
from seekspark.llm.suffix_dedup import repeat_report
from seekspark.llm.toxicity import toxicity_report
from seekspark.llm.url_filter import filter_urls
from seekspark.llm.vector_search import top_k
from seekspark.llm.whitening import whitening_report

#: The public model that op1 encodes with.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), load_pieces(MODEL))


def op2_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_report(_table(spark, sf_dir, "documents"), words=4)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(_table(spark, sf_dir, "embeddings"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_top_k_search, op3_toxicity, op4_language_id, op5_decontamination, op6_suffix_array_dedup, op7_line_dedup, op8_sharding, op9_minhash_near_dedup, op10_url_filters, op11_fingerprints, op12_whitening, op13_centroid_clustering)}


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_OP2 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) q from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) score
      from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select query_id, cast(rank as int) rank, vec_id, score from
  (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 5
"""

_OP5 = f"""
with i as (select item_id, regexp_extract_all(translate(text, {_AZ}), '{_WORD}') w from benchmark where text is not null),
win as (select distinct item_id, least(10, len(w)) n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') s
        from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) k from i where len(w) > 0)),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORD}') w from documents),
pos as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') s
        from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) k from d, (select distinct n from win) where len(w) >= n)),
hit as (select doc_id, item_id, pos.n, k from pos join win using (n, s)),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(k, k + n)) p from hit) group by 1),
items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) ids from (select distinct doc_id, item_id::varchar item from hit) group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

_OP7 = f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) place from documents),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) key from l),
r as (select key, max(doc_id) keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.doc_id, place, line, (keeper is not null and keeper <> k.doc_id) gone from k left join r on k.key = r.key)
select doc_id, count(*)::bigint n_lines, count(*) filter (gone)::bigint n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) kept_sha256
from m group by doc_id
"""

_OP9 = rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[k:k + least(4, len(w)) - 1], chr(10)) s
      from (select doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) k from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id u, b.doc_id v, count(*) c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
e as (select u, v from p join n a on a.doc_id = u join n b on b.doc_id = v where 100 * c >= 80 * (a.n + b.n - c)),
both_ways as (select u, v from e union all select v, u from e),
reach as (with recursive r(doc_id, other) as (select doc_id, doc_id from w union select r.doc_id, b.v from r join both_ways b on b.u = r.other) select * from r),
c as (select doc_id, min(other) component_id from reach group by 1)
select c.doc_id, coalesce(n, 0)::bigint n_shingles, component_id, c.doc_id = component_id kept from c left join n on n.doc_id = c.doc_id
"""

_OP10 = r"""
with u as (select page_id, coalesce(url, '') url from pages),
p as (select page_id, translate(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2) path from u),
r(rhost, rpath, rverdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (select page_id, rhost || rpath rule, rverdict, row_number() over (partition by page_id order by length(rhost) desc, length(rpath) desc) k
      from p join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select p.page_id, host, path, rule, coalesce(rverdict, 'allow') verdict from p left join m on m.page_id = p.page_id and k = 1
"""

_ROUND = """
d{k} as materialized (select vec_id, q, c, list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint far from v, m{k}),
a{k} as materialized (select vec_id, q, c, far from (select *, row_number() over (partition by vec_id order by far, c) r from d{k}) where r = 1),
s{k} as (select c, i, sum(q[i]::hugeint) s, count(*) n from (select c, q, unnest(range(1, 65)) i from a{k}) group by 1, 2),
n{k} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) m from s{k} group by 1),
m{next} as materialized (select m{k}.c, coalesce(n{k}.m, m{k}.m) m from m{k} left join n{k} on n{k}.c = m{k}.c)"""

_OP13 = f"""
with v as materialized (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) q from embeddings
                        where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
m0 as materialized (select row_number() over (order by sha256('2:' || vec_id)) - 1 c, q m from v order by sha256('2:' || vec_id) limit 40),
{",".join(_ROUND.format(k=k, next=k + 1) for k in range(6))}
select vec_id, a5.c::int cluster, far distance, sum(far) over (partition by a5.c)::bigint cluster_inertia, sum(far) over ()::bigint inertia, sha256(array_to_string(m, ',')) centroid_sha256
from a5 join m5 on a5.c = m5.c
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k_search": _OP2, "op5_decontamination": _OP5, "op7_line_dedup": _OP7, "op9_minhash_near_dedup": _OP9, "op10_url_filters": _OP10, "op13_centroid_clustering": _OP13}
