"""The registered queries of this package, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Job, table
from . import byte_bpe, decontaminate, embedding_dups, jaccard_join, language_id, license_scan, lexical_search, line_dedup, quality, sharding, token_files, toxicity, whitening
from .tables import digit, shared_dir

QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def wrap(job: Job) -> Job:
        QUERIES[job.__name__] = job
        if oracle:
            ORACLES[job.__name__] = oracle
        return job

    return wrap


@query()
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language_id.fit_languages(docs.where(digit() != 0))
    out = language_id.predict_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (digit() == 0).alias("held_out"), "lang_pred", "score")


@query(r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
firsts as (select key, min(doc_id) as first from keyed where length(key) >= 10 group by key),
marked as (select k.*, coalesce(f.first < k.doc_id, false) as gone from keyed k left join firsts f on k.key = f.key and length(k.key) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
""")
def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query()
def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.col("notices.license")))
    return out.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.concat_ws(",", names).alias("licenses"))


@query()
def op4_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens"
    token_files.write_tokens(table(spark, sf, "documents").select("doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.with_crc32(token_files.read_tokens(spark, folder))


@query(r"""
with v as (select vec_id, [cast(x as double) for x in embedding] as e from embeddings),
good as (select * from v where e is not null and len(e) > 0 and len([x for x in e if x is null or not isfinite(x)]) = 0 and len([x for x in e if x <> 0]) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9),
reach as (
  with recursive r(a, b) as (select vec_id, vec_id from v union select r.a, links.b from r join links on r.b = links.a)
  select a, min(b) as low from r group by a)
select v.vec_id, (select count(*) from links where links.a = v.vec_id) as n_links, low as component_id, low = v.vec_id as kept
from v join reach on reach.a = v.vec_id
""")
def op5_embedding_dups(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dups.linked_vectors(table(spark, sf, "embeddings"))


@query()
def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf, "labels").where(digit() != 0))
    out = quality.score_quality(docs, model)
    return out.select("doc_id", (digit() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit_severity(docs, table(spark, sf, "labels").where(digit() != 0))
    out = toxicity.score_severity(docs, model)
    return out.select("doc_id", (digit() == 0).alias("held_out"), "severity", "grade", (F.col("grade") > 0).alias("toxic"))


@query(r"""
with doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
item_windows as (
  select distinct item_id, least(len(w), 10) as n, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') as win
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from item_words where len(w) > 0)),
sizes as (select distinct n from item_windows),
doc_windows as (
  select doc_id, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc_words, sizes where len(w) >= n)),
matched as (select doc_id, i, n, item_id from doc_windows join item_windows using (n, win)),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from matched) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar) as item_id from matched) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join hits using (doc_id) left join found using (doc_id)
""")
def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    out = decontaminate.find_passages(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return out.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


@query(r"""
with doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, list_aggregate(w[i:i + least(len(w), 3) - 1], 'string_agg', ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) as i from doc_words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as i from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
sides as (select a, b from links union all select b, a from links),
reach as (
  with recursive r(a, b) as (select doc_id, doc_id from documents union select r.a, sides.b from r join sides on r.b = sides.a)
  select a, min(b) as low from r group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, low as component_id
from documents d join reach on reach.a = d.doc_id left join sizes on sizes.doc_id = d.doc_id
""")
def op9_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf, "documents").select("doc_id", "text"), words_each=3, num=9, den=10)


@query()
def op10_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = byte_bpe.decode(byte_bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), *vocabulary), *vocabulary)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query(r"""
with recursive steps(i, c, k) as (
  select i, i, 0 from range(256) t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
crc_table as (select list(c order by i) as t from steps where k = 8),
coded as (select doc_id, source, hex(encode(coalesce(text, ''))) as h, t from documents, crc_table),
bytes as (select doc_id, source, t, [('0x' || substr(h, 2 * i + 1, 2))::bigint for i in range(len(h) // 2)] as b from coded),
sized as (
  select doc_id, coalesce('=' || source, '') as stratum, md5('11:' || coalesce('=' || doc_id, '')) as hash, len(b) + 16 as size,
    xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295)) as text_crc32 from bytes),
ranked as (
  select *, row_number() over (partition by stratum order by hash) - 1 as r, count(*) over (partition by stratum) as n,
    ('0x' || substr(md5('11:source:' || stratum), 1, 8))::bigint / 4294967296.0::double as offs from sized),
placed as (select *, row_number() over (order by (r + offs) / n, stratum, hash) - 1 as p, count(*) over () as total from ranked),
cut as (select *, p * 40 // total as s from placed)
select doc_id, size, text_crc32, 'rows' as law, s as shard, p - (s * total + 39) // 40 as slot, cast(null as integer) as grown_shard from cut
""")
def op11_sharding(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf, "documents").select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.assign_shards(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query(r"""
with doc_terms as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents),
item_terms as (
  select item_id, t, count(*) as c from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark)
  group by item_id, t),
sizes as (select doc_id, count(*) as n from doc_terms group by doc_id),
whole as (select count(*) as nn, cast(sum(n) as bigint) as ll from sizes),
tf as (select doc_id, t, count(*) as tf from doc_terms group by doc_id, t),
weights as (select t, cast(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) as bigint) as w from tf, whole group by t, nn),
parts as (
  select item_id, doc_id, c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll))) as s
  from item_terms join tf using (t) join weights using (t) join sizes using (doc_id), whole),
scores as (select item_id, doc_id, cast(sum(s) as bigint) as score from parts group by item_id, doc_id having sum(s) > 0),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
""")
def op13_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
