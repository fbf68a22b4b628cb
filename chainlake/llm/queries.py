"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, decontaminate, hard_negatives, html_text, license_scan, lm_score, packing, periodic_runs,
               pii, simhash, toxicity, url_filter, vector_join)
from .common import crc_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


@query("op1_url_filter")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages"))


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@query("op3_html_text")
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op4_decontaminate", r"""
with w as (
  select id, kind, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from (select doc_id as id, text, 'd' as kind from documents
        union all select item_id, text, 'i' from benchmark)),
g as (
  select distinct id, kind, array_to_string(list_slice(words, p, p + 4), ' ') as gram
  from (select id, kind, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) as p from w where len(words) > 0)),
q as (select id, count(*) as n_item from g where kind = 'i' group by id)
select d.id as doc_id, i.id as item_id, count(*)::bigint as n_shared, max(q.n_item)::bigint as n_item,
       count(*) / max(q.n_item) as containment
from g i join g d on d.kind = 'd' and d.gram = i.gram join q on q.id = i.id
where i.kind = 'i' group by all having count(*) / max(q.n_item) >= 0.8
""")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item (5-word shingles, containment 0.8 or more)."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", "containment")


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         "predicted", F.size("spans").cast("long").alias("n_spans"))


#: Both turns of conversation -7, which op7 formats besides those of the table.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


@query("op7_chat_format", r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e as (
  select *, replace(replace(replace(replace(text, '\', '\b'), '#', '\h'), '</', '<\s'), '<|', '<\p') as body,
         replace(replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '</', '<\s'), '<|', '<\p'), ':', '\c') as head
  from c)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(head) + length(body) + 14)::bigint as formatted_chars
from e group by conv_id
""")
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], rows.schema)
    read = chat_format.read_back(chat_format.format_chats(rows.unionByName(control)))
    turns = F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query("op8_lm_score")
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op10_vector_join", """
with recursive v as (
  select row_number() over () as n, vec_id, label, embedding::double[] as e from embeddings),
g as (
  select * from v where label is not null and e is not null and len(e) > 0
    and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (
  select a.n as a, b.n as b, a.vec_id as a_id, b.vec_id as b_id from g a join g b
    on a.label = b.label and a.n <> b.n and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select n as a, n as b from v union select r.a, l.b from r join l on l.a = r.b),
m as (select r.a, min(v.vec_id) as component_id from r join v on v.n = r.b group by r.a)
select v.vec_id, coalesce(k.n_links, 0)::bigint as n_links, m.component_id, v.vec_id = m.component_id as kept
from v join m on m.a = v.n left join (select a, count(*) as n_links from l group by a) k on k.a = v.n
""")
def op10_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


@query("op11_pii")
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    is_base = lambda s: s["kind"] != pii.TERM
    written = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in (*pii.KINDS, pii.TERM)]
    base = F.array_join(F.transform(F.filter("spans", is_base), written), ",")
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", written), ",").alias("spans"))


@query("op12_hard_negatives", """
with v as (
  select row_number() over () as n, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         embedding::double[] as e from embeddings),
g as (
  select n, vec_id, label, list_transform(e, lambda x: floor(256 * x)) as e from v
  where vec_id is not null and label is not null and e is not null
    and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select a.n as a, a.vec_id as anchor_id, g.n, g.vec_id, a.label = g.label as same,
         case when len(a.e) = 0 then 0 else list_inner_product(a.e, g.e)::bigint end as score
  from g a join g on len(a.e) = len(g.e) where a.vec_id % 50 = 0),
p as (
  select a, anchor_id, vec_id as positive_id, score as positive_score,
         row_number() over (partition by a order by score desc, vec_id) as place
  from s where same and a <> n qualify place <= 5)
select p.anchor_id, p.positive_id, row_number() over (partition by p.a, p.place order by s.score desc, s.vec_id)::int as rank,
       s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.a = p.a and not s.same and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify rank <= 3
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts with crc32(doc_id) % 10 = 0 repeat their words from a place a on with a period p.

    With h the crc and g = h div 10: a = g % n and p = 1 + (n - a) div (3 + g % 8) for n words.  A null id
    counts as the empty text; texts without words stay as they are.
    """
    g = F.floor(crc_remainder(F.col("doc_id"), 1 << 32) / 10)

    def repeat(words):  # bound once, so that a text is split once
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, at(i).cast("int"))), " ")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(F.lit("")))[0]
    chosen = crc_remainder(F.col("doc_id"), 10) == 0
    return docs.select("doc_id", F.when(chosen, planted).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    found = periodic_runs.find_runs(docs).withColumn("longest", longest)
    start, length, period = -F.col("longest.back"), F.col("longest.length"), -F.col("longest.short")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
