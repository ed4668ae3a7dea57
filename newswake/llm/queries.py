"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from newswake.llm import (conversation_repair, exact_dedup, html_extract, lm_scoring, mixing, packing, quality_model,
                           quality_rules, secret_scan, simhash, suffix_dedup, token_counts, vector_clusters)
from newswake.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_exact_dedup", r"""
with d as (select doc_id, length(coalesce(text, '')) as n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as sha
           from documents)
select doc_id, first_value(doc_id) over w as keep_id,
       count(*) over (partition by sha) as group_size,
       doc_id = first_value(doc_id) over w as kept, sha as text_sha256
from d window w as (partition by sha order by n desc, doc_id)""")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exact_dedup.exact_dedup(docs)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op3_quality_rules", r"""
with d as (
  select doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
windows as (
  select doc_id, i, hash(words[i:i + 7]) as h, words[i:i + 7] as w
  from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from d where len(words) > 8)),
twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w) as n from windows)
  where n > 1),
repeats as (
  select doc_id, sum(least(8, coalesce(nxt - i, 8))) as n_repeat_words
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from twice)
  group by doc_id),
m as (
  select d.doc_id, len(words) as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
         len(lines) - len(list_distinct(lines)) as n_dup_lines, len(lines) as n_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) as n_upper,
         length(regexp_replace(text, '[^\p{L}]+', '', 'g')) as n_letters,
         length(regexp_replace(text, '[^!]+', '', 'g')) as n_marks,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) as n_stutters
  from d left join repeats using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 100 * n_symbols > 25 * n_words
            or (100 * n_upper > 50 * n_letters and n_letters >= 50)
            or (n_lines >= 5 and 100 * n_dup_lines > 40 * n_lines)
            or word_chars > 25 * n_words or word_chars < 2 * n_words
            or 100 * n_marks > 40 * n_words or 100 * n_stutters > 30 * n_words) as kept
from b""")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.verdicts(quality_rules.ledger(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@query("op2_packing")
def op2(spark, sf_dir):
    found = packing.pieces(table(spark, sf_dir, "documents"))
    narrow = found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(narrow)


@query("op4_token_counts")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op5_mixing")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n_chars"))
    return mixing.mix(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_rank")


@query("op8_simhash")
def op8(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "fingerprint", "component_id")


@query("op10_quality_model")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.classify(docs, model).select("doc_id", "held_out", "score", "predicted")


@query("op7_html_extraction")
def op7(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op9_suffix_dedup")
def op9(spark, sf_dir):
    found = suffix_dedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes",
                        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_lm_scoring")
def op6(spark, sf_dir):
    return lm_scoring.score(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_conversation_repair")
def op11(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.report(conversation_repair.damaged(given), given)


def cluster_sql() -> str:
    """Five rounds written out; a centroid's sum is divided downwards by its count."""
    distance = "cast(list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
    sql = [r"""with k as (
  select row_number() over () as r, vec_id,
         list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v
  from embeddings where len(embedding) = 64
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (select row_number() over (order by sha256('2:' || vec_id), v) - 1 as c, v from k qualify c < 40)"""]
    for n in range(6):
        sql.append(f"""a{n} as (
  select r, min(struct_pack(d := d, c := c)) as best
  from (select k.r, c.c, {distance} as d from k, c{n} c) group by r)""")
        if n < 5:
            sql.append(f"""s{n} as (
  select c, i, sum(x) as s, count(*) as n
  from (select a{n}.best.c as c, unnest(range(1, 65)) as i, unnest(k.v) as x from k join a{n} using (r))
  group by c, i),
c{n + 1} as (
  select c{n}.c, coalesce(m.v, c{n}.v) as v from c{n} left join (
    select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from s{n} group by c) m using (c))""")
    return ",\n".join(sql) + """
select k.vec_id, cast(a5.best.c as int) as cluster, a5.best.d as distance,
       cast(sum(a5.best.d) over (partition by a5.best.c) as bigint) as cluster_inertia,
       cast(sum(a5.best.d) over () as bigint) as inertia,
       sha256(array_to_string(c5.v, ',')) as centroid_sha256
from k join a5 using (r) join c5 on c5.c = a5.best.c"""


@query("op12_centroid_clustering", cluster_sql())
def op12(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_clusters.cluster_vectors(vectors).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


@query("op13_secret_scan")
def op13(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[secret_scan.count_of(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(secret_scan.written("base"), 256).alias("base_sha256"),
                        secret_scan.written("spans").alias("spans"))
