"""Registered queries: search, trust, similar cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from newswake.functions import text as tx
from newswake.operators import patterns as pt, query_graph as qg, search as se, search_index as si, trust as tr, vector_index as vi
from newswake.plans.catalog import query, r6, run_dir
from newswake.plans.text_queries import PUBLISHER_SQL, TIER_SQL, WORD_SQL, _publisher
from newswake.plans.views import documents, table
from newswake.sources.writers import kept
from newswake.streaming import sync

NOW = "2024-06-30 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def news_documents(spark, sf, only=None):
    """Search documents from documents and labels: dated, with companies, events and an outcome. With
    `only`, those of a small table (doc_id)."""
    k = F.substring("source", 4, 10).cast("int")
    labels = table(spark, sf, "labels")
    day = F.date_sub(F.lit(NOW).cast("date"), (F.col("doc_id") % 1000).cast("int"))
    at = day.cast("timestamp") - F.make_dt_interval(hours=(F.col("doc_id") % 24).cast("int"))
    docs = documents(spark, sf)
    if only is not None:
        docs = docs.join(F.broadcast(only.select("doc_id").distinct()), "doc_id", "left_semi")
    return docs.join(labels, "doc_id", "left").select(
        F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("id"), "doc_id",
        F.regexp_extract("text", r"^[^\n.]*", 0).alias("title"), F.col("text").alias("body"),
        _publisher().alias("publisher"), tx.publisher_tier(_publisher()).alias("publisher_tier"),
        at.alias("published_at"),
        F.concat(F.lit("http://n/"), "doc_id").alias("url"),
        F.array(F.concat(F.lit("src"), k), F.concat(F.lit("src"), (k * 3) % 20)).alias("companies"),
        F.array(F.concat(F.lit("src"), k), F.concat(F.lit("src"), (k * 3) % 20)).alias("companies_kw"),
        F.array("lang").alias("events"),
        F.concat(F.array(F.concat(F.lit("company."), "lang")),
                 F.when(F.col("quality") == 1, F.array(F.lit("sector.good")))
                 .otherwise(F.array().cast("array<string>"))).alias("event_codes"),
        F.when(F.col("quality").isNotNull(), 0.5 + 0.4 * F.col("quality")).alias("event_conf"),
        F.array().cast("array<string>").alias("tickers"),
        F.when(F.col("toxic") == 1, "LOW").when(F.col("toxic") == 0, "HIGH").alias("trust_outcome"))


DOCS_SQL = f"""
docs AS (
  SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, d.doc_id, regexp_extract(text, '^[^\\n.]*') AS title,
    text AS body, {PUBLISHER_SQL} AS publisher, CAST({TIER_SQL} AS DOUBLE) AS publisher_tier,
    TIMESTAMP '{NOW}' - to_days(CAST(doc_id % 1000 AS INTEGER)) - to_hours(CAST(doc_id % 24 AS INTEGER))
      AS published_at,
    ['src' || CAST(substr(source, 4) AS INTEGER), 'src' || (CAST(substr(source, 4) AS INTEGER) * 3 % 20)]
      AS companies,
    list_concat(['company.' || lang], CASE WHEN quality = 1 THEN ['sector.good'] ELSE [] END) AS event_codes,
    CASE WHEN quality IS NOT NULL THEN 0.5::DOUBLE + 0.4::DOUBLE * quality END AS event_conf, lang,
    CASE toxic WHEN 1 THEN 'LOW' WHEN 0 THEN 'HIGH' END AS trust_outcome
  FROM documents d LEFT JOIN labels USING (doc_id))"""

# --- BM25 over a batch of queries --------------------------------------------------------------

BM25_SQL = f"""
words AS (SELECT doc_id, regexp_extract_all(lower(text), {WORD_SQL}) AS w FROM documents),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM words),
tf AS (
  SELECT doc_id, dl, term, count(*)::DOUBLE AS tf
  FROM (SELECT doc_id, len(w)::DOUBLE AS dl, unnest(w) AS term FROM words) GROUP BY ALL),
qt AS (
  SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), {WORD_SQL})) AS term
  FROM benchmark),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
scores AS (
  SELECT query_id, doc_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5))
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term), corpus GROUP BY ALL),
top AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores
  QUALIFY rank <= 20)"""


def _bm25(spark, sf):
    terms = se.query_terms(table(spark, sf, "benchmark"), "item_id")
    return se.bm25(documents(spark, sf), terms, top=20)


@query("bm25_search", f"""
WITH {BM25_SQL} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM top""")
def bm25_search(spark, sf):
    return _bm25(spark, sf)


@query("postings", f"""
WITH {BM25_SQL} SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS occurrences,
  CAST(max(tf) AS BIGINT) AS max_tf FROM tf GROUP BY term""")
def postings(spark, sf):
    return se.postings(documents(spark, sf)).groupBy("term").agg(
        F.count("*").alias("docs"), F.sum("tf").alias("occurrences"), F.max("tf").alias("max_tf"))


SYNONYM_PAIRS = [("with", "mit"), ("mit", "with"), ("the", "les"), ("les", "the")]


@query("synonym_expansion", f"""
WITH {BM25_SQL}, syn AS (SELECT * FROM (VALUES ('with', 'mit'), ('mit', 'with'), ('the', 'les'),
  ('les', 'the')) v(term, synonym))
SELECT query_id, term FROM qt UNION SELECT query_id, synonym FROM qt JOIN syn USING (term)""")
def synonym_expansion(spark, sf):
    terms = se.query_terms(table(spark, sf, "benchmark"), "item_id")
    syn = spark.createDataFrame(SYNONYM_PAIRS, "term string, synonym string")
    return se.expand_synonyms(terms, syn)


POS_SQL = f"""
pos AS (
  SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(lower(text), {WORD_SQL}) AS w FROM documents))"""


PHRASE_SQL = f"""
WITH {POS_SQL}
SELECT a.doc_id, count(*)::DOUBLE AS freq FROM pos a JOIN pos b
  ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1"""


@query("phrase_search", PHRASE_SQL)
def phrase_search(spark, sf):
    return se.phrase_matches(documents(spark, sf), "Of the", 0)


SLOP_SQL = f"""
WITH {POS_SQL}, near AS (
  SELECT a.doc_id, a.pos, min(abs(b.pos - a.pos - 1)) AS d FROM pos a JOIN pos b
    ON a.doc_id = b.doc_id WHERE a.term = 'that' AND b.term = 'with' GROUP BY ALL)
SELECT doc_id, round(sum(1.0::DOUBLE / (1 + d)), 6) AS freq FROM near WHERE d <= 3 GROUP BY 1"""


@query("phrase_search_slop", SLOP_SQL)
def phrase_search_slop(spark, sf):
    return r6(se.phrase_matches(documents(spark, sf), "that with", 3), "freq")


# --- one query against fields -------------------------------------------------------------------

QUERY_WORDS = ["the", "nicht", "avec", "tion"]


def _field_sql(name: str, text: str) -> str:
    """CTE <name>(id, score): BM25 of the query words in one field."""
    terms = " + ".join(
        f"CASE WHEN t{i} > 0 THEN ln(1.0 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2"
        f" / (t{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(len(QUERY_WORDS)))
    counts = ", ".join(f"len(list_filter(w, lambda x: x = '{t}'))::DOUBLE AS t{i}"
                       for i, t in enumerate(QUERY_WORDS))
    dfs = ", ".join(f"count(*) FILTER (t{i} > 0)::DOUBLE AS d{i}" for i in range(len(QUERY_WORDS)))
    return f"""
{name}_w AS (SELECT id, regexp_extract_all(lower({text}), {WORD_SQL}) AS w FROM docs),
{name}_t AS (SELECT id, len(w)::DOUBLE AS dl, {counts} FROM {name}_w),
{name}_c AS (SELECT count(*) FILTER (dl > 0)::DOUBLE AS n, avg(dl) FILTER (dl > 0) AS avgdl, {dfs}
  FROM {name}_t),
{name} AS (SELECT id, {terms} AS score FROM {name}_t, {name}_c)"""


@query("multi_field_search", f"""
WITH {DOCS_SQL}, {_field_sql('ft', 'title')}, {_field_sql('fb', 'body')}
SELECT id, round(2.0 * greatest(3.0 * ft.score, 2.0 * fb.score), 6) AS score
FROM ft JOIN fb USING (id) WHERE greatest(ft.score, fb.score) > 0
ORDER BY score DESC, id LIMIT 20""")
def multi_field_search(spark, sf):
    docs = news_documents(spark, sf)
    stats = {f: se.stats_struct(docs, F.col(f), QUERY_WORDS) for f in ("title", "body")}
    best = se.best_field([
        se.match_score(tx.tokens(F.col("title")), QUERY_WORDS, stats["title"]) * 3.0,
        se.match_score(tx.tokens(F.col("body")), QUERY_WORDS, stats["body"]) * 2.0])
    return (docs.select("id", F.round(best * 2.0, 6).alias("score")).filter("score > 0")
            .orderBy(F.desc("score"), "id").limit(20))


FACTOR_SQL = f"""(publisher_tier + exp(ln(0.7::DOUBLE) * pow(epoch(TIMESTAMP '{NOW}' - published_at)
  / 86400.0 / 30.0, 2)) + 1.5::DOUBLE * coalesce(event_conf, 1.0))"""


@query("function_score", f"""
WITH {DOCS_SQL}, {_field_sql('fb', 'body')}
SELECT id, round(score, 6) AS base, round({FACTOR_SQL}, 6) AS factor,
       round(score * {FACTOR_SQL}, 6) AS score
FROM docs JOIN fb USING (id)""")
def function_score(spark, sf):
    docs = news_documents(spark, sf)
    stats = se.stats_struct(docs, F.col("body"), QUERY_WORDS)
    base = se.match_score(tx.tokens(F.col("body")), QUERY_WORDS, stats)
    factor = se.quality_factor(F.col("publisher_tier"), F.col("published_at"), F.col("event_conf"),
                               _now())
    scored = docs.select("id", base.alias("base"), factor.alias("factor"))
    return r6(scored.withColumn("score", F.col("base") * F.col("factor")), "base", "factor", "score")


def _company_event_sql(corpus: str) -> str:
    """`corpus`: whose numbers weigh the words, the documents of the range or all of them."""
    return f"""
WITH {DOCS_SQL}, ranged AS (
  SELECT * FROM docs WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 400 DAY AND published_at < TIMESTAMP '{NOW}'),
w AS (SELECT id, regexp_extract_all(lower(title), {WORD_SQL}) AS w FROM {corpus}),
t AS (
  SELECT id, len(w)::DOUBLE AS dl, len(list_filter(w, lambda x: x = 'the'))::DOUBLE AS t0,
    len(list_filter(w, lambda x: x = 'of'))::DOUBLE AS t1,
    len(list_filter(range(1, len(w)), lambda i: w[i] = 'the' AND w[i + 1] = 'of'))::DOUBLE AS p FROM w),
c AS (
  SELECT count(*) FILTER (dl > 0)::DOUBLE AS n, avg(dl) FILTER (dl > 0) AS avgdl,
    count(*) FILTER (t0 > 0)::DOUBLE AS d0, count(*) FILTER (t1 > 0)::DOUBLE AS d1 FROM t),
i AS (SELECT *, ln(1.0 + (n - d0 + 0.5) / (d0 + 0.5)) AS i0, ln(1.0 + (n - d1 + 0.5) / (d1 + 0.5)) AS i1 FROM c),
s AS (
  SELECT id,
    CASE WHEN p > 0 THEN 4.0 * (i0 + i1) * p * 2.2 / (p + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END
    + CASE WHEN t0 > 0 AND t1 > 0 THEN 2.0 * (
        i0 * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / avgdl))
        + i1 * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / avgdl))) ELSE 0 END AS words
  FROM t, i)
SELECT r.id, round((words + CASE WHEN list_has_any(companies, ['src3', 'src7']) THEN 8 ELSE 0 END
    + CASE WHEN list_contains(event_codes, 'sector.good') THEN 5 ELSE 0 END) * {FACTOR_SQL}, 6) AS score
FROM ranged r JOIN s USING (id)
WHERE words > 0 OR list_has_any(companies, ['src3', 'src7']) OR list_contains(event_codes, 'sector.good')
ORDER BY score DESC, id LIMIT 20"""


COMPANY_EVENT = se.SearchRequest("The of", companies=("src3", "SRC7"), event_labels=("sector.good",))


@query("company_event_search", _company_event_sql("ranged"))
def company_event_search(spark, sf):
    out = se.search(news_documents(spark, sf), COMPANY_EVENT, _now(),
                    _now() - F.make_dt_interval(days=F.lit(400)), _now())
    return out.select("id", "score")


# --- the stored index -----------------------------------------------------------------------------

@query("index_bm25", f"""
WITH {BM25_SQL} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM top""")
def index_bm25(spark, sf):
    """The queries of `bm25_search` from an index of the whole texts."""
    return si.bm25(_body_index(spark, sf), se.query_terms(table(spark, sf, "benchmark"), "item_id"), "body")


def _body_index(spark, sf):
    return si.update(documents(spark, sf).select("doc_id", "text"), run_dir(spark, "index"),
                     {"body": F.col("text")}, "doc_id")


@query("index_phrase", PHRASE_SQL)
def index_phrase(spark, sf):
    """The phrase of `phrase_search` from positions of the index; no text is read."""
    asked = si.phrase_table(spark, {"q": se.phrase_words("Of the")})
    return si.phrase_matches(_body_index(spark, sf), asked, "body").select("doc_id", "freq")


@query("index_phrase_slop", SLOP_SQL)
def index_phrase_slop(spark, sf):
    asked = si.phrase_table(spark, {"q": se.phrase_words("that with")})
    return r6(si.phrase_matches(_body_index(spark, sf), asked, "body", 3), "freq").select("doc_id", "freq")


GROUPS = [["with", "mit", "of the"], ["les", "that in"], ["nicht", "avec", "pas de tout"]]
GRAPH_QUERIES = {"a": "With thing", "b": "les nicht tion", "c": "of the re", "d": "that in that"}


@query("synonym_graph", f"""
WITH {BM25_SQL.split("qt AS (")[0]}
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term), {POS_SQL},
seg(q, s, a, k, n, term) AS (VALUES
  ('a', 0, 0, 0, 1, 'with'), ('a', 0, 1, 0, 1, 'mit'), ('a', 0, 2, 0, 2, 'of'), ('a', 0, 2, 1, 2, 'the'),
  ('a', 1, 0, 0, 1, 'thing'),
  ('b', 0, 0, 0, 1, 'les'), ('b', 0, 1, 0, 2, 'that'), ('b', 0, 1, 1, 2, 'in'),
  ('b', 1, 0, 0, 1, 'nicht'), ('b', 1, 1, 0, 1, 'avec'), ('b', 1, 2, 0, 3, 'pas'), ('b', 1, 2, 1, 3, 'de'),
  ('b', 1, 2, 2, 3, 'tout'), ('b', 2, 0, 0, 1, 'tion'),
  ('c', 0, 0, 0, 1, 'with'), ('c', 0, 1, 0, 1, 'mit'), ('c', 0, 2, 0, 2, 'of'), ('c', 0, 2, 1, 2, 'the'),
  ('c', 1, 0, 0, 1, 're'),
  ('d', 0, 0, 0, 1, 'les'), ('d', 0, 1, 0, 2, 'that'), ('d', 0, 1, 1, 2, 'in'), ('d', 1, 0, 0, 1, 'that')),
single AS (
  SELECT q, s, doc_id, sum(tf) AS f, max(dl) AS dl FROM seg JOIN tf USING (term) WHERE n = 1 GROUP BY 1, 2, 3),
single_w AS (
  SELECT q, s, ln(1.0 + ((SELECT n FROM corpus) - max(df) + 0.5) / (max(df) + 0.5)) AS weight
  FROM seg JOIN df USING (term) WHERE n = 1 GROUP BY 1, 2),
starts AS (
  SELECT q, s, a, n, doc_id, pos - k AS start FROM seg JOIN pos USING (term) WHERE n > 1
  GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) = n),
phrase AS (SELECT q, s, a, doc_id, count(*)::DOUBLE AS f FROM starts GROUP BY 1, 2, 3, 4),
phrase_w AS (
  SELECT q, s, a, sum(ln(1.0 + ((SELECT n FROM corpus) - df + 0.5) / (df + 0.5))) AS weight
  FROM seg JOIN df USING (term) WHERE n > 1 GROUP BY 1, 2, 3),
parts AS (
  SELECT q, doc_id, f, dl, weight FROM single JOIN single_w USING (q, s)
  UNION ALL SELECT q, doc_id, f, len(w)::DOUBLE, weight FROM phrase JOIN phrase_w USING (q, s, a) JOIN words USING (doc_id)),
graph_scores AS (
  SELECT q AS query_id, doc_id, round(sum(weight * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM parts, corpus GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
FROM graph_scores QUALIFY rank <= 20""")
def synonym_graph(spark, sf):
    """Queries whose words have spellings of one and of several words."""
    return qg.graph_search(_body_index(spark, sf), GRAPH_QUERIES, GROUPS, "body")


@query("index_update", f"""
WITH {BM25_SQL}, every AS (
  SELECT doc_id, 'body' AS field, term, tf, dl FROM tf
  UNION ALL SELECT doc_id, 'source', lower(source), 1, 1 FROM documents)
SELECT field, term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS occurrences,
  CAST(sum(dl) AS BIGINT) AS lengths, (SELECT count(*) FROM documents) AS indexed,
  (SELECT CAST(sum(len(w)) AS BIGINT) FROM words) AS words
FROM every GROUP BY 1, 2""")
def index_update(spark, sf):
    """All texts in two batches: some stand in the first with an older text, benchmark items are in
    it and then removed, and the second batch is applied twice. Equal to an index built at once."""
    path = run_dir(spark, "index")
    fields = {"body": F.col("text"), "source": F.col("source")}
    docs = documents(spark, sf).select("doc_id", "text", "source")
    part = F.col("doc_id") % 3
    items = table(spark, sf, "benchmark").select(
        (-1 - F.col("item_id")).alias("doc_id"), "text", F.lit("bench").alias("source"))
    older = docs.filter(part != 1).withColumn(
        "text", F.when(part == 0, F.concat(F.lit("older words "), F.substring("text", 1, 200)))
        .otherwise(F.col("text")))
    si.update(older.unionByName(items), path, fields, "doc_id")
    for _ in range(2):
        index = si.update(docs.filter(part != 2), path, fields, "doc_id", removed=items)
    one = index.numbers["body"]
    return index.postings(gaps=False, ids=False).groupBy("field", "term").agg(
        F.count("*").alias("docs"), F.sum("tf").alias("occurrences"), F.sum("dl").alias("lengths"),
        F.lit(one.documents).cast("long").alias("indexed"), F.lit(one.words).cast("long").alias("words"))


INDEX_TEXTS_SQL = """
SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS occurrences, (SELECT count(*) FROM documents) AS indexed,
  (SELECT CAST(sum(len(w)) AS BIGINT) FROM words) AS words FROM tf GROUP BY 1"""


@query("stream_index", f"WITH {BM25_SQL} {INDEX_TEXTS_SQL}")
def stream_index(spark, sf):
    """Texts streamed into the index in batches: two versions of some, every batch applied again as
    after a failure between the index and the checkpoint. Equal to an index built at once."""
    out = run_dir(spark, "streamed")
    docs = documents(spark, sf).select("doc_id", "text")
    at = F.lit(NOW).cast("timestamp")
    older = docs.filter("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("older words "), F.col("text")))
    for n, rows in enumerate([older.unionByName(docs.filter("doc_id % 3 = 1")), docs.filter("doc_id % 3 <> 1")]):
        (rows.withColumns({"created_at": at, "updated_at": at + F.make_dt_interval(mins=F.lit(n))})
         .coalesce(2).write.parquet(f"{out}/articles/part={n}"))
    schema = spark.read.parquet(f"{out}/articles/part=0").schema
    stream = sync.article_stream(spark, f"{out}/articles/*", schema, files_per_batch=2)
    for again in range(2):  # the second run has lost its checkpoint and replays all epochs
        sync.sync_index(stream, lambda rows: rows, f"{out}/index", {"body": F.col("text")}, f"{out}/state-{again}",
                        "articles", "doc_id", every=None).awaitTermination()
    index = si.opened(spark, f"{out}/index")
    one = index.numbers["body"]
    return index.postings(gaps=False, ids=False).groupBy("term").agg(
        F.count("*").alias("docs"), F.sum("tf").alias("occurrences"),
        F.lit(one.documents).cast("long").alias("indexed"), F.lit(one.words).cast("long").alias("words"))


@query("index_search", _company_event_sql("docs"))
def index_search(spark, sf):
    """The request of `company_event_search`; words are weighed by all documents, as in an index."""
    docs = news_documents(spark, sf)
    index = si.update(docs, run_dir(spark, "index"), {
        "title": F.col("title"), "body": F.col("body"), "events": F.concat_ws(" ", "events")})
    out = se.search(docs, COMPANY_EVENT, _now(), _now() - F.make_dt_interval(days=F.lit(400)), _now(),
                    index=index)
    return out.select("id", "score")


@query("knn_cosine_dated", """
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
  (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 6) AS score
FROM embeddings WHERE DATE '2024-06-30' - CAST(vec_id % 1000 AS INTEGER) >= DATE '2024-01-01'
  AND DATE '2024-06-30' - CAST(vec_id % 1000 AS INTEGER) < DATE '2024-06-01'
ORDER BY score DESC, vec_id LIMIT 10""")
def knn_cosine_dated(spark, sf):
    """Vector search within a range of dates."""
    vectors = table(spark, sf, "embeddings")
    q = vectors.filter("vec_id = 7").select("embedding").scalar()
    dated = vectors.withColumns({"q": q, "day": F.date_sub(
        F.lit("2024-06-30").cast("date"), (F.col("vec_id") % 1000).cast("int"))})
    return se.nearest(dated, F.col("q"), "vec_id", "embedding", 10, F.lit("2024-01-01").cast("date"),
                      F.lit("2024-06-01").cast("date"), "day")


@query("knn_cosine", """
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
  (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 6) AS score
FROM embeddings ORDER BY score DESC, vec_id LIMIT 10""")
def knn_cosine(spark, sf):
    vectors = table(spark, sf, "embeddings")
    q = vectors.filter("vec_id = 7").select("embedding").scalar()
    return se.nearest(vectors.withColumn("q", q), F.col("q"), "vec_id", "embedding", 10)


# --- the partitioned vector index ----------------------------------------------------------------

def _vector_index(spark, sf):
    day = F.date_sub(F.lit("2024-06-30").cast("date"), (F.col("vec_id") % 1000).cast("int"))
    return vi.build(table(spark, sf, "embeddings").withColumn("day", day), run_dir(spark, "vectors"),
                    "vec_id", "embedding", "day")


def _asked(spark, sf, which):
    return table(spark, sf, "embeddings").filter(which).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


KNN_ALL_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(v.e, q.e), 6) AS score
  FROM v q, v WHERE q.vec_id % 100 = 0{range}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


@query("knn_index", KNN_ALL_SQL.format(range="") + """
SELECT query_id, count(*) AS found, CAST(10 AS BIGINT) AS exact, true AS recalled FROM r WHERE rank <= 10 GROUP BY 1
UNION ALL SELECT NULL, count(*), CAST(10 * count(DISTINCT query_id) AS BIGINT), true FROM r WHERE rank <= 10""")
def knn_index(spark, sf):
    """Every hundredth vector against all by the index: rows found of each, and whether nine tenths of
    the exact ones, over all queries, are among them."""
    asked = _asked(spark, sf, "vec_id % 100 = 0")
    found = vi.search(_vector_index(spark, sf), asked)
    want = vi.exact(table(spark, sf, "embeddings"), asked.collect(), "vec_id", "embedding")
    enough = vi.recall(found, want).select((F.col("recall") >= 0.9).alias("ok")).scalar()
    each = found.groupBy("query_id").agg(F.count("*").alias("found"), F.lit(10).cast("long").alias("exact"),
                                         F.lit(True).alias("recalled"))
    total = found.agg(F.count("*").alias("found"), (10 * F.count_distinct("query_id")).alias("exact"))
    return each.unionByName(total.select(F.lit(None).cast("long").alias("query_id"), "found", "exact",
                                         enough.alias("recalled")))


@query("knn_index_dated", KNN_ALL_SQL.format(range=" AND DATE '2024-06-30' - CAST(v.vec_id % 1000 AS INTEGER)"
                                             " >= DATE '2024-01-01' AND DATE '2024-06-30'"
                                             " - CAST(v.vec_id % 1000 AS INTEGER) < DATE '2024-06-01'") + """
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def knn_index_dated(spark, sf):
    """All lists probed, within a range of dates: the rows of the range are all compared exactly."""
    index = _vector_index(spark, sf)
    return vi.search(vi.opened(spark, index.path), _asked(spark, sf, "vec_id % 100 = 0"), probes=len(index.centres),
                     rerank=1 << 30, start=F.lit("2024-01-01").cast("date"), end=F.lit("2024-06-01").cast("date"))


# --- trust ------------------------------------------------------------------------------------

AGAINST = ["license", "token", "ouoi", "nicht"]
CLAIM_WORDS = ["the", "tion", "nicht", "eaux", "mente", "zzz"]


def _claims(spark, sf):
    k = F.col("item_id")
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), "text",
        F.array(F.concat(F.lit("src"), k % 20), F.lit("src9")).alias("companies"),
        F.when(k % 4 == 0, F.array(F.lit("other"))).when(k % 4 == 1, F.array(F.lit("company.en")))
        .otherwise(F.array(F.lit("sector.good"))).alias("labels"),
        F.when(k % 3 == 0, F.array(F.lit("The"))).otherwise(F.array().cast("array<string>"))
        .alias("phrases"),
        (_now() - F.make_dt_interval(days=(k * 20 + 50).cast("int"))).alias("range_start"),
        _now().alias("range_end"))


def _hits(spark, sf):
    found = kept(_bm25(spark, sf))  # 20 rows a query, read twice; texts of other documents are not moved
    return found.join(news_documents(spark, sf, found), "doc_id").select(
        "query_id", "rank", "score", "id", "title", "body", "publisher", "published_at", "url",
        "companies", "event_codes")


CLAIMS_SQL = f"""
claims AS (
  SELECT item_id AS query_id, text, ['src' || (item_id % 20), 'src9'] AS q_companies,
    CASE item_id % 4 WHEN 0 THEN ['other'] WHEN 1 THEN ['company.en'] ELSE ['sector.good'] END AS q_labels,
    item_id % 3 = 0 AS has_phrase,
    TIMESTAMP '{NOW}' - to_days(CAST(item_id * 20 + 50 AS INTEGER)) AS range_start FROM benchmark)"""

HITS_SQL = f"""{BM25_SQL}, {DOCS_SQL}, {CLAIMS_SQL},
hits AS (SELECT query_id, rank, score, d.* FROM top JOIN docs d USING (doc_id)),
graded AS (
  SELECT h.*, list_has_any(companies, q_companies) AS cm,
    (q_labels <> ['other'] AND list_has_any(event_codes, q_labels))
      OR (has_phrase AND contains(lower(title), 'the')) AS em
  FROM hits h JOIN claims USING (query_id)),
marked AS (
  SELECT *, CASE WHEN cm AND em THEN 'exact' WHEN cm OR em THEN 'partial' ELSE 'none' END AS match FROM graded),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, match ORDER BY rank) AS mrank FROM marked),
numbers AS (
  SELECT query_id, count(*) AS results, min_by(score, rank) AS top_score,
    count(*) FILTER (match = 'exact') AS exact_n, count(*) FILTER (match = 'partial') AS partial_n,
    count(DISTINCT publisher) FILTER (match = 'exact' AND mrank <= 10) AS publishers,
    coalesce(avg(score) FILTER (match = 'exact' AND mrank <= 5), 0) AS exact_score,
    coalesce(avg(score) FILTER (match = 'partial' AND mrank <= 3), 0) AS partial_score
  FROM numbered GROUP BY query_id),
ladder AS (
  SELECT *, CASE
    WHEN exact_n > 0 THEN least(1.0, CASE WHEN exact_n = 1 THEN 0.5 WHEN exact_n = 2 THEN 0.65
      WHEN exact_n < 5 THEN 0.75 WHEN exact_n < 10 THEN 0.85 ELSE 0.9 END
      + CASE WHEN publishers >= 5 THEN 0.05 ELSE 0 END
      + CASE WHEN exact_score > 30 THEN 0.05 WHEN exact_score > 20 THEN 0.03
             WHEN exact_score > 10 THEN 0.02 ELSE 0 END)
    WHEN partial_n > 0 THEN CASE WHEN partial_n = 1 THEN 0.25 WHEN partial_n = 2 THEN 0.35
      WHEN partial_n < 5 THEN 0.45 ELSE 0.5 END
      + CASE WHEN partial_score > 20 THEN 0.03 WHEN partial_score > 10 THEN 0.02 ELSE 0 END
    WHEN top_score > 20 THEN 0.15 WHEN top_score > 10 THEN 0.1 ELSE 0.05 END::DOUBLE AS base
  FROM numbers),
against AS (
  SELECT query_id, doc_id, CASE {' '.join(
      f"WHEN contains(lower(title) || ' ' || lower(body), '{k}') THEN '{k}'" for k in AGAINST)} END AS keyword
  FROM hits),
terms AS (
  SELECT query_id, list_concat(q_companies, list_concat(
    regexp_extract_all(text, '\\d+[\\.,]?\\d*\\s*(?:조|억|만|천|백|달러|원|%)'),
    list_filter([{', '.join(f"'{k}'" for k in CLAIM_WORDS)}], lambda k: contains(text, k)))) AS terms
  FROM claims),
term_rows AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM terms),
supported AS (
  SELECT t.query_id, count(DISTINCT t.term) AS supported FROM term_rows t JOIN hits h
    ON h.query_id = t.query_id AND h.rank <= 10
    AND contains(lower(h.title) || ' ' || lower(h.body), lower(t.term)) GROUP BY 1),
support AS (
  SELECT query_id, len(terms) AS claims, coalesce(supported, 0) AS supported,
    coalesce(supported, 0)::DOUBLE / len(terms) AS support
  FROM terms LEFT JOIN supported USING (query_id)),
temporal AS (
  SELECT c.query_id, coalesce(avg(CASE WHEN h.published_at BETWEEN c.range_start AND TIMESTAMP '{NOW}'
    THEN 1.0 ELSE 0.0 END) FILTER (h.published_at IS NOT NULL), 0.5)::DOUBLE AS temporal
  FROM claims c LEFT JOIN hits h USING (query_id) GROUP BY 1)"""


@query("hit_matches", f"WITH {HITS_SQL} SELECT query_id, rank, id, match FROM marked")
def hit_matches(spark, sf):
    out = tr.classify_hits(_claims(spark, sf), _hits(spark, sf))
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "match")


@query("trust_ladder", f"""
WITH {HITS_SQL}
SELECT query_id, exact_n, partial_n, publishers, round(exact_score, 8) AS exact_score,
       round(partial_score, 8) AS partial_score, round(base, 6) AS base FROM ladder""")
def trust_ladder(spark, sf):
    n = tr.match_numbers(tr.classify_hits(_claims(spark, sf), _hits(spark, sf)))
    base = tr.base_score(*[F.col(c) for c in ("exact_n", "partial_n", "results", "publishers",
                                              "exact_score", "partial_score", "top_score")])
    out = n.withColumn("base", base).withColumns(
        {c: F.col(c).cast("long") for c in ("exact_n", "partial_n", "publishers")})
    return r6(r6(out, "base"), "exact_score", "partial_score", digits=8).drop("results", "top_score")


@query("contradictions", f"""
WITH {HITS_SQL} SELECT query_id, doc_id, keyword FROM against WHERE keyword IS NOT NULL""")
def contradictions(spark, sf):
    out = tr.contradictions(_hits(spark, sf), AGAINST)
    return out.select("query_id", F.col("id").cast("long").alias("doc_id"), "keyword")


@query("claim_support", f"""
WITH {HITS_SQL} SELECT query_id, claims, supported, round(support, 6) AS support FROM support""")
def claim_support(spark, sf):
    out = tr.claim_support(_claims(spark, sf), _hits(spark, sf), CLAIM_WORDS)
    return r6(out.withColumns({c: F.col(c).cast("long") for c in ("claims", "supported")}), "support")


@query("temporal_consistency", f"""
WITH {HITS_SQL} SELECT query_id, round(temporal, 6) AS temporal FROM temporal""")
def temporal_consistency(spark, sf):
    return r6(tr.temporal_consistency(_claims(spark, sf), _hits(spark, sf)), "temporal")


@query("rumor_verdicts", f"""
WITH {HITS_SQL}, n AS (SELECT query_id, count(keyword) AS contradictions FROM against GROUP BY 1),
fined AS (
  SELECT query_id, coalesce(exact_n, 0) AS exact_n, coalesce(partial_n, 0) AS partial_n,
    coalesce(contradictions, 0) AS contradictions, support, temporal,
    greatest(0.0, coalesce(base, 0)
      + CASE WHEN contradictions > 0 THEN -0.5 ELSE 0 END
      + CASE WHEN support < 0.3 THEN -0.2 WHEN support < 0.5 THEN -0.1 ELSE 0 END
      + CASE WHEN temporal < 0.2 THEN -0.15 WHEN temporal < 0.4 THEN -0.05 ELSE 0 END) AS score
  FROM support JOIN temporal USING (query_id) LEFT JOIN ladder USING (query_id) LEFT JOIN n USING (query_id))
SELECT query_id, round(score, 2) AS score,
  CASE WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level,
  CASE WHEN contradictions > 0 THEN 'contradicted' WHEN temporal < 0.3 THEN 'out_of_time'
    WHEN support < 0.5 AND exact_n > 0 THEN 'weak_claims' WHEN exact_n > 0 THEN 'exact_matches'
    WHEN partial_n > 0 THEN 'partial_matches' ELSE 'no_information' END AS reason,
  exact_n, partial_n, contradictions FROM fined""")
def rumor_verdicts(spark, sf):
    out = tr.verdicts(_claims(spark, sf), _hits(spark, sf), contradiction_words=AGAINST,
                      terms=CLAIM_WORDS)
    return out.select("query_id", "score", "level", "reason", *[
        F.col(c).cast("long").alias(c) for c in ("exact_n", "partial_n", "contradictions")])


@query("rumor_evidence", f"""
WITH {HITS_SQL}, sides AS (SELECT query_id, bool_or(match = 'exact') AS any_exact FROM marked GROUP BY 1)
SELECT m.query_id, count(*) AS hits, string_agg(m.rank || ' ' || url || ' ' || title, '|' ORDER BY m.rank) AS evidence
FROM (SELECT *, 'http://n/' || doc_id AS url FROM marked) m JOIN sides s ON s.query_id = m.query_id
WHERE NOT any_exact OR match = 'exact' GROUP BY 1""")
def rumor_evidence(spark, sf):
    """The articles that a verdict rests on."""
    listed = tr.evidence(tr.classify_hits(_claims(spark, sf), _hits(spark, sf)))
    return listed.select("query_id", F.size("evidence").cast("long").alias("hits"), F.concat_ws(
        "|", F.transform("evidence", lambda e: F.concat_ws(" ", e["rank"], e["url"], e["title"])))
        .alias("evidence"))


@query("trust_evaluator", """
WITH e AS (
  SELECT user_id, ts::DATE AS day, avg(value) / 100.0 AS mean, max(value) / 100.0 AS best, count(*) AS n,
    count(*) FILTER (event_type = 'purchase') AS exact_n, count(*) FILTER (event_type = 'click') AS partial_n,
    (user_id % 100)::DOUBLE / 100 AS c FROM events GROUP BY ALL)
SELECT user_id, day, CASE WHEN c >= 0.95 AND exact_n >= 1 AND best >= 0.8 THEN 'HIGH'
    WHEN c >= 0.6 AND (exact_n > 0 OR mean >= 0.5) THEN 'MEDIUM'
    WHEN c >= 0.3 OR partial_n > 0 THEN 'LOW' ELSE 'VERY_LOW' END AS level,
  round(c * 100 * 0.4 + mean * 100 * 0.3 + least(100.0, exact_n * 33.33) * 0.2
    + least(100.0, n * 20.0) * 0.1, 8) AS points FROM e""")
def trust_evaluator(spark, sf):
    # relevances of one user's day stand for the matches of one search
    g = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        (F.avg("value") / 100.0).alias("mean"), (F.max("value") / 100.0).alias("best"),
        F.count("*").alias("n"),
        F.count_if(F.col("event_type") == "purchase").alias("exact_n"),
        F.count_if(F.col("event_type") == "click").alias("partial_n"))
    e = tr.evaluate(F.col("user_id") % 100 / 100.0, F.col("mean"), F.col("best"), F.col("n"),
                    F.col("exact_n"), F.col("partial_n"), digits=8)
    return g.select("user_id", "day", e.alias("e")).select("user_id", "day", "e.level", "e.points")


# --- similar cases ------------------------------------------------------------------------------

Q_COMPANIES, Q_EVENTS = ["src3", "src9", "src4"], ["company.en", "sector.good"]


def _cases(spark, sf):
    return pt.similar_cases(news_documents(spark, sf), Q_COMPANIES, Q_EVENTS,
                            _now() - F.make_dt_interval(days=F.lit(365)), _now(), 0.3)


CASES_SQL = f"""{DOCS_SQL}, scored AS (
  SELECT *, CASE WHEN list_has_any(companies, {Q_COMPANIES}) THEN 1.0 ELSE 0.0 END
    + CASE WHEN list_has_any(event_codes, {Q_EVENTS}) THEN 1.0 ELSE 0.0 END AS score,
    (len(list_intersect({Q_COMPANIES}, companies)) + len(list_intersect({Q_EVENTS}, event_codes))) / 5.0::DOUBLE
      AS similarity
  FROM docs WHERE published_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 365 DAY AND TIMESTAMP '{NOW}'),
cases AS (SELECT * REPLACE (round(similarity, 2) AS similarity) FROM scored
          WHERE score > 0 AND round(similarity, 2) >= 0.3)"""


@query("similar_cases", f"""
WITH {CASES_SQL} SELECT id, similarity, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at
FROM cases ORDER BY cases.similarity DESC, cases.published_at DESC, id LIMIT 20""")
def similar_cases(spark, sf):
    return pt.top_cases(_cases(spark, sf)).select(
        "id", "similarity", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("pattern_frequency", f"""
WITH {CASES_SQL}, c AS (SELECT unnest(companies) AS value FROM cases),
e AS (SELECT unnest(event_codes) AS value FROM cases), n AS (SELECT count(*) AS n FROM cases)
SELECT * FROM (SELECT 'company' AS kind, value, count(*) AS count, round(least(1.0, count(*)::DOUBLE / max(n)), 6)
  AS share FROM c, n GROUP BY value HAVING count(*) >= 3 ORDER BY count DESC, value LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'event', value, count(*) AS k, round(least(1.0, count(*)::DOUBLE / max(n)), 6)
  FROM e, n GROUP BY value HAVING count(*) >= 3 ORDER BY k DESC, value LIMIT 3)""")
def pattern_frequency(spark, sf):
    cases = _cases(spark, sf)
    companies = pt.frequent(cases, "companies").select(F.lit("company").alias("kind"), "*")
    events = pt.frequent(cases, "event_codes").select(F.lit("event").alias("kind"), "*")
    return r6(companies.unionByName(events), "share")


@query("pattern_recency", f"""
WITH {CASES_SQL}
SELECT count(*) AS n, count(*) FILTER (floor(epoch(TIMESTAMP '{NOW}' - published_at) / 86400) <= 30) AS recent,
  round(count(*) FILTER (floor(epoch(TIMESTAMP '{NOW}' - published_at) / 86400) <= 30)::DOUBLE / count(*), 6) AS share,
  count(*) >= 5 AND count(*) FILTER (floor(epoch(TIMESTAMP '{NOW}' - published_at) / 86400) <= 30) >= count(*) * 0.5
    AS spike FROM cases""")
def pattern_recency(spark, sf):
    return r6(pt.recency(_cases(spark, sf), _now()), "share")


@query("pattern_interval", """
WITH g AS (
  SELECT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders),
a AS (SELECT o_custkey, count(*) AS n, max(d) - min(d) AS span FROM g GROUP BY 1 HAVING count(*) >= 5)
SELECT o_custkey, n, round(span::DOUBLE / (n - 1), 6) AS mean_gap, span::DOUBLE / (n - 1) BETWEEN 80 AND 100
  AS quarterly FROM a""")
def pattern_interval(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"))
    return r6(pt.interval_groups(orders, ["o_custkey"], "d"), "mean_gap")


@query("pattern_gaps", """
WITH g AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_custkey, d, CAST(d - lag(d) OVER (PARTITION BY o_custkey ORDER BY d) AS INTEGER) AS gap FROM g""")
def pattern_gaps(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"))
    return pt.gaps_between(orders, ["o_custkey"], "d")


@query("pattern_outcome", f"""
WITH {CASES_SQL}
SELECT trust_outcome AS outcome, count(*) AS count,
  round(count(*)::DOUBLE / (SELECT count(trust_outcome) FROM cases), 6) AS share
FROM cases WHERE trust_outcome IS NOT NULL GROUP BY 1 ORDER BY count DESC, outcome LIMIT 1""")
def pattern_outcome(spark, sf):
    return r6(pt.outcome_mode(_cases(spark, sf)), "share")


@query("pattern_mean_similarity", f"""
WITH {CASES_SQL} SELECT count(*) AS n, round(avg(similarity), 6) AS mean_similarity FROM cases""")
def pattern_mean_similarity(spark, sf):
    return r6(pt.mean_similarity(_cases(spark, sf)), "mean_similarity")


@query("pattern_insights", f"""
WITH {CASES_SQL}, n AS (SELECT count(*) AS n FROM cases),
c AS (SELECT unnest(companies) AS value FROM cases), e AS (SELECT unnest(event_codes) AS value FROM cases),
old AS (SELECT count(*) AS n, count(*) FILTER (
  floor(epoch(TIMESTAMP '{NOW}' - published_at) / 86400) <= 30) AS recent FROM cases),
gaps AS (SELECT floor(epoch(published_at - lag(published_at) OVER (ORDER BY published_at)) / 86400) AS g FROM cases),
q AS (SELECT sum(g) / (count(*) - 1) AS mean_gap, count(*) AS n FROM gaps)
SELECT 'frequent_company' AS pattern_type, value, count(*) AS frequency,
  round(least(1.0, count(*)::DOUBLE / max(n)), 6) AS confidence FROM c, n GROUP BY value
  HAVING count(*) >= 3 QUALIFY row_number() OVER (ORDER BY count(*) DESC, value) = 1
UNION ALL SELECT 'frequent_event', value, count(*), round(least(1.0, count(*)::DOUBLE / max(n)), 6) FROM e, n
  GROUP BY value HAVING count(*) >= 3 QUALIFY row_number() OVER (ORDER BY count(*) DESC, value) = 1
UNION ALL SELECT 'recent_spike', NULL, recent, round(recent::DOUBLE / n, 6) FROM old
  WHERE n >= 5 AND recent >= n * 0.5
UNION ALL SELECT 'quarterly_pattern', CAST(CAST(floor(mean_gap) AS BIGINT) AS VARCHAR), n, 0.7 FROM q
  WHERE n >= 5 AND mean_gap BETWEEN 80 AND 100
UNION ALL SELECT 'trust_pattern', trust_outcome, count(*),
  round(count(*)::DOUBLE / (SELECT count(trust_outcome) FROM cases), 6) FROM cases
  WHERE trust_outcome IS NOT NULL GROUP BY trust_outcome
  QUALIFY row_number() OVER (ORDER BY count(*) DESC, trust_outcome) = 1""")
def pattern_insights(spark, sf):
    return r6(pt.insights(_cases(spark, sf), _now()), "confidence")
