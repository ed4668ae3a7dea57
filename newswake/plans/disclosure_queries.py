"""Registered queries: disclosures and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from newswake.functions import text as tx, words
from newswake.operators import disclosures as ds
from newswake.plans.catalog import query, r6, run_dir
from newswake.plans.text_queries import _any_sql
from newswake.plans.views import table
from newswake.streaming import sync

REPORTS = [
    "단일판매ㆍ공급계약체결", "조회공시 요구(풍문또는보도)", "조회공시 답변(미확정)", "유상증자결정", "분기보고서",
    "주주총회소집결의", "타법인주식및출자증권취득결정", "영업실적 설명 안내", "수주 공급계약 (주)Alpha", "자기주식처분결정",
    "시설투자 증설", "임원 변동",
]
REPORT_SQL = "[" + ", ".join(f"'{r}'" for r in REPORTS) + "]"


def filings(spark, sf):
    """Disclosures from orders; about a ninth of them are listed twice, stored and live."""
    k = F.col("o_orderkey")
    base = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("rcept_no"),
        F.concat(F.lit("C"), F.col("o_custkey") % 50).alias("corp_code"),
        F.to_date("o_orderdate").alias("rcept_date"),
        F.element_at(tx.text_array(REPORTS), (k % 12 + 1).cast("int")).alias("report_nm"),
        F.when(k % 5 == 0, "I").otherwise("B").alias("pblntf_ty"),
        F.when(k % 7 == 0, "계약상대방: Beta Corp").otherwise("").alias("rm"),
        F.when(k % 4 == 0, F.concat(F.lit("(주) Gamma "), F.col("o_custkey") % 3)).alias("counterparty"))
    live = base.filter(F.col("rcept_no").cast("long") % 9 == 0).withColumn("rm", F.lit("live copy"))
    return base, live


FILINGS_SQL = f"""
filings AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS rcept_no, 'C' || (o_custkey % 50) AS corp_code,
    CAST(o_orderdate AS DATE) AS rcept_date, {REPORT_SQL}[o_orderkey % 12 + 1] AS report_nm,
    CASE WHEN o_orderkey % 5 = 0 THEN 'I' ELSE 'B' END AS pblntf_ty,
    CASE WHEN o_orderkey % 7 = 0 THEN '계약상대방: Beta Corp' ELSE '' END AS rm,
    CASE WHEN o_orderkey % 4 = 0 THEN '(주) Gamma ' || (o_custkey % 3) END AS counterparty FROM orders)"""

COMPANIES = ["Gamma1", "주식회사 Beta Corp", "Delta"]

# contract parties as the text rules find them in these report names and remarks
PARTIES_SQL = """CASE WHEN counterparty IS NOT NULL THEN [counterparty]
  ELSE list_concat(CASE WHEN rm <> '' THEN ['Beta Corp'] ELSE [] END,
                   CASE WHEN contains(report_nm, '(주)Alpha') THEN ['(주)Alpha'] ELSE [] END) END"""

SIGNALS_SQL = f"""{FILINGS_SQL},
parts AS (
  SELECT *, {_any_sql('lower(report_nm)', words.CONTRACT)} AS contract,
    {_any_sql('lower(report_nm)', words.DECISION)} AS dec, {_any_sql('lower(report_nm)', words.QUERY)} AS qry,
    {_any_sql('lower(report_nm)', words.ANSWER)} AS ans, {PARTIES_SQL} AS parties FROM filings),
matched AS (
  SELECT *, contract AND len(list_filter(parties, lambda p:
      lower(regexp_replace(p, '\\(주\\)|㈜|주식회사|\\s+', '', 'g')) IN ('gamma1', 'betacorp'))) > 0 AS hit
  FROM parts),
signals AS (
  SELECT *, CASE
    WHEN hit THEN -40 WHEN contract AND counterparty IS NOT NULL THEN -15
    WHEN pblntf_ty = 'I' AND qry THEN 20 WHEN pblntf_ty = 'I' AND dec THEN -30
    ELSE CASE WHEN dec THEN -30 ELSE 0 END + CASE WHEN qry THEN 20 ELSE 0 END
       + CASE WHEN ans THEN -10 ELSE 0 END END AS weight,
    CASE WHEN hit OR (contract AND counterparty IS NOT NULL) THEN 'DECISION'
    WHEN pblntf_ty = 'I' AND qry THEN 'QUERY' WHEN pblntf_ty = 'I' AND dec THEN 'DECISION'
    WHEN dec OR qry OR ans THEN concat_ws('|', CASE WHEN dec THEN 'DECISION' END,
      CASE WHEN qry THEN 'QUERY' END, CASE WHEN ans THEN 'ANSWER' END)
    ELSE 'NEUTRAL' END AS types FROM matched)"""


def _found(companies):
    return ds.signals(F.col("report_nm"), F.col("pblntf_ty"), F.col("rm"), F.col("counterparty"),
                      companies)


@query("disclosure_signals", f"WITH {SIGNALS_SQL} SELECT rcept_no, types, weight FROM signals")
def disclosure_signals(spark, sf):
    stored, _ = filings(spark, sf)
    return stored.withColumn("f", _found(tx.text_array(COMPANIES))).select(
        "rcept_no", F.concat_ws("|", F.transform("f", lambda s: s["type"])).alias("types"),
        ds.weight_sum(F.col("f")).alias("weight"))


@query("contract_signals", f"""
WITH {SIGNALS_SQL}
SELECT rcept_no, contract AS is_contract, contract AND (counterparty IS NOT NULL OR hit) AS has_counterparty,
       CASE WHEN hit THEN -40 WHEN contract AND counterparty IS NOT NULL THEN -15 ELSE 0 END AS weight FROM matched""")
def contract_signals(spark, sf):
    """Contracts among the filings, and whether their other party is a company of the rumor."""
    stored, _ = filings(spark, sf)
    s = ds.contract_signal(F.col("report_nm"), F.col("rm"), F.col("counterparty"), tx.text_array(COMPANIES))
    return stored.select("rcept_no", s.alias("s")).select(
        "rcept_no", "s.is_contract", "s.has_counterparty", F.col("s.weight").alias("weight"))


@query("first_receipt_dedupe", f"""
WITH {FILINGS_SQL} SELECT corp_code, rcept_no, report_nm, rm FROM filings""")
def first_receipt_dedupe(spark, sf):
    return ds.union_sources(*filings(spark, sf)).select("corp_code", "rcept_no", "report_nm", "rm")


@query("counterparties", f"""
WITH {FILINGS_SQL}
SELECT rcept_no, array_to_string(list_concat(CASE WHEN rm <> '' THEN ['Beta Corp'] ELSE [] END,
  CASE WHEN contains(report_nm, '(주)Alpha') THEN ['(주)Alpha'] ELSE [] END), '|') AS parties FROM filings""")
def counterparties(spark, sf):
    stored, _ = filings(spark, sf)
    return stored.select("rcept_no", F.concat_ws("|", tx.counterparties(
        F.concat_ws(" ", "report_nm", "rm"))).alias("parties"))


def _news_articles(spark, sf):
    """Articles about a company from line items of one order: text from return flag and status."""
    return table(spark, sf, "orders").select(
        F.concat(F.lit("a"), "o_orderkey").alias("article_id"),
        F.concat(F.lit("C"), F.col("o_custkey") % 50).alias("corp_code"),
        F.to_date("o_orderdate").alias("article_date"),
        F.when(F.col("o_orderkey") % 6 == 0, "단독 인수설?").when(F.col("o_orderkey") % 6 == 1, "계약 체결 발표")
        .otherwise("시장 소식").alias("title"),
        F.when(F.col("o_orderkey") % 10 == 0, "사실무근").when(F.col("o_orderkey") % 10 == 1, "조회공시 요구")
        .when(F.col("o_orderkey") % 10 == 2, "Analysts 전망").otherwise("본문").alias("body"),
        tx.text_array(COMPANIES).alias("companies"))


ARTICLES_SQL = """
articles AS (
  SELECT 'a' || o_orderkey AS article_id, 'C' || (o_custkey % 50) AS corp_code,
    CAST(o_orderdate AS DATE) AS article_date,
    CASE o_orderkey % 6 WHEN 0 THEN '단독 인수설?' WHEN 1 THEN '계약 체결 발표' ELSE '시장 소식' END AS title,
    CASE o_orderkey % 10 WHEN 0 THEN '사실무근' WHEN 1 THEN '조회공시 요구' WHEN 2 THEN 'Analysts 전망'
      ELSE '본문' END AS body FROM orders)"""

FULL = "lower(title || chr(10) || body)"
TONE_SQL = f"""CASE WHEN {_any_sql(FULL, words.HEDGING)} THEN 20 ELSE 0 END
  + CASE WHEN {_any_sql(FULL, words.CONFIRM)} THEN -15 ELSE 0 END
  + CASE WHEN contains(title, '?') THEN 10 ELSE 0 END + CASE WHEN contains(title, '단독') THEN 5 ELSE 0 END"""


@query("article_tone", f"WITH {ARTICLES_SQL} SELECT article_id, {TONE_SQL} AS tone FROM articles")
def article_tone(spark, sf):
    return _news_articles(spark, sf).select(
        "article_id", ds.article_tone(F.col("title"), F.col("body")).alias("tone"))


@query("disclosure_verify", f"""
WITH {SIGNALS_SQL}, {ARTICLES_SQL},
p AS (
  SELECT a.article_id, count(*) AS total, sum(s.weight) AS points, count(*) FILTER (s.types <> 'NEUTRAL')
    AS relevant FROM articles a JOIN signals s ON a.corp_code = s.corp_code
    AND a.article_date BETWEEN s.rcept_date - 3 AND s.rcept_date + 3 GROUP BY 1),
o AS (
  SELECT article_id, coalesce(total, 0) AS total, coalesce(relevant, 0) AS relevant,
    {TONE_SQL} + coalesce(points, 0) AS adjustment FROM articles LEFT JOIN p USING (article_id))
SELECT article_id, total, relevant, CAST(adjustment AS BIGINT) AS adjustment,
  CASE WHEN total = 0 THEN 'none' WHEN adjustment <= -30 THEN 'confirmed'
       WHEN adjustment >= 30 THEN 'likely_rumor' ELSE 'uncertain' END AS summary,
  round(greatest(0.0, least(100.0, 50.0 + adjustment)) / 100.0, 6)::DOUBLE AS probability,
  CASE WHEN 50 + adjustment >= 70 THEN 'likely_rumor' WHEN 50 + adjustment <= 30 THEN 'likely_confirmed'
       ELSE 'uncertain' END AS recommendation FROM o""")
def disclosure_verify(spark, sf):
    stored, live = filings(spark, sf)
    return r6(ds.verify(_news_articles(spark, sf), ds.union_sources(stored, live)), "probability")


@query("disclosure_verdict", f"""
WITH {FILINGS_SQL}, {ARTICLES_SQL},
added AS (
  SELECT a.article_id, sum(CASE WHEN {_any_sql('lower(report_nm)', words.DECISION)} THEN -25 ELSE 0 END
    + CASE WHEN {_any_sql('lower(report_nm)', words.QUERY)} THEN 10 ELSE 0 END
    + CASE WHEN {_any_sql('lower(report_nm)', words.ANSWER)} THEN -10 ELSE 0 END) AS add
  FROM articles a JOIN filings f ON a.corp_code = f.corp_code
    AND f.rcept_date BETWEEN a.article_date - 3 AND a.article_date GROUP BY 1),
s AS (
  SELECT article_id, greatest(0, least(100, 50 + coalesce(add, 0)
    + CASE WHEN {_any_sql(FULL, words.HEDGING)} THEN 20 ELSE 0 END
    + CASE WHEN {_any_sql(FULL, words.DENIAL)} THEN -30 ELSE 0 END
    + CASE WHEN {_any_sql(FULL, words.CONFIRM)} AND NOT contains(title || body, '조회공시') THEN -15 ELSE 0 END
    + CASE WHEN contains(title, '?') OR contains(title, '단독') THEN 10 ELSE 0 END)) AS score
  FROM articles LEFT JOIN added USING (article_id))
SELECT article_id, CAST(score AS INTEGER) AS score, CASE WHEN score >= 70 THEN 'rumor'
  WHEN score <= 35 THEN 'not_rumor' ELSE 'uncertain' END AS verdict FROM s""")
def disclosure_verdict(spark, sf):
    arts = _news_articles(spark, sf)
    stored, _ = filings(spark, sf)
    return ds.verdicts_around(arts, stored, 3, back_only=True)


LEXICON = {"earnings": {"metrics": ["실적", "매출"]}, "mna": {"actions": ["인수", "취득"]},
           "investment": {"actions": ["투자", "증설"]}, "financing": {"equity": ["증자"]}}
SIGNAL_WORDS = {"rumor": ["풍문", "인수"], "denial": ["부인", "사실무근"], "undecided": ["미확정", "검토 중"]}
RUMORS = ["인수 검토 풍문", "실적 증자 사실무근", "증설 투자 확대"]
LABELS = [["company.mna_acquisition"], ["company.earnings_result", "company.financing_equity"],
          ["company.capex_expansion"]]
PHRASES = [["타법인주식"], ["분기보고서 제출 예정"], []]


def _graded(spark, sf):
    stored, _ = filings(spark, sf)
    k = (F.col("rcept_no").cast("long") % 3).cast("int")
    pick = lambda values: F.when(k == 0, values[0]).when(k == 1, values[1]).otherwise(values[2])
    return stored.select(
        "rcept_no", F.concat(F.lit("a"), F.col("corp_code")).alias("article_id"), "report_nm",
        ds.relevance(F.col("report_nm"), pick([tx.text_array(x) for x in LABELS]),
                     pick([F.lit(x) for x in RUMORS]), pick([tx.text_array(x) for x in PHRASES]),
                     LEXICON, SIGNAL_WORDS).alias("relevance"))


def _relevance_cases() -> str:
    """The twelve report names meet three rumors; the values follow from the rules by hand."""
    # (report number, rumor number) -> relevance; report numbers count from 0
    by_hand = {
        (0, 0): 0.0, (0, 1): 0.0, (0, 2): 0.0,
        (1, 0): 0.4, (1, 1): 0.4, (1, 2): 0.4,
        (2, 0): 0.6, (2, 1): 0.6, (2, 2): 0.6,
        (3, 0): 0.0, (3, 1): 0.8, (3, 2): 0.0,
        (4, 0): 0.0, (4, 1): 1.0, (4, 2): 0.0,
        (5, 0): 0.0, (5, 1): 0.0, (5, 2): 0.0,
        (6, 0): 0.95, (6, 1): 0.0, (6, 2): 0.0,
        (7, 0): 0.0, (7, 1): 0.9, (7, 2): 0.0,
        (8, 0): 0.0, (8, 1): 0.0, (8, 2): 0.0,
        (9, 0): 0.0, (9, 1): 0.0, (9, 2): 0.0,
        (10, 0): 0.0, (10, 1): 0.0, (10, 2): 0.8,
        (11, 0): 0.0, (11, 1): 0.0, (11, 2): 0.0,
    }
    rows = ", ".join(f"({r}, {m}, {value!r}::DOUBLE)" for (r, m), value in by_hand.items())
    return f"""expected AS (SELECT * FROM (VALUES {rows}) v(report, rumor, relevance)),
graded AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS rcept_no, 'aC' || (o_custkey % 50) AS article_id,
    {REPORT_SQL}[o_orderkey % 12 + 1] AS report_nm, relevance
  FROM orders JOIN expected ON report = o_orderkey % 12 AND rumor = o_orderkey % 3)"""


@query("disclosure_relevance", f"""
WITH {_relevance_cases()} SELECT rcept_no, report_nm, round(relevance, 6) AS relevance FROM graded""")
def disclosure_relevance(spark, sf):
    return r6(_graded(spark, sf).drop("article_id"), "relevance")


@query("disclosure_relevance_adjustment", f"""
WITH {_relevance_cases()}, g AS (
  SELECT article_id, count(*) FILTER (relevance >= 0.5) AS direct,
    count(*) FILTER (relevance >= 0.2 AND relevance < 0.5) AS near,
    count(*) FILTER (relevance < 0.2) AS unrelated,
    count(*) FILTER (contains(report_nm, '조회공시') AND contains(report_nm, '요구')) AS inquiries
  FROM graded GROUP BY 1)
SELECT *, CASE WHEN direct > 0 THEN -30 WHEN near > 0 THEN -10 ELSE 0 END
    + CASE WHEN inquiries > 0 THEN 20 ELSE 0 END AS adjustment,
  CASE WHEN direct > 0 AND inquiries > 0 THEN 'mixed' WHEN direct > 0 THEN 'confirmed'
    WHEN near > 0 AND inquiries > 0 THEN 'uncertain' WHEN near > 0 THEN 'partly_confirmed'
    WHEN inquiries > 0 THEN 'inquiry_open' ELSE 'unrelated' END AS reason FROM g""")
def disclosure_relevance_adjustment(spark, sf):
    return ds.relevance_adjustment(_graded(spark, sf))


# --- streaming --------------------------------------------------------------------------------

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _event_stream(spark, sf):
    return sync.article_stream(spark, f"{sf}/events.parquet*", EVENT_SCHEMA)


@query("stream_tumbling_counts", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n,
       round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_tumbling_counts(spark, sf):
    """A stream drained to the end into a table of this run."""
    out = run_dir(spark, "tumbling")
    stream = sync.tumbling_counts(_event_stream(spark, sf), "ts", "1 day", "event_type", "value")
    sync.run_to_path(stream, out, "complete", f"{out}-state")
    return r6(spark.read.parquet(out).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"),
        "total", digits=4)


@query("stream_dedupe", """
SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_dedupe(spark, sf):
    """Every event arrives twice; the deduplicated stream is written out and counted."""
    out = run_dir(spark, "dedupe")
    stream = _event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    q = (sync.dedupe(stream, ["event_id"], "ts").drop("copy").writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", out + "-state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
