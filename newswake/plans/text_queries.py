"""Registered queries: text fields, documents, labels, company names."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from newswake.functions import dates, ids, text as tx, words
from newswake.operators import companies as co, documents as dc, extraction_store as xs, labels as lb
from newswake.plans.catalog import query, r6, run_dir
from newswake.plans.views import documents, table
from newswake.sources.writers import kept

WORD_SQL = "'[A-Za-z0-9가-힣]{2,}'"
BLANK_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def _strip_sql(x: str) -> str:
    return f"trim({x}, {BLANK_SQL})"


def _any_sql(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t.lower()}')" for t in terms) + ")"


# --- names, titles, URLs, dates ---------------------------------------------------------------

@query("split_companies", f"""
WITH p AS (
  SELECT doc_id, list_filter(list_transform(
    string_split_regex(text, '[,\\\\|/·]'), lambda x: {_strip_sql('x')}), lambda x: x <> '') AS names
  FROM documents)
SELECT doc_id, len(names) AS n, array_to_string(names, '|') AS names FROM p""")
def split_companies(spark, sf):
    names = tx.split_companies(F.col("text"))
    return documents(spark, sf).select(
        "doc_id", F.size(names).cast("long").alias("n"), F.concat_ws("|", names).alias("names"))


PUBLISHERS = ["연합뉴스", "매일경제", "서울경제", "MBN", "뉴스1", "지역신문"]


def _publisher():
    number = F.substring("source", 4, 10).cast("int")
    return F.element_at(tx.text_array(PUBLISHERS), number % 6 + 1)


PUBLISHER_SQL = ("[" + ", ".join(f"'{p}'" for p in PUBLISHERS)
                 + "][CAST(substr(source, 4) AS INTEGER) % 6 + 1]")
TIER_SQL = f"CASE {PUBLISHER_SQL} " + " ".join(
    f"WHEN '{p}' THEN {tx.PUBLISHER_TIER[p]}" for p in PUBLISHERS if p in tx.PUBLISHER_TIER
) + " ELSE 0.5 END"


@query("publisher_tier", f"""
SELECT doc_id, {PUBLISHER_SQL} AS publisher, CAST({TIER_SQL} AS DOUBLE) AS tier FROM documents""")
def publisher_tier(spark, sf):
    return documents(spark, sf).select(
        "doc_id", _publisher().alias("publisher"), tx.publisher_tier(_publisher()).alias("tier"))


@query("title_normalise", """
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text,
  '[\\[\\]()<>…·,.!?:;"''`]+', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM conversations""")
def title_normalise(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.normalize_title(F.col("text")).alias("title"))


@query("keyphrases", f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), {WORD_SQL}) AS w FROM documents),
g AS (
  SELECT doc_id, w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b,
    list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
      AS t FROM w),
a AS (
  SELECT doc_id, list_sort(list_distinct(list_concat(w, b, list_transform(b, lambda x: replace(x, ' ', '')),
    t, list_transform(t, lambda x: replace(x, ' ', ''))))) AS p FROM g)
SELECT doc_id, array_to_string(p, '|') AS phrases FROM a""")
def keyphrases(spark, sf):
    return documents(spark, sf).select("doc_id", tx.joined_keyphrases(F.col("text")).alias("phrases"))


@query("char_trigrams", """
SELECT gram, count(*) AS n FROM (
  SELECT unnest(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))) AS gram
  FROM benchmark) GROUP BY gram""")
def char_trigrams(spark, sf):
    return (table(spark, sf, "benchmark").select(F.explode(tx.char_ngrams(F.col("text")))
                                                 .alias("gram"))
            .groupBy("gram").agg(F.count("*").alias("n")))


@query("canonical_url", """
WITH u AS (SELECT page_id, replace(replace(url, 'page=', 'OID='), 'ref=', 'article_id=') AS url FROM pages)
SELECT page_id,
  lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://'
    || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_extract(url, '://[^/?#]*([^?#]*)', 1)
    || CASE WHEN contains(url, 'OID=') THEN '?aid=' || regexp_extract(url, 'article_id=([^&#]*)', 1)
         || '&oid=' || regexp_extract(url, 'OID=([^&#]*)', 1) ELSE '' END AS canonical,
  CASE WHEN contains(url, 'OID=') THEN regexp_extract(url, 'OID=([^&#]*)', 1) END AS oid
FROM u""")
def canonical_url(spark, sf):
    url = F.replace(F.replace(F.col("url"), F.lit("page="), F.lit("OID=")),
                    F.lit("ref="), F.lit("article_id="))
    return table(spark, sf, "pages").select(
        "page_id", tx.canonical_url(url).alias("canonical"),
        tx.article_keys(url)["oid"].alias("oid"))


@query("date_normalise", """
WITH e AS (SELECT event_id, date_trunc('second', ts) AS ts, event_id % 5 AS k FROM events),
s AS (SELECT event_id, k, CASE WHEN k = 0 THEN ts ELSE date_trunc('day', ts) END AS local FROM e)
SELECT event_id, CASE WHEN k < 4 THEN strftime(local - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') END AS utc,
       CASE WHEN k < 4 THEN strftime(local, '%Y-%m-%d %H:%M:%S') END AS seoul,
       CASE WHEN k IN (1, 2, 3) THEN CAST(local AS DATE) END AS day FROM s""")
def date_normalise(spark, sf):
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 5
    raw = (F.when(k == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
           .when(k == 1, F.date_format(ts, "yyyy-MM-dd"))
           .when(k == 2, F.date_format(ts, "yyyy.MM.dd"))
           .when(k == 3, F.date_format(ts, "yyyy/MM/dd")).otherwise("n/a"))
    at = dates.published_at(F.col("raw"))
    return table(spark, sf, "events").select("event_id", raw.alias("raw")).select(
        "event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("utc"),
        dates.seoul_text(at).alias("seoul"), dates.to_event_date(F.col("raw")).alias("day"))


@query("date_context", """
WITH t AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 8 AS k, CAST(o_custkey % 9 AS INTEGER) + 1 AS n
  FROM orders),
r AS (
  SELECT o_orderkey, CASE k
    WHEN 0 THEN d - n - 1 WHEN 1 THEN CAST(date_trunc('month', d - to_months(n)) AS DATE)
    WHEN 2 THEN d - 1 WHEN 3 THEN CAST(d - INTERVAL 3 MONTH AS DATE) WHEN 4 THEN DATE '1998-04-01' - 3
    WHEN 5 THEN make_date(year(d) - 1, 1, 1) WHEN 6 THEN DATE '1999-02-11' ELSE d - 30 END AS a,
  CASE k
    WHEN 0 THEN d - n + 1 WHEN 1 THEN last_day(CAST(d - to_months(n) AS DATE))
    WHEN 2 THEN d - 1 WHEN 3 THEN d WHEN 4 THEN least(DATE '1998-06-30' + 3, d)
    WHEN 5 THEN make_date(year(d) - 1, 12, 31) WHEN 6 THEN DATE '1999-02-13' ELSE d END AS b FROM t)
SELECT o_orderkey, a AS range_start, b AS range_end FROM r""")
def date_context(spark, sf):
    k, n = F.col("o_orderkey") % 8, (F.col("o_custkey") % 9 + 1).cast("string")
    text = (F.when(k == 0, F.concat(n, F.lit("일 전 발표"))).when(k == 1, F.concat(n, F.lit("개월 전")))
            .when(k == 2, "어제 나온 소식").when(k == 3, "최근 3개월 동안").when(k == 4, "1998년 2분기 실적")
            .when(k == 5, "작년 인수").when(k == 6, "1999년 2월 12일 공시").otherwise("소식"))
    c = dates.date_context(text, F.to_date("o_orderdate"))
    return table(spark, sf, "orders").select(
        "o_orderkey", c["start"].alias("range_start"), c["end"].alias("range_end"))


def _months_sql(year: str, first: int, last: int) -> tuple[str, str]:
    return (f"make_date({year}, {first}, 1) - 3", f"least(last_day(make_date({year}, {last}, 1)) + 3, d)")


WEEK_SQL = "(d - CAST(isodow(d) - 1 AS INTEGER))"
MONTH_SQL = "CAST(date_trunc('month', d) AS DATE)"
#: every kind of date phrase: text ({n} is a number of the row), first and last day
RUNGS: list[tuple[str, str, str]] = [
    ("{n}일 전 발표", "d - n - 1", "d - n + 1"), ("{n} 주전 소식", "d - 7 * n - 3", "d - 7 * n + 3"),
    ("{n}개월 전", "CAST(date_trunc('month', d - to_months(n)) AS DATE)", "last_day(CAST(d - to_months(n) AS DATE))"),
    ("어제 발표", "d - 1", "d - 1"), ("그제 발표", "d - 2", "d - 2"), ("오늘 발표", "d", "d"),
    ("이번주 소식", WEEK_SQL, "d"), ("지난주 소식", f"{WEEK_SQL} - 7", f"{WEEK_SQL} - 1"),
    ("이번달 소식", MONTH_SQL, "d"), ("지난달 소식", f"CAST(date_trunc('month', {MONTH_SQL} - 1) AS DATE)", f"{MONTH_SQL} - 1"),
    ("올해 소식", "make_date(year(d), 1, 1)", "d"), ("작년 소식", "make_date(year(d) - 1, 1, 1)", "make_date(year(d) - 1, 12, 31)"),
    ("재작년 소식", "make_date(year(d) - 2, 1, 1)", "make_date(year(d) - 2, 12, 31)"),
    ("최근 소식", "d - 7", "d"), ("요즘 소식", "d - 14", "d"), ("근래 소식", "d - 30", "d"),
    ("최근 일주일 소식", "d - 7", "d"), ("최근 한달 소식", "d - 30", "d"),
    ("최근 3개월 소식", "CAST(d - INTERVAL 3 MONTH AS DATE)", "d"), ("최근 6개월 소식", "CAST(d - INTERVAL 6 MONTH AS DATE)", "d"),
    *[(f"199{q + 3}년 {q} 분기 실적", *_months_sql(f"199{q + 3}", 3 * q - 2, 3 * q)) for q in range(1, 5)],
    *[(f"{q}분기 실적", *_months_sql("year(d)", 3 * q - 2, 3 * q)) for q in range(1, 5)],
    ("이번 상반기", *_months_sql("year(d)", 1, 6)), ("지난해 하반기", *_months_sql("year(d) - 1", 7, 12)),
    ("작년 4분기", *_months_sql("year(d) - 1", 10, 12)), ("재작년 상반기", *_months_sql("year(d) - 2", 1, 6)),
    ("1995 하반기", *_months_sql("1995", 7, 12)),
    *[(t, "DATE '1997-03-04'", "DATE '1997-03-06'") for t in ("1997년 3월 5일 공시", "1997-03-05", "1997.3.5 공시", "1997/03/05")],
    *[(t, *_months_sql("1996", 7, 7)) for t in ("1996년 7월", "1996-07", "1996.07", "96년 7월 소식")],
    ("1996년 소식", "CASE WHEN year(d) = 1996 THEN d - 120 ELSE DATE '1996-01-01' END",
     "CASE WHEN year(d) = 1996 THEN d ELSE least(DATE '1996-12-31', d) END"),
    ("코로나 시기", "DATE '2020-01-01'", "DATE '2023-05-11'"), ("러우전쟁", "DATE '2022-02-24'", "d"),
    ("금융위기", "DATE '2008-09-01'", "DATE '2009-06-30'"), ("소식", "d - 30", "d"), ("", "d - 30", "d"),
]


def _rung_sql(which: int) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {r[which]}" for i, r in enumerate(RUNGS)) + " END"


@query("date_context_rungs", f"""
WITH t AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % {len(RUNGS)} AS k, CAST(o_custkey % 9 AS INTEGER) + 1 AS n
  FROM orders)
SELECT o_orderkey, CAST({_rung_sql(1)} AS DATE) AS range_start, CAST({_rung_sql(2)} AS DATE) AS range_end FROM t""")
def date_context_rungs(spark, sf):
    """Every kind of date phrase, dealt over the orders."""
    text = F.element_at(tx.text_array([r[0] for r in RUNGS]), (F.col("o_orderkey") % len(RUNGS) + 1).cast("int"))
    text = F.replace(text, F.lit("{n}"), (F.col("o_custkey") % 9 + 1).cast("string"))
    c = dates.date_context(text, F.to_date("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", c["start"].alias("range_start"), c["end"].alias("range_end"))


@query("range_split_at_cutoff", """
WITH e AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS d, CAST(event_id % 7 AS INTEGER) AS k,
         CAST(ts AS DATE) - CASE WHEN hour(ts) >= 23 THEN 0 ELSE 1 END AS db_last FROM events),
r AS (SELECT *, d - k AS s, d + (k - 3) AS t FROM e)
SELECT event_id, CASE WHEN s <= db_last AND t >= s THEN s END AS db_start,
       CASE WHEN s <= db_last AND t >= s THEN least(db_last, t) END AS db_end,
       CASE WHEN db_last + 1 <= t THEN greatest(db_last + 1, s) END AS live_start,
       CASE WHEN db_last + 1 <= t THEN t END AS live_end FROM r""")
def range_split_at_cutoff(spark, sf):
    d, k = F.to_date("ts"), (F.col("event_id") % 7).cast("int")
    parts = dates.split_at_cutoff(F.date_sub(d, k), F.date_add(d, k - 3),
                                  F.col("ts").cast("timestamp"))
    names = ("db_start", "db_end", "live_start", "live_end")
    return table(spark, sf, "events").select(
        "event_id", *[p.alias(c) for p, c in zip(parts, names, strict=True)])


@query("stored_lists", """
SELECT p_partkey, string_split(p_name, ' ')[1] || '|' || string_split(p_name, ' ')[2] AS list,
       2 AS n, CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE p_retailprice END AS price FROM part""")
def stored_lists(spark, sf):
    w = F.split("p_name", " ")
    raw = (F.when(F.col("p_partkey") % 3 == 0, F.concat(
        F.lit("['"), w[0], F.lit("', \""), w[1], F.lit("\"]")))
        .when(F.col("p_partkey") % 3 == 1, F.concat_ws(", ", w[0], w[1]))
        .otherwise(F.concat(F.lit("["), w[0], F.lit(","), w[1], F.lit("]"))))
    price = F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string"))
    parsed = tx.parse_list(raw)
    return table(spark, sf, "part").select(
        "p_partkey", F.concat_ws("|", parsed).alias("list"), F.size(parsed).alias("n"),
        tx.parse_float(price, 0.5).alias("price"))


@query("stored_vectors", """
SELECT vec_id, len(embedding) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total
FROM embeddings""")
def stored_vectors(spark, sf):
    raw = F.concat(F.lit("["), F.concat_ws(", ", F.col("embedding").cast("array<string>")), F.lit("]"))
    v = tx.parse_vector(raw)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return r6(table(spark, sf, "embeddings").select(
        "vec_id", F.size(v).cast("long").alias("n"), total.alias("total")), "total", digits=5)


@query("text_keys", """
SELECT md5(text || lang) AS text_key, count(*) AS n, min(doc_id) AS first_doc
FROM documents GROUP BY 1""")
def text_keys(spark, sf):
    return (documents(spark, sf)
            .groupBy(tx.text_key(F.col("text"), F.col("lang")).alias("text_key"))
            .agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")))


@query("doc_id")
def doc_id(spark, sf):
    url = F.col("url")
    k, canon = tx.article_keys(url), tx.canonical_url(url)
    return table(spark, sf, "pages").select(
        "page_id", ids.document_id(k["oid"], k["aid"], canon, url, F.lit(""), F.lit("")).alias("id"))


@query("simhash64")
def simhash64(spark, sf):
    return documents(spark, sf).select(
        "doc_id", ids.simhash64(F.col("text")).alias("simhash"))


def articles(spark, sf):
    """Articles from documents: the first sentence is the title, the whole text the body."""
    number = F.substring("source", 4, 10).cast("int")
    day = F.date_sub(F.lit("2024-06-30").cast("date"), (F.col("doc_id") % 1000).cast("int"))
    return documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("article_id"),
        F.regexp_extract("text", r"^[^\n.]*", 0).alias("title"),
        F.date_format(day, "yyyy.MM.dd").alias("published_at"),
        _publisher().alias("publisher"), F.col("lang").alias("category"),
        F.concat(F.lit("https://News.example.com/a%20b?b=1&aid="), F.col("doc_id"),
                 F.lit("&office_id="), number).alias("url"),
        F.concat(F.lit("(주)Source "), number, F.lit(", Source "), number, F.lit("/Press"))
        .alias("stock_name"),
        F.col("text").alias("body"))


SYNONYMS = [("tion", "movement"), ("eaux", "water"), ("nicht", "denial"), ("the th", "article"),
            ("ciónll", "movement"), ("ung", "process")]


@query("document_build", f"""
WITH d AS (
  SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS k,
    trim(regexp_replace(regexp_replace(regexp_extract(text, '^[^\\n.]*'),
      '[\\[\\]()<>…·,.!?:;"''`]+', ' ', 'g'), '\\s+', ' ', 'g')) AS title, text, source FROM documents)
SELECT title, 'https://news.example.com/a b?aid=' || doc_id || '&oid=' || k AS canonical_url,
  CAST(k AS VARCHAR) AS oid, CAST(doc_id AS VARCHAR) AS aid,
  strftime(DATE '2024-06-30' - CAST(doc_id % 1000 AS INTEGER) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S')
    AS published_at,
  CAST({TIER_SQL} AS DOUBLE) AS publisher_tier, 'Source ' || k || '|Press' AS companies,
  length(text) AS body_length,
  concat_ws('|', CASE WHEN contains(lower(title), 'tion') OR contains(lower(title), 'ciónll')
                      THEN 'movement' END,
    CASE WHEN contains(lower(title), 'eaux') THEN 'water' END,
    CASE WHEN contains(lower(title), 'nicht') THEN 'denial' END,
    CASE WHEN contains(lower(title), 'the th') THEN 'article' END,
    CASE WHEN contains(lower(title), 'ung') THEN 'process' END) AS event_codes
FROM d""")
def document_build(spark, sf):
    docs = dc.build(articles(spark, sf), SYNONYMS)
    return docs.select(
        "title", "canonical_url", "oid", "aid",
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
        "publisher_tier", F.concat_ws("|", "companies").alias("companies"),
        F.length("body").cast("long").alias("body_length"),
        F.concat_ws("|", "event_codes").alias("event_codes"))


# --- labels -----------------------------------------------------------------------------------

# a registry for the invented words of the test texts, in the shape of the label files
REGISTRY_FILE = {
    "labels": {
        "company.motion": {"fine": True, "priority": 110, "triggers": ["tion.{0,6}the", "ciónll"]},
        "company.water": {"fine": False, "priority": 120, "triggers": ["eau(x|s)"]},
        "company.night": {"fine": False, "priority": 130, "triggers": ["nicht", "nacht"]},
        "sector.lesson": {"fine": True, "priority": 130, "triggers": [r"the\s+(re|in)\S*"]},
        "sector.token": {"fine": False, "priority": 90, "triggers": [r"(token|license|copyright)"]},
        "flow.number": {"fine": False, "priority": 200, "triggers": [r"[0-9]{3,}"]},
        "other": {"fine": False, "priority": 1000000, "triggers": []},
    },
    "profiles": {"early_numbers": {"flow.number": 10, "company.water": 125}},
}


def _registry(profile="early_numbers"):
    return lb.build_registry(REGISTRY_FILE["labels"], REGISTRY_FILE["profiles"].get(profile))


LABEL_HITS_SQL = "hits AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{la.name}' AS label, {la.priority} AS priority, {0 if la.fine else 1} AS coarse "
    f"FROM documents WHERE regexp_matches(text, '{'|'.join(f'(?:{t})' for t in la.triggers)}', 'i')"
    for la in lb.build_registry(REGISTRY_FILE["labels"], REGISTRY_FILE["profiles"]["early_numbers"])
    if la.triggers) + ")"


@query("label_rules", f"""
WITH {LABEL_HITS_SQL}
SELECT doc_id, label,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY priority, coarse, label) - 1 AS INTEGER)
         AS rank FROM hits""")
def label_rules(spark, sf):
    return lb.label_rows(documents(spark, sf).select("doc_id", "text"), "text",
                         _registry()).select("doc_id", "label", "rank")


@query("label_top2", f"""
WITH {LABEL_HITS_SQL}, ranked AS (
  SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY priority, coarse, label) AS r
  FROM hits),
two AS (SELECT doc_id, string_agg(label, '|' ORDER BY r) AS labels FROM ranked WHERE r <= 2 GROUP BY 1)
SELECT doc_id, CASE WHEN length({_strip_sql('text')}) < 5 THEN 'other' ELSE coalesce(labels, 'other') END
         AS labels,
       CASE WHEN labels IS NULL OR length({_strip_sql('text')}) < 5 THEN 0.0 ELSE 0.75 END::DOUBLE AS confidence
FROM documents LEFT JOIN two USING (doc_id)""")
def label_top2(spark, sf):
    c = lb.classify(F.col("text"), _registry())
    return documents(spark, sf).select("doc_id", c.alias("c")).select(
        "doc_id", F.concat_ws("|", "c.labels").alias("labels"),
        F.col("c.confidence").alias("confidence"))


@query("label_counts", f"WITH {LABEL_HITS_SQL} SELECT label, count(*) AS count FROM hits GROUP BY 1")
def label_counts(spark, sf):
    rows = documents(spark, sf).select(
        F.explode(lb.matched_labels(F.col("text"), _registry())).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("count"))


# one invented phrase for every label of the registry that ships with the package, in its order
LABEL_PHRASES = """거래 재개|서킷 브레이커 발동|MSCI 편입 후 FTSE 정기 변경|옵션 동시 만기|인수 의향서 접수|최종 계약
공정위 심사 통과|거래 무산|최대 주주 변경|질권 설정|락업 해제|스톡 옵션 부여|스톡 옵션 행사|자사주 소각|만기 연장
재무 약정 유예|전망 상향|조기 상환|대형 공장 증설|정기 보수|램프 업|정전|플랫폼 론칭|과징금 부과|집단 소송|패소
압수수색|내부 고발|노조 교섭|상장 폐지 우려|경영권 인수|대규모 계약|액면 분할|영업익 흑자|가이던스 상향|HBM 양산
테이프 아웃|퀄 통과|캐파 장기 공급|수율 개선|임상 3상 결과|FDA 허가|IND 승인|BLA 제출|PDUFA 데드라인|희귀 의약품 지정
환자 모집 마감|주 평가 지표 달성|임상 보류 해제|편의점 재고|구독 이탈 율|국제 유가|컨테이너 운임|순 이자 이익
전기차 보조금|실적 발표 일정|중간 배당 기준일|선물옵션 만기일|지수 리밸런싱 시행|보호 예수 만료 예정|투자자 설명회
정기 주총|공매도 금지|공매도 과열 지정|단일가 매매|투자 경고 지정|조회 공시 요구|불성실 공시 법인|상폐 통지
변동성 완화 장치 발동|목표가 상향|투자의견 유지|리포트 발간|IR 행사|유상 증자|무상 증자|감자 결정|유무상 증자
영구채 발행|전환 사채 발행|신주 인수권부 사채 발행|교환 사채 발행|흡수 합병|주식 교환|분할 합병|해외 상장|사업 양수
영업 양도|토지 매입|건물 매각|지분 취득|주식 매도|채권 매입|파생 처분|부동산 거래|풋백 옵션|자사주 취득|자사주 처분
자사주 신탁 계약|자사주 신탁 해지|디폴트|영업 중단|회생 절차 개시|법인 해산|예고 공시|특별 배당 증액 배당 변경
우선주 전환|대표이사 선임|지분 변동 보고|판매 가격 인상|부품 부족 지연|회계 의견 거절|금감원 조사|인권|정정 공시
신용 등급 하향|자발적 리콜|개인 정보 유출""".replace("\n", "|").split("|")
SHIPPED = [la for la in lb.starter_registry() if la.triggers]


def _bounded(trigger: str) -> str:
    """Word ends spelt out: DuckDB's know Latin letters only. The titles below are padded for it."""
    return trigger.replace(r"\b", "(?:^|$|[^0-9A-Za-z_가-힣])")


TITLES_SQL = f"""
phrases AS (SELECT [{', '.join(f"'{p}'" for p in LABEL_PHRASES)}] AS p),
titles AS (
  SELECT doc_id, '  ' || p[doc_id % {len(LABEL_PHRASES)} + 1] || '  ' || source || '  '
    || p[(doc_id * 31 + 7) % {len(LABEL_PHRASES)} + 1] || '  ' AS title FROM documents, phrases)"""


@query("shipped_labels", f"""
WITH {TITLES_SQL}, hits AS ({' UNION ALL '.join(
    f"SELECT doc_id, '{la.name}' AS label, {la.priority} AS priority, {0 if la.fine else 1} AS coarse "
    f"FROM titles WHERE regexp_matches(title, '{'|'.join(f'(?:{_bounded(t)})' for t in la.triggers)}', 'i')"
    for la in SHIPPED)})
SELECT doc_id, label,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY priority, coarse, label) - 1 AS INTEGER)
         AS rank FROM hits""")
def shipped_labels(spark, sf):
    """Every label that ships with the package over titles made of two phrases."""
    n = len(LABEL_PHRASES)
    phrase = lambda i: F.get(tx.text_array(LABEL_PHRASES), (i % n).cast("int"))
    titles = table(spark, sf, "documents").select("doc_id", F.concat_ws(
        "  ", phrase(F.col("doc_id")), "source", phrase(F.col("doc_id") * 31 + 7)).alias("title"))
    return lb.label_rows(titles, "title", lb.starter_registry()).select("doc_id", "label", "rank")


def _conf_sql(aliases):
    return " ".join(f"WHEN contains(lower(text), '{a}') THEN {min(0.9, 0.5 + len(a) * 0.05):.2f}"
                    for a in aliases)


SYNONYM_CODES = list(dict.fromkeys(c for _, c in SYNONYMS))


@query("synonym_events", " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS code, CAST(CASE {_conf_sql([a for a, k in SYNONYMS if k == c])} END AS DOUBLE)"
    f" AS confidence FROM documents WHERE {_any_sql('lower(text)', [a for a, k in SYNONYMS if k == c])}"
    for c in SYNONYM_CODES))
def synonym_events(spark, sf):
    return r6(documents(spark, sf).select(
        "doc_id", F.explode(lb.synonym_events(F.col("text"), SYNONYMS)).alias("e")
    ).select("doc_id", "e.code", "e.confidence"), "confidence")


LEXICON = {"earnings": {"metrics": ["tion", "eaux"], "periods": ["nicht", "Token"]},
           "mna": {"actions": ["the", "mente", "LOI"]},
           "signal": {"rumor": ["on the", "est"], "denial": ["license", "nicht"],
                      "undecided": ["und", "que la"]}}


@query("keyword_hits", " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS category, '{g}' AS subcategory, '{k}' AS keyword FROM documents "
    f"WHERE contains(lower(text), '{k.lower()}')"
    for c, groups in LEXICON.items() for g, ks in groups.items() for k in ks))
def keyword_hits(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.explode(lb.lexicon_hits(F.col("text"), LEXICON)).alias("h")
    ).select("doc_id", "h.category", "h.subcategory", "h.keyword")


@query("classification_merge", """
SELECT doc_id,
  CASE WHEN quality = 1 THEN 'company.water' ELSE 'other' END AS labels,
  CASE WHEN toxic = 1 THEN '사건' ELSE '' END AS phrases,
  CASE WHEN quality = 1 AND toxic = 1 THEN greatest(0.5 + doc_id % 5 / 10.0, 0.7)
       WHEN quality = 1 THEN 0.5 + doc_id % 5 / 10.0 WHEN toxic = 1 THEN 0.7 ELSE 0.0 END AS confidence,
  CASE WHEN quality = 1 AND toxic = 1 THEN 'both' WHEN quality = 1 THEN 'labels'
       WHEN toxic = 1 THEN 'phrases' ELSE 'none' END AS source
FROM labels""")
def classification_merge(spark, sf):
    labels = F.array(F.when(F.col("quality") == 1, "company.water").otherwise("other"))
    phrases = lb.clean_phrases(F.when(F.col("toxic") == 1, tx.text_array([" 사건", "사건", "event"]))
                               .otherwise(F.array().cast("array<string>")))
    m = lb.merge_labellers(labels, F.lit(0.5) + F.col("doc_id") % 5 / 10.0, phrases, F.lit(0.7))
    return r6(table(spark, sf, "labels").select("doc_id", m.alias("m")).select(
        "doc_id", F.concat_ws("|", "m.labels").alias("labels"),
        F.concat_ws("|", "m.phrases").alias("phrases"), "m.confidence", "m.source"), "confidence")


@query("label_replies", """
SELECT doc_id,
  CASE doc_id % 4 WHEN 0 THEN 'company.water|company.night' WHEN 1 THEN 'company.water'
    WHEN 2 THEN 'sector.lesson' ELSE 'other' END AS labels,
  CASE doc_id % 4 WHEN 0 THEN 0.85 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence
FROM labels""")
def label_replies(spark, sf):
    k = F.col("doc_id") % 4
    reply = (F.when(k == 0, "라벨: Company . Water, company.night, company.motion\n정확도: 85\n근거: 제목")
             .when(k == 1, '{"labels": ["company.water"], "confidence": 0.9, "reason": "x"}')
             .when(k == 2, "label: lesson\nreason: short").otherwise("label: none\nconfidence: 0.4"))
    names = [la.name for la in _registry()]
    p = lb.parse_reply(reply, names)
    return r6(table(spark, sf, "labels").select("doc_id", p.alias("p")).select(
        "doc_id", F.concat_ws("|", "p.labels").alias("labels"), "p.confidence"), "confidence")


@query("analyst_gate", f"""
WITH t AS (
  SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'UBS note: ' || text WHEN 1 THEN text || ' UBS hold'
    ELSE 'KB증권 ' || text || ' 목표가' END AS text FROM conversations)
SELECT conv_id, turn,
  ({' OR '.join(f"contains(text, '{b}')" for b in words.BROKERS)})
  AND {_any_sql('lower(text)', words.REPORT_WORDS)} AS analyst,
  length({_strip_sql('text')}) BETWEEN 10 AND 2000 AS fits
FROM t""")
def analyst_gate(spark, sf):
    k = F.col("turn") % 3
    text = (F.when(k == 0, F.concat(F.lit("UBS note: "), "text"))
            .when(k == 1, F.concat("text", F.lit(" UBS hold")))
            .otherwise(F.concat(F.lit("KB증권 "), "text", F.lit(" 목표가"))))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.alias("t")).select(
        "conv_id", "turn", co.is_analyst_report(F.col("t")).alias("analyst"),
        tx.long_enough(F.col("t"), 10, 2000).alias("fits"))


# --- company names ----------------------------------------------------------------------------

def _master(spark, sf):
    """Company names from the long words of the benchmark texts."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0)))
    return (table(spark, sf, "benchmark").select("item_id", word.alias("name"))
            .groupBy("name").agg(F.min("item_id").alias("item"))
            .select("name", F.lpad(F.col("item").cast("string"), 6, "0").alias("code"),
                    F.when(F.col("item") % 2 == 0, "IT").alias("sector"),
                    F.lit("KRX").alias("market"),
                    F.when(F.col("item") % 3 == 0, "private").otherwise("listed").alias("type"),
                    (F.col("item") % 5 != 0).alias("verified")))


MASTER_SQL = """
bw AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS name FROM benchmark),
master AS (SELECT name, min(item_id) AS item FROM bw GROUP BY name)"""

MENTIONS_SQL = MASTER_SQL + """,
mentions AS (
  SELECT doc_id, name AS alias,
    (length(lower(text)) - length(replace(lower(text), name, ''))) // length(name) AS hits
  FROM documents, master WHERE contains(lower(text), name))"""


@query("company_mentions", f"WITH {MENTIONS_SQL} SELECT doc_id, alias, hits FROM mentions")
def company_mentions(spark, sf):
    aliases = _master(spark, sf).select(F.col("name").alias("alias"))
    return co.count_mentions(documents(spark, sf), aliases)


@query("company_mentions_join", f"WITH {MENTIONS_SQL} SELECT doc_id, alias, hits FROM mentions")
def company_mentions_join(spark, sf):
    """The same counts by joins alone, the path of a dictionary too large to ship to tasks."""
    aliases = _master(spark, sf).select(F.col("name").alias("alias"))
    return co.dictionary_hits(documents(spark, sf), aliases)


@query("company_votes", f"""
WITH {MENTIONS_SQL}, provider AS (
  SELECT m.doc_id, m.alias FROM mentions m JOIN labels l ON l.doc_id = m.doc_id WHERE l.quality = 1),
v AS (
  SELECT m.doc_id, m.alias AS company, m.hits * 0.45 + CASE WHEN p.alias IS NULL THEN 0 ELSE 0.55 END
           AS score, CASE WHEN p.alias IS NULL THEN 1 ELSE 2 END AS methods
  FROM mentions m LEFT JOIN provider p ON p.doc_id = m.doc_id AND p.alias = m.alias)
SELECT doc_id, company, CAST(round(score, 6) AS DOUBLE) AS score, methods,
       CASE WHEN score >= 0.55 THEN 'high' WHEN score >= 0.55 * 0.7 THEN 'medium'
            WHEN score >= 0.3 THEN 'low' END AS tier FROM v""")
def company_votes(spark, sf):
    hits = co.count_mentions(documents(spark, sf),
                             _master(spark, sf).select(F.col("name").alias("alias")))
    pattern = hits.select("doc_id", F.col("alias").alias("company"),
                          F.lit("pattern_matching").alias("method"),
                          F.explode(F.sequence(F.lit(1), F.col("hits"))).alias("_i")).drop("_i")
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    provider = hits.join(good, "doc_id").select("doc_id", F.col("alias").alias("company"),
                                                F.lit("provider").alias("method"))
    votes = co.collect_votes(pattern.unionByName(provider))
    return r6(votes.select("doc_id", "company", "score", F.col("methods").cast("int").alias("methods"),
                           co.tier(F.col("score"), F.col("methods")).alias("tier")), "score")


@query("company_pattern_weights", f"""
WITH {MASTER_SQL}
SELECT name AS company, round(0.75::DOUBLE + CASE WHEN item % 5 <> 0 THEN 0.1 ELSE 0 END
  + CASE WHEN item % 3 = 0 THEN 0 ELSE 0.1 END + CASE WHEN item % 2 = 0 THEN 0.05 ELSE 0 END, 6)
  AS weight FROM master""")
def company_pattern_weights(spark, sf):
    master = _master(spark, sf)
    out = co.pattern_weights(co.alias_table(master), master)
    return r6(out.select("company", "weight"), "weight")


@query("company_extract")
def company_extract(spark, sf):
    """Whole extraction: dictionary spans, votes, validation, relevance. Checked in the tests."""
    master = _master(spark, sf)
    patterns = co.pattern_weights(co.alias_table(master), master)
    return r6(co.extract(documents(spark, sf), patterns, master),
              "confidence", "relevance")


@query("company_enrich", f"""
WITH {MENTIONS_SQL},
ranked AS (
  SELECT doc_id, alias AS company, item, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, alias) AS rank
  FROM mentions JOIN master ON alias = name),
coded AS (
  SELECT *, CASE WHEN item % 4 > 0 THEN lpad(CAST(item AS VARCHAR), 6, '0')
                 WHEN item % 8 = 0 THEN 'L' || company END AS code FROM ranked)
SELECT doc_id, string_agg(company, ',' ORDER BY rank) AS names,
       coalesce(string_agg(code, ',' ORDER BY rank), '') AS tickers, count(*) AS n FROM coded GROUP BY 1""")
def company_enrich(spark, sf):
    """Names and codes of each document's companies: the master's code, else that of the listing."""
    master = _master(spark, sf)
    item = F.col("code").cast("int")
    listing = master.filter(item % 8 == 0).select(
        F.col("name").alias("corp_name"), F.concat(F.lit("L"), "name").alias("stock_code"), F.lit("c").alias("corp_code"))
    hits = co.count_mentions(documents(spark, sf), master.select(F.col("name").alias("alias")))
    w = Window.partitionBy("doc_id").orderBy(F.desc("hits"), "alias")
    ranked = hits.select("doc_id", F.col("alias").alias("company"), F.row_number().over(w).alias("rank"))
    full = co.enrich(ranked, master.withColumn("code", F.when(item % 4 > 0, F.col("code"))), listing)
    counts = full.groupBy("doc_id").agg(F.count("*").alias("n"))
    return co.names_and_tickers(full).join(counts, "doc_id")


@query("extraction_store", """
WITH d AS (SELECT DISTINCT text FROM documents),
first AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 > 0)
SELECT (SELECT count(*) FROM first) AS first_run,
       (SELECT count(*) FROM d WHERE text NOT IN (SELECT text FROM first)) AS second_run,
       CAST(0 AS BIGINT) AS third_run, (SELECT count(*) FROM d) AS stored, true AS same""")
def extraction_store(spark, sf):
    """Texts that three runs over growing tables had to extract, and whether the rows are those of an
    extraction without the store."""
    path = run_dir(spark, "extracted")
    master = _master(spark, sf)
    patterns = kept(co.pattern_weights(co.alias_table(master), master))
    docs = documents(spark, sf).select("doc_id", "text")
    version = xs.dictionary_version(patterns, master)
    keyed = lambda d: d.withColumn("key", xs.row_key(F.col("text")))
    runs, rows = [], None
    for part in (docs.filter("doc_id % 3 > 0"), docs, docs):
        runs.append(xs.missing(keyed(part), path, version).count())
        rows = xs.extract(part, patterns, master, path)
    cols = ["doc_id", "company", "status", F.round("confidence", 9).alias("c"), F.round("relevance", 9).alias("r"), "rank"]
    h = F.sum(F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols]).cast("decimal(38,0)"))
    digest = lambda df: df.agg(F.struct(h, F.count("*")).alias("d")).scalar()
    same = digest(rows) == digest(co.extract(docs, patterns, master))
    return xs.stored(spark, path, version).agg(F.count("*").alias("stored")).select(
        *[F.lit(n).cast("long").alias(c) for n, c in zip(runs, ("first_run", "second_run", "third_run"), strict=True)],
        "stored", same.alias("same"))


@query("suffix_aliases", """
WITH n AS (
  SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'S' || s_suppkey || '전자'
    WHEN 1 THEN 'S' || s_suppkey || '자동차' WHEN 2 THEN 'S' || s_suppkey || '홀딩스'
    ELSE s_name END AS name FROM supplier)
SELECT s_suppkey, name, CASE s_suppkey % 4 WHEN 1 THEN 'S' || s_suppkey || '|S' || s_suppkey || '차'
  WHEN 3 THEN '' ELSE 'S' || s_suppkey END AS aliases FROM n""")
def suffix_aliases(spark, sf):
    k = F.col("s_suppkey") % 4
    stem = F.concat(F.lit("S"), F.col("s_suppkey"))
    name = (F.when(k == 0, F.concat(stem, F.lit("전자"))).when(k == 1, F.concat(stem, F.lit("자동차")))
            .when(k == 2, F.concat(stem, F.lit("홀딩스"))).otherwise(F.col("s_name")))
    return table(spark, sf, "supplier").select("s_suppkey", name.alias("name")).select(
        "s_suppkey", "name", F.concat_ws("|", co.suffix_aliases(F.col("name"))).alias("aliases"))


SIMILAR_SQL = """
names AS (SELECT DISTINCT p_name || 's' AS name FROM part),
officials AS (SELECT DISTINCT p_name AS official FROM part),
letters AS (
  SELECT name, official, list_distinct(string_split(name, '')) AS a,
         list_distinct(string_split(official, '')) AS b FROM names, officials),
sims AS (
  SELECT name, official, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) * 0.7
    + (1.0 - abs(length(name) - length(official)) / greatest(length(name), length(official))) * 0.3
    AS similarity FROM letters)"""


@query("name_similarity", f"""
WITH {SIMILAR_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(similarity, 9) DESC, official) AS rank
  FROM sims WHERE similarity >= 0.8)
SELECT name, official, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE rank <= 3""")
def name_similarity(spark, sf):
    part = table(spark, sf, "part").select("p_name").distinct()
    out = co.similar_names(part.select(F.concat("p_name", F.lit("s")).alias("name")),
                           part.select(F.col("p_name").alias("name")), 0.8)
    return r6(out.withColumn("rank", F.col("rank").cast("int")), "similarity")


WORD_PAIRS_SQL = """
w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM documents),
names AS (SELECT name, list_sort(list_distinct(string_split(name, ''))) AS a FROM w WHERE length(name) >= 10),
officials AS (
  SELECT DISTINCT 'c' || name AS official FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM benchmark) WHERE length(name) >= 7),
letters AS (
  SELECT name, official, a, list_sort(list_distinct(string_split(official, ''))) AS b
  FROM names JOIN officials ON least(length(name), length(official)) * 3 >= greatest(length(name), length(official)) * 2),
sims AS (
  SELECT name, official, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) * 0.7
    + (1.0 - abs(length(name) - length(official)) / greatest(length(name), length(official))) * 0.3
    AS similarity FROM letters)"""


@query("similar_words", f"""
WITH {WORD_PAIRS_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(similarity, 9) DESC, official) AS rank
  FROM sims WHERE similarity >= 0.9)
SELECT name, official, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE rank <= 3""")
def similar_words(spark, sf):
    """Many distinct names: long words of all texts against long words of the benchmark."""
    def words_of(name):
        return table(spark, sf, name).select(F.explode(F.regexp_extract_all(
            F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("name")).distinct()

    names = words_of("documents").filter(F.length("name") >= 10)
    master = words_of("benchmark").filter(F.length("name") >= 7).select(F.concat(F.lit("c"), "name").alias("name"))
    out = co.similar_names(names, master, 0.9)
    return r6(out.withColumn("rank", F.col("rank").cast("int")), "similarity")


@query("learned_alias_histogram", f"""
WITH {SIMILAR_SQL}, best AS (SELECT name, max(similarity) AS s FROM sims GROUP BY name)
SELECT floor(round(s, 9) * 10) / 10 AS band, count(*) AS count FROM best WHERE s >= 0.9 GROUP BY 1""")
def learned_alias_histogram(spark, sf):
    part = table(spark, sf, "part").select("p_name").distinct()
    master = part.select(F.col("p_name").alias("name"))
    known = master.select(F.col("name").alias("company"), F.col("name").alias("alias"))
    learned = co.learn_aliases(part.select(F.concat("p_name", F.lit("s")).alias("name")), known, master)
    return co.learning_histogram(learned)
