"""The study's tables as views over the general test tables, with the same views as SQL text.

Daily prices come from line items, analysed news and disclosures from orders, the name list
from suppliers, articles from documents and labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newswake.operators.prices import pad_code
from newswake.sources.readers import spread

AS_OF = "2001-06-30"
SCAN_START = "2000-07-01"
HISTORY_START = "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A text table, split finely enough for per-document work."""
    return spread(table(spark, sf_dir, name))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(pad_code(F.col("l_suppkey")).alias("stock_code"),
                 F.to_date("l_shipdate").alias("trade_date"))
        .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close_price"))
    )


def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("company"), pad_code(F.col("s_suppkey")).alias("stock_code"))


def stock_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        pad_code(F.col("s_suppkey")).alias("stock_code"),
        F.concat(F.lit("C"), F.col("s_suppkey")).alias("corp_code"),
        F.col("s_name").alias("corp_name"),
        F.when(F.col("s_nationkey") % 2 == 0, "KOSPI").otherwise("KOSDAQ").alias("market"))


def _event_code():
    family = (F.when(F.col("o_orderstatus") == "O", "company")
              .when(F.col("o_orderstatus") == "F", "sector").otherwise("flow"))
    return F.concat(family, F.lit("."), F.lower("o_orderstatus"), F.lit("_"),
                    F.substring("o_orderpriority", 1, 1))


def _codes(spark: SparkSession, sf_dir: str):
    """Number of listed codes, as a scalar subquery."""
    return table(spark, sf_dir, "supplier").agg((F.max("s_suppkey") + 1).alias("n")).scalar()


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _codes(spark, sf_dir)
    name = lambda k: F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0"))
    cust = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("n"), F.col("o_orderkey")).alias("news_id"),
        F.concat_ws(" ", F.lit("Order"), F.col("o_orderpriority"), F.col("o_orderstatus"))
        .alias("news_title"),
        F.concat_ws(", ", name(cust % n), name((cust * 7 + 3) % n), F.lit("Unlisted Holdings"))
        .alias("companies"),
        F.concat_ws(",", _event_code(), F.lit(" Other"), F.lit("")).alias("event_codes"),
        F.to_date("o_orderdate").alias("news_date"),
    )


def labelled_disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rcept_no, corp_code, event_date, event_code); every seventh priority-5 one is `other`."""
    n = _codes(spark, sf_dir)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("rcept_no"),
        F.concat(F.lit("C"), F.col("o_custkey") % (n + 2)).alias("corp_code"),
        F.to_date("o_orderdate").alias("event_date"),
        F.when(F.col("o_orderkey") % 7 == 0, "other").otherwise(_event_code()).alias("event_code"),
    )


SQL_PX = """
px AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS stock_code,
         CAST(l_shipdate AS DATE) AS trade_date,
         avg(l_extendedprice / l_quantity) AS close_price
  FROM lineitem GROUP BY 1, 2)"""

SQL_PXF = SQL_PX + """,
pxf AS (
  SELECT *, lead(close_price, 1) OVER w AS c1, lead(close_price, 3) OVER w AS c3,
         lead(close_price, 5) OVER w AS c5, lead(trade_date, 1) OVER w AS d1
  FROM px WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date))"""

SQL_EVENT = """(CASE o_orderstatus WHEN 'O' THEN 'company' WHEN 'F' THEN 'sector' ELSE 'flow' END
  || '.' || lower(o_orderstatus) || '_' || substr(o_orderpriority, 1, 1))"""

SQL_NEWS = f"""
codes AS (SELECT max(s_suppkey) + 1 AS n FROM supplier),
news AS (
  SELECT 'n' || o_orderkey AS news_id,
         'Order ' || o_orderpriority || ' ' || o_orderstatus AS news_title,
         'Supplier#' || lpad(CAST(o_custkey % n AS VARCHAR), 9, '0') || ', Supplier#'
           || lpad(CAST((o_custkey * 7 + 3) % n AS VARCHAR), 9, '0') || ', Unlisted Holdings'
           AS companies,
         {SQL_EVENT} || ', Other,' AS event_codes,
         CAST(o_orderdate AS DATE) AS news_date
  FROM orders, codes)"""

SQL_FACTS = SQL_NEWS + """,
named AS (
  SELECT news_id, news_title, news_date, event_codes,
         trim(unnest(string_split(companies, ','))) AS company FROM news),
exploded AS (
  SELECT news_id, news_title, news_date, company,
         trim(unnest(string_split(event_codes, ','))) AS event_code FROM named),
facts AS (
  SELECT e.news_id, e.news_title, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock_code,
         e.company AS stock_name, e.event_code, e.news_date
  FROM exploded e JOIN supplier s ON e.company = s.s_name
  WHERE e.event_code <> '' AND lower(e.event_code) <> 'other')"""

SQL_ANCHORED = SQL_PXF + "," + SQL_FACTS + """,
anchored AS (
  SELECT f.*, p.trade_date AS anchor_date, p.close_price AS anchor_price,
         ln(p.c1 / p.close_price) AS r1, ln(p.c3 / p.close_price) AS r3,
         ln(p.c5 / p.close_price) AS r5, p.d1
  FROM facts f ASOF JOIN pxf p ON f.stock_code = p.stock_code AND f.news_date <= p.trade_date)"""

# price rows of the padded history range only, as the history builder reads them
SQL_NEWS_RETURNS = f""",
hpx AS (
  SELECT *, lead(close_price, 1) OVER w AS h1, lead(close_price, 3) OVER w AS h3,
         lead(close_price, 5) OVER w AS h5
  FROM px WHERE trade_date BETWEEN DATE '{HISTORY_START}' - 5 AND DATE '{AS_OF}' + 5
  WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date)),
news_returns AS (
  SELECT DISTINCT f.news_id, f.stock_code, f.stock_name, f.event_code, f.news_date,
         p.close_price AS anchor_price,
         CAST(ln(p.h1 / p.close_price) AS DECIMAL(10,6)) AS return_1d,
         CAST(ln(p.h3 / p.close_price) AS DECIMAL(10,6)) AS return_3d,
         CAST(ln(p.h5 / p.close_price) AS DECIMAL(10,6)) AS return_5d
  FROM facts f ASOF JOIN hpx p ON f.stock_code = p.stock_code AND f.news_date <= p.trade_date
  WHERE f.news_date BETWEEN DATE '{HISTORY_START}' AND DATE '{AS_OF}')"""

SQL_DISCLOSURES = f"""
dcodes AS (SELECT max(s_suppkey) + 1 AS n FROM supplier),
disclosures AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS rcept_no, 'C' || (o_custkey % (n + 2)) AS corp_code,
         CAST(o_orderdate AS DATE) AS event_date,
         CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE {SQL_EVENT} END AS event_code
  FROM orders, dcodes),
stock_list AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock_code, 'C' || s_suppkey AS corp_code,
         s_name AS corp_name,
         CASE WHEN s_nationkey % 2 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END AS market FROM supplier)"""

SQL_HISTORY = SQL_DISCLOSURES + """,
coded AS (SELECT d.*, l.stock_code FROM disclosures d LEFT JOIN stock_list l USING (corp_code)),
outcomes AS (
  SELECT c.*, p.trade_date AS anchor_date, p.close_price AS anchor_price,
         ln(p.c1 / p.close_price) AS r1, ln(p.c3 / p.close_price) AS r3,
         ln(p.c5 / p.close_price) AS r5,
         CASE WHEN c.event_code = 'other' THEN 'no_label'
              WHEN c.stock_code IS NULL THEN 'no_stock_code'
              WHEN p.trade_date IS NULL THEN 'no_anchor'
              WHEN p.c1 IS NULL AND p.c3 IS NULL AND p.c5 IS NULL THEN 'no_return'
              ELSE 'saved' END AS status
  FROM coded c ASOF LEFT JOIN pxf p
    ON c.stock_code = p.stock_code AND c.event_date <= p.trade_date),
history AS (
  SELECT DISTINCT stock_code, event_date, event_code, anchor_date, anchor_price,
         CAST(r1 AS DECIMAL(10,6)) AS return_1d, CAST(r3 AS DECIMAL(10,6)) AS return_3d,
         CAST(r5 AS DECIMAL(10,6)) AS return_5d
  FROM outcomes WHERE status = 'saved')"""
