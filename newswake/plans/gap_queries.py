"""Registered queries: prices, returns, expectations, gap scans, reports, histories, upserts."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from newswake.functions.dates import as_date
from newswake.operators import expectation as ex, gap_reports as rep, gaps as gp, prices as pr
from newswake.operators import event_store as st, market as mk, upsert as up
from newswake.operators.gaps import GapRules
from newswake.operators.news import explode_news, news_facts
from newswake.plans import study, views as v
from newswake.plans.catalog import query, r6, run_dir
from newswake.sources.writers import kept, month_of
from newswake.plans.views import (
    AS_OF, HISTORY_START, SCAN_START, SQL_ANCHORED, SQL_DISCLOSURES, SQL_FACTS, SQL_HISTORY,
    SQL_NEWS, SQL_NEWS_RETURNS, SQL_PX, SQL_PXF,
)

# the look-back of a scan at AS_OF begins here, and its statistics need no earlier rows
LOOKBACK_START = (date.fromisoformat(AS_OF) - timedelta(days=GapRules().lookback_days)).isoformat()


def _as_of():
    return as_date(AS_OF)


def _news_returns(spark, sf, start=HISTORY_START):
    return study.build_news_returns(v.news(spark, sf), v.alias_map(spark, sf),
                                    v.prices(spark, sf), start, AS_OF)


def _outcomes(spark, sf, start=HISTORY_START):
    events = v.labelled_disclosures(spark, sf).filter(F.col("event_date") >= as_date(start))
    return study.label_outcomes(events, v.stock_list(spark, sf), v.prices(spark, sf), start)


def _history(spark, sf, start=HISTORY_START):
    return study.build_event_history(_outcomes(spark, sf, start))


def _inputs(spark, sf):
    return v.news(spark, sf), v.alias_map(spark, sf), v.prices(spark, sf)


def _gap_table(spark, sf):
    """The `news_gaps` table: one row per (news, stock, event, horizon)."""
    signals = study.scan_with_fallback(
        *_inputs(spark, sf), _history(spark, sf, LOOKBACK_START),
        _news_returns(spark, sf, LOOKBACK_START), SCAN_START, AS_OF, AS_OF)
    keys = ["news_id", "stock_code", "event_code", "horizon"]
    return up.first_per_key(signals, keys, F.struct(*[c for c in signals.columns if c not in keys]))


# --- SQL counterparts ------------------------------------------------------------------------

GRADE4 = """CASE WHEN abs(z) >= 3 THEN 'EXTREME' WHEN abs(z) >= 2 THEN 'HIGH'
  WHEN abs(z) >= 1 THEN 'MODERATE' ELSE 'LOW' END"""
GRADE3 = """CASE WHEN abs(z) >= 3 THEN 'EXTREME' WHEN abs(z) >= 2 THEN 'HIGH'
  ELSE 'MODERATE' END"""
DIRECTION = "CASE WHEN z > 0 THEN 'OVER' ELSE 'UNDER' END"

SQL_SIMPLE_STATS = f""",
sstats AS (
  SELECT event_code, avg(CAST(return_1d AS DOUBLE)) AS mean,
         stddev_pop(CAST(return_1d AS DOUBLE)) AS std, count(return_1d) AS cnt
  FROM news_returns
  WHERE return_1d IS NOT NULL AND news_date BETWEEN DATE '{AS_OF}' - 365 AND DATE '{AS_OF}'
  GROUP BY event_code)"""

SQL_LONG_HISTORY = """,
long_history AS (
  SELECT event_code, event_date, 1 AS horizon, CAST(return_1d AS DOUBLE) AS ret FROM history
  UNION ALL SELECT event_code, event_date, 3, CAST(return_3d AS DOUBLE) FROM history
  UNION ALL SELECT event_code, event_date, 5, CAST(return_5d AS DOUBLE) FROM history)"""

SQL_HISTORY_STATS = SQL_LONG_HISTORY + f""",
hstats AS (
  SELECT event_code, horizon, avg(ret) AS mean, quantile_cont(ret, 0.5) AS median,
         stddev_samp(ret) AS std, quantile_cont(ret, 0.25) AS q25,
         quantile_cont(ret, 0.75) AS q75, count(*) AS n, least(1.0, count(*) / 100.0) AS confidence
  FROM long_history
  WHERE ret IS NOT NULL AND event_date BETWEEN DATE '{AS_OF}' - 365 AND DATE '{AS_OF}'
  GROUP BY ALL HAVING count(*) >= 10)"""

SQL_SCAN_SIMPLE = SQL_ANCHORED + SQL_NEWS_RETURNS + SQL_SIMPLE_STATS + f""",
scored AS (
  SELECT a.*, s.mean, s.std, s.cnt, (a.r1 - s.mean) / s.std AS z
  FROM anchored a JOIN sstats s USING (event_code)
  WHERE a.news_date BETWEEN DATE '{SCAN_START}' AND DATE '{AS_OF}'
    AND a.d1 <= a.news_date + 5 AND s.cnt >= 10 AND s.std >= 1e-6)"""

SQL_FALLBACK = SQL_ANCHORED + SQL_NEWS_RETURNS + SQL_SIMPLE_STATS + "," + SQL_HISTORY \
    + SQL_HISTORY_STATS + f""",
two AS (
  SELECT a.*, h.median AS h_centre, h.std AS h_std, h.n AS h_n, s.mean AS s_centre,
         s.std AS s_std, s.cnt AS s_n,
         CASE WHEN h.std >= 1e-6 THEN (a.r1 - h.median) / h.std END AS zh,
         CASE WHEN a.d1 <= a.news_date + 5 AND s.std >= 1e-6
              THEN (a.r1 - s.mean) / s.std END AS zs
  FROM anchored a
  LEFT JOIN (SELECT * FROM hstats WHERE horizon = 1 AND confidence >= 0.5) h USING (event_code)
  LEFT JOIN (SELECT * FROM sstats WHERE cnt >= 10) s USING (event_code)
  WHERE a.news_date BETWEEN DATE '{SCAN_START}' AND DATE '{AS_OF}'),
picked AS (
  SELECT *, CASE WHEN abs(zh) >= 2 THEN 'HISTORY' ELSE 'SIMPLE' END AS calc_mode,
         CASE WHEN abs(zh) >= 2 THEN zh ELSE zs END AS z
  FROM two WHERE abs(zh) >= 2 OR abs(zs) >= 2),
gaps AS (
  SELECT DISTINCT news_id, news_title, stock_code, stock_name, event_code, news_date, 1 AS horizon,
         r1 AS actual_return,
         CASE calc_mode WHEN 'HISTORY' THEN h_centre ELSE s_centre END AS expected_return,
         CASE calc_mode WHEN 'HISTORY' THEN h_std ELSE s_std END AS expected_std,
         z AS z_score, {DIRECTION} AS direction,
         CASE calc_mode WHEN 'HISTORY' THEN {GRADE3} ELSE {GRADE4} END AS magnitude,
         CASE calc_mode WHEN 'HISTORY' THEN h_n ELSE s_n END AS sample_count, calc_mode
  FROM picked)"""

SIGNAL_SQL = """news_id, stock_code, stock_name, event_code, news_date, 1 AS horizon,
  round(r1, 6) AS actual_return, round(mean, 12) AS expected_return, round(std, 6) AS expected_std,
  round(z, 6) AS z_score"""


def _rounded(df):
    """Signal columns for comparison; the centre lies on a decimal grid and takes more digits."""
    return r6(r6(df, "actual_return", "expected_std", "z_score"), "expected_return", digits=12)


def _signals(df):
    return _rounded(df).drop("news_title", "calc_mode")


# --- facts and prices ------------------------------------------------------------------------

@query("news_explode_filter", f"""
WITH {SQL_NEWS}, named AS (
  SELECT news_id, news_date, event_codes,
         trim(unnest(string_split(companies, ','))) AS company FROM news),
exploded AS (
  SELECT news_id, news_date, company,
         trim(unnest(string_split(event_codes, ','))) AS event_code FROM named)
SELECT news_id, news_date, company, event_code FROM exploded
WHERE company <> '' AND event_code <> '' AND lower(event_code) <> 'other'""")
def news_explode_filter(spark, sf):
    return explode_news(v.news(spark, sf)).select("news_id", "news_date", "company", "event_code")


@query("alias_join", f"WITH {SQL_FACTS} SELECT * FROM facts")
def alias_join(spark, sf):
    return news_facts(v.news(spark, sf), v.alias_map(spark, sf)).select(
        "news_id", "news_title", "stock_code", "stock_name", "event_code", "news_date")


@query("anchor_price", f"""
WITH {SQL_ANCHORED}
SELECT news_id, stock_code, event_code, news_date, anchor_date,
       round(anchor_price, 8) AS anchor_price FROM anchored""")
def anchor_price(spark, sf):
    anchored = study.anchored_facts(*_inputs(spark, sf), as_date(HISTORY_START))
    return r6(anchored.select("news_id", "stock_code", "event_code", "news_date", "anchor_date",
                              "anchor_price"), "anchor_price", digits=8)


@query("forward_returns_135", f"""
WITH {SQL_ANCHORED}
SELECT news_id, stock_code, event_code, news_date, round(r1, 6) AS return_1d,
       round(r3, 6) AS return_3d, round(r5, 6) AS return_5d FROM anchored""")
def forward_returns_135(spark, sf):
    anchored = study.anchored_facts(*_inputs(spark, sf), as_date(HISTORY_START))
    return r6(anchored.select("news_id", "stock_code", "event_code", "news_date", "return_1d",
                              "return_3d", "return_5d"), "return_1d", "return_3d", "return_5d")


@query("price_path_n", f"""
WITH {SQL_PX}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY trade_date) AS step
  FROM px WHERE trade_date >= DATE '{SCAN_START}')
SELECT stock_code, CAST(step AS INTEGER) AS step, trade_date, round(close_price, 8) AS close_price
FROM numbered WHERE step <= 10""")
def price_path_n(spark, sf):
    return r6(pr.price_path(v.prices(spark, sf), as_date(SCAN_START), 10), "close_price", digits=8)


@query("prices_between", f"""
WITH {SQL_PX} SELECT stock_code, trade_date, round(close_price, 8) AS close_price FROM px
WHERE trade_date BETWEEN DATE '{SCAN_START}' AND DATE '{AS_OF}'""")
def prices_between(spark, sf):
    return r6(pr.prices_between(v.prices(spark, sf), as_date(SCAN_START), _as_of()), "close_price",
              digits=8)


@query("price_change_range", f"""
WITH {SQL_PX}
SELECT stock_code, round((max(close_price) - min(close_price)) / min(close_price) * 100, 6)
  AS change_pct FROM px WHERE trade_date >= DATE '{AS_OF}' - 30 GROUP BY stock_code""")
def price_change_range(spark, sf):
    return r6(pr.range_change(v.prices(spark, sf), F.date_sub(_as_of(), 30)), "change_pct")


@query("price_change_firstlast", f"""
WITH {SQL_PX}, ends AS (
  SELECT stock_code, min_by(close_price, trade_date) AS a, max_by(close_price, trade_date) AS b,
         count(*) AS n
  FROM px WHERE trade_date BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}' GROUP BY stock_code)
SELECT stock_code, CASE WHEN n >= 2 AND a <> 0 THEN round((b - a) / a * 100, 6) END AS change_pct
FROM ends""")
def price_change_firstlast(spark, sf):
    return r6(pr.first_last_change(v.prices(spark, sf), F.date_sub(_as_of(), 30), _as_of()), "change_pct")


@query("corr_two_series", f"""
WITH {SQL_PX}
SELECT '000001' AS stock1, '000002' AS stock2, round(corr(a.close_price, b.close_price), 6)
  AS correlation, count(*) AS days
FROM px a JOIN px b ON a.trade_date = b.trade_date
WHERE a.stock_code = '000001' AND b.stock_code = '000002'
  AND a.trade_date BETWEEN DATE '{HISTORY_START}' AND DATE '{AS_OF}'""")
def corr_two_series(spark, sf):
    return r6(pr.close_correlation(v.prices(spark, sf), "000001", "000002",
                                   as_date(HISTORY_START), _as_of()), "correlation")


# --- expectations ----------------------------------------------------------------------------

EXPECTATION_SQL = f"""
WITH {SQL_PXF}, {SQL_HISTORY} {SQL_HISTORY_STATS}
SELECT event_code, horizon, round(mean, 12) AS mean, round(median, 12) AS median,
       round(std, 6) AS std, round(q25, 12) AS q25, round(q75, 12) AS q75,
       round(q75 - q25, 12) AS iqr, n AS sample_count,
       CAST(round(confidence, 6) AS DOUBLE) AS confidence
FROM hstats"""


@query("expectation_stats", EXPECTATION_SQL)
def expectation_stats(spark, sf):
    stats = ex.expectation_stats(_history(spark, sf), _as_of())
    return r6(r6(stats, "std", "confidence"), "mean", "median", "q25", "q75", "iqr", digits=12)


@query("event_stats_pop", f"""
WITH {SQL_PX}, {SQL_FACTS} {SQL_NEWS_RETURNS} {SQL_SIMPLE_STATS}
SELECT event_code, round(mean, 12) AS mean, round(std, 6) AS std, cnt FROM sstats""")
def event_stats_pop(spark, sf):
    stats = ex.event_stats(_news_returns(spark, sf), _as_of())
    return r6(r6(stats.withColumnRenamed("stat_key", "event_code"), "std"), "mean", digits=12)


@query("event_stats_prefix", f"""
WITH {SQL_PX}, {SQL_FACTS} {SQL_NEWS_RETURNS}
SELECT split_part(event_code, '.', 1) AS category,
       round(avg(CAST(return_1d AS DOUBLE)), 12) AS mean,
       round(stddev_pop(CAST(return_1d AS DOUBLE)), 6) AS std, count(return_1d) AS cnt
FROM news_returns
WHERE return_1d IS NOT NULL AND news_date BETWEEN DATE '{AS_OF}' - 365 AND DATE '{AS_OF}'
GROUP BY 1""")
def event_stats_prefix(spark, sf):
    stats = ex.event_stats(_news_returns(spark, sf), _as_of(), key=ex.event_prefix(F.col("event_code")))
    return r6(r6(stats.withColumnRenamed("stat_key", "category"), "std"), "mean", digits=12)


@query("empirical_percentile", f"""
WITH {SQL_ANCHORED}, {SQL_HISTORY} {SQL_LONG_HISTORY},
kept AS (SELECT event_code, ret FROM long_history WHERE horizon = 1 AND ret IS NOT NULL),
asked AS (
  SELECT news_id, stock_code, event_code, r1 FROM anchored
  WHERE r1 IS NOT NULL AND news_date BETWEEN DATE '{SCAN_START}' AND DATE '{AS_OF}')
SELECT a.news_id, a.stock_code, a.event_code,
       round(coalesce((SELECT sum(CASE WHEN k.ret < a.r1 THEN 1.0 ELSE 0.0 END) / count(*)
                       FROM kept k WHERE k.event_code = a.event_code), 0.5), 6) AS percentile
FROM asked a""")
def empirical_percentile(spark, sf):
    news = study.news_between(v.news(spark, sf), SCAN_START, AS_OF)
    facts = study.anchored_facts(news, v.alias_map(spark, sf), v.prices(spark, sf),
                                 as_date(SCAN_START), horizons=(1,))
    asked = facts.filter(F.col("return_1d").isNotNull()).select(
        "news_id", "stock_code", "event_code", F.lit(1).alias("horizon"),
        F.col("return_1d").alias("actual_return"))
    return r6(ex.empirical_percentile(asked, _history(spark, sf)).select(
        "news_id", "stock_code", "event_code", "percentile"), "percentile")


# --- gap scans -------------------------------------------------------------------------------

@query("gap_scan_simple", f"""
WITH {SQL_SCAN_SIMPLE}
SELECT {SIGNAL_SQL}, {DIRECTION} AS direction, {GRADE4} AS magnitude, cnt AS sample_count
FROM scored WHERE abs(z) >= 2""")
def gap_scan_simple(spark, sf):
    return _signals(study.scan_simple(*_inputs(spark, sf),
                                      _news_returns(spark, sf, LOOKBACK_START), SCAN_START, AS_OF, AS_OF))


HISTORY_SCAN_SQL = f"""
WITH {SQL_ANCHORED}, {SQL_HISTORY} {SQL_HISTORY_STATS},
scored AS (
  SELECT a.*, h.median AS centre, h.*, (a.r1 - h.median) / h.std AS z
  FROM anchored a JOIN hstats h ON a.event_code = h.event_code AND h.horizon = 1
  WHERE a.news_date BETWEEN DATE '{SCAN_START}' AND DATE '{AS_OF}'
    AND h.confidence >= 0.5 AND h.std >= 1e-6 AND a.r1 IS NOT NULL),
kept AS (SELECT event_code, ret FROM long_history WHERE horizon = 1 AND ret IS NOT NULL)
SELECT s.news_id, s.stock_code, s.stock_name, s.event_code, s.news_date, 1 AS horizon,
       s.anchor_date, round(s.r1, 6) AS actual_return, round(s.centre, 12) AS expected_return,
       round(s.std, 6) AS expected_std, round(s.mean, 12) AS expected_mean,
       round(s.q25, 12) AS expected_q25, round(s.q75, 12) AS expected_q75, round(z, 6) AS z_score,
       CAST(round(s.confidence, 6) AS DOUBLE) AS confidence,
       {DIRECTION} AS direction, {GRADE3} AS magnitude, s.n AS sample_count,
       round((SELECT sum(CASE WHEN k.ret < s.r1 THEN 1.0 ELSE 0.0 END) / count(*)
              FROM kept k WHERE k.event_code = s.event_code), 6) AS percentile
FROM scored s WHERE abs(z) >= 2"""


@query("gap_scan_history", HISTORY_SCAN_SQL)
def gap_scan_history(spark, sf):
    out = study.scan_history(*_inputs(spark, sf), _history(spark, sf), SCAN_START, AS_OF, AS_OF,
                             with_percentile=True)
    return r6(r6(_signals(out), "confidence", "percentile"),
              "expected_mean", "expected_q25", "expected_q75", digits=12)


def _stored_history(spark, sf):
    """The history, its summaries, and a month that was counted before its rows were all there."""
    path = run_dir(spark, "counts")
    history = kept(_history(spark, sf))
    some = history.filter(F.crc32(F.col("stock_code")) % 3 > 0)
    st.update(some, path, "event_date")
    months = [r.m for r in history.select(month_of("event_date").alias("m")).distinct().collect()]
    st.update(history, path, "event_date", months[::2])
    st.update(history, path, "event_date", months[1::2])
    st.update(history, path, "event_date", months[:1])  # once more: nothing changes
    return study.Summaries(history.limit(0), st.opened(spark, path))


@query("expectation_stored", EXPECTATION_SQL)
def expectation_stored(spark, sf):
    """The statistics from stored counts; the history is not read."""
    stats = _stored_history(spark, sf).expectation(_as_of(), GapRules(), (1, 3, 5))
    return r6(r6(stats, "std", "confidence"), "mean", "median", "q25", "q75", "iqr", digits=12)


@query("gap_scan_stored", HISTORY_SCAN_SQL)
def gap_scan_stored(spark, sf):
    """The scan with percentiles from stored counts."""
    out = study.scan_history(*_inputs(spark, sf), _stored_history(spark, sf), SCAN_START, AS_OF, AS_OF,
                             with_percentile=True)
    return r6(r6(_signals(out), "confidence", "percentile"),
              "expected_mean", "expected_q25", "expected_q75", digits=12)


@query("gap_batch_135", f"""
WITH {SQL_ANCHORED}, {SQL_HISTORY} {SQL_HISTORY_STATS},
long AS (
  SELECT news_id, stock_code, event_code, news_date, 1 AS horizon, r1 AS r FROM anchored
  UNION ALL SELECT news_id, stock_code, event_code, news_date, 3, r3 FROM anchored
  UNION ALL SELECT news_id, stock_code, event_code, news_date, 5, r5 FROM anchored),
scored AS (
  SELECT l.*, (l.r - h.median) / h.std AS z, h.n FROM long l JOIN hstats h USING (event_code, horizon)
  WHERE l.news_date BETWEEN DATE '{SCAN_START}' AND DATE '{AS_OF}' AND l.r IS NOT NULL
    AND h.confidence >= 0.5 AND h.std >= 1e-6)
SELECT news_id, stock_code, event_code, horizon, round(z, 6) AS z_score,
       {DIRECTION} AS direction, {GRADE3} AS magnitude, n AS sample_count
FROM scored WHERE abs(z) >= 2""")
def gap_batch_135(spark, sf):
    out = study.scan_history(*_inputs(spark, sf), _history(spark, sf, LOOKBACK_START), SCAN_START,
                             AS_OF, AS_OF, horizons=(1, 3, 5))
    return r6(out.select("news_id", "stock_code", "event_code", "horizon", "z_score", "direction",
                         "magnitude", "sample_count"), "z_score")


@query("gap_scan_fallback", f"""
WITH {SQL_FALLBACK}
SELECT news_id, news_title, stock_code, stock_name, event_code, news_date, horizon,
       round(actual_return, 6) AS actual_return, round(expected_return, 12) AS expected_return,
       round(expected_std, 6) AS expected_std, round(z_score, 6) AS z_score, direction,
       magnitude, sample_count, calc_mode FROM gaps""")
def gap_scan_fallback(spark, sf):
    return _rounded(_gap_table(spark, sf))


@query("gap_scan_pooled", f"""
WITH {SQL_ANCHORED} {SQL_NEWS_RETURNS},
pool AS (
  SELECT split_part(event_code, '.', 1) AS category, avg(CAST(return_1d AS DOUBLE)) AS mean,
         stddev_pop(CAST(return_1d AS DOUBLE)) AS std, count(return_1d) AS cnt
  FROM news_returns
  WHERE return_1d IS NOT NULL AND news_date BETWEEN DATE '{AS_OF}' - 365 AND DATE '{AS_OF}'
  GROUP BY 1),
scored AS (
  SELECT a.*, p.mean, p.std, p.cnt, (a.r1 - p.mean) / p.std AS z
  FROM anchored a JOIN pool p ON split_part(a.event_code, '.', 1) = p.category
  WHERE a.news_date BETWEEN DATE '{AS_OF}' - 60 AND DATE '{AS_OF}'
    AND a.r1 IS NOT NULL AND p.cnt >= 10 AND p.std >= 1e-6)
SELECT {SIGNAL_SQL}, {DIRECTION} AS direction, {GRADE3} AS magnitude, cnt AS sample_count
FROM scored WHERE abs(z) >= 2""")
def gap_scan_pooled(spark, sf):
    return _signals(study.scan_recent_pooled(*_inputs(spark, sf),
                                             _news_returns(spark, sf, LOOKBACK_START), AS_OF, hours=24 * 60))


@query("gap_backfill", f"""
WITH {SQL_ANCHORED} {SQL_NEWS_RETURNS},
days AS (
  SELECT DISTINCT event_code, news_date FROM anchored
  WHERE news_date BETWEEN DATE '{SCAN_START}' AND DATE '{AS_OF}'),
rolled AS (
  SELECT d.event_code, d.news_date, avg(CAST(r.return_1d AS DOUBLE)) AS mean,
         stddev_pop(CAST(r.return_1d AS DOUBLE)) AS std, count(r.return_1d) AS cnt
  FROM days d JOIN news_returns r ON r.event_code = d.event_code AND r.return_1d IS NOT NULL
    AND r.news_date BETWEEN d.news_date - 365 AND d.news_date
  GROUP BY 1, 2),
scored AS (
  SELECT a.*, s.mean, s.std, s.cnt, (a.r1 - s.mean) / s.std AS z
  FROM anchored a JOIN rolled s USING (event_code, news_date)
  WHERE a.d1 <= a.news_date + 5 AND s.cnt >= 10 AND s.std >= 1e-6)
SELECT {SIGNAL_SQL}, {DIRECTION} AS direction, {GRADE4} AS magnitude, cnt AS sample_count
FROM scored WHERE abs(z) >= 2""")
def gap_backfill(spark, sf):
    return _signals(study.backfill(*_inputs(spark, sf), _news_returns(spark, sf),
                                   SCAN_START, AS_OF))


# --- reports over the gap table ---------------------------------------------------------------

@query("gap_list_filtered", f"""
WITH {SQL_FALLBACK}
SELECT news_id, stock_code, stock_name, event_code, news_date, round(z_score, 6) AS z_score,
       direction, magnitude, round(actual_return * 100, 4) AS actual_return,
       round(expected_return * 100, 4) AS expected_return, sample_count
FROM gaps WHERE news_date >= DATE '{AS_OF}' - 200 AND abs(z_score) >= 2.2 AND direction = 'OVER'
ORDER BY abs(z_score) DESC, news_id, stock_code, event_code LIMIT 20""")
def gap_list_filtered(spark, sf):
    out = rep.list_gaps(_gap_table(spark, sf), _as_of(), 200, direction="OVER", min_z=2.2, limit=20)
    out = out.withColumns({c: F.col(c) * 100 for c in ("actual_return", "expected_return")})
    return r6(r6(out, "z_score"), "actual_return", "expected_return", digits=4).select(
        "news_id", "stock_code", "stock_name", "event_code", "news_date", "z_score", "direction",
        "magnitude", "actual_return", "expected_return", "sample_count")


@query("gap_check_top5", f"""
WITH {SQL_FALLBACK}
SELECT news_id, event_code, news_date, horizon, round(z_score, 6) AS z_score, direction, magnitude,
       round(actual_return * 100, 4) AS actual_return,
       round(expected_return * 100, 4) AS expected_return, sample_count
FROM gaps WHERE stock_code = (SELECT max(stock_code) FROM gaps)
  AND news_date >= DATE '{AS_OF}' - 365
ORDER BY abs(z_score) DESC, news_id, event_code LIMIT 5""")
def gap_check_top5(spark, sf):
    gaps = _gap_table(spark, sf)
    code = gaps.agg(F.max("stock_code").alias("c")).scalar()
    return r6(r6(rep.check(gaps, code, _as_of(), 365), "z_score").drop("news_title"),
              "actual_return", "expected_return", digits=4)


@query("gap_check_summary", f"""
WITH {SQL_FALLBACK}, ends AS (
  SELECT stock_code, min_by(close_price, trade_date) AS a, max_by(close_price, trade_date) AS b,
         count(*) AS n
  FROM px WHERE trade_date BETWEEN DATE '{AS_OF}' - 100 AND DATE '{AS_OF}' GROUP BY stock_code),
changes AS (SELECT stock_code, CASE WHEN n >= 2 AND a <> 0 THEN (b - a) / a * 100 END AS c FROM ends),
found AS (
  SELECT stock_code, min(stock_name) AS stock_name, count(*) AS gap_count
  FROM gaps WHERE news_date >= DATE '{AS_OF}' - 100 GROUP BY stock_code)
SELECT stock_code, stock_name, 100 AS days, gap_count IS NOT NULL AS has_gap,
       coalesce(gap_count, 0) AS gap_count, round(c, 6) AS price_change
FROM changes FULL JOIN found USING (stock_code)""")
def gap_check_summary(spark, sf):
    changes = pr.first_last_change(v.prices(spark, sf), F.date_sub(_as_of(), 100), _as_of())
    return r6(rep.check_summary(_gap_table(spark, sf), changes, _as_of(), 100), "price_change")


def _kinds_sql(where: str, third: str) -> str:
    parts = [f"SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS key, count(*) AS count "
             f"FROM gaps {where}"]
    parts += [f"SELECT '{c}', {c}, count(*) FROM gaps {where} GROUP BY 2"
              for c in ("direction", "magnitude")]
    return " UNION ALL ".join(parts) + f" UNION ALL {third}"


RECENT = f"WHERE news_date >= DATE '{AS_OF}' - 200"


@query("gap_stats_grouping", f"WITH {SQL_FALLBACK} " + _kinds_sql(RECENT, f"""
SELECT * FROM (SELECT 'event_code', event_code, count(*) AS c FROM gaps {RECENT} GROUP BY 2
               ORDER BY c DESC, event_code LIMIT 10)"""))
def gap_stats_grouping(spark, sf):
    return rep.stats(_gap_table(spark, sf), _as_of(), 200)


@query("gap_stats_simple", f"""
WITH {SQL_FALLBACK}
SELECT count(*) AS total_count, count(*) FILTER (direction = 'OVER') AS over_count,
       count(*) FILTER (direction = 'UNDER') AS under_count, round(avg(z_score), 6) AS avg_z_score
FROM gaps {RECENT}""")
def gap_stats_simple(spark, sf):
    return r6(rep.simple_stats(_gap_table(spark, sf), _as_of(), 200), "avg_z_score")


@query("scan_summary", f"WITH {SQL_FALLBACK} " + _kinds_sql(
    "", "SELECT 'calc_mode', calc_mode, count(*) FROM gaps GROUP BY 2"))
def scan_summary(spark, sf):
    return rep.scan_summary(_gap_table(spark, sf))


@query("scan_top5", f"""
WITH {SQL_FALLBACK}
SELECT news_id, stock_code, event_code, round(z_score, 6) AS z_score, direction, calc_mode
FROM gaps ORDER BY abs(gaps.z_score) DESC, news_id, stock_code, event_code LIMIT 5""")
def scan_top5(spark, sf):
    return r6(rep.strongest(_gap_table(spark, sf)).select(
        "news_id", "stock_code", "event_code", "z_score", "direction", "calc_mode"), "z_score")


@query("gap_monitor_rows", f"""
WITH {SQL_FALLBACK}, kept AS (
  SELECT * FROM gaps WHERE (contains(lower(stock_name), '#00000000') OR contains(stock_code, '#0'))
    AND direction IN ('OVER', 'UNDER') AND magnitude IN ('HIGH', 'EXTREME') AND abs(z_score) >= 2)
SELECT stock_code, event_code, news_date, direction, magnitude, min(news_id) AS news_id
FROM kept
GROUP BY stock_code, event_code, news_date, direction, magnitude, floor(z_score * 100 + 0.5)""")
def gap_monitor_rows(spark, sf):
    return rep.monitor_rows(_gap_table(spark, sf), "#00000000", magnitudes=("HIGH", "EXTREME"),
                            min_z=2.0).select("stock_code", "event_code", "news_date",
                                              "direction", "magnitude", "news_id")


@query("gap_monitor_stats", f"""
WITH {SQL_FALLBACK}, kept AS (
  SELECT stock_code, event_code, news_date, direction, magnitude FROM gaps
  WHERE direction IN ('OVER', 'UNDER') AND magnitude IN ('HIGH', 'EXTREME') AND abs(z_score) >= 2
  GROUP BY stock_code, event_code, news_date, direction, magnitude, floor(z_score * 100 + 0.5)),
counted AS (
  SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS key, count(*) AS count FROM kept
  UNION ALL SELECT 'direction', direction, count(*) FROM kept GROUP BY 2
  UNION ALL SELECT 'magnitude', magnitude, count(*) FROM kept GROUP BY 2
  UNION ALL SELECT * FROM (SELECT 'event_code', event_code, count(*) AS c FROM kept GROUP BY 2
    ORDER BY c DESC, event_code LIMIT 8))
SELECT * FROM counted""")
def gap_monitor_stats(spark, sf):
    """Histograms and the most frequent events of the rows that the monitor's filters leave."""
    return rep.kind_counts(rep.monitor_rows(_gap_table(spark, sf), magnitudes=("HIGH", "EXTREME"), min_z=2.0), 8)


@query("event_performance", f"""
WITH {SQL_FALLBACK}
SELECT event_code, round(avg(actual_return), 6) AS avg_actual_return,
       round(avg(expected_return), 6) AS avg_expected_return,
       round(avg(z_score), 6) AS avg_z_score, count(*) AS count
FROM gaps {RECENT} GROUP BY event_code""")
def event_performance(spark, sf):
    return r6(rep.event_performance(_gap_table(spark, sf), _as_of(), 200), "avg_actual_return",
              "avg_expected_return", "avg_z_score")


@query("gap_vs_return", f"""
WITH {SQL_FALLBACK}
SELECT g.news_id, g.stock_code, g.event_code, g.news_date, round(g.z_score, 6) AS z_score,
       g.direction, round(g.actual_return, 6) AS actual_return,
       CAST(r.return_1d AS DOUBLE) AS return_1d, CAST(r.return_3d AS DOUBLE) AS return_3d,
       CAST(r.return_5d AS DOUBLE) AS return_5d
FROM gaps g JOIN news_returns r USING (news_id, stock_code, event_code)
WHERE g.news_date >= DATE '{AS_OF}' - 200""")
def gap_vs_return(spark, sf):
    return r6(rep.gap_vs_return(_gap_table(spark, sf), _news_returns(spark, sf), _as_of(), 200),
              "z_score", "actual_return", "return_1d", "return_3d", "return_5d")


# --- histories and upserts --------------------------------------------------------------------

@query("news_returns_build", f"""
WITH {SQL_PX}, {SQL_FACTS} {SQL_NEWS_RETURNS}
SELECT news_id, stock_code, stock_name, event_code, news_date,
       round(anchor_price, 8) AS anchor_price, CAST(return_1d AS DOUBLE) AS return_1d,
       CAST(return_3d AS DOUBLE) AS return_3d, CAST(return_5d AS DOUBLE) AS return_5d
FROM news_returns""")
def news_returns_build(spark, sf):
    return r6(r6(_news_returns(spark, sf), "return_1d", "return_3d", "return_5d"),
              "anchor_price", digits=8)


@query("event_history_build", f"""
WITH {SQL_PXF}, {SQL_HISTORY}
SELECT stock_code, event_date, event_code, anchor_date, round(anchor_price, 8) AS anchor_price,
       CAST(return_1d AS DOUBLE) AS return_1d, CAST(return_3d AS DOUBLE) AS return_3d,
       CAST(return_5d AS DOUBLE) AS return_5d FROM history""")
def event_history_build(spark, sf):
    out = _history(spark, sf).drop("volume", "market_cap")
    return r6(r6(out, "return_1d", "return_3d", "return_5d"), "anchor_price", digits=8)


@query("history_run_counters", f"""
WITH {SQL_PXF}, {SQL_HISTORY} SELECT status, count(*) AS count FROM outcomes GROUP BY status""")
def history_run_counters(spark, sf):
    return study.run_counters(_outcomes(spark, sf))


SQL_UPSERT_SIDES = f"""
WITH {SQL_PX}, {SQL_FACTS} {SQL_NEWS_RETURNS},
old AS (SELECT * FROM news_returns WHERE news_date <= DATE '2000-12-31'),
new AS (
  SELECT news_id, stock_code, stock_name, event_code, news_date, anchor_price + 1 AS anchor_price,
         CASE WHEN return_3d IS NULL THEN NULL ELSE return_1d + 1 END AS return_1d,
         return_3d, return_5d
  FROM news_returns WHERE news_date >= DATE '2000-07-01')"""


def _upsert_sides(spark, sf):
    rows = _news_returns(spark, sf)
    old = rows.filter(F.col("news_date") <= as_date("2000-12-31"))
    new = rows.filter(F.col("news_date") >= as_date("2000-07-01")).withColumns({
        "anchor_price": F.col("anchor_price") + 1,
        "return_1d": F.when(F.col("return_3d").isNotNull(),
                            (F.col("return_1d") + 1).cast("decimal(10,6)"))})
    return old, new


RETURN_KEYS = ["news_id", "stock_code", "event_code"]


def _stored(df):
    return r6(r6(df, "return_1d", "return_3d", "return_5d"), "anchor_price", digits=8)


@query("upsert_partial", SQL_UPSERT_SIDES + """
SELECT news_id, stock_code, event_code, coalesce(o.stock_name, n.stock_name) AS stock_name,
       coalesce(o.news_date, n.news_date) AS news_date,
       round(coalesce(o.anchor_price, n.anchor_price), 8) AS anchor_price,
       CAST(CASE WHEN n.news_date IS NULL THEN o.return_1d ELSE n.return_1d END AS DOUBLE) AS return_1d,
       CAST(CASE WHEN n.news_date IS NULL THEN o.return_3d ELSE n.return_3d END AS DOUBLE) AS return_3d,
       CAST(CASE WHEN n.news_date IS NULL THEN o.return_5d ELSE n.return_5d END AS DOUBLE) AS return_5d
FROM old o FULL JOIN new n USING (news_id, stock_code, event_code)""")
def upsert_partial(spark, sf):
    old, new = _upsert_sides(spark, sf)
    return _stored(up.upsert(old, new, RETURN_KEYS, ["return_1d", "return_3d", "return_5d"]))


@query("upsert_full", SQL_UPSERT_SIDES + """
SELECT news_id, stock_code, stock_name, event_code, news_date,
       round(anchor_price, 8) AS anchor_price, CAST(return_1d AS DOUBLE) AS return_1d,
       CAST(return_3d AS DOUBLE) AS return_3d, CAST(return_5d AS DOUBLE) AS return_5d
FROM (SELECT * FROM new UNION ALL
      SELECT * FROM old o WHERE NOT EXISTS (
        SELECT 1 FROM new n WHERE n.news_id = o.news_id AND n.stock_code = o.stock_code
          AND n.event_code = o.event_code))""")
def upsert_full(spark, sf):
    old, new = _upsert_sides(spark, sf)
    return _stored(up.upsert(old, new, RETURN_KEYS))


@query("upsert_gaps", f"""
WITH {SQL_FALLBACK},
old AS (SELECT * FROM gaps WHERE news_date <= DATE '2001-03-31'),
new AS (
  SELECT * REPLACE (z_score + 1 AS z_score, 'RERUN' AS calc_mode, sample_count + 1 AS sample_count)
  FROM gaps WHERE news_date >= DATE '2001-01-01')
SELECT news_id, stock_code, event_code, horizon,
       round(CASE WHEN n.z_score IS NULL THEN o.z_score ELSE n.z_score END, 6) AS z_score,
       coalesce(n.calc_mode, o.calc_mode) AS calc_mode,
       coalesce(o.sample_count, n.sample_count) AS sample_count
FROM old o FULL JOIN new n USING (news_id, stock_code, event_code, horizon)""")
def upsert_gaps(spark, sf):
    gaps = _gap_table(spark, sf)
    old = gaps.filter(F.col("news_date") <= as_date("2001-03-31"))
    new = gaps.filter(F.col("news_date") >= as_date("2001-01-01")).withColumns({
        "z_score": F.col("z_score") + 1, "calc_mode": F.lit("RERUN"),
        "sample_count": F.col("sample_count") + 1})
    keys = ["news_id", "stock_code", "event_code", "horizon"]
    out = up.upsert(old, new, keys, ["z_score", "direction", "magnitude", "calc_mode"])
    return r6(out.select(*keys, "z_score", "calc_mode", "sample_count"), "z_score")


# --- reads over stored returns and the listing -------------------------------------------------

@query("avg_return_by_event", f"""
WITH {SQL_PX}, {SQL_FACTS} {SQL_NEWS_RETURNS}
SELECT event_code, round(avg(CAST(return_1d AS DOUBLE)), 12) AS avg_return_1d,
       round(avg(CAST(return_3d AS DOUBLE)), 12) AS avg_return_3d, count(*) AS count
FROM news_returns GROUP BY event_code""")
def avg_return_by_event(spark, sf):
    return r6(mk.average_returns(_news_returns(spark, sf)), "avg_return_1d", "avg_return_3d",
              digits=12)


@query("win_rate", f"""
WITH {SQL_PX}, {SQL_FACTS} {SQL_NEWS_RETURNS}
SELECT stock_code, round(avg(CAST(return_1d AS DOUBLE)), 12) AS avg_1d,
       round(avg(CAST(return_3d AS DOUBLE)), 12) AS avg_3d,
       round(100.0 * avg(CASE WHEN return_1d > 0 THEN 1.0 WHEN return_1d IS NOT NULL THEN 0.0 END), 6)
         AS win_rate, count(*) AS count
FROM news_returns GROUP BY stock_code""")
def win_rate(spark, sf):
    return r6(r6(mk.return_analysis(_news_returns(spark, sf)), "win_rate"), "avg_1d", "avg_3d",
              digits=12)


@query("market_counts", f"""
WITH {SQL_DISCLOSURES}
SELECT market, count(*) AS count FROM stock_list GROUP BY market""")
def market_counts(spark, sf):
    return mk.market_counts(v.stock_list(spark, sf))


@query("stock_page", f"""
WITH {SQL_DISCLOSURES}
SELECT stock_code, corp_code, corp_name, market FROM stock_list
WHERE market = 'KOSPI' AND contains(lower(corp_name), 'supplier')
ORDER BY stock_code LIMIT 20 OFFSET 20""")
def stock_page(spark, sf):
    return mk.stock_page(v.stock_list(spark, sf), page=1, size=20, market="KOSPI",
                         name_part="supplier")


@query("table_profile", f"""
WITH {SQL_PX}, {SQL_FACTS} {SQL_NEWS_RETURNS}
SELECT count(*) AS n_rows, count(DISTINCT stock_code) AS stocks,
       min(news_date) AS first_day, max(news_date) AS last_day FROM news_returns""")
def table_profile(spark, sf):
    return mk.table_profile(_news_returns(spark, sf), "stock_code", "news_date")
