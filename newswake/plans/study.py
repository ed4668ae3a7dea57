"""The event study end to end: build histories, scan days, back-fill ranges."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from newswake.functions.dates import as_date
from newswake.operators import expectation as ex, gaps as gp, prices as pr
from newswake.operators.event_store import EventStore
from newswake.operators.gaps import GapRules
from newswake.operators.news import news_facts
from newswake.operators.upsert import first_per_key
from newswake.schemas import RETURN

Day = date | str | Column


def news_between(news: DataFrame, start: Day, end: Day) -> DataFrame:
    return news.filter(F.col("news_date").between(as_date(start), as_date(end)))


def _prices_around(prices: DataFrame, start: Column, end: Column, pad: int) -> DataFrame:
    return prices.filter(F.col("trade_date").between(
        F.date_sub(start, pad), F.date_add(end, pad)))


def anchored_facts(news: DataFrame, alias_map: DataFrame, prices: DataFrame, first_day: Column,
                   last_day: Column | None = None, pad_days: int | None = None,
                   horizons=pr.HORIZONS) -> DataFrame:
    """Facts of the news with their anchor rows; only prices that are anchors of days of the news are moved."""
    return pr.with_anchor(news_facts(news, alias_map), prices, first_day, horizons, pad_days, last_day)


def build_news_returns(news: DataFrame, alias_map: DataFrame, prices: DataFrame, start: Day,
                       end: Day, pad_days: int = 5) -> DataFrame:
    """`news_returns` rows of [start, end]: anchor price and 1/3/5-day returns, all-null ones kept.

    Prices are read for the range and `pad_days` calendar days on both sides of it.
    """
    start, end = as_date(start), as_date(end)
    anchored = anchored_facts(news_between(news, start, end), alias_map,
                              _prices_around(prices, start, end, pad_days), start, end)
    return (
        _first(anchored, ["news_id", "stock_code", "event_code"])
        .select("news_id", "stock_code", "stock_name", "event_code", "news_date", "anchor_price",
                *[F.col(f"return_{h}d").cast(RETURN).alias(f"return_{h}d") for h in pr.HORIZONS])
    )


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key, of repeats that differ the first in the order of all other columns."""
    return first_per_key(rows, keys, F.struct(*[c for c in rows.columns if c not in keys]))


def label_outcomes(events: DataFrame, stock_list: DataFrame, prices: DataFrame,
                   first_day: Day) -> DataFrame:
    """Every labelled disclosure with the reason it is or is not kept, for counters and saving.

    `events` is (corp_code, event_date, event_code). Prices use zero-padded codes.
    """
    codes = stock_list.groupBy("corp_code").agg(F.min("stock_code").alias("stock_code"))
    coded = events.join(codes, "corp_code", "left").withColumn(
        "stock_code", pr.pad_code(F.col("stock_code")))
    first_day = as_date(first_day)
    joined = pr.with_anchor(coded, prices.filter(F.col("trade_date") >= first_day), first_day,
                            date_col="event_date", how="left")
    any_return = F.coalesce("return_1d", "return_3d", "return_5d").isNotNull()
    status = (
        F.when(F.col("event_code").isNull() | (F.lower("event_code") == "other"), "no_label")
        .when(F.col("stock_code").isNull(), "no_stock_code")
        .when(F.col("anchor_date").isNull(), "no_anchor")
        .when(~any_return, "no_return")
        .otherwise("saved"))
    return joined.withColumn("status", status)


def build_event_history(outcomes: DataFrame) -> DataFrame:
    """`event_returns_history` rows: the saved outcomes, one per (stock, day, event)."""
    return (
        _first(outcomes.filter(F.col("status") == "saved"), ["stock_code", "event_date", "event_code"])
        .select("stock_code", "event_date", "event_code", "anchor_date", "anchor_price",
                *[F.col(f"return_{h}d").cast(RETURN).alias(f"return_{h}d") for h in pr.HORIZONS],
                F.lit(0).cast("long").alias("volume"),
                F.lit(0).cast("decimal(20,2)").alias("market_cap"))
    )


def run_counters(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count("*").alias("count"))


@dataclass(frozen=True)
class Summaries:
    """Where a scan takes its statistics from: the stored counts of a table of returns where there are
    any, else its rows."""
    rows: DataFrame
    store: EventStore | None = None

    def expectation(self, as_of: Column, rules: GapRules, horizons) -> DataFrame:
        if self.store is None:
            return ex.expectation_stats(self.rows, as_of, rules.lookback_days, rules.min_samples, horizons)
        counts = self.store.counts(F.date_sub(as_of, rules.lookback_days), as_of)
        return ex.stats_of_counts(ex.on_grid(counts.filter(F.col("horizon").isin(list(horizons)))), rules.min_samples)

    def moments(self, as_of: Column, rules: GapRules, key: Column | None = None) -> DataFrame:
        if self.store is None:
            return ex.event_stats(self.rows, as_of, rules.lookback_days, key=key)
        counts = self.store.counts(F.date_sub(as_of, rules.lookback_days), as_of)
        return ex.event_stats_of_counts(ex.on_grid(counts), key)

    def percentile(self, signals: DataFrame, horizons) -> DataFrame:
        if self.store is None:
            return ex.empirical_percentile(signals, self.rows, horizons=horizons)
        return ex.percentile_of_counts(signals, self.store.counts())


def _summaries(given: DataFrame | Summaries) -> Summaries:
    return given if isinstance(given, Summaries) else Summaries(given)


def scan_simple(news: DataFrame, alias_map: DataFrame, prices: DataFrame, news_returns: DataFrame | Summaries,
                start: Day, end: Day, as_of: Day, rules: GapRules = GapRules()) -> DataFrame:
    start, end, as_of = as_date(start), as_date(end), as_date(as_of)
    near = _prices_around(prices, start, end, rules.price_pad_days)
    anchored = anchored_facts(news_between(news, start, end), alias_map, near, start, end,
                              rules.price_pad_days, horizons=(1,))
    return gp.detect_simple(anchored, _summaries(news_returns).moments(as_of, rules), rules)


def scan_history(news: DataFrame, alias_map: DataFrame, prices: DataFrame, history: DataFrame | Summaries,
                 start: Day, end: Day, as_of: Day, rules: GapRules = GapRules(),
                 horizons=(1,), with_percentile: bool = False) -> DataFrame:
    start, end, as_of = as_date(start), as_date(end), as_date(as_of)
    anchored = anchored_facts(news_between(news, start, end), alias_map,
                              prices.filter(F.col("trade_date") >= start), start, end)
    known = _summaries(history)
    signals = gp.detect_history(anchored, known.expectation(as_of, rules, horizons), rules, horizons)
    return known.percentile(signals, horizons) if with_percentile else signals


def scan_with_fallback(news: DataFrame, alias_map: DataFrame, prices: DataFrame,
                       history: DataFrame | Summaries, news_returns: DataFrame | Summaries, start: Day, end: Day,
                       as_of: Day, rules: GapRules = GapRules()) -> DataFrame:
    start, end, as_of = as_date(start), as_date(end), as_date(as_of)
    anchored = anchored_facts(news_between(news, start, end), alias_map,
                              prices.filter(F.col("trade_date") >= start), start, end,
                              horizons=(1,))
    h = _summaries(history).expectation(as_of, rules, (1,))
    s = _summaries(news_returns).moments(as_of, rules)
    return gp.detect_with_fallback(anchored, h, s, rules)


def scan_recent_pooled(news: DataFrame, alias_map: DataFrame, prices: DataFrame,
                       news_returns: DataFrame | Summaries, as_of: Day, hours: int = 48,
                       rules: GapRules = GapRules()) -> DataFrame:
    """News of the last hours (whole days) against the pooled category statistics."""
    as_of = as_date(as_of)
    start = F.date_sub(as_of, -(-hours // 24))
    anchored = anchored_facts(news_between(news, start, as_of), alias_map,
                              prices.filter(F.col("trade_date") >= start), start, as_of,
                              horizons=(1,))
    stats = _summaries(news_returns).moments(as_of, rules, ex.event_prefix(F.col("event_code")))
    return gp.detect_pooled(anchored, stats, rules)


def backfill(news: DataFrame, alias_map: DataFrame, prices: DataFrame, news_returns: DataFrame,
             start: Day, end: Day, rules: GapRules = GapRules()) -> DataFrame:
    """The SIMPLE scan of every day of [start, end] in one job, each day with its own look-back.

    A day loop becomes a join on (event, day) with statistics rolled over day rows.
    """
    start, end = as_date(start), as_date(end)
    near = _prices_around(prices, start, end, rules.price_pad_days)
    anchored = anchored_facts(news_between(news, start, end), alias_map, near, start, end,
                              rules.price_pad_days, horizons=(1,))
    needed = news_returns.filter(F.col("news_date").between(
        F.date_sub(start, rules.lookback_days), end))
    # days with facts but without stored returns still need a row of rolled statistics
    days = anchored.select("event_code", "news_date").distinct().withColumn(
        "return_1d", F.lit(None).cast(RETURN))
    stats = ex.rolling_event_stats(
        needed.select("event_code", "news_date", "return_1d").unionByName(days),
        rules.lookback_days)
    return gp.detect_simple(anchored, stats, rules)
