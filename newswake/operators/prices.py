"""Price series: daily dedupe, forward returns and the forward as-of join.

A price table has one row per (stock_code, trade_date), so the rows of one code are bounded by
the number of trading days. That is what makes a window per code safe; rows that arrive more
than once per day are aggregated before any window sees them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newswake.functions.scores import log_return

HORIZONS = (1, 3, 5)


def pad_code(code: Column) -> Column:
    """Zero-pad to six characters without cutting longer codes."""
    code = code.cast("string")
    return F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)


def daily_close(prices: DataFrame) -> DataFrame:
    """One row per (stock_code, trade_date); of repeated rows the smallest close stays."""
    return prices.groupBy("stock_code", "trade_date").agg(F.min("close_price").alias("close_price"))


def forward_closes(series: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Add, per row, the close and date of the h-th later trading day and the previous date."""
    w = Window.partitionBy("stock_code").orderBy("trade_date")
    series = daily_close(series)
    cols = [F.lag("trade_date").over(w).alias("prev_date")]
    for h in horizons:
        cols += [F.lead("close_price", h).over(w).alias(f"close_{h}d"),
                 F.lead("trade_date", h).over(w).alias(f"date_{h}d")]
    return series.select("*", *cols)


def anchor_spans(series: DataFrame, first_day: Column, horizons=HORIZONS,
                 pad_days: int | None = None, last_day: Column | None = None) -> DataFrame:
    """`forward_closes` with the calendar days [start, stop] that each trading day is the anchor of.

    The days run from `first_day` to the last trading day of a code, or to `last_day`. With `pad_days`,
    an anchor further than that many calendar days after the event day does not count.
    """
    w = forward_closes(series, horizons)
    since = F.coalesce(F.date_add("prev_date", 1), F.least(first_day, F.col("trade_date")))
    if pad_days is not None:
        since = F.greatest(since, F.date_sub("trade_date", pad_days))
    start = F.greatest(since, F.least(first_day, F.col("trade_date")))
    stop = F.col("trade_date") if last_day is None else F.least(last_day, F.col("trade_date"))
    return w.filter(F.col("trade_date") >= first_day).filter(start <= stop).withColumns({"start": start, "stop": stop})


def _anchor_columns(day: Column, horizons, pad_days: int | None) -> list[Column]:
    """Anchor and forward returns of an event day; with `pad_days`, a later close further than that
    many calendar days after it does not count."""
    base = F.col("close_price")
    cols = [F.col("trade_date").alias("anchor_date"), base.cast("double").alias("anchor_price")]
    for h in horizons:
        r = log_return(F.col(f"close_{h}d"), base)
        if pad_days is not None:
            r = F.when(F.col(f"date_{h}d") <= F.date_add(day, pad_days), r)
        cols += [r.alias(f"return_{h}d"), F.col(f"date_{h}d")]
    return cols


def anchor_calendar(series: DataFrame, first_day: Column, horizons=HORIZONS,
                    pad_days: int | None = None, last_day: Column | None = None) -> DataFrame:
    """The forward as-of join unrolled into one row per (stock_code, event_date), as a table to look
    days up in. It has codes x calendar days rows; facts are joined by `with_anchor` instead."""
    days = anchor_spans(series, first_day, horizons, pad_days, last_day).withColumn(
        "event_date", F.explode(F.sequence("start", "stop")))
    return days.select("stock_code", "event_date", *_anchor_columns(F.col("event_date"), horizons, pad_days))


def _month_no(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def with_anchor(facts: DataFrame, series: DataFrame, first_day: Column, horizons=HORIZONS,
                pad_days: int | None = None, last_day: Column | None = None, date_col: str = "news_date",
                how: str = "inner") -> DataFrame:
    """Facts with the first trading day on or after their day: the forward as-of join.

    A price row is laid out once a month that its days lie in, and facts meet prices on (code, month).
    Of the at most 31 rows there one has the day of the fact. So prices move as often as they are, not
    once a calendar day, and a hot code is spread over its months; a hot month of a code is split at
    run time. The merge hint keeps the planner from broadcasting the prices by an estimate that does
    not see the spread.
    """
    spans = anchor_spans(series, first_day, horizons, pad_days, last_day)
    months = F.explode(F.sequence(_month_no(F.col("start")), _month_no(F.col("stop"))))
    look = spans.drop("prev_date").withColumnRenamed("stock_code", "_code").withColumn("_month", months).hint("merge")
    day = F.col(date_col)
    both = facts.join(look, (F.col("stock_code") == F.col("_code")) & (_month_no(day) == F.col("_month"))
                      & (day >= F.col("start")) & (day <= F.col("stop")), how)
    keys = ["stock_code", date_col]
    return both.select(*keys, *[c for c in facts.columns if c not in keys],
                       *_anchor_columns(F.col(date_col), horizons, pad_days))


def price_path(series: DataFrame, start: Column, days: int = 10) -> DataFrame:
    """The next `days` closes of every code from `start` on, numbered from 1."""
    w = Window.partitionBy("stock_code").orderBy("trade_date")
    return (
        daily_close(series.filter(F.col("trade_date") >= start))
        .withColumn("step", F.row_number().over(w))
        .filter(F.col("step") <= days)
        .select("stock_code", F.col("step").cast("int").alias("step"), "trade_date",
                F.col("close_price").cast("double").alias("close_price"))
    )


def prices_between(series: DataFrame, start: Column, end: Column,
                   stock_code: str | None = None) -> DataFrame:
    out = series.filter(F.col("trade_date").between(start, end))
    return out.filter(F.col("stock_code") == stock_code) if stock_code else out


def range_change(series: DataFrame, since: Column) -> DataFrame:
    """(max - min) / min * 100 per code from `since` on."""
    close = F.col("close_price").cast("double")
    return (
        series.filter(F.col("trade_date") >= since)
        .groupBy("stock_code")
        .agg(F.max(close).alias("high"), F.min(close).alias("low"))
        .select("stock_code", F.when(F.col("low") != 0,
                                     (F.col("high") - F.col("low")) / F.col("low") * 100.0)
                .alias("change_pct"))
    )


def first_last_change(series: DataFrame, start: Column, end: Column) -> DataFrame:
    """(last - first) / first * 100 per code in [start, end]; null under two rows or from zero.

    When both end days traded they are the first and last rows anyway, so no special case is
    needed for them.
    """
    close = F.col("close_price").cast("double")
    return (
        daily_close(series.filter(F.col("trade_date").between(start, end)))
        .groupBy("stock_code")
        .agg(F.min_by(close, "trade_date").alias("first_close"),
             F.max_by(close, "trade_date").alias("last_close"),
             F.count("*").alias("n"))
        .select("stock_code", F.when(
            (F.col("n") >= 2) & (F.col("first_close") != 0),
            (F.col("last_close") - F.col("first_close")) / F.col("first_close") * 100.0)
            .alias("change_pct"))
    )


def close_correlation(series: DataFrame, code_a: str, code_b: str, start: Column, end: Column
                      ) -> DataFrame:
    """Pearson correlation of two codes' closes over their common days, in one pass."""
    close = F.col("close_price").cast("double")
    return (
        series.filter(F.col("stock_code").isin(code_a, code_b)
                      & F.col("trade_date").between(start, end))
        .groupBy("trade_date")
        .agg(F.max(F.when(F.col("stock_code") == code_a, close)).alias("a"),
             F.max(F.when(F.col("stock_code") == code_b, close)).alias("b"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
        .agg(F.corr("a", "b").alias("correlation"), F.count("*").alias("days"))
        .select(F.lit(code_a).alias("stock1"), F.lit(code_b).alias("stock2"), "correlation", "days")
    )
