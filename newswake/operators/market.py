"""Small reads over stored returns, the stock list and analysed news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def average_returns(returns: DataFrame) -> DataFrame:
    return returns.groupBy("event_code").agg(
        F.avg(F.col("return_1d").cast("double")).alias("avg_return_1d"),
        F.avg(F.col("return_3d").cast("double")).alias("avg_return_3d"),
        F.count("*").alias("count"))


def return_analysis(returns: DataFrame) -> DataFrame:
    """Mean 1/3-day return, share of positive 1-day returns in percent, and count per stock."""
    r1 = F.col("return_1d").cast("double")
    return returns.groupBy("stock_code").agg(
        F.avg(r1).alias("avg_1d"),
        F.avg(F.col("return_3d").cast("double")).alias("avg_3d"),
        (F.avg((r1 > 0).cast("int")) * 100.0).alias("win_rate"),
        F.count("*").alias("count"))


def returns_of(returns: DataFrame, news_id: str | None = None, stock_code: str | None = None,
               since: Column | None = None) -> DataFrame:
    out = returns
    if news_id is not None:
        out = out.filter(F.col("news_id") == news_id)
    if stock_code is not None:
        out = out.filter(F.col("stock_code") == stock_code)
    return out.filter(F.col("news_date") >= since) if since is not None else out


def market_counts(stocks: DataFrame) -> DataFrame:
    return stocks.groupBy("market").agg(F.count("*").alias("count"))


def markets(stocks: DataFrame) -> DataFrame:
    return stocks.select("market").filter(F.col("market").isNotNull()).distinct()


def stock_page(stocks: DataFrame, page: int = 0, size: int = 20, market: str | None = None,
               name_part: str | None = None) -> DataFrame:
    """One page of the listing in code order, of one market and with a name part if given."""
    out = stocks
    if market is not None:
        out = out.filter(F.col("market") == market)
    if name_part:
        out = out.filter(F.lower("corp_name").contains(name_part.lower()))
    return out.orderBy("stock_code").offset(page * size).limit(size)


def news_where(news: DataFrame, limit: int | None = None, **equals) -> DataFrame:
    """News rows equal to every given column value, newest first."""
    out = news
    for name, value in equals.items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    out = out.orderBy(F.desc("published_at"), "id")
    return out.limit(limit) if limit is not None else out


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))


def table_profile(rows: DataFrame, stock_col: str, date_col: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct(stock_col).alias("stocks"),
                    F.min(date_col).alias("first_day"), F.max(date_col).alias("last_day"))
