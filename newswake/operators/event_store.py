"""Stored summaries of returns per event: counts of values by day and by month, updated by day.

Returns lie on a grid, so how often each value came on a day says all that the statistics ask for:
moments, exact quantiles and ranks are computed from counts, and counts of days add up. Below one folder

    daily    (event_code, horizon, day, grid, n), partitioned by month
    monthly  (event_code, horizon, grid, n), partitioned by month: the sum of its days

An update reads the rows of the months that its days lie in and rewrites these partitions; repeating
it changes nothing. Rows are added or change their values; a month that lost all its rows keeps what was
counted. A reader of a range takes whole months from `monthly` and days only from the
months at both ends, so the history itself is never read again. Rows without a date or return count
nowhere.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newswake.functions.dates import as_date
from newswake.operators.expectation import GRID, unpivot_returns
from newswake.sources.writers import exists, month_of

DAILY = "event_code string, horizon int, day date, grid long, n long, month string"
MONTHLY = "event_code string, horizon int, grid long, n long, month string"


def _write(rows: DataFrame, path: str) -> None:
    (rows.hint("rebalance", F.col("month")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("month").parquet(path))


def update(history: DataFrame, path: str, date_col: str, months: list[str] | None = None, horizons=(1, 3, 5)) -> None:
    """Count the rows of some months of the history (of all by default) anew."""
    spark = history.sparkSession
    month = month_of(date_col)
    rows = history.filter(F.col(date_col).isNotNull())
    if months is not None:
        rows = rows.filter(month.isin(list(months)))
    long = unpivot_returns(rows.withColumn("day", F.col(date_col).cast("date")), horizons, keep=("day",))
    daily = long.groupBy("event_code", "horizon", "day", (F.col("ret") * GRID).cast("long").alias("grid")).agg(
        F.count("*").alias("n")).withColumn("month", month_of("day"))
    _write(daily.select("event_code", F.col("horizon").cast("int").alias("horizon"), "day", "grid", "n", "month"), f"{path}/daily")
    days = _read(spark, path, "daily", DAILY)
    if months is not None:
        days = days.filter(F.col("month").isin(list(months)))
    _write(days.groupBy("event_code", "horizon", "grid", "month").agg(F.sum("n").alias("n"))
           .select("event_code", "horizon", "grid", "n", "month"), f"{path}/monthly")


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def opened(spark: SparkSession, path: str) -> EventStore | None:
    """The store; None if there is none."""
    return EventStore(spark, path) if exists(spark, f"{path}/monthly") else None


class EventStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def counts(self, start: date | str | Column | None = None, end: date | str | Column | None = None) -> DataFrame:
        """(event_code, horizon, grid, n) from a day on and up to another. Partitions are pruned."""
        monthly = _read(self.spark, self.path, "monthly", MONTHLY)
        daily = _read(self.spark, self.path, "daily", DAILY)
        if start is None and end is None:
            return monthly.groupBy("event_code", "horizon", "grid").agg(F.sum("n").alias("n"))
        edges, inner, days = F.lit(False), F.lit(True), F.lit(True)
        if start is not None:
            first = month_of(as_date(start))
            inner, edges, days = inner & (F.col("month") > first), edges | (F.col("month") == first), days & (F.col("day") >= as_date(start))
        if end is not None:
            last = month_of(as_date(end))
            inner, edges, days = inner & (F.col("month") < last), edges | (F.col("month") == last), days & (F.col("day") <= as_date(end))
        some = daily.filter(edges & days).select("event_code", "horizon", "grid", "n")
        whole = monthly.filter(inner).select("event_code", "horizon", "grid", "n")
        return whole.unionByName(some).groupBy("event_code", "horizon", "grid").agg(F.sum("n").alias("n"))
