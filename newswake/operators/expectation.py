"""Return distributions per event: moments, exact quantiles, prefix pools, empirical ranks.

Returns at rest are DECIMAL(10,6), so distinct values per event are bounded by the value grid
while rows are not. Everything that cannot be merged cheaply is computed from
(event, value, count) rows: the first aggregation is keyed by value too, so an event that holds
a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newswake.functions.scores import sample_confidence
from newswake.schemas import RETURN
from newswake.sources.writers import kept

QUANTILES = (0.25, 0.5, 0.75)


def unpivot_returns(history: DataFrame, horizons=(1, 3, 5), keep: tuple[str, ...] = ()
                    ) -> DataFrame:
    """One row per (event_code, horizon, ret), nulls dropped, on the stored grid."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"return_{h}d").cast(RETURN).alias("ret"))
        for h in horizons
    ]))
    return (
        history.select("event_code", *keep, pairs.alias("p"))
        .select("event_code", *keep, "p.horizon", "p.ret")
        .filter(F.col("ret").isNotNull())
    )


def value_counts(returns: DataFrame) -> DataFrame:
    return returns.groupBy("event_code", "horizon", "ret").agg(F.count("*").alias("n"))


def expectation_stats(history: DataFrame, as_of: Column, lookback_days: int = 365,
                      min_samples: int = 10, horizons=(1, 3, 5)) -> DataFrame:
    """Mean, median, sample sigma, quartiles, count and confidence per (event_code, horizon)."""
    recent = history.filter(
        (F.col("event_date") >= F.date_sub(as_of, lookback_days)) & (F.col("event_date") <= as_of))
    return stats_of_counts(value_counts(unpivot_returns(recent, horizons)), min_samples)


def on_grid(counts: DataFrame) -> DataFrame:
    """(event_code, horizon, ret, n) of counts by grid value."""
    ret = (F.col("grid").cast("decimal(24,6)") / GRID).cast(RETURN)
    return counts.select("event_code", "horizon", ret.alias("ret"), "n")


def stats_of_counts(counts: DataFrame, min_samples: int = 10) -> DataFrame:
    """`expectation_stats` of (event_code, horizon, ret, n)."""
    counted = counts.withColumn("x", F.col("ret").cast("double"))
    n, x = F.col("n"), F.col("x")
    by_event = counted.groupBy("event_code", "horizon").agg(
        F.sum("n").alias("n"),
        (F.sum(x * n) / F.sum("n")).alias("mean"),
        F.sum(x * n).alias("sx"),
        F.sum(x * x * n).alias("sxx"),
        F.percentile(x, list(QUANTILES), n).alias("q"),
    ).filter(F.col("n") >= min_samples)
    spread = F.greatest(F.lit(0.0), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))
    return by_event.select(
        "event_code", "horizon", "mean",
        F.col("q")[1].alias("median"),
        F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).alias("std"),
        F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"),
        (F.col("q")[2] - F.col("q")[0]).alias("iqr"),
        F.col("n").alias("sample_count"),
        sample_confidence(F.col("n")).alias("confidence"),
    )


def daily_moments(returns: DataFrame, key: Column, date_col: str = "news_date") -> DataFrame:
    """n, sum and sum of squares of the non-null 1-day returns per (key, day).

    At most keys x calendar days rows come out, however many news rows go in. A day with only
    null returns gives a row with n = 0.
    """
    r = F.col("return_1d").cast(RETURN)
    return (
        returns.groupBy(key.alias("stat_key"), F.col(date_col).alias("day"))
        .agg(F.count("return_1d").alias("n"),
             F.coalesce(F.sum(r).cast("double"), F.lit(0.0)).alias("sx"),
             F.coalesce(F.sum(r.cast("double") * r.cast("double")), F.lit(0.0)).alias("sxx"))
    )


def _from_moments(n: Column, sx: Column, sxx: Column) -> tuple[Column, Column]:
    mean = F.when(n > 0, sx / n)
    return mean, F.sqrt(F.greatest(F.lit(0.0), F.when(n > 0, sxx / n) - mean * mean))


def event_stats(returns: DataFrame, as_of: Column, lookback_days: int = 365,
                date_col: str = "news_date", key: Column | None = None) -> DataFrame:
    """Mean, population sigma and count of the 1-day return per event over the look-back."""
    key = F.col("event_code") if key is None else key
    recent = returns.filter(F.col(date_col).between(F.date_sub(as_of, lookback_days), as_of))
    agg = daily_moments(recent, key, date_col).groupBy("stat_key").agg(
        F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sxx").alias("sxx"))
    mean, std = _from_moments(F.col("n"), F.col("sx"), F.col("sxx"))
    return agg.select("stat_key", mean.alias("mean"), std.alias("std"), F.col("n").alias("cnt"))


def event_stats_of_counts(counts: DataFrame, key: Column | None = None) -> DataFrame:
    """`event_stats` from (event_code, horizon, ret, n); only the 1-day returns are taken."""
    key = F.col("event_code") if key is None else key
    x, n = F.col("ret").cast("double"), F.col("n")
    agg = counts.filter("horizon = 1").groupBy(key.alias("stat_key")).agg(
        F.sum("n").alias("n"), F.sum(x * n).alias("sx"), F.sum(x * x * n).alias("sxx"))
    mean, std = _from_moments(F.col("n"), F.col("sx"), F.col("sxx"))
    return agg.select("stat_key", mean.alias("mean"), std.alias("std"), F.col("n").alias("cnt"))


def rolling_event_stats(returns: DataFrame, lookback_days: int = 365,
                        date_col: str = "news_date", key: Column | None = None) -> DataFrame:
    """`event_stats` as of every day that has returns: (stat_key, day, mean, std, cnt).

    The window runs over day rows, not over news rows.
    """
    key = F.col("event_code") if key is None else key
    daily = daily_moments(returns, key, date_col).withColumn("day_no", F.unix_date("day"))
    w = (Window.partitionBy("stat_key").orderBy("day_no")
         .rangeBetween(-lookback_days, Window.currentRow))
    rolled = daily.select("stat_key", "day", F.sum("n").over(w).alias("n"),
                          F.sum("sx").over(w).alias("sx"), F.sum("sxx").over(w).alias("sxx"))
    mean, std = _from_moments(F.col("n"), F.col("sx"), F.col("sxx"))
    return rolled.select("stat_key", "day", mean.alias("mean"), std.alias("std"),
                         F.col("n").alias("cnt"))


def event_prefix(code: Column) -> Column:
    """Text before the first dot. `code = x OR code LIKE prefix.%` is equality of prefixes."""
    return F.split_part(code, F.lit("."), F.lit(1))


GRID = 1_000_000
BUCKET = 100
SPAN = 1_000


def _grid_key(value: Column) -> Column:
    """Smallest grid index not below `value`: stored returns under it are exactly those < value."""
    return F.ceil(value.cast("decimal(24,12)") * F.lit(GRID)).cast("long")


def empirical_percentile(signals: DataFrame, history: DataFrame, value_col: str = "actual_return",
                         horizons=(1,)) -> DataFrame:
    """Add `percentile`: the share of the event's stored returns strictly under the value.

    0.5 when the event has no stored return.
    """
    counts = value_counts(unpivot_returns(history, horizons)).select(
        "event_code", "horizon", (F.col("ret") * GRID).cast("long").alias("grid"), "n")
    return percentile_of_counts(signals, counts, value_col)


def percentile_of_counts(signals: DataFrame, counts: DataFrame, value_col: str = "actual_return") -> DataFrame:
    """`empirical_percentile` over (event_code, horizon, grid, n).

    An event's counts are laid out in buckets of BUCKET grid values, and these in spans of SPAN buckets:
    one row a span with what lies below it, one row a bucket of a filled span with its values and what
    lies below it in the span. Empty spans and buckets have rows too. A signal meets one row of each and
    three numbers of its event, so what moves with a signal is a few bytes, whatever the history holds.
    """
    keys = ["event_code", "horizon"]
    grid = _grid_key(F.col(value_col))
    bucket = F.floor(grid / BUCKET)
    asked = signals.withColumns({"_grid": grid, "_bucket": bucket, "_span": F.floor(bucket / SPAN)})
    at = F.floor(F.col("grid") / BUCKET)
    cells = kept(counts.groupBy(*keys, F.floor(at / SPAN).alias("_span"), at.alias("_bucket")).agg(
        F.sum("n").alias("_n"), F.collect_list(F.struct("grid", "n")).alias("_cells")))  # read four times
    sums = cells.groupBy(*keys, "_span").agg(F.sum("_n").alias("_n"))
    totals = sums.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.min("_span").alias("_first"),
                                     F.max("_span").alias("_last"))
    spans = _ladder(sums, keys, "_span", F.col("_span"), F.col("_span") + 1).withColumnRenamed("_before", "_lower")
    start = F.col("_span") * SPAN
    inner = _ladder(cells.drop("_cells"), [*keys, "_span"], "_bucket", start, start + SPAN)
    buckets = inner.join(cells.drop("_n"), [*keys, "_span", "_bucket"], "left")
    zero = F.lit(0).cast("long")
    inside = F.aggregate(F.coalesce("_cells", F.array().cast("array<struct<grid: bigint, n: bigint>>")), zero,
                         lambda a, c: a + F.when(c["grid"] < F.col("_grid"), c["n"]).otherwise(zero))
    under = (F.when(F.col("_span") < F.col("_first"), zero).when(F.col("_span") > F.col("_last"), F.col("_all"))
             .otherwise(F.col("_lower") + F.coalesce("_before", zero) + inside))
    share = F.when(F.col("_grid").isNotNull(), under / F.col("_all"))
    return (asked.join(F.broadcast(totals), keys, "left").join(spans, [*keys, "_span"], "left")
            .join(buckets, [*keys, "_span", "_bucket"], "left")
            .select(*signals.columns, F.coalesce(share, F.lit(0.5)).alias("percentile")))


def _ladder(rows: DataFrame, keys: list[str], at: str, start: Column, stop: Column) -> DataFrame:
    """(keys, at, _before): what lies below each place from `start` of the first row on and before
    `stop` of the last, places without a row too."""
    line = Window.partitionBy(*keys).orderBy(at)
    here = F.col(at)
    steps = rows.select(*keys, here.alias("_at"), "_n",
                        F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("_to"),
                        F.when(F.lag(at).over(line).isNull(), start).otherwise(here).alias("_from"),
                        F.coalesce(F.lead(at).over(line), stop).alias("_next"))
    return steps.select(*keys, F.explode(F.sequence("_from", F.col("_next") - 1)).alias(at), "_at", "_n", "_to").select(
        *keys, at, F.when(here <= F.col("_at"), F.col("_to") - F.col("_n")).otherwise(F.col("_to")).alias("_before"))
