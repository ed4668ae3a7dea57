"""Reads over the `news_gaps` table: check, filtered list, statistics, summary."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from newswake.functions.scores import percent


def since(as_of: Column, days: int) -> Column:
    return F.date_sub(as_of, days)


def _where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    given = [c for c in conditions if c is not None]
    return df.filter(reduce(and_, given)) if given else df


def by_stock(gaps: DataFrame, stock_code: str | Column, as_of: Column, days: int) -> DataFrame:
    return gaps.filter((F.col("stock_code") == stock_code)
                       & (F.col("news_date") >= since(as_of, days)))


def check(gaps: DataFrame, stock_code: str | Column, as_of: Column, days: int = 3,
          top: int = 5) -> DataFrame:
    """The strongest gaps of one stock, returns in percent."""
    return (
        by_stock(gaps, stock_code, as_of, days)
        .orderBy(F.abs("z_score").desc(), "news_id", "event_code", "horizon")
        .limit(top)
        .select("news_id", "news_title", "event_code", "news_date", "horizon", "z_score",
                "direction", "magnitude", percent(F.col("actual_return")).alias("actual_return"),
                percent(F.col("expected_return")).alias("expected_return"), "sample_count")
    )


def check_summary(gaps: DataFrame, changes: DataFrame, as_of: Column, days: int) -> DataFrame:
    """One row per stock: has_gap, gap_count, name and price change, for every stock at once."""
    recent = gaps.filter(F.col("news_date") >= since(as_of, days))
    found = recent.groupBy("stock_code").agg(
        F.min("stock_name").alias("stock_name"), F.count("*").alias("gap_count"))
    return changes.join(found, "stock_code", "full_outer").select(
        "stock_code", "stock_name", F.lit(days).alias("days"),
        F.col("gap_count").isNotNull().alias("has_gap"),
        F.coalesce("gap_count", F.lit(0)).alias("gap_count"),
        F.col("change_pct").alias("price_change"))


def list_gaps(gaps: DataFrame, as_of: Column, days: int = 7, direction: str | None = None,
              magnitude: str | None = None, min_z: float = 2.0, limit: int | None = 20
              ) -> DataFrame:
    """Gaps of the last days under optional filters, strongest first."""
    out = _where(
        gaps, F.col("news_date") >= since(as_of, days), F.abs("z_score") >= min_z,
        F.col("direction") == direction if direction else None,
        F.col("magnitude") == magnitude if magnitude else None,
    ).orderBy(F.abs("z_score").desc(), "news_id", "stock_code", "event_code", "horizon")
    return out.limit(limit) if limit is not None else out


def stats(gaps: DataFrame, as_of: Column, days: int = 7, top_events: int | None = 10
          ) -> DataFrame:
    """(kind, key, count) for the total and by direction, magnitude and event code, in one pass.

    Null keys are not counted. Event codes are cut to the most frequent; pass None for all.
    """
    return kind_counts(gaps.filter(F.col("news_date") >= since(as_of, days)), top_events)


def kind_counts(rows: DataFrame, top_events: int | None = None) -> DataFrame:
    """`stats` of the rows given, such as those a monitor's filters leave."""
    counted = rows.groupingSets(
        [[], ["direction"], ["magnitude"], ["event_code"]], "direction", "magnitude", "event_code"
    ).agg(F.count("*").alias("count"), F.grouping_id().alias("gid"))
    kind = (F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "direction")
            .when(F.col("gid") == 5, "magnitude").otherwise("event_code"))
    rows = counted.select(
        kind.alias("kind"),
        F.coalesce("direction", "magnitude", "event_code").alias("key"), "count"
    ).filter((F.col("kind") == "total") | F.col("key").isNotNull())
    if top_events is None:
        return rows
    events = rows.filter(F.col("kind") == "event_code").orderBy(
        F.desc("count"), "key").limit(top_events)
    return rows.filter(F.col("kind") != "event_code").unionByName(events)


def simple_stats(gaps: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return gaps.filter(F.col("news_date") >= since(as_of, days)).agg(
        F.count("*").alias("total_count"),
        F.count_if(F.col("direction") == "OVER").alias("over_count"),
        F.count_if(F.col("direction") == "UNDER").alias("under_count"),
        F.avg(F.col("z_score").cast("double")).alias("avg_z_score"))


def scan_summary(gaps: DataFrame) -> DataFrame:
    """(kind, key, count) by direction, magnitude and mode, and the total."""
    counted = gaps.groupingSets(
        [[], ["direction"], ["magnitude"], ["calc_mode"]], "direction", "magnitude", "calc_mode"
    ).agg(F.count("*").alias("count"), F.grouping_id().alias("gid"))
    kind = (F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "direction")
            .when(F.col("gid") == 5, "magnitude").otherwise("calc_mode"))
    return counted.select(kind.alias("kind"),
                          F.coalesce("direction", "magnitude", "calc_mode").alias("key"), "count")


def strongest(gaps: DataFrame, top: int = 5) -> DataFrame:
    return gaps.orderBy(F.abs("z_score").desc(), "news_id", "stock_code", "event_code").limit(top)


def monitor_rows(gaps: DataFrame, text: str = "", directions=("OVER", "UNDER"),
                 magnitudes=("MODERATE", "HIGH", "EXTREME"), min_z: float = 0.0) -> DataFrame:
    """The monitor table: substring, direction, magnitude and |z| filters, then one row per
    (stock, event, date, direction, magnitude, z to two digits); of equals the first news id."""
    q = text.strip().lower()
    matches = (F.lower("stock_name").contains(q) | F.col("stock_code").contains(q)) if q else None
    kept = _where(
        gaps, matches, F.col("direction").isin(*directions), F.col("magnitude").isin(*magnitudes),
        F.coalesce(F.abs("z_score"), F.lit(0.0)) >= min_z)
    keys = ["stock_code", "event_code", "news_date", "direction", "magnitude"]
    z2 = F.floor(F.coalesce(F.col("z_score").cast("double"), F.lit(0.0)) * 100 + 0.5)
    return (
        kept.groupBy(*keys, z2.alias("z100"))
        .agg(F.min_by(F.struct("news_id", "stock_name", "z_score"), "news_id").alias("first"))
        .select(*keys, "first.stock_name", "first.z_score", "first.news_id")
    )


def event_performance(gaps: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Mean realised and expected return, mean z and count per event code."""
    return gaps.filter(F.col("news_date") >= since(as_of, days)).groupBy("event_code").agg(
        F.avg(F.col("actual_return").cast("double")).alias("avg_actual_return"),
        F.avg(F.col("expected_return").cast("double")).alias("avg_expected_return"),
        F.avg(F.col("z_score").cast("double")).alias("avg_z_score"),
        F.count("*").alias("count"))


def gap_vs_return(gaps: DataFrame, returns: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Gaps of the last days next to the stored returns of the same (news, stock, event)."""
    recent = gaps.filter(F.col("news_date") >= since(as_of, days)).select(
        "news_id", "stock_code", "event_code", "news_date", "z_score", "direction",
        "actual_return")
    stored = returns.select("news_id", "stock_code", "event_code",
                            "return_1d", "return_3d", "return_5d")
    return recent.join(stored, ["news_id", "stock_code", "event_code"])
