"""Gap detection: realised forward returns against the event's learned distribution.

Modes
  SIMPLE   mean and population sigma of `news_returns`, prices within +-5 calendar days
  HISTORY  median and sample sigma of `event_returns_history`, confidence gate (n >= 50 by default)
  POOLED   mean and population sigma over the event's whole category (text before the dot)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from newswake.functions import scores
from newswake.operators import expectation as ex

SIGNAL_COLUMNS = (
    "news_id", "news_title", "stock_code", "stock_name", "event_code", "news_date", "horizon",
    "actual_return", "expected_return", "expected_std", "z_score", "direction", "magnitude",
    "sample_count", "calc_mode",
)


@dataclass(frozen=True)
class GapRules:
    z_threshold: float = 2.0
    min_samples: int = 10
    min_confidence: float = 0.5
    lookback_days: int = 365
    price_pad_days: int = 5


def score(facts: DataFrame, actual: Column, centre: Column, sigma: Column, count: Column,
          mode: str, horizon: Column | int = 1, four_grades: bool = True) -> DataFrame:
    """Add the scored columns of a gap row; rows that cannot be scored get a null z."""
    z = scores.z_score(actual, centre, sigma)
    return (
        facts.withColumn("horizon", F.lit(horizon) if isinstance(horizon, int) else horizon)
        .withColumn("actual_return", actual)
        .withColumn("expected_return", centre)
        .withColumn("expected_std", sigma)
        .withColumn("z_score", z)
        .withColumn("direction", scores.direction(F.col("z_score")))
        .withColumn("magnitude", scores.magnitude(F.col("z_score"), four_grades))
        .withColumn("sample_count", count)
        .withColumn("calc_mode", F.lit(mode))
    )


def _gate(scored: DataFrame, rules: GapRules) -> DataFrame:
    return scored.filter(F.abs(F.col("z_score")) >= rules.z_threshold)


def detect_simple(anchored: DataFrame, stats: DataFrame, rules: GapRules = GapRules()
                  ) -> DataFrame:
    """SIMPLE gaps. `stats` is `event_stats` output, or `rolling_event_stats` for point in time.

    With rolling stats the row of the news day itself is used; a day without returns of that
    event has no row there, so callers pass stats that were rolled over the news returns.
    """
    on = ["event_code"] + (["news_date"] if "day" in stats.columns else [])
    look = stats.withColumnsRenamed({"stat_key": "event_code", "day": "news_date"})
    joined = anchored.filter(F.col("return_1d").isNotNull()).join(
        look.filter(F.col("cnt") >= rules.min_samples), on)
    return _gate(score(joined, F.col("return_1d"), F.col("mean"), F.col("std"), F.col("cnt"),
                       "SIMPLE"), rules).select(*SIGNAL_COLUMNS)


def detect_pooled(anchored: DataFrame, pooled_stats: DataFrame, rules: GapRules = GapRules()
                  ) -> DataFrame:
    """Gaps against the whole category. `pooled_stats` is keyed by `event_prefix`."""
    look = pooled_stats.filter(F.col("cnt") >= rules.min_samples)
    joined = (anchored.filter(F.col("return_1d").isNotNull())
              .withColumn("stat_key", ex.event_prefix(F.col("event_code")))
              .join(look, "stat_key"))
    return _gate(score(joined, F.col("return_1d"), F.col("mean"), F.col("std"), F.col("cnt"),
                       "POOLED", four_grades=False), rules).select(*SIGNAL_COLUMNS)


def detect_history(anchored: DataFrame, stats: DataFrame, rules: GapRules = GapRules(),
                   horizons=(1,)) -> DataFrame:
    """HISTORY gaps over one or more horizons, with the quartiles and confidence they came from.

    `stats` is `expectation_stats` output (already gated on its own minimum sample count).
    """
    by_horizon = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"return_{h}d").alias("ret"))
        for h in horizons
    ]))
    keep = [c for c in anchored.columns if not c.startswith("return_")]
    long = (anchored.select(*keep, by_horizon.alias("p"))
            .select(*keep, "p.horizon", F.col("p.ret").alias("ret"))
            .filter(F.col("ret").isNotNull()))
    look = stats.filter(F.col("confidence") >= rules.min_confidence).withColumnRenamed(
        "sample_count", "n")
    joined = long.join(look, ["event_code", "horizon"])
    scored = score(joined, F.col("ret"), F.col("median"), F.col("std"), F.col("n"), "HISTORY",
                   F.col("horizon"), four_grades=False)
    return _gate(scored, rules).select(
        *SIGNAL_COLUMNS, "anchor_date", F.col("mean").alias("expected_mean"),
        F.col("q25").alias("expected_q25"), F.col("q75").alias("expected_q75"), "confidence")


def detect_with_fallback(anchored: DataFrame, history_stats: DataFrame,
                         simple_stats: DataFrame, rules: GapRules = GapRules()) -> DataFrame:
    """HISTORY where it signals, else SIMPLE where that does.

    `anchored` comes from a calendar without a pad. SIMPLE also runs for facts whose HISTORY
    score stayed under the threshold. Both verdicts are taken in one pass over the facts: the
    stats sides are the only joins, the facts never meet themselves.
    """
    padded = pad_returns(anchored, rules.price_pad_days)
    hist = history_stats.filter(
        (F.col("horizon") == 1) & (F.col("confidence") >= rules.min_confidence)
    ).select("event_code", F.col("median").alias("h_centre"), F.col("std").alias("h_std"),
             F.col("sample_count").alias("h_n"))
    on = ["event_code"] + (["news_date"] if "day" in simple_stats.columns else [])
    simple = simple_stats.filter(F.col("cnt") >= rules.min_samples).withColumnsRenamed(
        {"stat_key": "event_code", "day": "news_date", "mean": "s_centre", "std": "s_std",
         "cnt": "s_n"})
    both = padded.join(hist, "event_code", "left").join(simple, on, "left")

    z_h = scores.z_score(F.col("return_1d"), F.col("h_centre"), F.col("h_std"))
    z_s = scores.z_score(F.col("padded_return_1d"), F.col("s_centre"), F.col("s_std"))

    def verdict(z, actual, centre, std, n, mode, four):
        return F.when(F.abs(z) >= rules.z_threshold, F.struct(
            actual.alias("actual_return"), centre.alias("expected_return"),
            std.alias("expected_std"), z.alias("z_score"),
            scores.direction(z).alias("direction"),
            scores.magnitude(z, four).alias("magnitude"),
            n.cast("long").alias("sample_count"), F.lit(mode).alias("calc_mode")))

    picked = F.coalesce(
        verdict(z_h, F.col("return_1d"), F.col("h_centre"), F.col("h_std"), F.col("h_n"),
                "HISTORY", False),
        verdict(z_s, F.col("padded_return_1d"), F.col("s_centre"), F.col("s_std"), F.col("s_n"),
                "SIMPLE", True))
    return (
        both.withColumn("g", picked).filter(F.col("g").isNotNull())
        .withColumn("horizon", F.lit(1))
        .select("news_id", "news_title", "stock_code", "stock_name", "event_code", "news_date",
                "horizon", "g.*")
        .select(*SIGNAL_COLUMNS)
    )


def pad_returns(anchored: DataFrame, pad_days: int) -> DataFrame:
    """Add `padded_return_1d`: the 1-day return when both its prices lie within the pad."""
    near = F.col("date_1d") <= F.date_add("news_date", pad_days)
    return anchored.withColumn("padded_return_1d", F.when(near, F.col("return_1d")))
