"""Similar cases of a query and the patterns in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newswake.functions.text import text_array


def similarity(companies: Column, events: Column, q_companies: Column, q_events: Column,
               score: Column, steps: tuple[float, float] = (20.0, 10.0)) -> Column:
    """Share of query features the case has, +0.1 or +0.05 for a high search score, at most 1.

    Null features count as none; a query without features gives 0.
    """
    n = F.size(q_companies) + F.size(q_events)
    none = F.array().cast("array<string>")
    hit = (F.size(F.array_intersect(q_companies, F.coalesce(companies, none)))
           + F.size(F.array_intersect(q_events, F.coalesce(events, none))))
    share = hit / F.greatest(n, F.lit(1))
    high, low = steps
    lifted = (F.when(score > high, F.least(F.lit(1.0), share + 0.1))
              .when(score > low, F.least(F.lit(1.0), share + 0.05)).otherwise(share))
    return F.when(n > 0, lifted).otherwise(0.0)


def similar_cases(docs: DataFrame, companies: Sequence[str], events: Sequence[str], start: Column,
                  end: Column, min_similarity: float = 0.0, size: int | None = None) -> DataFrame:
    """All documents that share a company or an event with the query, graded by `similarity`; with
    `size` only the first ones by (score, date).

    A matching feature group scores 1, as the search engine's constant term queries do.
    """
    q_companies, q_events = text_array(companies), text_array(events)
    by_company = F.coalesce(F.arrays_overlap("companies", q_companies), F.lit(False))
    wants_event = bool(events) and list(events) != ["other"]
    by_event = (F.coalesce(F.arrays_overlap("event_codes", q_events), F.lit(False))
                if wants_event else F.lit(False))
    score = by_company.cast("double") + by_event.cast("double")
    hits = (docs.filter(F.col("published_at").between(start, end) & (by_company | by_event))
            .withColumn("score", score))
    if size is not None:
        hits = hits.orderBy(F.desc("score"), F.desc("published_at"), "id").limit(size)
    graded = hits.withColumn("similarity", F.round(similarity(
        F.col("companies"), F.col("event_codes"), q_companies, q_events, F.col("score")), 2))
    return graded.filter(F.col("similarity") >= min_similarity)


def top_cases(cases: DataFrame, top: int = 20) -> DataFrame:
    return cases.orderBy(F.desc("similarity"), F.desc("published_at"), "id").limit(top)


def frequent(cases: DataFrame, list_col: str, top: int = 3, least: int = 3) -> DataFrame:
    """(value, count, share): the most frequent list values, if the first reaches `least`.

    Ties go to the smaller value. The share is of all cases, at most 1.
    """
    total = cases.agg(F.count("*").alias("n")).scalar()
    counted = (cases.select(F.explode(list_col).alias("value")).groupBy("value")
               .agg(F.count("*").alias("count")).filter(F.col("count") >= least)
               .orderBy(F.desc("count"), "value").limit(top))
    return counted.withColumn("share", F.least(F.lit(1.0), F.col("count") / total))


def recency(cases: DataFrame, as_of: Column, days: int = 30, least: int = 5) -> DataFrame:
    """One row: dated cases, those of the last days, their share and whether it is a spike."""
    dated = cases.filter(F.col("published_at").isNotNull())
    age = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("published_at")) / 86400)
    return dated.agg(F.count("*").alias("n"), F.count_if(age <= days).alias("recent")).select(
        "n", "recent", F.when(F.col("n") > 0, F.col("recent") / F.col("n")).alias("share"),
        ((F.col("n") >= least) & (F.col("recent") >= F.col("n") * 0.5)).alias("spike"))


def interval_groups(events: DataFrame, keys: list[str], date_col: str, least: int = 5
                    ) -> DataFrame:
    """Mean days between consecutive cases per group, and whether that is quarterly.

    The mean gap of sorted dates is (last - first) / (n - 1): no sort and no window are needed.
    """
    span = F.datediff(F.max(date_col), F.min(date_col))
    return (
        events.filter(F.col(date_col).isNotNull()).groupBy(*keys)
        .agg(F.count("*").alias("n"), span.alias("span")).filter(F.col("n") >= least)
        .select(*keys, "n", (F.col("span") / (F.col("n") - 1)).alias("mean_gap"))
        .withColumn("quarterly", F.col("mean_gap").between(80, 100)))


def mean_interval(cases: DataFrame, least: int = 5) -> DataFrame:
    """One row (n, mean_gap): mean of the whole days between consecutive cases.

    Gaps are taken inside blocks of 30 days, which many tasks share, and then from block to block:
    only the first and last case of each block of the time span meet in one window.
    """
    t = F.unix_timestamp("published_at")
    dated = cases.filter(F.col("published_at").isNotNull()).select(t.alias("t")).withColumn(
        "block", F.floor(F.col("t") / (30 * 86400)))
    days = lambda b, a: F.floor((b - a) / 86400)
    # cases of one instant have no days between them, so one of them stands for all
    instants = dated.groupBy("block", "t").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("block").orderBy("t")
    blocks = (instants.withColumn("gap", days(F.col("t"), F.lag("t").over(inside))).groupBy("block")
              .agg(F.sum("n").alias("n"), F.sum("gap").alias("gap"), F.min("t").alias("first"),
                   F.max("t").alias("last")))
    across = days(F.col("first"), F.lag("last").over(Window.orderBy("block")))
    total = F.coalesce(F.sum("gap"), F.lit(0)) + F.coalesce(F.sum("across"), F.lit(0))
    return (blocks.withColumn("across", across).agg(F.sum("n").alias("n"), total.alias("total"))
            .filter(F.col("n") >= least).select("n", (F.col("total") / (F.col("n") - 1)).alias("mean_gap")))


def gaps_between(events: DataFrame, keys: list[str], date_col: str) -> DataFrame:
    """Days since the previous distinct date of a group; rows per group are bounded by its days."""
    w = Window.partitionBy(*keys).orderBy(date_col)
    days = events.select(*keys, date_col).distinct()
    return days.withColumn("gap", F.datediff(date_col, F.lag(date_col).over(w)))


def outcome_mode(cases: DataFrame, col: str = "trust_outcome") -> DataFrame:
    """(outcome, count, share): the most frequent outcome; ties go to the smaller name."""
    known = cases.filter(F.col(col).isNotNull() & (F.col(col) != ""))
    total = known.agg(F.count("*").alias("n")).scalar()
    return (known.groupBy(F.col(col).alias("outcome")).agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), "outcome").limit(1)
            .withColumn("share", F.col("count") / total))


def mean_similarity(cases: DataFrame, top: int | None = None) -> DataFrame:
    """Over all cases, or the `top` most similar ones."""
    return (cases if top is None else top_cases(cases, top)).agg(F.count("*").alias("n"),
                                     F.avg("similarity").alias("mean_similarity"))


def insights(cases: DataFrame, as_of: Column) -> DataFrame:
    """(pattern_type, value, frequency, confidence): every pattern the cases show."""
    def row(df: DataFrame, kind: str, value: Column, n: Column, conf: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("pattern_type"), value.cast("string").alias("value"),
                         n.cast("long").alias("frequency"), conf.cast("double").alias("confidence"))

    parts = [
        row(frequent(cases, "companies", 1), "frequent_company", F.col("value"), F.col("count"),
            F.col("share")),
        row(frequent(cases, "event_codes", 1), "frequent_event", F.col("value"), F.col("count"),
            F.col("share")),
        row(recency(cases, as_of).filter("spike"), "recent_spike", F.lit(None), F.col("recent"),
            F.col("share")),
        row(mean_interval(cases).filter(F.col("mean_gap").between(80, 100)), "quarterly_pattern",
            F.floor("mean_gap"), F.col("n"), F.lit(0.7)),
    ]
    if "trust_outcome" in cases.columns:
        parts.append(row(outcome_mode(cases), "trust_pattern", F.col("outcome"), F.col("count"),
                         F.col("share")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
