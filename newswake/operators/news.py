"""From analysed news rows to (news, company, event) facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newswake.functions.text import comma_list, each


def company_list(raw: Column) -> Column:
    return comma_list(raw)


def event_list(raw: Column) -> Column:
    """Comma list without blanks and without `other` in any case."""
    return F.filter(comma_list(raw), lambda e: F.lower(e) != "other")


def explode_news(news: DataFrame) -> DataFrame:
    """One row per (news, company, event), in the order of the two lists; repeats are kept."""
    return (
        news.filter(F.col("companies").isNotNull() & F.col("event_codes").isNotNull())
        .withColumn("event_code", each(event_list(F.col("event_codes"))))
        .withColumn("company", each(company_list(F.col("companies"))))
        .filter(F.col("event_code").isNotNull() & F.col("company").isNotNull())
        .drop("companies", "event_codes")
    )


def attach_codes(facts: DataFrame, alias_map: DataFrame) -> DataFrame:
    """Inner join on the company name; names without a code drop out.

    `alias_map` is (company, stock_code) with one row per name. It is left to the size-based
    broadcast decision of the planner and of adaptive execution, as it grows with the listings.
    """
    return facts.join(alias_map, "company").withColumnRenamed("company", "stock_name")


def news_facts(news: DataFrame, alias_map: DataFrame) -> DataFrame:
    return attach_codes(explode_news(news), alias_map)
