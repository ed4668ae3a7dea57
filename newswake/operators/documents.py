"""Article rows to search documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newswake.functions import dates, ids, text as tx
from newswake.functions.words import EVENT_NAMES
from newswake.operators.labels import synonym_events
from newswake.schemas import NEWS_DOCUMENT, conform


def normalise_company(name: Column) -> Column:
    return tx.strip_company_form(name)


def build(articles: DataFrame, synonyms: Sequence[tuple[str, str]] = (),
          provider_labels: Column | None = None, provider_phrases: Column | None = None,
          provider_confidence: Column | None = None) -> DataFrame:
    """The document table from (title, published_at text, publisher, category, url, stock_name, body).

    Events come from a provider's columns where they are not null, else from the synonym list.
    One projection without any shuffle; rows that cannot be dated keep a null date.
    """
    url = F.trim(F.coalesce("url", F.lit("")))
    keys = tx.article_keys(url)
    base = articles.select(
        "*",
        tx.normalize_title(F.col("title")).alias("_title"),
        dates.published_at(F.col("published_at")).alias("_at"),
        url.alias("_url"), keys["oid"].alias("_oid"), keys["aid"].alias("_aid"),
        tx.canonical_url(url).alias("_canonical"),
        tx.split_companies(F.col("stock_name")).alias("_raw"))
    iso = F.date_format(dates.seoul_clock(F.col("_at")), "yyyy-MM-dd'T'HH:mm:ss'+09:00'")
    names = tx.distinct_names(F.transform("_raw", normalise_company))
    by_rule = synonym_events(F.col("_title"), synonyms) if synonyms else None
    none = F.array().cast("array<string>")
    rule_codes = F.transform(by_rule, lambda e: e["code"]) if synonyms else none
    label_map = F.create_map(*[x for k, v in EVENT_NAMES.items() for x in (F.lit(k), F.lit(v))])
    rule_names = F.transform(rule_codes, lambda c: F.coalesce(label_map[c], c))
    rule_conf = (F.array_max(F.transform(by_rule, lambda e: e["confidence"])) if synonyms
                 else F.lit(None).cast("double"))
    codes = rule_codes if provider_labels is None else F.coalesce(provider_labels, rule_codes)
    events = rule_names if provider_phrases is None else F.coalesce(provider_phrases, rule_names)
    conf = rule_conf if provider_confidence is None else F.coalesce(provider_confidence, rule_conf)
    rows = base.select(
        ids.document_id(F.col("_oid"), F.col("_aid"), F.col("_canonical"), F.col("_url"),
                        F.col("_title"), iso).alias("id"),
        F.col("_oid").alias("oid"), F.col("_aid").alias("aid"), F.col("_title").alias("title"),
        tx.keyphrases(F.col("_title")).alias("keyphrases"),
        ids.simhash64(F.col("_title")).alias("title_simhash"),
        F.col("_at").alias("published_at"), F.trim(F.coalesce("publisher", F.lit("")))
        .alias("publisher"), tx.publisher_tier(F.col("publisher")).alias("publisher_tier"),
        F.trim(F.coalesce("category", F.lit(""))).alias("category"),
        F.col("_url").alias("url"), F.col("_canonical").alias("canonical_url"),
        names.alias("companies"), F.transform(names, lambda n: F.lower(n)).alias("companies_kw"),
        F.col("_raw").alias("companies_raw"), none.alias("tickers"), events.alias("events"),
        codes.alias("event_codes"), conf.alias("event_conf"),
        F.col("body"))
    return conform(rows, NEWS_DOCUMENT)


def add_tickers(documents: DataFrame, alias_map: DataFrame) -> DataFrame:
    """Fill `tickers` from (company, stock_code) by a join on single names."""
    named = documents.select("id", F.explode("companies").alias("company")).join(
        alias_map, "company").groupBy("id").agg(
        F.array_sort(F.collect_set("stock_code")).alias("_tickers"))
    return (documents.join(named, "id", "left")
            .withColumn("tickers", F.coalesce("_tickers", "tickers")).drop("_tickers"))


def from_preprocessed(rows: DataFrame) -> DataFrame:
    """Documents from text columns of a preprocessed file: list, number and vector fields parsed."""
    have = set(rows.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    lists = ("keyphrases", "companies", "companies_kw", "companies_raw", "tickers", "events",
             "event_codes")
    parsed = rows.select(
        *[text(c).alias(c) for c in ("id", "oid", "aid", "title", "title_simhash", "publisher",
                                     "category", "url", "canonical_url", "body")],
        dates.published_at(text("published_at")).alias("published_at"),
        *[tx.parse_list(text(c)).alias(c) for c in lists],
        tx.parse_float(text("publisher_tier"), 0.5).alias("publisher_tier"),
        F.when(F.trim(text("event_conf")) != "", tx.parse_float(text("event_conf"), 1.0))
        .alias("event_conf"),
        tx.parse_vector(text("embedding")).alias("embedding"))
    return conform(parsed, NEWS_DOCUMENT)


def quarantine(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): documents without an id, title or date are set aside."""
    ok = (F.col("id").isNotNull() & (F.coalesce(F.length("title"), F.lit(0)) > 0)
          & F.col("published_at").isNotNull())
    return documents.filter(ok), documents.filter(~ok)
