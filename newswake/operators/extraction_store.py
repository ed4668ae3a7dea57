"""Results of company extraction kept by what they depend on, so that a text is read once.

A result depends on the text, its title, a provider's answers and the dictionary. The first three give
the key of a row, the dictionary gives the version; below the store's folder lie, partitioned by
version,

    (key, companies array<company, status, confidence, relevance, rank>)

one row a key, also where nothing was found. A run looks up its keys, extracts only what is missing,
each key once however many rows have it, appends it in one write and joins the results back: a run
that finds all its keys starts no Python worker. `expire` drops the results of other dictionaries.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newswake.operators import companies as co
from newswake.sources.writers import drop_partition, exists

RESULT = "array<struct<company: string, status: string, confidence: double, relevance: double, rank: int>>"
SCHEMA = f"key string, companies {RESULT}, version string"


def dictionary_version(patterns: DataFrame, master: DataFrame) -> str:
    """A digest of the rows of a dictionary, in whatever order they come; equal rows count each."""
    def digest(rows: DataFrame) -> str:
        columns = sorted(rows.columns)
        h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns], F.lit(",".join(columns)))
        r = rows.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
        return ":".join(map(str, r))

    text = digest(patterns.select("alias", "company", "weight")) + "|" + digest(master)
    return uuid.uuid5(uuid.NAMESPACE_OID, text).hex


def row_key(text: Column, title: Column | None = None, provided: Column | None = None) -> Column:
    """SHA-256 of what a result depends on, each part with its length so that parts cannot run together."""
    parts = [text, *([title] if title is not None else [])]
    if provided is not None:
        parts.append(F.to_json(F.struct(F.sort_array(provided).alias("p"))))
    framed = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*framed), 256)


def stored(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(key, companies) of a dictionary."""
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA).drop("version")
    return spark.read.schema(SCHEMA).parquet(path).filter(F.col("version") == version).drop("version")


def missing(docs: DataFrame, path: str, version: str) -> DataFrame:
    """One row of each key (`key`) that has no result yet."""
    new = docs.join(stored(docs.sparkSession, path, version).select("key"), "key", "left_anti")
    return new.groupBy("key").agg(F.first(F.struct(*[c for c in new.columns if c != "key"])).alias("r")).select("key", "r.*")


def extract(docs: DataFrame, patterns: DataFrame, master: DataFrame, path: str, id_col: str = "doc_id",
            text_col: str = "text", title_col: str | None = None, provider_col: str | None = None) -> DataFrame:
    """`companies.extract` through the store at `path`: a row of ids that repeat or are missing has its
    companies like any other."""
    spark = docs.sparkSession
    version = dictionary_version(patterns, master)
    inputs = [c for c in (text_col, title_col, provider_col) if c]
    key = row_key(F.col(text_col), F.col(title_col) if title_col else None, F.col(provider_col) if provider_col else None)
    keyed = docs.select(id_col, *inputs, key.alias("key"))
    new = missing(keyed.select("key", *inputs), path, version)
    if not new.isEmpty():
        found = co.extract(new, patterns, master, "key", text_col, title_col, provider_col)
        listed = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(
            "rank", "company", "status", "confidence", "relevance"))).alias("c"))
        result = F.transform("c", lambda c: F.struct(c["company"].alias("company"), c["status"].alias("status"),
                                                     c["confidence"].alias("confidence"), c["relevance"].alias("relevance"),
                                                     c["rank"].alias("rank")))
        rows = new.select("key").join(listed, "key", "left").select(
            "key", F.coalesce(result, F.array()).cast(RESULT).alias("companies"), F.lit(version).alias("version"))
        rows.write.mode("append").partitionBy("version").parquet(path)
    return (keyed.select(id_col, "key").join(stored(spark, path, version), "key")
            .select(id_col, F.explode("companies").alias("c")).select(id_col, "c.*"))


def expire(spark: SparkSession, path: str, keep: list[str]) -> None:
    """Drop the results of all dictionaries but those of the versions named."""
    if not exists(spark, path):
        return
    for r in spark.read.schema(SCHEMA).parquet(path).select("version").distinct().collect():
        if r.version not in keep:
            drop_partition(spark, path, f"version={r.version}")
