"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before kept, and its result is written as Parquet and
read again, so a stage is never computed twice and a lost executor costs one stage at most. All
stages but the last give rows of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newswake.llm import exact_dedup, mixing, packing, quality_rules, simhash
from newswake.llm.tables import drop_stored, recorded, stored, stored_place, table

_work: list[str] = []


def stage(function):
    """When a stage is given documents, those of the stage before it have been written, so the work
    tables behind them go first. The first stage begins a run and leaves what another run's result
    may still read."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if run_stage is not STAGES[0][1]:
            drop_stored(spark, _work)
        _work.clear()
        with recorded() as made:
            found = function(spark, docs, sf_dir)
        _work.extend(made)
        return found
    run_stage.__doc__ = function.__doc__
    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy accepts."""
    return quality_rules.accepted(docs)


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that differs in white space only: the longest, then smallest id."""
    return exact_dedup.keep_one(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return simhash.one_of_each(docs)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which sources are interleaved by their target weights."""
    return mixing.mixed_order(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens.

    The order of the stored documents, which is that of the mixing stage, decides among pieces of
    equal length and numbers the sequences."""
    found = packing.pieces(docs.withColumn("_place", stored_place(docs)), place="_place")
    return packing.pack(found.select("doc_id", "piece", "start", "length",
                                     F.crc32("ids").alias("ids_crc32"), "_place"), place="_place").drop("_place")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near),
          ("source mixing", mixed), ("packing", packed)]

#: The tokenizer, the fingerprints and the packing rounds have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stored(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
