"""Dictionary files: alias JSON, synonym text, label registry, keyword lexicon, learned aliases."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newswake.operators.labels import Label, build_registry


def alias_lists(spark: SparkSession, path: str) -> DataFrame:
    """(company, alias, ord) from `{name: [alias, ..., code]}` JSON."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", T.MapType(
        T.StringType(), T.ArrayType(T.StringType()))).alias("m"))
    return (parsed.select(F.explode("m").alias("company", "list"))
            .select("company", F.posexplode("list").alias("ord", "alias")))


def alias_map(aliases: DataFrame, six_digits: bool = False) -> DataFrame:
    """(company, stock_code): every official name and alias with the list's first digit-only code.

    Lists without a code drop out. A name in several lists takes the one of the greatest official
    name, so that the result does not depend on the order of reading.
    """
    is_code = F.col("alias").rlike(r"^\d{6}$" if six_digits else r"^\d+$")
    code = (aliases.filter(is_code).groupBy("company")
            .agg(F.min_by("alias", "ord").alias("stock_code")))
    names = aliases.filter(~F.col("alias").rlike(r"^\d+$")).join(code, "company").select(
        F.col("alias").alias("name"), "stock_code", F.col("company").alias("official"))
    own = code.select(F.col("company").alias("name"), "stock_code", F.col("company").alias("official"))
    return (own.unionByName(names).groupBy("name")
            .agg(F.max_by("stock_code", "official").alias("stock_code"))
            .withColumnRenamed("name", "company"))


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(alias, code, ord) from `alias1, alias2 => code` lines; `#` starts a comment line."""
    lines = spark.read.text(path).select(
        F.trim("value").alias("line"), F.monotonically_increasing_id().alias("n"))
    rules = lines.filter(~F.col("line").startswith("#") & F.col("line").contains("=>"))
    sides = F.split("line", "=>", 2)
    return (rules.select(F.trim(sides[1]).alias("code"), "n",
                         F.posexplode(F.split(sides[0], ",")).alias("i", "alias"))
            .select(F.lower(F.trim("alias")).alias("alias"), "code",
                    F.struct("n", "i").alias("ord"))
            .filter(F.col("alias") != ""))


def synonym_list(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The synonym file as the literal list the column functions take."""
    rows = synonyms(spark, path).orderBy("ord").collect()
    return [(r.alias, r.code) for r in rows]


def _merged(into: dict, more: dict) -> dict:
    for key, value in more.items():
        both = isinstance(value, dict) and isinstance(into.get(key), dict)
        into[key] = _merged(into[key], value) if both else value
    return into


def _whole(spark: SparkSession, path: str) -> dict:
    """The JSON object of a file, or of all files of a folder: entries of later names go on top."""
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("name")).orderBy("name")
    out: dict = {}
    for r in files.collect():  # configuration files
        _merged(out, json.loads(r.value))
    return out


def label_registry(spark: SparkSession, path: str, profile: str | None = None) -> list[Label]:
    """Labels from `{labels: {name: {fine, priority, triggers}}, profiles: {p: {name: priority}}}`."""
    data = _whole(spark, path)
    return build_registry(data["labels"], data.get("profiles", {}).get(profile, {}))


def keyword_lexicon(spark: SparkSession, path: str) -> dict:
    """`{category: {group: [keyword]}}`; the signal lists stand under the category `signal`."""
    return _whole(spark, path)


def save_learned(learned: DataFrame, path: str) -> None:
    learned.write.mode("overwrite").json(path)


def load_learned(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("alias string, official string, similarity double").json(path)


def merge_learned(known: DataFrame, learned: DataFrame) -> DataFrame:
    """Known aliases plus the learned ones that are new; of repeats the most similar stays."""
    best = learned.groupBy("alias").agg(
        F.max_by(F.struct("official", "similarity"), "similarity").alias("b"))
    return known.unionByName(best.select("alias", "b.official", "b.similarity").join(
        known.select("alias"), "alias", "left_anti"))
