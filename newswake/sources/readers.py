"""Reading tables, delimited text in several encodings, and incremental slices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# fixed values: encodings tried in turn, with their names on the JVM
ENCODINGS = (("utf-8", "UTF-8"), ("cp949", "x-windows-949"), ("euc-kr", "EUC-KR"))

FILES = "*.{csv,tsv,txt}"

# fixed values: Korean column names of the price files
PRICE_COLUMNS = {"날짜": "trade_date", "종목코드": "stock_code", "종목명": "stock_name",
                 "종가": "close_price"}
ARTICLE_COLUMNS = ("published_at", "category", "title", "publisher", "url", "stock_name")


def table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """The frame over at least as many partitions as there are cores.

    A small file with one row group is one task, which makes text work serial. Inputs that
    already have enough splits, as any large table does, are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def jdbc(spark: SparkSession, url: str, name: str, options: Mapping[str, str] | None = None,
         column: str | None = None, lower=None, upper=None, parts: int = 64) -> DataFrame:
    """A database table; with `column` it is read in ranges by several tasks, not in pages."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    if column:
        reader = (reader.option("partitionColumn", column).option("lowerBound", str(lower))
                  .option("upperBound", str(upper)).option("numPartitions", parts))
    return reader.load()


def separator(path: str) -> str:
    return "\t" if path.lower().endswith((".tsv", ".txt")) else ","


def charsets(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """JVM name of a charset to the files below a path that it decodes, each file in the first of
    ENCODINGS that fits all of its lines.

    Tasks test the lines that are not plain ASCII; one row a file reaches the driver, as does the
    listing of the files anyway. A file that none fits is an error.
    """
    @F.pandas_udf("int")
    def misfits(lines: pd.Series) -> pd.Series:
        def one(raw: bytes) -> int:
            bad = 0
            for bit, (name, _) in enumerate(ENCODINGS):
                try:
                    raw.decode(name)
                except UnicodeDecodeError:
                    bad |= 1 << bit
            return bad
        return lines.map(one).astype("int32")

    # no letter of these charsets has a line feed among its bytes
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", FILES).text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("raw")))
    plain = F.col("raw").cast("string").rlike(r"^[\x00-\x7F]*$")
    found = (lines.select("file", F.when(plain, 0).otherwise(misfits("raw")).alias("bad"))
             .groupBy("file").agg(F.bit_or("bad").alias("bad")).orderBy("file").collect())
    out: dict[str, list[str]] = {}
    for r in found:
        fits = [jvm for bit, (_, jvm) in enumerate(ENCODINGS) if not r["bad"] >> bit & 1]
        if not fits:
            raise ValueError(f"{r['file']} is in none of {[name for name, _ in ENCODINGS]}")
        out.setdefault(fits[0], []).append(unquote(r["file"]))
    return out


def delimited(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
              encoding: str | None = None, sep: str | None = None, multi_line: bool = False) -> DataFrame:
    """A CSV or TSV file or folder, all columns as text, headers trimmed and without a BOM.

    Files are read in their own charsets, unless one is given. With `multi_line` fields may have line
    breaks, and a file is then read by one task; without it large files are split.
    """
    groups = {encoding: [path]} if encoding else charsets(spark, path) or {ENCODINGS[0][1]: [path]}
    if set(groups) != {"UTF-8"}:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    out = None
    for charset, paths in sorted(groups.items()):
        reader = (spark.read.option("header", True).option("sep", sep or separator(path))
                  .option("encoding", charset).option("multiLine", multi_line)
                  .option("escape", '"').option("quote", '"')
                  .option("recursiveFileLookup", "true").option("pathGlobFilter", FILES))
        df = reader.csv([path] if len(groups) == 1 else paths)
        df = df.toDF(*[c.strip().lstrip("\ufeff") for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.select(*columns) if columns else out


def folder(spark: SparkSession, path: str, **kwargs) -> DataFrame:
    """Every delimited file below a folder, with the file each row came from."""
    return delimited(spark, path, **kwargs).withColumn("source_file", F.input_file_name())


def price_file(spark: SparkSession, path: str) -> DataFrame:
    """Daily prices from a file with Korean or English column names."""
    from newswake.functions.dates import to_event_date
    from newswake.operators.prices import pad_code
    from newswake.schemas import DAILY_PRICE, conform
    df = delimited(spark, path)
    df = df.withColumnsRenamed({k: v for k, v in PRICE_COLUMNS.items() if k in df.columns})
    return conform(df.withColumns({
        "trade_date": to_event_date(F.col("trade_date")),
        "stock_code": pad_code(F.col("stock_code")),
        "close_price": F.regexp_replace("close_price", ",", "").try_cast("decimal(15,2)"),
    }), DAILY_PRICE)


def master_file(spark: SparkSession, path: str) -> DataFrame:
    """(name, code, sector, market, type, verified) from a listing file; names of two letters up."""
    df = delimited(spark, path)
    cols = df.columns
    pick = lambda i: F.col(f"`{cols[i]}`") if len(cols) > i else F.lit(None).cast("string")
    name = F.trim(pick(1))
    return df.filter(F.length(name) >= 2).select(
        name.alias("name"), pick(0).alias("code"), pick(2).alias("sector"),
        pick(3).alias("market"), F.lit("listed").alias("type"), F.lit(True).alias("verified"))


def company_json(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from `{categories: {c: {companies: {name: {...}}}}}` JSON."""
    entry = T.MapType(T.StringType(), T.StringType())
    schema = T.StructType([T.StructField("categories", T.MapType(T.StringType(), T.StructType([
        T.StructField("companies", T.MapType(T.StringType(), entry))])))])
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = (raw.select(F.explode("categories").alias("category", "c"))
            .select("category", F.explode("c.companies").alias("name", "i")))
    return rows.select("name", F.col("i")["code"].alias("code"), F.col("i")["sector"].alias("sector"),
                       F.lit(None).cast("string").alias("market"),
                       F.coalesce(F.col("i")["type"], F.lit("listed")).alias("type"),
                       F.lit(True).alias("verified"))


def merge_masters(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first listing plus the names that only the second has."""
    return first.unionByName(second.join(first.select("name"), "name", "left_anti")
                             .select(*first.columns))


def changed_since(rows: DataFrame, since: datetime | Column) -> DataFrame:
    at = F.lit(since)
    return rows.filter((F.col("updated_at") >= at) | (F.col("created_at") >= at))


def last_minutes(rows: DataFrame, now: datetime | Column, minutes: int = 60) -> DataFrame:
    """Rows touched in the last minutes before `now`."""
    start = F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))
    return changed_since(rows, start)


def by_ids(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return rows.join(ids.select(id_col), id_col, "left_semi")


def page(rows: DataFrame, order: Sequence[str | Column], size: int, number: int = 0) -> DataFrame:
    """One page for display. Whole-table work reads the table instead of paging through it."""
    return rows.orderBy(*order).offset(size * number).limit(size)


def tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    return spark.sql("SHOW TABLES" + (f" IN {database}" if database else ""))


def describe(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"DESCRIBE TABLE {name}")
