"""Writing tables: replace, append, export, and upserts that rewrite only touched partitions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newswake.operators.upsert import upsert
from newswake.session import checkpoint_dir


def replace(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option(
        "escape", '"').csv(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once to a work folder on shared storage and read back."""
    path = f"{checkpoint_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def month_of(date_col: str) -> Column:
    return F.date_format(date_col, "yyyy-MM")


def upsert_table(incoming: DataFrame, path: str, keys: list[str], date_col: str,
                 update_cols: list[str] | None = None) -> None:
    """Merge rows into a Parquet table kept in month partitions of `date_col` (one for null dates).

    Rows keyed to the same key must be reduced to one before. Read and rewritten are the months of
    the incoming rows and those where their keys are stored. The new partitions are written beside
    the old ones and swapped in by the commit of the job, so a lost executor or a failed job leaves
    the table as it was; a month that its only rows have left is removed after that.
    """
    spark = incoming.sparkSession
    fresh = incoming.withColumn("month", month_of(date_col))
    if not exists(spark, path):
        replace(fresh, path, "month")
        return
    fresh = kept(fresh)  # read several times below
    stored = spark.read.option("mergeSchema", "true").parquet(path).withColumn(
        "month", F.col("month").cast("string"))
    held = stored.join(fresh.select(*keys), keys, "left_semi").select("month")
    # partition names, at most one a month, so that the scan below is pruned by them
    months = [r.month for r in fresh.select("month").unionByName(held).distinct().collect()]
    touched = F.col("month").isin([m for m in months if m is not None])
    if None in months:
        touched = touched | F.col("month").isNull()
    new = fresh.select(*keys, F.col("month").alias("new"))

    def moved(table: DataFrame) -> DataFrame:
        """Months with rows whose keys now belong to another month."""
        both = table.select(*keys, F.col("month").alias("old")).join(new, keys)
        return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("old").distinct()

    dates_change = update_cols is None or date_col in update_cols
    left = moved(stored.filter(touched)).collect() if dates_change else []
    merged = upsert(stored.filter(touched).select(*fresh.columns), fresh, keys, update_cols)
    merged = merged.withColumn("month", month_of(date_col))
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("month").parquet(path))
    if left:  # a month that lost its last row got no new partition, and still has the old one
        table = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
        for r in moved(table).collect():
            drop_partition(spark, path, f"month={r.old or '__HIVE_DEFAULT_PARTITION__'}")


def drop_partition(spark: SparkSession, path: str, name: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
