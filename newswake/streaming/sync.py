"""Incremental index sync and streaming views.

Progress is the checkpoint's, not a clock's: rows that arrive while a batch runs are read by the
next one. The event-time views are an addition; with on-time data they equal the batch result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from newswake.operators import search_index as si
from newswake.operators.upsert import latest_per_key


def article_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                   files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def last_touched() -> Column:
    return F.greatest("created_at", "updated_at")


def sync_documents(articles: DataFrame, transform: Callable[[DataFrame], DataFrame],
                   write: Callable[[DataFrame], None], checkpoint: str, id_col: str = "id",
                   every: str | None = "60 seconds") -> StreamingQuery:
    """Run `transform` and `write` on each batch of changed rows, newest version of an id only.

    `write` must be an upsert, so a batch that is repeated after a failure changes nothing.
    With `every=None` all available data is taken once and the query ends.
    """
    def apply(batch: DataFrame, _: int) -> None:
        write(transform(latest_per_key(batch, [id_col], last_touched())))

    writer = articles.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def sync_index(articles: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str,
               fields: Mapping[str, Column], checkpoint: str, name: str, id_col: str = "id",
               every: str | None = "60 seconds") -> StreamingQuery:
    """Index the changed rows of each batch, newest version of an id only.

    The index notes the epoch of every batch under the stream's name, in the same commit. A batch that
    is repeated, after a failure or because the checkpoint was lost, finds its epoch there and is left
    alone.
    """
    def apply(batch: DataFrame, epoch: int) -> None:
        rows = transform(latest_per_key(batch, [id_col], last_touched()))
        si.update(rows, path, fields, id_col, stream=name, epoch=epoch)

    writer = articles.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def dedupe(stream: DataFrame, id_cols: list[str], time_col: str, delay: str = "1 day"
           ) -> DataFrame:
    return (stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
            .withWatermark(time_col, delay).dropDuplicatesWithinWatermark(id_cols))


def tumbling_counts(stream: DataFrame, time_col: str, width: str, by: str, value: str,
                    delay: str = "1 day") -> DataFrame:
    """Rows and mean value per window and key."""
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark(time_col, delay)
    return (timed.groupBy(F.window(time_col, width).alias("w"), by)
            .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
            .select(F.col("w.start").alias("window_start"), by, "n", "total"))


def run_to_path(stream: DataFrame, path: str, mode: str, checkpoint: str) -> None:
    """Drain what is available into a Parquet table on shared storage; a complete result replaces
    the one before, so a batch that is repeated after a failure changes nothing."""
    def write(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(path)
        else:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
