"""A total order over rows of any number: range-sorted, numbered from 0, stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newswake.llm.tables import stored


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """The rows with `rank`, their place in the order (ties by nothing further: add a unique key).

    One range shuffle. The parts are written in order, counted (one row a part goes to the driver)
    and shifted by the rows before them, so no task ever sorts more than its range."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stored(spread.select("*", F.spark_partition_id().alias("_part"),
                                 F.monotonically_increasing_id().alias("_seq")))
    sizes = (parts.groupBy("_part").agg(F.min("_seq").alias("first"), F.count("*").alias("n"))
             .orderBy("_part").collect())
    shifts, before = [], 0
    for s in sizes:
        shifts.append((s["_part"], before - s["first"]))
        before += s["n"]
    shift = df.sparkSession.createDataFrame(shifts, "_part int, _shift long")
    # one row a part
    return (parts.join(F.broadcast(shift), "_part")
            .withColumn("rank", F.col("_seq") + F.col("_shift")).drop("_part", "_seq", "_shift"))
