"""Helpers of this subpackage: input tables, work tables on shared storage, rows as structs.

`rows(df)` packs the columns of a table into one struct, so that an operator's own columns never
clash with those it was given; `unpacked` puts them back beside the operator's results, which
replace given columns of the same name.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: [\x20\x09-\x0D], the white space of words
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session without
    one gets a folder of its own; on a cluster a missing setting is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="newswake-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


_recorders: list[list[str]] = []


@contextmanager
def recorded():
    """The paths of the work tables that are stored inside, for `drop_stored`."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.remove(made)


def drop_stored(spark: SparkSession, paths: list[str]) -> None:
    """Remove work tables whose results have been written."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to shared storage and read back: later steps neither compute them
    again nor depend on shuffle files of an executor that may be lost."""
    path = f"{shared_dir(df.sparkSession)}/newswake-{uuid.uuid4().hex}"
    for made in _recorders:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows(df: DataFrame, **more: Column) -> DataFrame:
    """One struct column `row` of all columns, and further columns computed from the given ones."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     *[v.alias(k) for k, v in more.items()])


def unpacked(df: DataFrame, results: list[str]) -> DataFrame:
    given = [f.name for f in df.schema["row"].dataType.fields]
    fresh = {r.lower() for r in results}
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in given if c.lower() not in fresh],
                     *results)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, though the body uses it many times."""
    return F.transform(F.array(value), body)[0]


def blocks_for(df: DataFrame, size: Column, target: int) -> int:
    """How many blocks of about `target` it takes to hold the sum of `size`: grows with the input."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return max(1, -(-int(total) // target))


def stored_place(df: DataFrame) -> Column:
    """The place of a row of a table read from Parquet: by the number of its part, then its place in
    the file. Sorted rows that were range-partitioned and written are in this order. Rows of a table
    that was not read from files have the places Spark gives them."""
    try:
        df.select("_metadata.row_index", "_metadata.file_name").schema
    except AnalysisException:
        return F.monotonically_increasing_id()
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).try_cast("long")
    return F.shiftleft(F.coalesce(part, F.lit(0).cast("long")), 40) + F.col("_metadata.row_index")
