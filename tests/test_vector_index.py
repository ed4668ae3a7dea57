"""The partitioned vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newswake.operators import search as se, vector_index as vi

SCHEMA = "id long, v array<double>, day date"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.35 * rng.normal(size=16)).tolist()) for i in range(900)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [1.0] * 15), (1003, [float("nan")] + [1.0] * 15), (None, [1.0] * 16)]
    rows += [(1004 + i, rows[5][1]) for i in range(3)]
    return spark.createDataFrame([(*r, None) for r in rows], SCHEMA).withColumn(
        "day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 100).cast("int"))).repartition(4)


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    vi.build(vectors, path, "id", "v", "day", width=16, lists=12, parts=4, codes=32)
    return vi.opened(spark, path)


def asked(vectors, which="id % 30 = 0"):
    return vectors.filter(which).select(F.col("id").alias("query_id"), F.col("v").alias("q"))


def test_every_usable_row_is_indexed_once(index):
    rows = index.rows().groupBy("id").count().collect()
    assert {r.id for r in rows} == {*range(900), 1004, 1005, 1006} and all(r["count"] == 1 for r in rows)


def test_recall_with_few_lists(index, vectors):
    queries = asked(vectors)
    found = vi.search(index, queries, 10, probes=3, rerank=60, block=7)
    want = vi.exact(vectors, queries.collect(), "id", "v", 10, 16)
    got = vi.recall(found, want).first()
    assert got.queries == 30 and got.recall >= 0.9
    assert found.groupBy("query_id").count().filter("count <> 10").count() == 0


def test_recall_does_not_fall_with_the_rows(spark, index, vectors):
    queries = asked(vectors)
    want = vi.exact(vectors, queries.collect(), "id", "v", 10, 16)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:  # 25 rows of every batch of 50, not of the whole table
        found = vi.search(index, queries, 10, probes=12, rerank=25)
        assert vi.recall(found, want).first().recall >= 0.9
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan  # no candidates move to be met with their vectors
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_all_lists_and_ranges_are_exact(index, vectors):
    q = vectors.filter("id = 7").select("v").scalar()
    start, end = F.lit("2024-02-01").cast("date"), F.lit("2024-03-01").cast("date")
    want = se.nearest(vectors.filter("id is not null and id not in (1000, 1001, 1002, 1003)").withColumn("q", q), F.col("q"),
                      "id", "v", 10, start, end, "day").collect()
    got = vi.search(index, asked(vectors, "id = 7"), 10, 12, 1 << 30, start, end).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(r.id, r.score) for r in want] and len(got) == 10
    same = vi.search(index, asked(vectors, "id = 5"), 4, 12, 1 << 30).orderBy("rank").collect()
    assert [r.id for r in same] == [5, 1004, 1005, 1006]  # ties by id


def test_added_rows_are_found_and_unasked_lists_not_read(spark, index, vectors, tmp_path):
    import shutil
    path = str(tmp_path / "copy")
    shutil.copytree(index.path, path)
    copy = vi.opened(spark, path)
    vi.add(vectors.filter("id = 3").withColumn("id", F.lit(5000).cast("long")), copy, "id", "v", "day")
    best = vi.search(copy, asked(vectors, "id = 3"), 2, 2, 50).orderBy("rank").collect()
    assert [r.id for r in best] == [3, 5000]
    plan = copy.rows([4])._jdf.queryExecution().executedPlan().toString()
    assert "list" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_empty_tables(spark, vectors, index, tmp_path):
    none = vi.build(vectors.limit(0), str(tmp_path / "none"), "id", "v", "day", width=16)
    assert vi.search(none, asked(vectors, "id = 3")).collect() == []
    assert vi.search(index, asked(vectors, "id = 1000")).collect() == []
