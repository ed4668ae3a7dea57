"""A partitioned index of vectors for cosine search: coarse lists, product-quantised residuals.

Vectors are scaled to length one. A coarse k-means gives `lists` centres; a vector lies in the list of
its nearest one, and what is left of it is cut into `parts` pieces, each written as the number of the
nearest of `codes` pieces of a codebook. Below one folder on shared storage lie

    model   (kind, part, number, v, note): centres, codebooks and the schema of rows; a fixed number of rows
    rows    (id, time, code, v), partitioned by list

A search looks up the lists nearest to a query, adds up a table of inner products by code for every
row there, and takes the exact cosine of the best `rerank` ones of every batch of rows that a task reads,
so that their share stays the same however many rows there are. Lists are partitions, so rows of
others are not read; a list of any size is read by as many tasks as it has splits, and a task passes
on the best k rows of a batch a query, no candidates. Queries are taken in blocks.

Centres and codebooks are learned from at most `sample` vectors, taken by a hash of the id; every
vector is indexed. A task gives sums and counts a centre; Spark adds them up. Rows without an id, and
vectors of another length, with nulls or non-finite values, or of length zero have no cosine and are
not indexed. `search.nearest` is the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SEED = 7


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    centres: np.ndarray
    books: np.ndarray
    """(parts, codes, width / parts)"""
    schema: str

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        every = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        return every if lists is None else every.filter(F.col("list").isin(lists))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1) - 2.0 * (x @ centres.T)).argmin(axis=1)


def usable(vectors: DataFrame, id_col: str, vec_col: str, width: int) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    good = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    long = F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False)) & F.coalesce(long, F.lit(False)))


def k_means(points: DataFrame, start: np.ndarray, rounds: int, cut) -> np.ndarray:
    """Centres (groups, k, width) after some rounds over a table (v). `cut` makes an array (groups,
    rows, width) of a batch of vectors; a group is clustered by itself."""
    centres = start
    for _ in range(rounds):
        now = centres

        def sums(frames: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            groups, k, width = now.shape
            total, count = np.zeros(now.shape), np.zeros((groups, k))
            for frame in frames:
                if not len(frame):
                    continue
                for g, x in enumerate(cut(unit(matrix(frame["v"])))):
                    near = closest(x, now[g])
                    count[g] += np.bincount(near, minlength=k)
                    for d in range(width):
                        total[g, :, d] += np.bincount(near, weights=x[:, d], minlength=k)
            at = np.flatnonzero(count.ravel())
            if len(at):
                yield pd.DataFrame({"at": at, "n": count.ravel()[at], "s": list(total.reshape(-1, width)[at])})

        parts = points.mapInPandas(sums, "at long, n double, s array<double>")
        width = now.shape[2]
        found = parts.groupBy("at").agg(F.sum("n").alias("n"), F.array(*[
            F.sum(F.col("s")[i]) for i in range(width)]).alias("s")).collect()  # a row a centre
        flat = now.reshape(-1, width).copy()
        for r in found:
            flat[r["at"]] = np.array(r["s"]) / r["n"]
        centres = flat.reshape(now.shape)
    return centres


def build(vectors: DataFrame, path: str, id_col: str, vec_col: str, time_col: str | None = None, width: int = 64,
          lists: int = 32, parts: int = 16, codes: int = 64, rounds: int = 6, sample: int = 100_000) -> VectorIndex:
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vec_col, width).select(
        F.col(id_col).alias("id"), (F.col(time_col) if time_col else F.lit(None).cast("date")).alias("time"),
        F.col(vec_col).cast("array<double>").alias("v"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in good.schema) + ", code binary, list int"
    count = good.count()
    learned = good.select("v", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("h"))
    if count > sample:
        learned = learned.filter(F.col("h") < int(sample / count * (1 << 30)))
    first = learned.orderBy("h", "v").limit(max(lists, codes)).select("v").collect()
    if not first:
        books = np.zeros((parts, 1, width // parts))
        return _written(good, path, VectorIndex(spark, path, np.zeros((1, width)), books, schema))
    seeds = unit(np.array([r["v"] for r in first]))
    centres = k_means(learned.select("v"), seeds[None, :lists], rounds, lambda x: x[None])[0]

    def residual(x: np.ndarray) -> np.ndarray:
        rest = x - centres[closest(x, centres)]
        return rest.reshape(len(x), parts, -1).transpose(1, 0, 2)

    books = k_means(learned.select("v"), residual(seeds[:codes]), rounds, residual)
    return _written(good, path, VectorIndex(spark, path, centres, books, schema))


def _written(good: DataFrame, path: str, index: VectorIndex) -> VectorIndex:
    model: list[tuple] = [("schema", 0, 0, None, index.schema)]
    model += [("centre", 0, n, c.tolist(), None) for n, c in enumerate(index.centres)]
    model += [("book", p, n, c.tolist(), None) for p, book in enumerate(index.books) for n, c in enumerate(book)]
    add(good, index, "id", "v", "time", "overwrite")
    spark = good.sparkSession
    spark.createDataFrame(model, "kind string, part int, number int, v array<double>, note string").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/model")
    return index


def opened(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "part", "number").collect()
    centres = np.array([r["v"] for r in rows if r["kind"] == "centre"])
    parts = 1 + max(r["part"] for r in rows if r["kind"] == "book")
    books = np.array([r["v"] for r in rows if r["kind"] == "book"])
    schema = next(r["note"] for r in rows if r["kind"] == "schema")
    return VectorIndex(spark, path, centres, books.reshape(parts, -1, books.shape[1]), schema)


def encoder(index: VectorIndex):
    centres, books = index.centres, index.books

    @F.pandas_udf("list int, code binary")
    def encode(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"list": pd.Series([], dtype="int32"), "code": pd.Series([], dtype=object)})
        x = unit(matrix(vectors))
        near = closest(x, centres)
        rest = (x - centres[near]).reshape(len(x), len(books), -1)
        code = np.stack([closest(rest[:, p], book) for p, book in enumerate(books)], axis=1).astype(np.uint8)
        return pd.DataFrame({"list": near.astype(np.int32), "code": [c.tobytes() for c in code]})
    return encode


def add(vectors: DataFrame, index: VectorIndex, id_col: str, vec_col: str, time_col: str | None = None,
        mode: str = "append") -> None:
    """Index further vectors with the centres and codebooks there are."""
    good = usable(vectors, id_col, vec_col, index.centres.shape[1])
    coded = good.select(F.col(id_col).alias("id"), (F.col(time_col) if time_col else F.lit(None).cast("date")).alias("time"),
                        F.col(vec_col).alias("v"), encoder(index)(F.col(vec_col).cast("array<double>")).alias("c"))
    (coded.select("id", "time", "v", "c.code", "c.list").hint("rebalance", F.col("list"))
     .write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("list").parquet(f"{index.path}/rows"))


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int = 20, rerank: int = 200, start=None,
           end=None, block: int = 256) -> DataFrame:
    """(query_id, id, score, rank): the best k of each query (query_id, q) among the rows of its
    nearest `probes` lists from `start` on and before `end`. Ties by id."""
    width = index.centres.shape[1]
    asked = usable(queries, "query_id", "q", width).select("query_id", F.col("q").cast("array<double>").alias("q"))
    out = None
    for part in _blocks(asked, block):
        found = _search(index, part, k, probes, rerank, start, end)
        out = found if out is None else out.unionByName(found)
    if out is not None:
        return out
    none = index.rows().limit(0).select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "id")
    return none.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))


def _blocks(asked: DataFrame, block: int) -> Iterator[list]:
    """Lists of at most `block` queries; one block is on the driver at a time."""
    held = []
    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def _search(index: VectorIndex, asked: list, k: int, probes: int, rerank: int, start, end) -> DataFrame:
    centres, books = index.centres, index.books
    q = unit(np.array([r["q"] for r in asked]))
    names = np.array([r["query_id"] for r in asked], dtype=object)
    parts, codes, piece = books.shape
    by_centre = q @ centres.T
    # nearest centres, as vectors were assigned
    order = np.argsort((centres ** 2).sum(axis=1) - 2.0 * by_centre, axis=1, kind="stable")[:, :probes]
    probing = np.zeros((len(q), len(centres)), dtype=bool)
    np.put_along_axis(probing, order, True, axis=1)
    tables = np.einsum("qpd,pcd->qpc", q.reshape(len(q), parts, piece), books)

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            number, ids = frame["list"].to_numpy(), frame["id"].to_numpy()
            place = np.unique(ids, return_inverse=True)[1]
            x = unit(matrix(frame["v"]))
            open_rows = probing[:, number]
            few = rerank < len(frame)
            if few:
                code = np.frombuffer(b"".join(frame["code"]), np.uint8).reshape(len(frame), parts)
                about = by_centre[:, number]
                for p in range(parts):
                    about += tables[:, p, code[:, p]]
                about[~open_rows] = -np.inf
            found = []
            for i in range(len(q)):
                if few:
                    near = np.argpartition(-about[i], rerank)[:rerank]
                    near = near[open_rows[i, near]]
                else:
                    near = np.flatnonzero(open_rows[i])
                score = np.round(x[near] @ q[i], 6)
                top = np.lexsort((place[near], -score))
                again = np.zeros(len(top), dtype=bool)  # an id that was added twice
                again[1:] = (place[near[top[1:]]] == place[near[top[:-1]]]) & (score[top[1:]] == score[top[:-1]])
                top = top[~again][:k]
                found.append(pd.DataFrame({"query_id": np.full(len(top), names[i], dtype=object), "id": ids[near[top]], "score": score[top]}))
            yield pd.concat(found, ignore_index=True)

    rows = index.rows([int(n) for n in np.unique(order)])
    if start is not None:
        rows = rows.filter(F.col("time") >= start)
    if end is not None:
        rows = rows.filter(F.col("time") < end)
    id_type = rows.schema["id"].dataType.simpleString()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (rows.select("id", "v", "code", "list").mapInPandas(best, f"query_id {_type_of(asked)}, id {id_type}, score double")
            .distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))


def _type_of(asked: list) -> str:
    return "string" if isinstance(asked[0]["query_id"], str) else "long"


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the share of the exact rows (query_id, id) that were found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def exact(vectors: DataFrame, queries: list, id_col: str, vec_col: str, k: int = 10, width: int = 64) -> DataFrame:
    """(query_id, id, score, rank): the best k of a block of queries among all rows, each task keeping
    its best."""
    q = unit(np.array([r["q"] for r in queries], dtype=np.float64))
    names = [r["query_id"] for r in queries]

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            score = np.round(q @ unit(matrix(frame["v"])).T, 6)
            for i, row in enumerate(score):
                top = np.lexsort((frame["id"].to_numpy(), -row))[:k]
                yield pd.DataFrame({"query_id": names[i], "id": frame["id"].to_numpy()[top], "score": row[top]})

    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = usable(vectors, id_col, vec_col, width).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.mapInPandas(best, f"query_id {_type_of(queries)}, id {id_type}, score double").withColumn(
        "rank", F.row_number().over(w)).filter(F.col("rank") <= k)
