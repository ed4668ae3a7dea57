"""Centroid clustering of integer vectors, exact, with most distances never computed.

Vectors are turned once: the principal axes of all vectors (sums of products a task, an eigenproblem
of one small matrix on the driver) give a rotation, and a vector keeps its leading rotated
coordinates and the norm of the rest. For two vectors, the squared distance of the leading
coordinates plus the squared difference of the rest norms is never above their squared distance.
A round computes this bound for all centroids at once, verifies the centroid with the least bound in
whole numbers, and then only centroids whose bound does not exceed that distance (with a margin for
rounding), so results do not depend on floating point or on the split into tasks. How many centroids
that leaves depends on the data: with noise alike on all axes few leading coordinates rule out
nothing, so `leading` is three quarters of the components unless given.

Centroids are a table of fixed size (`clusters` rows) that goes to every task. A task gives one row
of sums and a count a cluster; these are added by Spark, so a cluster with all vectors is summed by
all tasks. The turned vectors are stored once and read once a round.

Defined results: vectors with another number of components, nulls or non-finite values have no row
in the result; floor(256 x) beyond +-2^26 is taken as that bound, so that distances fit a long; sums of
distances beyond a long are its largest value. Repeated rows and ids are vectors of their own; a null
id hashes like the empty text, first vectors with one hash are taken in order of their components. With
fewer vectors than clusters every vector starts one; no vectors give no rows. Given columns stay but the
vector; the operator's own replace those of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newswake.llm.tables import stored, unpacked

LIMIT = 1 << 26
CHUNK = 4096


def whole_vectors(df: DataFrame, column: str, width: int, scale: int) -> DataFrame:
    """`row` of the other given columns and `v`, the vector as whole numbers."""
    given = F.col(f"`{column}`").cast("array<double>")
    fits = (F.size(given) == width) & F.forall(
        given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bounded = F.transform(given, lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(
        F.lit(float(LIMIT)), x * scale))).cast("int"))
    others = [F.col(f"`{c}`") for c in df.columns if c.lower() != column.lower()]
    return df.filter(F.coalesce(fits, F.lit(False))).select(F.struct(*others).alias("row"), bounded.alias("v"))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.int64) if len(vectors) else np.zeros((0, width), np.int64)


def moments(vectors: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sums and sums of products, a row a task, added on the way by groups of tasks."""
    def of_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, products = 0, np.zeros(width), np.zeros((width, width))
        for frame in frames:
            x = matrix(frame["v"], width).astype(float)
            n += len(x)
            total += x.sum(axis=0)
            products += x.T @ x
        yield pd.DataFrame({"n": [n], "s": [np.concatenate([total, products.ravel()])]})

    parts = vectors.select("v").mapInPandas(of_task, "n long, s array<double>")
    cells = parts.select("n", F.posexplode("s").alias("at", "x"))
    sums = cells.groupBy("at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # width * (width + 1) rows
    flat = np.zeros(width * (width + 1))
    for r in sums:
        flat[r["at"]] = r["x"]
    return (sums[0]["n"] if sums else 0), flat[:width], flat[width:].reshape(width, width)


class Rotation:
    """Leading principal coordinates and the norm of the rest, about the mean."""

    def __init__(self, n: int, total: np.ndarray, products: np.ndarray, leading: int):
        self.mean = total / max(n, 1)
        covariance = products / max(n, 1) - np.outer(self.mean, self.mean)
        _, axes = np.linalg.eigh(covariance)
        self.axes = axes[:, ::-1][:, :leading]

    def turn(self, whole: np.ndarray) -> np.ndarray:
        centred = whole - self.mean
        led = centred @ self.axes
        rest = np.einsum("ij,ij->i", centred, centred) - np.einsum("ij,ij->i", led, led)
        return np.column_stack([led, np.sqrt(np.maximum(rest, 0.0))])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    difference = a - b
    return np.einsum("ij,ij->i", difference, difference)


def nearest(whole: np.ndarray, turned: np.ndarray, centroids: np.ndarray,
            turned_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smallest number), squared distance, and how many were verified, of each."""
    sizes, sizes_c = squared(turned, 0.0), squared(turned_centroids, 0.0)
    bounds = sizes[:, None] + sizes_c[None, :] - 2.0 * (turned @ turned_centroids.T)
    first = bounds.argmin(axis=1)
    best = squared(whole, centroids[first])
    margin = 1e-9 * (sizes[:, None] + sizes_c[None, :]) + 1e-3
    row, cluster = np.nonzero(bounds - margin <= best[:, None])
    exact = np.empty(len(row), np.int64)
    for at in range(0, len(row), 1 << 16):
        part = slice(at, at + (1 << 16))
        exact[part] = squared(whole[row[part]], centroids[cluster[part]])
    order = np.lexsort((cluster, exact, row))
    row, cluster, exact = row[order], cluster[order], exact[order]
    lead = np.ones(len(row), bool)
    lead[1:] = row[1:] != row[:-1]
    return cluster[lead].astype(np.int32), exact[lead], np.bincount(row, minlength=len(whole)).astype(np.int32)


def first_centroids(vectors: DataFrame, id_column: str, clusters: int, seed: int) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"row.`{id_column}`").cast("string"), F.lit(""))), 256)
    first = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


def chunks(vectors: pd.Series, turned: pd.Series, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(vectors), CHUNK):
        yield matrix(vectors[at:at + CHUNK], width), np.stack(turned[at:at + CHUNK].to_numpy())


def turner(rotation: Rotation, width: int):
    @F.pandas_udf("array<double>")
    def turn(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(rotation.turn(matrix(vectors, width))))
    return turn


def assigner(centroids: np.ndarray, rotation: Rotation, width: int):
    """A column function of (v, z): cluster, distance, and how many centroids were verified."""
    about = rotation.turn(centroids)

    @F.pandas_udf("cluster int, distance long, verified int")
    def assign(vectors: pd.Series, turned: pd.Series) -> pd.DataFrame:
        found = [nearest(whole, z, centroids, about) for whole, z in chunks(vectors, turned, width)]
        return pd.DataFrame({k: np.concatenate([f[i] for f in found]) for i, k in enumerate(
            ["cluster", "distance", "verified"])})
    return assign


def moved(turned: DataFrame, centroids: np.ndarray, rotation: Rotation, width: int) -> np.ndarray:
    """The centroids after one round."""
    about, clusters = rotation.turn(centroids), len(centroids)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((clusters, width), np.int64), np.zeros(clusters, np.int64)
        for frame in frames:
            for whole, z in chunks(frame["v"], frame["z"], width):
                cluster, _, _ = nearest(whole, z, centroids, about)
                for c in np.unique(cluster):
                    total[c] += whole[cluster == c].sum(axis=0)
                count += np.bincount(cluster, minlength=clusters)
        used = np.flatnonzero(count)
        if len(used):
            yield pd.DataFrame({"cluster": used.astype(np.int32), "n": count[used], "s": list(total[used])})

    parts = turned.select("v", "z").mapInPandas(sums, "cluster int, n long, s array<long>")
    summed = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[
        F.sum(F.col("s")[i]) for i in range(width)]).alias("s")).collect()  # one row a cluster
    out = centroids.copy()
    for r in summed:
        out[r["cluster"]] = [s // r["n"] for s in r["s"]]
    return out


def cluster_vectors(df: DataFrame, column: str = "embedding", id_column: str = "vec_id", width: int = 64,
                    scale: int = 256, clusters: int = 40, rounds: int = 5, seed: int = 2,
                    leading: int = 48) -> DataFrame:
    """Given columns but the vector, and cluster, distance, cluster_inertia, inertia, centroid (whole
    numbers)."""
    vectors = whole_vectors(df, column, width, scale)
    results = ["cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    centroids = first_centroids(vectors, id_column, clusters, seed)
    if not len(centroids):
        return unpacked(vectors.select("row", *[F.lit(None).cast(t).alias(c) for c, t in zip(
            results, ["int", "long", "long", "long", "array<long>"])]), results)
    rotation = Rotation(*moments(vectors, width), leading)
    turned = stored(vectors.select("row", "v", turner(rotation, width)("v").alias("z")))
    for _ in range(rounds):
        centroids = moved(turned, centroids, rotation, width)
    found = stored(turned.select("row", assigner(centroids, rotation, width)("v", "z").alias("a"))
                   .select("row", "a.cluster", "a.distance"))
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    every, most = sum(int(r["d"]) for r in inertia), (1 << 63) - 1
    table = df.sparkSession.createDataFrame(
        [(r["cluster"], min(int(r["d"]), most), min(every, most), [int(x) for x in centroids[r["cluster"]]])
         for r in inertia], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    # a row a cluster
    return unpacked(found.join(F.broadcast(table), "cluster"), results)
