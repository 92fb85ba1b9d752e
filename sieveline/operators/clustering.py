"""Representatives of clusters: k-means, medoids, and a deterministic single step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.functions.vectors import filled, l2_normalised
from sieveline.operators.predict import matrix
from sieveline.operators.sampling import draw
from sieveline.session import saved

#: Numbers (centres times columns) that every task may hold.
MOST_CENTRES = 20_000_000
#: Numbers (rows times columns) of a repeatable k-means that go to the driver; more stay where they are and take a pass for each move.
MOST_POINTS = 4_000_000
#: Rows that meet all centres at once.
BLOCK_ROWS = 4096


def kmeans_centres(rows: DataFrame, n: int, seed: int = 42, tries: int = 3) -> list[list[float]]:
    """Centres of the cheapest of several fits; rows are put in a fixed order first, since results follow their layout."""
    features = saved(rows.select("id", array_to_vector("v").alias("features")).repartitionByRange("id").sortWithinPartitions("id"))
    fits = [KMeans(k=n, seed=seed + t, maxIter=50).fit(features) for t in range(tries)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return [c.tolist() for c in best.clusterCenters()]


def assigned(rows: DataFrame, centres: list[list[float]]) -> DataFrame:
    """id, v, cluster, dist: the nearest centre of each row, ties to the first; distances to ten decimals.

    The centres are as many as the rows to choose; they are checked against a
    bound before they go to every task.
    """
    if sum(map(len, centres)) > MOST_CENTRES:
        raise ValueError("too many centres for one task; choose in blocks of the pool")
    table = np.array(centres, dtype=float)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch.column("v").to_pylist(), dtype=float)
            cluster, dist = [], []
            for start in range(0, len(v), 64):
                d = np.round(np.sqrt(((v[start : start + 64, None, :] - table[None]) ** 2).sum(axis=2)), 10)
                cluster += d.argmin(axis=1).tolist()
                dist += d.min(axis=1).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(dist, pa.float64())], names=["id", "v", "cluster", "dist"])

    return rows.select("id", "v").mapInArrow(run, f"id {kind}, v array<double>, cluster int, dist double")


def medoids(rows: DataFrame, centres: list[list[float]]) -> DataFrame:
    """id of the row nearest to each centre among its cluster's, ties to the smaller id; empty clusters give none."""
    near = assigned(rows, centres).groupBy("cluster").agg(F.min(F.struct("dist", "id")).alias("m"))
    return near.select("cluster", "m.id")


def lloyd_medoids(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """cluster and id: one deterministic step from rows drawn by hash: assign, average, and take the nearest of each cluster."""
    drawn = rows.orderBy(draw(F.lit(str(seed)), F.col("id")), "id").limit(n).select("id", "v").collect()
    if not drawn:
        return empty(rows.sparkSession)
    first = assigned(rows, [r.v for r in drawn])
    mean = first.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"))
    centre = mean.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    apart = F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = first.join(centre, "cluster").select("cluster", "id", F.round(F.sqrt(apart), 10).alias("dist"))
    return near.groupBy("cluster").agg(F.min(F.struct("dist", "id")).alias("m")).select("cluster", "m.id")


def diverse(rows: DataFrame, n: int, seed: int = 42, normalise: bool = False) -> DataFrame:
    """id of n representatives (k-means medoids), or of all rows if there are no more than n.

    Gaps are filled with medians for the clustering alone: it tells which rows are chosen, never what they hold.
    """
    if rows.limit(n + 1).count() <= n:
        return rows.select("id")
    rows = filled(rows)
    points = rows.select("id", l2_normalised(F.col("v")).alias("v")) if normalise else rows.select("id", "v")
    return medoids(points, kmeans_centres(points, n, seed)).select("id")


def closest(v: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As in ``assigned``: each row's nearest centre and its distance to ten decimals, ties to the first.

    A matrix product tells which centres may be the nearest; where they are several, distances are taken one by one.
    """
    squares, sizes = (v * v).sum(axis=1, keepdims=True), (table * table).sum(axis=1)
    apart = squares - 2 * (v @ table.T) + sizes
    maybe = apart <= apart.min(axis=1, keepdims=True) + 1e-9 * (1 + squares + sizes.max())
    cluster = maybe.argmax(axis=1)
    for i in np.flatnonzero(maybe.sum(axis=1) > 1):
        some = np.flatnonzero(maybe[i])
        cluster[i] = some[np.round(np.sqrt(((v[i] - table[some]) ** 2).sum(axis=1)), 10).argmin()]
    return cluster, np.round(np.sqrt(((v - table[cluster]) ** 2).sum(axis=1)), 10)


def totals(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """By try and centre: the number of its rows, their squared distances, and their sum."""
    tries, n, width = centres.shape
    out = np.zeros((tries, n, width + 2))
    for start in range(0, len(v), BLOCK_ROWS):
        block = v[start : start + BLOCK_ROWS]
        for t in range(tries):
            cluster, dist = closest(block, centres[t])
            for i, weights in enumerate([np.ones(len(block)), dist * dist, *block.T]):
                out[t, :, i] += np.bincount(cluster, weights, n)
    return out


class Held:
    """Points (id, v) on the driver."""

    def __init__(self, points: DataFrame):
        self.v = matrix(points.orderBy("id").select("v").toArrow().column(0))

    def totals(self, centres: np.ndarray) -> np.ndarray:
        return totals(self.v, centres)

    def farthest(self, table: np.ndarray, n: int) -> np.ndarray:
        """The n points that are farthest from their centres, ties to the smaller id; none that lies on one."""
        dist = np.concatenate([closest(self.v[i : i + BLOCK_ROWS], table)[1] for i in range(0, len(self.v), BLOCK_ROWS)])
        first = np.argsort(-dist, kind="stable")[:n]
        return self.v[first[dist[first] > 0]]


class Spread:
    """The same where they are too many: they stay where they are."""

    def __init__(self, points: DataFrame):
        self.points = points

    def totals(self, centres: np.ndarray) -> np.ndarray:
        shared = self.points.sparkSession.sparkContext.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = sum(totals(matrix(batch.column("v")), shared.value) for batch in batches if batch.num_rows)
            t, c = np.nonzero(found[:, :, 0]) if isinstance(found, np.ndarray) else ([], [])
            if len(t):
                columns = pa.array(t, pa.int32()), pa.array(c, pa.int32()), pa.array(found[t, c].tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(list(columns), names=["t", "c", "s"])

        parts = self.points.select("v").mapInArrow(run, "t int, c int, s array<double>").select("t", "c", F.posexplode("s").alias("i", "s"))
        out = np.zeros((*centres.shape[:2], centres.shape[2] + 2))
        for r in parts.groupBy("t", "c", "i").agg(F.sum("s").alias("s")).collect():
            out[r.t, r.c, r.i] = r.s
        shared.unpersist()
        return out

    def farthest(self, table: np.ndarray, n: int) -> np.ndarray:
        far = assigned(self.points, table.tolist()).where("dist > 0").orderBy(F.col("dist").desc(), "id").limit(n)
        return np.array([r.v for r in far.select("v").collect()])


def repeatable_centres(rows: DataFrame, n: int, seed: int = 42, tries: int = 3, most: int = 300) -> list[list[float]]:
    """Centres of the cheapest of several k-means fits that SQL can repeat, whatever the rows' layout; there are more than n rows.

    Each starts from different rows drawn by hash, with seed + its number, and moves until its centres stay. Centres without rows move
    to the rows that are farthest from their centres.
    """
    unlike = saved(rows.groupBy("v").agg(F.min("id").alias("id")))
    drawn = [[r.v for r in unlike.orderBy(draw(F.lit(str(seed + t)), F.col("id")), "id").limit(n).collect()] for t in range(tries)]
    centres = np.array(drawn, dtype=float)
    if centres.size > MOST_CENTRES:
        raise ValueError("too many centres for one task; choose in blocks of the pool")
    points = Held(rows) if rows.count() * centres.shape[2] <= MOST_POINTS else Spread(rows)
    moving = np.arange(tries)
    for _ in range(most):
        found, before = points.totals(centres[moving]), centres[moving]
        count = found[:, :, :1]
        after = np.where(count > 0, found[:, :, 2:] / np.maximum(count, 1), before)
        for t, empty in enumerate(count[:, :, 0] == 0):
            if empty.any():
                far = points.farthest(before[t], int(empty.sum()))
                after[t, np.flatnonzero(empty)[: len(far)]] = far.reshape(-1, centres.shape[2])
        centres[moving] = after
        moving = moving[np.sqrt(((after - before) ** 2).sum(axis=2)).max(axis=1) > 1e-12]
        if not len(moving):
            break
    costs = points.totals(centres)[:, :, 1].sum(axis=1)
    return centres[np.round(costs, 6).argmin()].tolist()


def repeatable(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """id of n representatives as in ``diverse``, by the k-means that SQL can repeat."""
    if rows.limit(n + 1).count() <= n:
        return rows.select("id")
    points = saved(filled(rows).select("id", "v"))
    return medoids(points, repeatable_centres(points, n, seed)).select("id")


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ord", F.row_number().over(Window.orderBy("id")))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "cluster int, id long")
