"""Exact nearest neighbours by matrix products: with all rows, if they may be sent to every task, or else of every pair of blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.predict import matrix

#: Rows of a block, of which a task holds two; and distances that it holds at once.
BLOCK, DISTANCES = 16_384, 4_000_000
#: Numbers (rows times components) that may be sent to every task.
MOST_SENT = 4_000_000


def nearest(rows: DataFrame, k: int = 15, *, vector_col: str = "v", block: int = BLOCK, most_sent: int = MOST_SENT) -> DataFrame:
    """id, nid, dist, rank: the k nearest others of each row by cosine distance, itself left out by id.

    Distances are rounded to ten decimals before they are ranked, and ties go to
    the smaller id, so results do not depend on the order of additions. A zero
    vector is at distance 1 from all. With k or fewer others, all are returned.
    Rows of at most ``most_sent`` numbers together go to every task, and none is
    shuffled; of more, each block of rows meets each other one.
    """
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector_col)).alias("d")).collect()[0]
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, near array<struct<dist:double,nid:{kind}>>"
    rows = rows.select("id", F.col(vector_col).alias("v"))
    if size.n * (size.d or 0) <= most_sent:
        shared = rows.sparkSession.sparkContext.broadcast(by_id(rows.toArrow()))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = closest(pa.Table.from_batches([batch]), *shared.value, k)
                yield from found.to_batches()

        found = rows.mapInArrow(meet, schema)
    else:
        parts = max(1, math.ceil(size.n / block))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        asked = dealt.select("id", "v", F.col("part").alias("i"), every.alias("j"))
        given = dealt.select("id", "v", F.col("part").alias("j"), every.alias("i"))

        def search(key: tuple, q: pa.Table, e: pa.Table) -> pa.Table:
            return closest(q, *by_id(e), k)

        found = asked.groupBy("i", "j").cogroup(given.groupBy("i", "j")).applyInArrow(search, schema)
    best = found.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return best.select("id", F.posexplode("near").alias("i", "x")).select("id", "x.nid", "x.dist", (F.col("i") + 1).alias("rank"))


def by_id(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order, and their unit vectors."""
    ids = np.array(rows.column("id").to_pylist())
    order = np.argsort(ids, kind="stable")
    return ids[order], unit(rows)[order]


def closest(q: pa.Table, e_ids: np.ndarray, b: np.ndarray, k: int) -> pa.Table:
    """id and near: for each row of q its k nearest of the given ones, nearest first."""
    out: tuple[list, list] = ([], [])
    if q.num_rows and len(e_ids):
        q_ids, a, piece = q.column("id").to_pylist(), unit(q), max(1, DISTANCES // len(b))
        for start in range(0, len(a), piece):
            dist = np.round(1.0 - a[start : start + piece] @ b.T, 10)
            for q_id, d in zip(q_ids[start : start + piece], dist, strict=True):
                d = np.where(e_ids == q_id, np.inf, d)
                last = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
                chosen = np.flatnonzero((d <= last) & (d < np.inf))
                best = chosen[np.argsort(d[chosen], kind="stable")[:k]]  # ids ascend, so ties go to the smaller
                out[0].append(q_id)
                out[1].append([{"dist": float(d[x]) + 0.0, "nid": e_ids[x]} for x in best])
    kind = q.schema.field("id").type
    near = pa.list_(pa.struct([("dist", pa.float64()), ("nid", kind)]))
    return pa.table({"id": pa.array(out[0], kind), "near": pa.array(out[1], near)})


def unit(rows: pa.Table) -> np.ndarray:
    """Vectors at length 1; zero vectors stay."""
    v = matrix(rows.column("v"))
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, length, out=v.copy(), where=length > 0)
