"""In-context prediction: queries against context sets.

A context set is bounded by its parameters (sets times size), which is checked
before it goes to every task; queries stay where they are and are never
shuffled. A set beyond the bound is met in blocks whose sums add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers (rows times columns) of context that a task may hold at once.
MOST_CONTEXT = 20_000_000
#: Products of queries and context rows that the stand-in holds at once (32 MB, three times over).
MOST_PRODUCTS = 4_000_000
#: Queries of a block, and the least number of blocks, where a set is too large for every task.
BLOCK_QUERIES, LEAST_BLOCKS = 200_000, 64


class Model(Protocol):
    """A classifier that is fitted on a context set: ``fit(X, y)`` gives a function of X to P(label 1)."""

    def fit(self, x: np.ndarray, y: np.ndarray): ...


class AttentionVote:
    """The stand-in: P(1 | x) is the softmax-weighted share of label 1, by inner product over temperature.

    Missing components take no part in a product.
    """

    def __init__(self, temperature: float = 0.1):
        self.temperature = temperature

    def fit(self, x: np.ndarray, y: np.ndarray):
        x = np.nan_to_num(x)
        step = max(1, MOST_PRODUCTS // max(1, len(x)))

        def some(q: np.ndarray) -> np.ndarray:
            logits = np.nan_to_num(q) @ x.T / self.temperature
            weights = np.exp(logits - logits.max(axis=1, keepdims=True))
            return (weights * y).sum(axis=1) / weights.sum(axis=1)

        def predict(q: np.ndarray) -> np.ndarray:
            p = np.empty(len(q))
            for i in range(0, len(q), step):
                p[i : i + step] = some(q[i : i + step])
            return p

        return predict


#: Fixed values of the published memory estimate, in MB: base, and per row, per feature, and per row and feature.
MEMORY_BASE, MEMORY_ROW, MEMORY_FEATURE, MEMORY_CELL = 138.54, -2.07e-05, 2.27e-04, 5.37e-03


def chunk_rows(context: int, features: int, members: int, memory_mb: float = 16_384, safety: float = 0.7) -> int:
    """Query rows of one pass that fit beside the context, between 100 and 50,000."""
    room = memory_mb * safety - MEMORY_BASE - MEMORY_FEATURE * features
    together = int(room / (members * (MEMORY_ROW + MEMORY_CELL * features)))
    return min(50_000, max(100, together - context))


def chunk_rows_column(context: Column, features: Column, members: Column, memory_mb: float = 16_384, safety: float = 0.7) -> Column:
    """The same as a column."""
    room = F.lit(memory_mb * safety - MEMORY_BASE) - MEMORY_FEATURE * features
    together = (room / (members * (MEMORY_ROW + MEMORY_CELL * features))).cast("long")
    return F.least(F.lit(50_000), F.greatest(F.lit(100), together - context)).cast("long")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long lists of numbers as rows; null components are NaN."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(whole), -1) if len(whole) else np.empty((0, 0))


def predict(queries: DataFrame, contexts: DataFrame, model: Model | None = None, *, vector_col: str = "x", set_col: str = "k") -> DataFrame:
    """id, k, p: P(label 1) of every query under every context set; no row is left out of its own set.

    A set without rows predicts nothing; an empty query table gives no rows.
    """
    model = model or AttentionVote()
    rows = contexts.select(set_col, "label", vector_col)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector_col)).alias("d")).collect()[0]
    if (size.n or 0) * (size.d or 0) > MOST_CONTEXT:
        return predict_by_set(queries, contexts, model, vector_col=vector_col, set_col=set_col)
    # Sets may share most of their rows, so each different row is sent once, with the sets that hold it.
    held = rows.groupBy("label", vector_col).agg(F.collect_list(set_col).alias("sets")).orderBy("label", vector_col).toArrow()
    y, x, sets = held.column(0).to_numpy().astype(float), matrix(held.column(1)), held.column(2).combine_chunks()
    keys, at = sets.flatten().to_numpy(), np.repeat(np.arange(len(y)), sets.value_lengths().to_numpy())
    shared = queries.sparkSession.sparkContext.broadcast((x, y, {int(k): at[keys == k] for k in np.unique(keys)}))
    kind = queries.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, members = shared.value
        fitted = {k: model.fit(x[rows], y[rows]) for k, rows in members.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(batch.column("x"))
            for k, f in fitted.items():
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([k] * len(q), pa.int32()), pa.array(f(q), pa.float64())], names=["id", "k", "p"])

    return queries.select("id", F.col(vector_col).alias("x")).mapInArrow(run, f"id {kind}, k int, p double")


def predict_by_set(queries: DataFrame, contexts: DataFrame, model: Model, *, vector_col: str = "x", set_col: str = "k", blocks: int | None = None) -> DataFrame:
    """The same where the sets together are too large for every task: a set meets the queries in blocks, one a task."""
    kind = queries.schema["id"].dataType.simpleString()
    blocks = blocks or max(LEAST_BLOCKS, -(-queries.count() // BLOCK_QUERIES))
    sets = [r[0] for r in contexts.select(set_col).distinct().orderBy(set_col).collect()]
    asked = queries.select("id", F.col(vector_col).alias("x"), F.explode(F.array(*map(F.lit, sets))).alias("k"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"))
    given = contexts.select(F.col(set_col).alias("k"), "label", F.col(vector_col).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))

    def run(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table({"id": q.column("id").slice(0, 0), "k": pa.array([], pa.int32()), "p": pa.array([], pa.float64())})
        f = model.fit(matrix(c.column("x")), c.column("label").to_numpy().astype(float))
        p = f(matrix(q.column("x")))
        return pa.table({"id": q.column("id"), "k": pa.array([key[0].as_py()] * len(p), pa.int32()), "p": pa.array(p, pa.float64())})

    return asked.groupBy("k", "b").cogroup(given.groupBy("k", "b")).applyInArrow(run, f"id {kind}, k int, p double")


def classes(predictions: DataFrame) -> DataFrame:
    """id, p_trusted and p_noisy: the two columns of a probability matrix."""
    return predictions.select("id", (F.lit(1.0) - F.col("p")).alias("p_trusted"), F.col("p").alias("p_noisy"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id long, k int, p double")
