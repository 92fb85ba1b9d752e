"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves, each with its own codebook; a cell is a pair of
centroids. A query walks centroid pairs in the order of summed distance with a
heap until its share of all entries is covered, and the entries of the visited
cells are reranked with exact inner products. Entries live in shards of bounded
size; a query is sent to the shards that hold its cells, with a bit for each.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import saved

#: Centroids of a half: one bit each in a 64-bit word of visited cells.
CENTROIDS = 64
#: Queries whose cells one task chooses.
ASK_ROWS = 512


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of rows that take part: an id, and finite components that are not all zero."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))


def lloyd(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of k-means from evenly spaced first points; an empty cluster keeps its centroid."""
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        nearest = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        n = np.bincount(nearest, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def fit(rows: DataFrame, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of both halves, from the ``sample_rows`` rows with the smallest hash of their id (the documented bound)."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").toPandas()["vector"]
    if not len(sample):
        return np.zeros((0, 0)), np.zeros((0, 0))
    dim = int(sample.map(len).mode().iloc[0])
    points = np.array([v for v in sample if len(v) == dim], dtype=float)
    return lloyd(points[:, : dim // 2], CENTROIDS), lloyd(points[:, dim // 2 :], CENTROIDS)


def encoded(rows: DataFrame, books: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The rows of the codebooks' dimension with their cell's halves, a and b."""
    dim = books[0].shape[1] + books[1].shape[1]
    cut = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"), dim)
            codes = [((c**2).sum(1) - 2 * h @ c.T).argmin(1) for c, h in zip(books, (x[:, :cut], x[:, cut:]), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vector"), *(pa.array(c, pa.int32()) for c in codes)], names=["id", "vector", "a", "b"]
            )

    return rows.where(F.size("vector") == dim).mapInArrow(run, "id long, vector array<double>, a int, b int")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def visited(scores_a: np.ndarray, scores_b: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """For each centroid of the first half, a word of bits: the second halves of the cells that cover ``enough`` entries.

    Pairs come in the order of summed distance: the heap holds, for each first
    half seen so far, its next second half.
    """
    order_a, order_b = np.argsort(-scores_a, kind="stable").tolist(), np.argsort(-scores_b, kind="stable").tolist()
    far_a, far_b = [-scores_a[i] for i in order_a], [-scores_b[j] for j in order_b]
    words, found = [0] * len(order_a), 0
    heap = [(far_a[0] + far_b[0], 0, 0)]
    n = counts.tolist()
    while heap and found < enough:
        _, i, j = heapq.heappop(heap)
        a, b = order_a[i], order_b[j]
        if n[a][b]:
            words[a] |= 1 << b
            found += n[a][b]
        if j + 1 < len(order_b):
            heapq.heappush(heap, (far_a[i] + far_b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(order_a):
            heapq.heappush(heap, (far_a[i + 1] + far_b[0], i + 1, 0))
    return words


def shards_of(counts: np.ndarray, size: int) -> list[list[int]]:
    """For each centroid of the first half, its shards: small lists share one, long ones are dealt to several."""
    out: list[list[int]] = []
    shard, filled = 0, 0
    for n in counts.sum(1).tolist():
        if n > size:
            if filled:
                shard, filled = shard + 1, 0
            parts = math.ceil(n / size)
            out.append(list(range(shard, shard + parts)))
            shard += parts
            continue
        if filled and filled + n > size:
            shard, filled = shard + 1, 0
        out.append([shard])
        filled += n
    return out


def search(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 20,
    top: int = 20,
    visit_share: float = 0.55,
    sample_rows: int = 16_384,
    shard_rows: int = 4_096,
    query_rows: int = 8_192,
) -> DataFrame:
    """query_id, rank, vec_id and score: the ``top`` nearest found for each row whose id is divisible by ``every``.

    Nearness is the inner product in double precision, ties go to the smaller
    id. A query visits cells until they hold ``visit_share`` of all entries, and
    enough for ``top`` of other ids; vectors without structure need about half for
    a recall of 0.9. Null ids take no part, nor do vectors that are null, zero,
    of null or non-finite components, or of another length than most of the
    sample. Rows that repeat an id are all entries, the smallest vector of an
    id is its query, and no query finds its own id. No usable row gives no
    rows; other columns are ignored.

    Shards hold at most about ``shard_rows`` entries and are met by blocks of
    about ``query_rows`` queries, so no task's load depends on a crowded cell.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    schema = "query_id long, rank int, vec_id long, score double"
    books = fit(rows, sample_rows)
    if not len(books[0]):
        return spark.createDataFrame([], schema)
    index = saved(encoded(rows, books))
    dim, cut = books[0].shape[1] + books[1].shape[1], books[0].shape[1]
    counts = np.zeros((len(books[0]), len(books[1])), dtype=np.int64)
    for r in index.groupBy("a", "b").count().collect():  # at most 64 x 64 rows
        counts[r.a, r.b] = r["count"]
    total = int(counts.sum())
    own = index.where(F.col("id") % every == 0).groupBy("id").count().agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).collect()[0]
    n_queries = own.n
    # So many that ``top`` entries are left beside those of the query's own id.
    enough = max(math.ceil(visit_share * total), top + (own.most or 0))
    shards = shards_of(counts, shard_rows)
    members: dict[int, list[int]] = {}
    for a, own in enumerate(shards):
        for s in own:
            members.setdefault(s, []).append(a)
    query_blocks = max(1, math.ceil(n_queries / query_rows))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"), dim)
            ids = batch.column("id").to_pylist()
            found = [visited(sa, sb, counts, enough) for sa, sb in zip(x[:, :cut] @ books[0].T, x[:, cut:] @ books[1].T, strict=True)]
            at, words = [], []
            for k, per_a in enumerate(found):
                for s, own in members.items():
                    bits = np.array([per_a[a] for a in own], dtype="<u8")
                    if bits.any():
                        at.append((s, k))
                        words.append(bits.tobytes())
            take = pa.array([k for _, k in at], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s for s, _ in at], pa.int32()),
                    pa.array([hash(ids[k]) % query_blocks for _, k in at], pa.int32()),
                    batch.column("id").take(take),
                    batch.column("vector").take(take),
                    pa.array(words, pa.binary()),
                ],
                names=["shard", "block", "id", "vector", "cells"],
            )

    def rerank(key: tuple, queries: pa.Table, entries: pa.Table) -> pa.Table:
        found: dict[int, list[dict]] = {}
        if queries.num_rows and entries.num_rows:
            own = members[key[0].as_py()]
            place = {a: i for i, a in enumerate(own)}
            e = matrix(entries.column("vector").combine_chunks(), dim)
            e_ids = entries.column("id").to_numpy()
            row_a = np.array([place[a] for a in entries.column("a").to_pylist()])
            row_b = entries.column("b").to_numpy().astype(np.uint64)
            q_ids = queries.column("id").to_pylist()
            q = matrix(queries.column("vector").combine_chunks(), dim)
            words = np.frombuffer(b"".join(queries.column("cells").to_pylist()), dtype="<u8").reshape(len(q), len(own))
            for start in range(0, len(q), 128):
                part = slice(start, start + 128)
                near = q[part] @ e.T
                near[(words[part][:, row_a] >> row_b) & np.uint64(1) == 0] = -np.inf
                for scores, query, q_id in zip(near, q[part], q_ids[part], strict=True):
                    scores[e_ids == q_id] = -np.inf
                    least = np.partition(scores, -top)[-top] if len(scores) > top else -np.inf
                    chosen = np.flatnonzero((scores >= least - 1e-9) & (scores > -np.inf))
                    # Products of one row are summed in a fixed order, so equal vectors have equal scores.
                    exact = (e[chosen] * query).sum(axis=1)
                    best = np.lexsort((e_ids[chosen], -exact))[:top]
                    found[q_id] = [{"far": -exact[k], "vec_id": e_ids[chosen[k]]} for k in best]
        shard = pa.array([key[0].as_py()] * len(found), pa.int32())
        near = pa.array(list(found.values()), pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())])))
        return pa.table({"query_id": pa.array(list(found), pa.int64()), "shard": shard, "near": near})

    shard = F.element_at(F.array(*(F.array(*map(F.lit, s)) for s in shards)), F.col("a") + 1)
    dealt = index.withColumn("own", shard).withColumn("shard", F.element_at("own", (F.pmod(F.xxhash64("id", "vector"), F.size("own")) + 1).cast("int")))
    entries = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("block"), "id", "vector", "a", "b")
    asked = index.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    # Choosing cells is the work here: by many tasks, however small the table of queries is.
    asked = asked.repartition(max(1, math.ceil(n_queries / ASK_ROWS)), "id")
    queries = asked.mapInArrow(ask, "shard int, block int, id long, vector array<double>, cells binary")
    reply = "query_id long, shard int, near array<struct<far:double,vec_id:long>>"
    found = queries.groupBy("shard", "block").cogroup(entries.groupBy("shard", "block")).applyInArrow(rerank, reply)
    # One list a query and shard, merged in two steps, so that many shards stay short lists.
    for keys in (["query_id", F.pmod("shard", F.lit(64)).alias("shard")], ["query_id"]):
        found = found.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, top).alias("near"))
    ranked = found.select("query_id", F.posexplode("near").alias("i", "x"))
    return ranked.select("query_id", (F.col("i") + 1).alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))
