"""Seeded sampling without replacement, by the order of a hash that any engine can compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.config import TRUSTED
from sieveline.session import saved


def draw(seed: Column, key: Column) -> Column:
    """md5 of seed and id: the order in which rows are drawn."""
    return F.md5(F.concat_ws("-", seed.cast("string"), key.cast("string")).cast("binary"))


def lowest(every: DataFrame, group: list[str], seed: Column, quota: dict[bool, int], sizes: dict[bool, int], groups: int) -> DataFrame:
    """Rows of ``every`` (id, positive and the columns of ``group``) that are drawn first in their group, up to its quota; stored.

    Hashes are even, so only rows whose hash is low enough to stand a chance are
    sorted; should they not fill the quotas, all are.
    """
    order = Window.partitionBy(*group).orderBy("h", "id")
    hashed = every.withColumn("h", draw(seed, F.col("id")))
    limit = F.when(F.col("positive"), quota[True]).otherwise(quota[False])
    shares = {p: min(1.0, (2 * quota[p] + 50) / max(1, sizes.get(p, 0))) for p in (True, False)}
    ends = {p: f"{min(16**8 - 1, int(share * 16**8)):08x}" for p, share in shares.items()}
    low = hashed.where(F.substring("h", 1, 8) <= F.when(F.col("positive"), ends[True]).otherwise(ends[False]))
    wanted = groups * sum(min(quota[p], sizes.get(p, 0)) for p in (True, False))
    for rows in (low, hashed):
        ranked = rows.withColumn("ord", F.row_number().over(order)).where((F.col("ord") <= max(quota.values())) & (F.col("ord") <= limit))
        chosen = saved(ranked.select(*group, "id"))
        if chosen.count() == wanted:
            break
    return chosen


def class_sizes(rows: DataFrame, positive: Column) -> dict[bool, int]:
    return {r.positive: r["count"] for r in rows.groupBy(positive.alias("positive")).count().collect()}


def probes(rows: DataFrame, k: int, size: int, seed: int = 42, positive: int = TRUSTED) -> DataFrame:
    """k, id, label and the rows' other columns: k stratified sets of size // 2 positives and the rest others.

    A class with fewer rows gives all it has.
    """
    stratum = F.coalesce(F.col("label") == positive, F.lit(False))
    every = rows.select("id", stratum.alias("positive"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    quota = {True: size // 2, False: size - size // 2}
    chosen = lowest(every, ["k", "positive"], F.concat_ws("-", F.lit(str(seed)), "k"), quota, class_sizes(rows, stratum), k)
    return chosen.select("k", "id").join(rows, "id").select("k", "id", *(c for c in rows.columns if c != "id"))


def baseline_draws(rows: DataFrame, n: int, runs: int, seed: int = 42) -> DataFrame:
    """run, id and the rows' other columns: n rows drawn for each run, with seed + run."""
    every = rows.select("id", F.lit(False).alias("positive"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    chosen = lowest(every, ["run"], F.col("run") + seed, {True: 0, False: n}, {False: rows.count()}, runs)
    return chosen.select("run", "id").join(rows, "id").select("run", "id", *(c for c in rows.columns if c != "id"))


def target_sizes(n_positive: int, target: int | None) -> tuple[int, int]:
    """How many positives and others a context set gets: half of the target each, rounded down, or as many others as positives."""
    each = n_positive if target is None else target // 2
    return each, each
