"""Which noisy-class rows join a context set: six strategies over a pool of scored rows.

A pool has id, v (prediction vector) and reliability_score. A strategy gives id
and ord (its rank); a pool no larger than asked for is taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.config import NOISY, STRATEGIES, TRUSTED
from sieveline.functions.percentiles import exact
from sieveline.operators import clustering
from sieveline.operators.sampling import draw
from sieveline.session import saved


def mean_of(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)


def variance_of(v: Column) -> Column:
    """Population variance of a vector's numbers."""
    centre = mean_of(v)
    return F.aggregate(F.transform(v, lambda x: (x - centre) * (x - centre)), F.lit(0.0), lambda s, x: s + x) / F.size(v)


def top(rows: DataFrame, rank: Column, n: int) -> DataFrame:
    """id and ord of the n rows with the highest rank value, to ten decimals; ties go to the smaller id.

    ``orderBy.limit`` keeps n rows a task; only those n are numbered.
    """
    first = rows.select("id", F.round(rank, 10).alias("r")).orderBy(F.col("r").desc(), "id").limit(n)
    return first.withColumn("ord", F.row_number().over(Window.orderBy(F.col("r").desc(), "id"))).select("id", "ord")


def by_reliability(pool: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return top(pool, F.col("reliability_score"), n)


def by_information(pool: DataFrame, n: int, seed: int = 42, alpha: float = 0.25) -> DataFrame:
    """Score times 1 + alpha times the variance, stretched between its 5th and 95th percentile and cut to 0..1."""
    rows = pool.withColumn("var", variance_of(F.col("v")))
    low, high = exact(rows, "var", [0.05, 0.95])
    if low is None:
        return top(rows, F.col("reliability_score"), n)
    stretched = F.least(F.greatest((F.col("var") - low) / (high - low + 1e-8), F.lit(0.0)), F.lit(1.0))
    return top(rows, F.col("reliability_score") * (1 + alpha * stretched), n)


def by_boundary(pool: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """0.6 of the mean plus 0.4 of the variance, each stretched from its least to its greatest."""
    rows = pool.withColumns({"m": mean_of(F.col("v")), "var": variance_of(F.col("v"))})
    span = rows.agg(F.min("m").alias("m0"), F.max("m").alias("m1"), F.min("var").alias("v0"), F.max("var").alias("v1")).collect()[0]
    if span.m0 is None:
        return top(rows, F.col("m"), n)
    mean = (F.col("m") - span.m0) / (span.m1 - span.m0 + 1e-10)
    var = (F.col("var") - span.v0) / (span.v1 - span.v0 + 1e-10)
    return top(rows, 0.6 * mean + 0.4 * var, n)


def at_random(pool: DataFrame, n: int, seed: int = 42) -> DataFrame:
    key = draw(F.lit(str(seed)), F.col("id"))
    first = pool.select("id", key.alias("r")).orderBy("r", "id").limit(n)
    return first.withColumn("ord", F.row_number().over(Window.orderBy("r", "id"))).select("id", "ord")


def by_kmeans(pool: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Medoids of k-means clusters of the normalised vectors; empty clusters make them fewer."""
    return clustering.ranked(clustering.diverse(pool, n, seed, normalise=True))


def quotas(n: int) -> tuple[int, int, int, int]:
    """Representative, random, hard and boundary shares of a hybrid choice: 40, 20 and 20 percent, and the rest."""
    rep, rand, hard = int(0.4 * n), int(0.2 * n), int(0.2 * n)
    return rep, rand, hard, n - rep - rand - hard


def hybrid(pool: DataFrame, n: int, seed: int = 42, representatives: Callable[[DataFrame, int, int], DataFrame] | None = None) -> DataFrame:
    """Representatives, then the highest means, then the highest variances, then random rows; ord follows ids.

    Quotas add up: a stage that finds fewer leaves the rest to the next one.
    """
    rows = saved(pool.select("id", F.round(mean_of(F.col("v")), 10).alias("m"), F.round(variance_of(F.col("v")), 10).alias("var"), "v"))
    if rows.limit(n + 1).count() <= n:
        return clustering.ranked(rows.select("id"))
    rep, _, hard, boundary = quotas(n)
    pick = representatives or (lambda p, k, s: clustering.diverse(p, k, s, normalise=True))
    chosen = saved(pick(rows.select("id", "v"), rep, seed).select("id").distinct())
    for upto, order in ((rep + hard, F.col("m").desc()), (rep + hard + boundary, F.col("var").desc()), (n, draw(F.lit(str(seed)), F.col("id")))):
        short = upto - chosen.count()
        if short > 0:
            more = rows.join(chosen, "id", "left_anti").orderBy(order, "id").limit(short).select("id")
            chosen = saved(chosen.unionByName(more))
    return clustering.ranked(chosen)


CHOICES: dict[str, Callable[..., DataFrame]] = {
    "random": at_random,
    "reliable": by_reliability,
    "informed": by_information,
    "kmeans": by_kmeans,
    "boundary": by_boundary,
    "hybrid": hybrid,
}


def choose(pool: DataFrame, n: int, strategy: str, seed: int = 42) -> DataFrame:
    """id and ord by a strategy's name."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    return CHOICES[strategy](pool, n, seed)


def near_threshold(rows: DataFrame, n: int) -> DataFrame:
    """The n rows with the highest scores."""
    return top(rows, F.col("reliability_score"), n)


def positives(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """id of all trusted rows, or of n diverse ones if there are more."""
    return clustering.diverse(rows, n, seed)


def trusted_ids(train: DataFrame, n: int, seed: int = 42, pick: Callable[[DataFrame, int, int], DataFrame] | None = None) -> DataFrame:
    """id of the trusted training rows of a context set, by another choice than ``positives`` if one is given; stored, as several sets may share them."""
    return saved((pick or positives)(train.where(F.col("label") == TRUSTED).withColumnRenamed("x", "v"), n, seed))


def context_set(
    train: DataFrame, pool: DataFrame, n_negative: int | None = None, strategy: str = "random", seed: int = 42, n_positive: int | None = None, trusted: DataFrame | None = None
) -> DataFrame:
    """The chosen rows of train with ord: trusted ones (or those given by id) first, then the chosen noisy ones, as many as trusted ones by default."""
    if n_positive is None:
        n_positive = train.where(F.col("label") == TRUSTED).count()
    first = (trusted_ids(train, n_positive, seed) if trusted is None else trusted).select("id", F.lit(0).alias("ord"))
    others = choose(pool, n_positive if n_negative is None else n_negative, strategy, seed)
    chosen = first.unionByName(others.select("id", "ord"))
    return train.join(chosen, "id")


def context_sets(train: DataFrame, pool: DataFrame, k: int, strategy: str = "random", seed: int = 42, **options) -> DataFrame:
    """k context sets with seeds from ``seed`` on, as one frame with k."""
    out = None
    for i in range(k):
        one = context_set(train, pool, strategy=strategy, seed=seed + i, **options).withColumn("k", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def noisy(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("label") == NOISY)
