"""Exact percentiles and running counts that need no single task over all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Half the share of rows that a bracket around a rank holds, about.
SLACK = 0.002
#: Values that one task may sort, and rows of a range of running sums.
MOST, RANGE_ROWS = 1_000_000, 500_000


def exact(df: DataFrame, column: str, shares: list[float], most: int = MOST) -> list[float | None]:
    """Percentiles with linear interpolation between ranks, as exact as a sort; None without known values.

    Up to ``most`` values are sorted at once. Of more, sketches bracket a rank
    closer and closer: values outside are only counted, until few are inside.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n = values.count()
    if not n:
        return [None] * len(shares)
    ranks = [s * (n - 1) for s in shares]
    if n <= most:
        return at_ranks(values, ranks, 0)
    return [at_ranks(*bracket(values, n, r, most))[0] for r in ranks]


def at_ranks(values: DataFrame, ranks: list[float], below: int) -> list[float]:
    """Values at the ranks, of which ``below`` belong to values that were left out. Equal values are one row."""
    upto = values.groupBy("v").count().withColumn("upto", F.sum("count").over(Window.orderBy("v")) + below)
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    got = upto.agg(*(first(f(r)).alias(f"{i}{f.__name__}") for i, r in enumerate(ranks) for f in (math.floor, math.ceil))).collect()[0]
    return [got[2 * i] + (got[2 * i + 1] - got[2 * i]) * (r - math.floor(r)) for i, r in enumerate(ranks)]


def bracket(values: DataFrame, n: int, rank: float, most: int) -> tuple[DataFrame, list[float], int]:
    """The values around a rank, at most ``most`` of them unless equal ones crowd there, the rank, and how many values lie below."""
    below, inside, slack = 0, n, SLACK
    while inside > most:
        at = (rank - below) / (inside - 1)
        ends = [max(0.0, at - slack), min(1.0, at + slack)]
        lo, hi = values.agg(F.percentile_approx("v", ends, int(2 / SLACK)).alias("q")).collect()[0].q
        under, upto = values.agg(F.count_if(F.col("v") < lo), F.count_if(F.col("v") <= hi)).collect()[0]
        if below + under > math.floor(rank) or below + upto <= math.ceil(rank):  # the sketch missed
            slack *= 10
            continue
        if upto - under >= inside:  # nothing but the values that crowd
            break
        values, below, inside, slack = values.where((F.col("v") >= lo) & (F.col("v") <= hi)), below + under, upto - under, SLACK
    return values, [rank], below


def running(df: DataFrame, by: str, sums: list[str], keys: list[str], parts: int | None = None) -> DataFrame:
    """The rows with ``run_<c>`` for each c of ``sums``: its sum over its group's rows with ``by`` as large or larger.

    Rows fall into ranges of ``by``; a range's offset is the sum of the ranges
    above it, and only rows of one group and range are sorted together. ``by``
    must be different in each row of a group (of equal ``keys``).
    """
    parts = parts or min(10_000, max(64, df.count() // RANGE_ROWS))
    cuts = df.agg(F.percentile_approx(by, [i / parts for i in range(1, parts)], 10 * parts).alias("q")).collect()[0].q or []
    cuts = sorted(set(cuts))
    place: Column = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: F.col(by) >= c)) if cuts else F.lit(0)
    rows = df.withColumn("_part", place)
    above = Window.partitionBy(*keys).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_part").agg(*(F.sum(c).alias(f"_{c}") for c in sums))  # at most ``parts`` rows a group
    offsets = totals.select(*keys, "_part", *(F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_off_{c}") for c in sums))
    inside = Window.partitionBy(*keys, "_part").orderBy(F.col(by).desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_in_{c}": F.sum(c).over(inside) for c in sums}).join(offsets, [*keys, "_part"])
    return rows.select(*df.columns, *((F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"run_{c}") for c in sums))
