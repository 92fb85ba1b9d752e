"""Reliability of rows from the vectors of their predictions under many probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.config import NOISY, Scoring
from sieveline.functions.percentiles import exact
from sieveline.functions.vectors import l2_normalised
from sieveline.operators.neighbours import nearest
from sieveline.session import saved


def vectors_of(predictions: DataFrame) -> DataFrame:
    """id and v: the predictions of each row in the order of probes (bounded by the number of probes)."""
    listed = F.sort_array(F.collect_list(F.struct("k", "p")))
    return predictions.groupBy("id").agg(F.transform(listed, lambda s: s["p"]).alias("v"))


def entropy(mu: Column) -> Column:
    """Binary entropy in bits, of a probability kept off 0 and 1 by 1e-7."""
    p = F.least(F.greatest(mu, F.lit(1e-7)), F.lit(1 - 1e-7))
    return -(p * F.log2(p) + (1 - p) * F.log2(1 - p))


def moments(predictions: DataFrame) -> DataFrame:
    """id, v, mu, sigma, entropy: mean, population deviation over 0.5 (0 to 1), and entropy of the mean."""
    stats = predictions.groupBy("id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda s: s["p"]).alias("v"),
        F.avg("p").alias("mu"),
        F.least(F.greatest(F.stddev_pop("p") / 0.5, F.lit(0.0)), F.lit(1.0)).alias("sigma"),
    )
    return stats.withColumn("entropy", entropy(F.col("mu")))


def neighbourhood(rows: DataFrame, k: int = 15) -> DataFrame:
    """id, agreement and density of rows with v and mu: one search serves both.

    Agreement is the share of the k nearest whose mean is above 0.5; density is
    1 / (mean distance + 1e-8), stretched from 0 to just below 1 over all rows.
    """
    near = nearest(rows.select("id", l2_normalised(F.col("v")).alias("v")), k)
    of = rows.select(F.col("id").alias("nid"), (F.col("mu") > 0.5).cast("double").alias("up"))
    raw = near.join(of, "nid").groupBy("id").agg(F.avg("up").alias("agreement"), (F.lit(1.0) / (F.avg("dist") + 1e-8)).alias("raw"))
    raw = saved(raw)
    span = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).collect()[0]
    if span.lo is None:
        return raw.select("id", "agreement", F.col("raw").alias("density"))
    return raw.select("id", "agreement", ((F.col("raw") - span.lo) / (span.hi - span.lo + 1e-8)).alias("density"))


def scores(predictions: DataFrame, options: Scoring | None = None) -> DataFrame:
    """id, v, mu, sigma, entropy, agreement, density and reliability_score, stored."""
    o = options or Scoring()
    rows = saved(moments(predictions))
    total = (
        o.mean * F.col("mu") + o.stability * (1 - F.col("sigma")) + o.certainty * (1 - F.col("entropy")) + o.agreement * F.col("agreement") + o.density * F.col("density")
    )
    return saved(rows.join(neighbourhood(rows, o.neighbours), "id").withColumn("reliability_score", total))


def thresholds(rows: DataFrame, options: Scoring | None = None) -> tuple[float | None, float | None]:
    """From which score a row is reliable, and below which it is suspect: exact percentiles, or the fixed ones."""
    o = options or Scoring()
    if o.method == "fixed":
        return o.reliable_at, o.uncertain_at
    if o.method != "percentile":
        raise ValueError(f"no threshold method {o.method!r}")
    high, low = exact(rows, "reliability_score", [(100 - o.reliable_percent) / 100, o.suspect_percent / 100])
    return high, low


def classified(rows: DataFrame, high: float | None, low: float | None) -> DataFrame:
    """The rows with reliable, uncertain or suspect as ``classification``; reliable wins where the two overlap."""
    s = F.col("reliability_score")
    return rows.withColumn("classification", F.when(s >= F.lit(high), "reliable").when(s >= F.lit(low), "uncertain").otherwise("suspect"))


def pool(rows: DataFrame, high: float | None, low: float | None) -> DataFrame:
    """Candidates: reliable or uncertain rows."""
    s = F.col("reliability_score")
    return rows.where((s >= F.lit(high)) | (s >= F.lit(low)))


def joint(predictions: DataFrame, labels: DataFrame, options: Scoring | None = None) -> DataFrame:
    """Scores of all splits together, with thresholds from the noisy class alone: id, split, label and the score columns."""
    rows = scores(predictions, options).join(labels.select("id", "split", "label"), "id")
    high, low = thresholds(rows.where(F.col("label") == NOISY), options)
    return classified(rows, high, low)


def class_counts(rows: DataFrame) -> DataFrame:
    """split and the numbers of reliable, uncertain and suspect rows of the noisy class."""
    noisy = rows.where(F.col("label") == NOISY)
    return noisy.groupBy("split").agg(*(F.count_if(F.col("classification") == c).alias(f"n_{c}") for c in ("reliable", "uncertain", "suspect")))
