"""Ranking and threshold metrics; the trusted class (label 0) is the one to be found.

Input rows have ``s`` (the score, P(trusted)) and ``y`` (1 for the trusted
class). Rows of equal score are one step of a curve; the steps are added up in
ranges of the score, so no task sorts all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.config import TRUSTED
from sieveline.functions.percentiles import running


def target(label: Column) -> Column:
    """1 for the trusted class, else 0."""
    return (label == TRUSTED).cast("int")


def scored(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """s and y from P(noisy) predictions and labels."""
    return predictions.join(labels.select("id", "label"), "id").select("id", (1 - F.col("p")).alias("s"), target(F.col("label")).alias("y"))


def steps(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, s, np, n, tp, pp: at each score its positives and rows, and those at it or above; with totals tot_p and tot_n.

    Without keys all rows are one group, 0 in the column ``all``.
    """
    rows, keys = (rows, keys) if keys else (rows.withColumn("all", F.lit(0)), ["all"])
    grouped = rows.groupBy(*keys, F.col("s").cast("double").alias("s")).agg(F.sum("y").cast("long").alias("np"), F.count(F.lit(1)).alias("n"))
    total = grouped.groupBy(*keys).agg(F.sum("np").alias("tot_p"), F.sum("n").alias("tot_n"))
    curve = running(grouped, "s", ["np", "n"], keys).withColumnsRenamed({"run_np": "tp", "run_n": "pp"})
    return curve.join(total, keys)


def areas(curve: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pr_auc (average precision, ties grouped) and roc_auc (ties count half); null without both classes."""
    share = F.try_divide(F.col("np").cast("double"), F.col("tot_p")) * F.col("tp") / F.col("pp")
    wins = (F.col("n") - F.col("np")) * (F.col("tp") - F.col("np")) + 0.5 * F.col("np") * (F.col("n") - F.col("np"))
    pairs = F.max(F.col("tot_p") * (F.col("tot_n") - F.col("tot_p")))
    return curve.groupBy(*keys).agg(F.sum(share).alias("pr_auc"), F.try_divide(F.sum(wins), pairs).alias("roc_auc"))


def pr_curve(curve: DataFrame, keys: list[str]) -> DataFrame:
    """keys, threshold, precision and recall at each score, and the closing point (1, 0) without a threshold."""
    points = curve.select(*keys, F.col("s").alias("threshold"), (F.col("tp") / F.col("pp")).alias("precision"), F.try_divide(F.col("tp"), F.col("tot_p")).alias("recall"))
    end = curve.select(*keys).distinct().select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def best_thresholds(curve: DataFrame, keys: list[str], otherwise: float | None = 0.5) -> DataFrame:
    """keys, the lowest score with the best F1 (1e-8 in its denominator), and that F1; ``otherwise`` (None: the lowest score) if no F1 is above 0."""
    p, r = F.col("tp") / F.col("pp"), F.try_divide(F.col("tp"), F.col("tot_p"))
    f1 = F.coalesce(F.round(2 * p * r / (p + r + 1e-8), 12), F.lit(0.0))
    best = curve.select(*keys, "s", f1.alias("f1")).groupBy(*keys).agg(F.max(F.struct(F.col("f1"), (-F.col("s")).alias("low"))).alias("b"))
    lowest = -F.col("b.low")
    at = lowest if otherwise is None else F.when(F.col("b.f1") > 0, lowest).otherwise(otherwise)
    return best.select(*keys, at.alias("threshold"), F.col("b.f1").alias("best_f1"))


def at_thresholds(curve: DataFrame, keys: list[str], thresholds: DataFrame) -> DataFrame:
    """keys, threshold, f1, precision, recall (0 where undefined) and n_predicted at s >= threshold."""
    hit = F.col("s") >= F.col("threshold")
    counts = curve.join(thresholds.select(*keys, "threshold"), keys).groupBy(*keys, "threshold")
    found = counts.agg(F.sum(F.when(hit, F.col("np")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("pp"), F.max("tot_p").alias("p"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    tp, pp, p = F.col("tp"), F.col("pp"), F.col("p")
    return found.select(
        *keys, "threshold", ratio(2 * tp, pp + p).alias("f1"), ratio(tp, pp).alias("precision"), ratio(tp, p).alias("recall"), pp.cast("long").alias("n_predicted")
    )


def evaluate_by(rows: DataFrame, keys: list[str], thresholds: DataFrame | None = None, otherwise: float | None = 0.5) -> DataFrame:
    """All metrics of each group; without thresholds (keys, threshold) the best of the group's own rows is taken, or ``otherwise``."""
    curve = steps(rows, keys)
    at = best_thresholds(curve, keys, otherwise) if thresholds is None else thresholds
    return areas(curve, keys).join(at_thresholds(curve, keys, at), keys)


def evaluate(rows: DataFrame, threshold: float | None = None) -> dict[str, float]:
    """All metrics of the rows as one group."""
    one = rows.withColumn("all", F.lit(0))
    at = None if threshold is None else rows.sparkSession.range(1).select(F.lit(0).alias("all"), F.lit(threshold).alias("threshold"))
    found = evaluate_by(one, ["all"], at).drop("all").collect()
    if not found:
        return dict.fromkeys(("pr_auc", "roc_auc")) | {"threshold": 0.5 if threshold is None else threshold, "f1": 0.0, "precision": 0.0, "recall": 0.0, "n_predicted": 0}
    return found[0].asDict()


#: The columns of metric files, as DDL.
REPORT = "roc_auc double, pr_auc double, f1 double, optimal_threshold double, n_predicted_bogus long"


def report_by(rows: DataFrame, keys: list[str], otherwise: float | None = 0.5) -> DataFrame:
    """keys and the five figures of metric files."""
    figures = ("roc_auc", "pr_auc", "f1", F.col("threshold").alias("optimal_threshold"), F.col("n_predicted").alias("n_predicted_bogus"))
    return evaluate_by(rows, keys, otherwise=otherwise).select(*keys, *figures)


def report(rows: DataFrame) -> dict[str, float]:
    """The five figures of metric files; the threshold is always fitted on the rows themselves."""
    found = evaluate(rows)
    return {k: found[k] for k in ("roc_auc", "pr_auc", "f1")} | {"optimal_threshold": found["threshold"], "n_predicted_bogus": found["n_predicted"]}
