"""Random baseline, joint scoring of all splits, and the ablation over target sizes and strategies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.config import NOISY, STRATEGIES, TRUSTED, Run
from sieveline.operators import metrics, predict, reliability, sampling, selection
from sieveline.plans.construct import Construction
from sieveline.session import saved
from sieveline.sources import sinks

METRICS = ("roc_auc", "pr_auc", "f1", "precision", "recall")


def predicted(plan: Construction, contexts: DataFrame) -> DataFrame:
    """k, split, s, y: validation and test rows under every context set, in one pass; stored.

    Scores have twelve decimals: rows with equal vectors are one step of a curve, though their sums may differ in the last bits.
    """
    rows = plan.rows.where(F.col("split").isin("validation", "test"))
    found = predict.predict(rows, contexts, plan.model).join(rows.select("id", "split", "label"), "id")
    return saved(found.select("k", "split", F.round(1 - F.col("p"), 12).alias("s"), metrics.target(F.col("label")).alias("y")))


def measured(plan: Construction, contexts: DataFrame) -> DataFrame:
    """By context set k: validation metrics with their threshold, and test metrics at it."""
    found = predicted(plan, contexts)
    val = saved(metrics.evaluate_by(found.where("split = 'validation'"), ["k"], otherwise=None))
    test = metrics.evaluate_by(found.where("split = 'test'"), ["k"], val)
    named = [df.select("k", *(F.col(m).alias(f"{s}_{m}") for m in METRICS), *more) for s, df, more in (("val", val, ["threshold"]), ("test", test, []))]
    return named[0].join(named[1], "k")


def random_contexts(plan: Construction, target_size: int | None, runs: int, seed: int, chosen: DataFrame | None = None) -> DataFrame:
    """k, id, label, x: for each run the same trusted rows (or those given by id), and as many noisy ones drawn at random with seed + run."""
    trusted = plan.train.where(F.col("label") == TRUSTED)
    n_positive, n_negative = sampling.target_sizes(trusted.count(), target_size)
    chosen = selection.trusted_ids(plan.train, n_positive) if chosen is None else chosen
    keep = trusted.join(chosen, "id").select(F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("k"), "id", "label", "x")
    drawn = sampling.baseline_draws(plan.train.where(F.col("label") == NOISY), n_negative, runs, seed)
    return saved(keep.unionByName(drawn.select(F.col("run").alias("k"), "id", "label", "x")))


def random_baseline(rows: DataFrame, target_size: int | None = None, runs: int = 5, seed: int = 42, model: predict.Model | None = None, trusted: DataFrame | None = None, above: float | None = 0.0) -> tuple[DataFrame, DataFrame | None]:
    """A row for each run (from 1) and split with the figures of metric files, and the best run's context set.

    The best run has the first of the highest validation PR areas, if that is above ``above``; with None it is the first run where no
    area is known, and there is none without validation rows. All runs are predicted in one pass.
    Trusted rows are those given by id; without them half of the target are chosen, as diverse as can be.
    """
    plan = Construction(rows, model=model)
    contexts = random_contexts(plan, target_size, runs, seed, trusted)
    table = saved(metrics.report_by(predicted(plan, contexts), ["k", "split"], otherwise=None).withColumn("run", F.col("k") + 1))
    known = F.lit(True) if above is None else F.col("pr_auc") > above
    best = table.where("split = 'validation'").where(known).orderBy(F.col("pr_auc").desc_nulls_last(), "run").limit(1).collect()
    context = contexts.where(F.col("k") == best[0].k).drop("k") if best else None
    return table.select("run", "split", "roc_auc", "pr_auc", "f1", "optimal_threshold", "n_predicted_bogus"), context


def joint_scores(rows: DataFrame, run: Run | None = None, model: predict.Model | None = None) -> DataFrame:
    """Every row of every split, scored under probes of the training split alone."""
    o = run or Run()
    probes = sampling.probes(rows.where(F.col("split") == "train"), o.probes, o.probe_size, o.seed)
    return reliability.joint(predict.predict(rows, probes, model), rows, o.scoring)


def ablation(rows: DataFrame, sizes: list[int], run: Run | None = None, methods: tuple[str, ...] = STRATEGIES, baseline_runs: int = 5, model: predict.Model | None = None, output: str | None = None, trusted: DataFrame | None = None, pick: Callable[[DataFrame, int, int], DataFrame] | None = None) -> DataFrame:
    """A row for each target size, method and run; rows are scored once for all of them.

    Every set holds the trusted rows given by id; without them half of the target are chosen, as diverse as can be, or by ``pick``.
    """
    o = run or Run()
    plan = Construction(rows, o, model)
    scored = saved(plan.score())
    if output:
        sinks.write_scores(scored, f"{output}/reliability_scores.csv", "csv")
    pool = scored.where(F.col("classification") != "suspect")
    # All sizes, methods and runs are one frame of context sets, predicted and measured in one pass.
    names: list[tuple[int, str, int]] = []
    contexts = None
    for size in sizes:
        n_positive, n_negative = sampling.target_sizes(0, size)
        chosen = selection.trusted_ids(plan.train, n_positive, o.seed, pick) if trusted is None else trusted  # the same for all methods and runs
        parts = [random_contexts(plan, size, baseline_runs, o.seed, chosen).withColumn("k", F.col("k") + len(names))]
        names += [(size, "baseline_random", run + 1) for run in range(baseline_runs)]
        for method in methods:
            one = selection.context_set(plan.train, pool, n_negative, method, o.seed, n_positive, chosen)
            if output:
                one = saved(one)
                sinks.write_context(one, f"{output}/target_{size}/support_set_{method}.csv")
            parts.append(one.select(F.lit(len(names)).alias("k"), "id", "label", "x"))
            names.append((size, method, 1))
        for part in parts:
            contexts = part if contexts is None else contexts.unionByName(part)
    found = measured(plan, saved(contexts))
    label = F.array(*(F.struct(F.lit(n).cast("long").alias("target_size"), F.lit(m).alias("method"), F.lit(r).alias("run")) for n, m, r in names))
    figures = [f"{s}_{m}" for s in ("val", "test") for m in METRICS]
    return found.withColumn("_of", F.element_at(label, F.col("k") + 1)).select("_of.*", *figures, "threshold")


def known(area: str) -> Column:
    """An area, or not a number for null."""
    return F.coalesce(area, F.lit(float("nan")))


def deviation(area: Column, runs: Column) -> Column:
    """The sample deviation of an area: 0 for one run, null for none and where no area is known."""
    return F.when((F.count(area) > 0) | (runs == 1), F.coalesce(F.stddev_samp(area), F.lit(0.0)))


def summary(results: DataFrame) -> DataFrame:
    """Means of the ten metrics by target size and method, and sample deviations of the two PR areas (0 for one run, null where unknown)."""
    means = [F.avg(f"{s}_{m}").alias(f"{s}_{m}_mean") for s in ("val", "test") for m in METRICS]
    deviations = [deviation(F.col(f"{s}_pr_auc"), F.count(F.lit(1))).alias(f"{s}_pr_auc_std") for s in ("val", "test")]
    return results.groupBy("target_size", "method").agg(*means, *deviations)


def overall(results: DataFrame) -> DataFrame:
    """One row over the baseline's runs: means of both areas and F1, and the sample deviation of the PR area (0 for one run, null for none and where unknown), on both splits."""
    out = []
    for short, split in (("val", "validation"), ("test", "test")):
        of = {m: F.when(F.col("split") == split, F.col(m)) for m in ("pr_auc", "roc_auc", "f1")}
        out += [F.avg(c).alias(f"{short}_{m}_mean") for m, c in of.items()]
        out.append(deviation(of["pr_auc"], F.count_if(F.col("split") == split)).alias(f"{short}_pr_auc_std"))
    return results.agg(*out)


def progress(history: DataFrame, order: str, metric: str, least_gain: float = 0.005) -> DataFrame:
    """The history with ``previous``, ``gain``, ``stops`` (gain below the least) and ``best`` (the first of the highest, if above 0)."""
    from pyspark.sql import Window

    by = Window.orderBy(order)  # one row a round
    rank = F.row_number().over(Window.orderBy(F.col(metric).desc(), order))
    out = history.withColumn("previous", F.lag(metric).over(by)).withColumn("gain", F.col(metric) - F.col("previous"))
    return out.withColumn("stops", F.coalesce(F.col("gain") < least_gain, F.lit(False))).withColumn("best", (rank == 1) & (F.col(metric) > 0))
