"""Context-set construction in rounds: probe, score, classify, select, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.config import NOISY, TRUSTED, Run
from sieveline.operators import metrics, predict, reliability, sampling, selection
from sieveline.session import saved
from sieveline.sources import sinks, tables

#: The folder of the best set.
BEST = "best_support_set.csv"


@dataclass
class Result:
    """What a run leaves: the best context set and metric, a row of history a round, and the scored rows."""

    best: DataFrame | None
    best_metric: float
    history: list[dict]
    scored: DataFrame


class Construction:
    """A run over rows with id, split, label and vector x, and the named features that x was made of, if there are any."""

    def __init__(self, rows: DataFrame, run: Run | None = None, model: predict.Model | None = None, features: tables.Features | None = None):
        self.features = features
        self.run_options = run or Run()
        self.model = model or predict.AttentionVote(self.run_options.predictor.temperature)
        self.rows = rows
        self.train = rows.where(F.col("split") == "train")

    def score(self) -> DataFrame:
        """Scored and classified noisy training rows. Probes and rows are the same in every round, so this runs once."""
        o = self.run_options
        probes = sampling.probes(self.train, o.probes, o.probe_size)
        predictions = predict.predict(self.train.where(F.col("label") == NOISY), probes, self.model)
        scored = reliability.scores(predictions, o.scoring)
        high, low = reliability.thresholds(scored, o.scoring)
        return reliability.classified(scored, high, low)

    def evaluate(self, context: DataFrame, split: str = "validation", threshold: float | None = None) -> dict[str, float]:
        """Metrics of a context set on a split; the threshold is fitted there unless one is given."""
        rows = self.rows.where(F.col("split") == split)
        found = predict.predict(rows, context.withColumn("k", F.lit(0)), self.model)
        return metrics.evaluate(saved(metrics.scored(found, rows)), threshold)

    def report(self, context: DataFrame, split: str = "validation") -> dict[str, float]:
        """The figures of metric files for a context set on a split."""
        rows = self.rows.where(F.col("split") == split)
        found = predict.predict(rows, context.withColumn("k", F.lit(0)), self.model)
        return metrics.report(saved(metrics.scored(found, rows)))

    def run(self, output: str | None = None) -> Result:
        """Rounds until the metric gains less than ``convergence`` on the round before; scores and sets are written if asked for."""
        o = self.run_options
        scored = self.score()
        counts = {r.classification: r["count"] for r in scored.groupBy("classification").count().collect()}
        pool = scored.where(F.col("classification") != "suspect")
        n_trusted = self.train.where(F.col("label") == TRUSTED).count()
        n_positive, n_negative = sampling.target_sizes(n_trusted, o.target_size)
        best, best_metric, history = None, 0.0, []
        for number in range(1, o.rounds + 1):
            context = saved(selection.context_set(self.train, pool, n_negative, o.strategy, o.seed + number - 1, n_positive))
            found = self.report(context)
            history.append(found | {"iteration": number} | {f"n_{c}": counts.get(c, 0) for c in ("reliable", "uncertain", "suspect")})
            metric = found["pr_auc"] or 0.0
            if metric > best_metric:
                best, best_metric = context, metric
            if number > 1 and metric - (history[-2]["pr_auc"] or 0.0) < o.convergence:
                break
        if output:
            spark = self.rows.sparkSession
            # Scores are the same in every round, so they are written once.
            sinks.write_scores(scored, f"{output}/reliability_scores.csv", "csv")
            sinks.write_table(spark.createDataFrame(history), f"{output}/metrics_history.csv", "csv", one_file=True)
            if best is not None:
                sinks.write_context(best, f"{output}/{BEST}")
            high, low = reliability.thresholds(scored, o.scoring)
            chosen = {r.label: r["count"] for r in best.groupBy("label").count().collect()} if best is not None else {}
            artifacts = {name: f"{output}/{name}.csv" for name in ("best_support_set", "metrics_history", "reliability_scores")}
            sizes = {r.split: r["count"] for r in self.rows.groupBy("split").count().collect()}
            more = {
                "pipeline": {"iterations_run": len(history), "best_metric": best_metric},
                "reliability_scoring": {"resolved_reliable_threshold": high, "resolved_uncertain_threshold": low},
                "support_set_composition": {"n_positives": chosen.get(TRUSTED, 0), "n_negatives": chosen.get(NOISY, 0)},
                "classes": counts,
            }
            sinks.write_manifest(spark, f"{output}/artifact_manifest", sinks.manifest("support_set_construction", artifacts, o, sizes, self.features, more))
        return Result(best, best_metric, history, scored)

    def final(self, output: str, context: DataFrame | None = None) -> dict[str, float]:
        """Metrics on the test split, the threshold fitted there too: of the set saved in the folder, or of a given one."""
        spark = self.rows.sparkSession
        found = self.report(tables.saved_context(spark, f"{output}/{BEST}", self.features) if context is None else context, "test")
        sinks.write_table(spark.createDataFrame([found]), f"{output}/test_metrics.csv", "csv", one_file=True)
        return found
