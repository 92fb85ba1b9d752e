"""Command line: python -m sieveline select|baseline|score|ablation|cost ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.config import STRATEGIES, Predictor, Run, Scoring
from sieveline.operators import encoding
from sieveline.plans import construct, experiments
from sieveline.session import saved
from sieveline.sources import sinks, tables


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    """All flags of the five commands."""
    top = argparse.ArgumentParser(prog="sieveline")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("select", "baseline", "score", "ablation"):
        one = commands.add_parser(name)
        one.add_argument("--setting", required=True, help="folder with train, validation and test tables")
        one.add_argument("--features", help="ranking of features, a table with column feature")
        one.add_argument("--id", default="id")
        one.add_argument("--label", default="label")
        one.add_argument("--format", default="parquet", choices=("parquet", "csv"))
        one.add_argument("--top-features", type=int, default=150)
        one.add_argument("--output", default="exp")
        one.add_argument("--seed", type=int, default=42)
        one.add_argument("--temperature", type=float, default=0.1)
        if name == "baseline":
            one.add_argument("--n-runs", type=int, default=5)
        else:
            one.add_argument("--K", type=int, default=20)
            one.add_argument("--support-size", type=int, default=500)
            one.add_argument("--threshold-method", default="percentile", choices=("percentile", "fixed"))
            one.add_argument("--reliable-threshold", type=float, default=0.75)
            one.add_argument("--uncertain-threshold", type=float, default=0.45)
            one.add_argument("--reliable-percentile", type=float, default=30)
            one.add_argument("--suspect-percentile", type=float, default=30)
        if name in ("select", "baseline"):
            one.add_argument("--target-size", type=int)
        if name == "select":
            one.add_argument("--max-iterations", type=int, default=1)
            one.add_argument("--neg-sampling", default="random", choices=STRATEGIES)
            one.add_argument("--eval-test", action="store_true")
        if name == "ablation":
            one.add_argument("--target-sizes", required=True)
            one.add_argument("--baseline-runs", type=int, default=5)
    cost = commands.add_parser("cost")
    cost.add_argument("--target-sizes", required=True)
    cost.add_argument("--top-features", type=int, default=150)
    cost.add_argument("--n-estimators", type=int, default=8)
    cost.add_argument("--n-query", type=int, default=10_000)
    cost.add_argument("--output", default="exp")
    cost.add_argument("--empirical", action="store_true", help="check the closed forms against a recount of all products")
    return top.parse_args(argv)


def numbers(text: str) -> list[int]:
    return [int(x.strip()) for x in text.split(",")]


def loaded(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, tables.Features]:
    """id, split, label, the features as doubles (texts encoded on train, gaps left) and the vector x of them; and what made x."""
    paths = {s: f"{a.setting}/{s}.{a.format}" for s in tables.SPLITS}
    schema = tables.read_split(spark, paths["train"]).schema
    names = [f.name for f in schema if f.name not in (a.id, a.label)]
    if a.features:
        ranking = tables.read_split(spark, a.features).withColumn("ord", F.monotonically_increasing_id())
        names = [r[0] for r in tables.top_features(ranking, a.top_features).collect()]
    rows = tables.read_splits(spark, paths, names, a.id, a.label)
    texts = [f.name for f in schema if f.name in names and f.dataType.typeName() in ("string", "varchar", "char")]
    codes = encoding.fit(rows.where("split = 'train'"), texts) if texts else None
    rows = encoding.apply(rows, codes, texts) if texts else rows
    rows = rows.select("id", "split", "label", *(F.col(f"`{c}`").cast("double").alias(c) for c in names))
    categories = {r.col: r.n_categories for r in encoding.cardinality(codes).collect()} if texts else {}
    features = tables.features_of(rows, names, tuple(sorted(categories.items())))
    return rows.withColumn("x", features.vector()), features


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("sieveline").getOrCreate()
    output = sinks.run_dir(a.output, a.command, getattr(a, "setting", "").rstrip("/").rsplit("/", 1)[-1])
    if a.command == "cost":
        from sieveline.functions import costs

        table = costs.sweep(spark, numbers(a.target_sizes), a.top_features, a.n_estimators, a.n_query)
        sinks.write_table(table, f"{output}/flops_target_size.csv", "csv", one_file=True)
        largest = None
        if a.empirical:
            checked = saved(costs.validation(spark))
            sinks.write_table(checked, f"{output}/empirical_validation.csv", "csv", one_file=True)
            largest = costs.largest_error(checked).collect()[0][0]
        sinks.write_manifest(spark, f"{output}/artifact_manifest", vars(a) | {"empirical_validation": largest, "linear": costs.linear_coefficients(spark, a.top_features, a.n_estimators).collect()[0].asDict()})
        return
    rows, features = loaded(spark, a)
    sizes = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
    dataset = {"data_setting": a.setting} | {f"{s}_path": f"{a.setting}/{s}.{a.format}" for s in tables.SPLITS}

    def manifest(kind: str, files: list[str], run: Run, **more) -> None:
        content = sinks.manifest(kind, {f: f"{output}/{f}.csv" for f in files}, run, sizes, features, {"arguments": vars(a)} | more, dataset)
        sinks.write_manifest(spark, f"{output}/artifact_manifest", content)

    if a.command == "baseline":
        found, best = experiments.random_baseline(rows, a.target_size, a.n_runs, a.seed)
        for short, split in (("val", "validation"), ("test", "test")):
            sinks.write_table(found.where(F.col("split") == split).drop("split"), f"{output}/{short}_metrics.csv", "csv", one_file=True)
        if best is not None:
            sinks.write_context(best, f"{output}/{construct.BEST}")
        overall = experiments.overall(found)
        sinks.write_table(overall, f"{output}/summary.csv", "csv", one_file=True)
        run = Run(seed=a.seed, target_size=a.target_size, predictor=Predictor(temperature=a.temperature), top_features=a.top_features)
        manifest("baseline_random", ["best_support_set", "val_metrics", "test_metrics", "summary"], run, summary=overall.collect()[0].asDict(), n_runs=a.n_runs)
        return
    scoring = Scoring(method=a.threshold_method, reliable_at=a.reliable_threshold, uncertain_at=a.uncertain_threshold, reliable_percent=a.reliable_percentile, suspect_percent=a.suspect_percentile)
    run = Run(probes=a.K, probe_size=a.support_size, seed=a.seed, scoring=scoring, predictor=Predictor(temperature=a.temperature), top_features=a.top_features)
    if a.command == "score":
        found = experiments.joint_scores(rows, run)
        sinks.write_scores(found, f"{output}/reliability_scores_all.csv", "csv")
        wide = found.select("id", "split", *(F.col("v")[k].alias(f"p_fraud_probe_{k}") for k in range(a.K)))
        sinks.write_table(wide, f"{output}/prediction_vectors.csv", "csv")
        manifest("reliability_scores", ["reliability_scores_all", "prediction_vectors"], run)
    elif a.command == "ablation":
        found = experiments.ablation(rows, numbers(a.target_sizes), run, baseline_runs=a.baseline_runs, output=output)
        found = saved(found)
        sinks.write_table(found, f"{output}/ablation_results.csv", "csv", one_file=True)
        sinks.write_table(experiments.summary(found), f"{output}/ablation_summary.csv", "csv", one_file=True)
        manifest("ablation", ["reliability_scores", "ablation_results", "ablation_summary"], run)
    else:
        from dataclasses import replace

        plan = construct.Construction(rows, replace(run, rounds=a.max_iterations, target_size=a.target_size, strategy=a.neg_sampling), features=features)
        result = plan.run(output)
        if a.eval_test and result.best is not None:
            plan.final(output)


if __name__ == "__main__":
    main()
