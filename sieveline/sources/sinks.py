"""Results as files: scores, metrics, context sets, prediction vectors, tables and manifests."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.config import Run
from sieveline.operators.predict import chunk_rows
from sieveline.sources.tables import Features

SCORE_COLUMNS = ("reliability_score", "mu", "sigma", "entropy", "agreement", "density", "classification")

#: Columns of a context set beside its features.
CONTEXT_COLUMNS = frozenset(("id", "label", "x", "ord", "split", "k"))


def run_dir(base: str, kind: str, setting: str = "", now: datetime | None = None) -> str:
    """A folder name that starts with the time, then the kind of run and its setting."""
    stamp = (now or datetime.now(UTC)).strftime("%Y%m%d_%H%M")
    return "/".join([base.rstrip("/"), "_".join(x for x in (stamp, kind, setting) if x)])


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by: tuple[str, ...] = (), one_file: bool = False) -> None:
    """Rows as Parquet or CSV with a header; a folder that exists is an error. ``one_file`` is for small results."""
    writer = (df.coalesce(1) if one_file else df).write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("header", True).format(form).save(path)


def write_scores(scores: DataFrame, path: str, form: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """id and score columns, per iteration or split if asked for."""
    lead = [c for c in ("id", "split", "label", "iteration") if c in scores.columns]
    write_table(scores.select(*lead, *SCORE_COLUMNS), path, form, by)


def write_context(context: DataFrame, path: str, form: str = "csv") -> None:
    """A context set as a table: id first, then each feature as it was read, label last.

    Rows that hold a vector alone give its components, as x_0, x_1 and on.
    """
    features = [F.col(f"`{c}`") for c in context.columns if c not in CONTEXT_COLUMNS]
    if not features:
        size = context.agg(F.max(F.size("x")).alias("d")).collect()[0].d or 0
        features = [F.col("x")[i].alias(f"x_{i}") for i in range(size)]
    write_table(context.select("id", *features, "label"), path, form)


def wide_predictions(predictions: DataFrame, probes: int) -> DataFrame:
    """One row an id with a column p_fraud_probe_k for each probe; the probes are named, so no pass is spent on finding them."""
    keys = [c for c in ("id", "split") if c in predictions.columns]
    wide = predictions.groupBy(*keys).pivot("k", list(range(probes))).agg(F.first("p"))
    return wide.select(*keys, *(F.col(str(k)).alias(f"p_fraud_probe_{k}") for k in range(probes)))


def manifest_row(df: DataFrame, **fields) -> DataFrame:
    """One row of JSON from a one-row frame and constants."""
    constants = [F.lit(json.dumps(v) if isinstance(v, (dict, list, tuple)) else v).alias(k) for k, v in fields.items()]
    return df.select(F.to_json(F.struct(*constants, *df.columns)).alias("manifest"))


def manifest(kind: str, artifacts: dict, run: Run, sizes: dict[str, int], features: Features | None = None, more: dict | None = None, dataset: dict | None = None) -> dict:
    """What a run was made of and what it left: the fields of a manifest file, with the run's parameters as they were resolved.

    ``more`` adds fields, or adds to those that are tables themselves.
    """
    p, s = run.predictor, run.scoring
    out = {
        "artifact_type": kind,
        "artifacts": artifacts,
        "created_at": datetime.now(UTC).isoformat(),
        "dataset": (dataset or {}) | {"n_train": sizes.get("train", 0), "n_val": sizes.get("validation", 0), "n_test": sizes.get("test", 0)},
        "model": {
            "model_type": "AttentionVote",
            "n_estimators": p.members,
            "batch_size": p.batch_size,
            "softmax_temperature": p.temperature,
            "kv_cache": p.cache,
            "random_state": p.seed,
            "chunk_size": chunk_rows(run.probe_size, run.top_features, p.members),
        },
        "preprocessing": {
            "top_features": run.top_features,
            "selected_features": list(features.names) if features else [],
            "ordinal_encoded_columns": dict(features.encoded) if features else {},
        },
        "pipeline": {
            "K": run.probes,
            "support_set_size_initial": run.probe_size,
            "max_iterations": run.rounds,
            "convergence_threshold": run.convergence,
            "eval_metric": "pr_auc",
            "seed": run.seed,
        },
        "reliability_scoring": {
            "w_mean_prob": s.mean,
            "w_stability": s.stability,
            "w_entropy": s.certainty,
            "w_agreement": s.agreement,
            "w_density": s.density,
            "n_neighbors": s.neighbours,
            "similarity_metric": "cosine",
            "threshold_method": s.method,
            "reliable_threshold_config": s.reliable_at,
            "uncertain_threshold_config": s.uncertain_at,
            "reliable_percentile": s.reliable_percent,
            "suspect_percentile": s.suspect_percent,
        },
        "support_set_composition": {"target_size": run.target_size, "neg_sampling_strategy": run.strategy},
    }
    for name, value in (more or {}).items():
        out[name] = out[name] | value if isinstance(out.get(name), dict) else value
    return out


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """Indented JSON as a one-file text folder, by Spark's writer, so that any shared store will do."""
    text = json.dumps(content, indent=2, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").option("lineSep", "\n").text(path)
