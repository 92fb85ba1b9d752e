"""Encoding, imputation, sampling, order statistics, costs, sinks, prediction and streaming."""

import json
import math

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline import __main__ as cli
from sieveline.config import Architecture, Run
from sieveline.functions import costs, percentiles
from sieveline.functions.vectors import filled, imputed, l2_normalised
from sieveline.operators import encoding, predict, sampling
from sieveline.plans import experiments
from sieveline.plans.construct import Construction
from sieveline.sources import sinks, tables


def test_encoding(spark):
    rows = spark.createDataFrame([(i, "train", c) for i, c in enumerate(["b", "A", "a", None, "A"])] + [(9, "validation", "a"), (10, "validation", "z"), (11, "validation", None)], "id int, split string, c string")
    codes = encoding.fit(rows.where("split = 'train'"), ["c"])
    assert {r.category: r.code for r in codes.collect()} == {"A": 0, "a": 1, "b": 2}
    got = {r.id: r.c for r in encoding.apply(rows, codes, ["c"]).collect()}
    assert [got[i] for i in range(5)] == [2, 0, 1, -1, 0] and [got[i] for i in (9, 10, 11)] == [1, -1, -1]
    assert {(r.split, r.n_unseen) for r in encoding.unseen(rows, codes, ["c"]).collect()} == {("train", 0), ("validation", 1)}


def test_imputation(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1.0, nan), (nan, nan), (3.0, nan)], "a double, b double")
    assert sorted((r.a, r.b) for r in imputed(rows, ["a", "b"]).collect()) == [(1, 0), (2, 0), (3, 0)]


def test_normalised_zero_vector(spark):
    r = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>").select(l2_normalised(F.col("v")).alias("u")).collect()
    assert [x.u for x in r] == [[0, 0], [0.6, 0.8]]


def test_probes_are_stratified(spark):
    rows = spark.createDataFrame([(i, i % 4 and 1) for i in range(80)], "id long, label int")
    found = sampling.probes(rows, 3, 5).groupBy("k", "label").count().collect()
    assert {(r.k, r.label): r["count"] for r in found} == {(k, y): n for k in range(3) for y, n in ((0, 2), (1, 3))}
    few = sampling.probes(rows.where("id < 8"), 1, 100).count()
    assert few == 8


def test_draws_repeat_and_differ_by_run(spark):
    rows = spark.range(200).select("id", F.lit(1).alias("label"))
    a, b = (sorted((r.run, r.id) for r in sampling.baseline_draws(rows, 10, 2).collect()) for _ in range(2))
    assert a == b and {i for r, i in a if r == 0} != {i for r, i in a if r == 1}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6) | st.integers(-3, 3).map(float), min_size=1, max_size=60), st.floats(0, 1))
def test_percentiles_are_exact(spark, values, share):
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for most in (percentiles.MOST, 5):  # sorted at once, and bracketed
        assert percentiles.exact(rows, "x", [share], most)[0] == pytest.approx(float(np.percentile(values, 100 * share)), rel=1e-9, abs=1e-9)


def test_percentiles_of_nothing(spark):
    assert percentiles.exact(spark.createDataFrame([(None,), (float("nan"),)], "x double"), "x", [0.1, 0.9]) == [None, None]


def test_running_sums(spark):
    rows = spark.range(2000).select((F.col("id") * 7 % 1000).cast("double").alias("s"), F.lit(2).alias("n"), (F.col("id") >= 1000).alias("g"))
    got = percentiles.running(rows, "s", ["n"], ["g"], parts=7)
    assert got.where(F.col("run_n") != 2 * (1000 - F.col("s"))).count() == 0 and got.count() == 2000


GOLDEN = {100: (4428058624, 822102704128, 45102688944128, 826530762752), 1000: (4605005824, 5935548694528, 51985606934528, 5940153700352), 5000: (5391437824, 32515492118528, 86429870358528, 32520883556352)}


def test_costs_are_the_published_ones():
    d = Architecture()
    for n, (query, fit, uncached, single) in GOLDEN.items():
        assert costs.per_query(n, 298, 8, d) == query and costs.fit(n, 298, 8, d) == fit
        assert costs.call(10_000, n, 298, 8, d, False) == uncached and costs.call(1, n, 298, 8, d, False) == single


def test_chunks():
    assert [predict.chunk_rows(*c) for c in ((500, 150, 8), (1000, 150, 8), (5000, 150, 8), (500, 298, 8), (100, 10, 1))] == [1258, 758, 100, 385, 50000]


def test_both_ways_of_prediction_agree(spark):
    rows = tables.vectors(spark, SMALL)
    sets = sampling.probes(rows, 2, 20)
    asked = rows.where("id < 60")
    a = {(r.id, r.k): r.p for r in predict.predict(asked, sets).collect()}
    b = {(r.id, r.k): r.p for r in predict.predict_by_set(asked, sets, predict.AttentionVote(), blocks=3).collect()}
    assert a.keys() == b.keys() and len(a) == 2 * asked.count()
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_another_model_plugs_in(spark):
    class Prior:
        def fit(self, x, y):
            return lambda q: np.full(len(q), y.mean())

    rows = tables.vectors(spark, SMALL)
    got = predict.predict(rows.where("id < 5"), sampling.probes(rows, 1, 10), Prior()).collect()
    assert {r.p for r in got} == {0.5}


def test_run_writes_its_results(spark, tmp_path):
    plan = Construction(tables.vectors(spark, SMALL), Run(probes=2, probe_size=20, rounds=2, target_size=60))
    out = f"{tmp_path}/run"
    result = plan.run(out)
    assert result.best.where("label = 0").count() == 30 and result.best_metric > 0
    saved = tables.read_split(spark, f"{out}/best_support_set.csv")
    dim = len(result.best.first().x)
    assert saved.columns == ["id", *(f"x_{i}" for i in range(dim)), "label"] and saved.count() == result.best.count()
    assert tables.read_split(spark, f"{out}/reliability_scores.csv").count() == result.scored.count()
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{out}/artifact_manifest").collect()))
    assert manifest["pipeline"]["iterations_run"] == len(result.history) and manifest["model"]["chunk_size"] == predict.chunk_rows(20, 150, 8)
    assert manifest["support_set_composition"]["n_positives"] == manifest["support_set_composition"]["n_negatives"] == 30
    # The saved set is read back, and gives what the set itself gives.
    assert plan.final(out) == pytest.approx(plan.final(f"{tmp_path}/other", result.best))
    assert spark.read.option("header", True).csv(f"{out}/test_metrics.csv").count() == 1


def test_progress_and_summary(spark):
    rows = spark.createDataFrame([(1, 0.6), (2, 0.61), (3, 0.612)], "iteration int, metric double")
    got = experiments.progress(rows, "iteration", "metric").orderBy("iteration").collect()
    assert [r.stops for r in got] == [False, False, True] and [r.best for r in got] == [False, False, True]


def test_splits_from_files(spark, tmp_path):
    for split, rows in {"train": [(1, 0.5, "a", 0), (2, None, "b", 1)], "validation": [(3, 1.5, "c", 1)], "test": [(4, 2.5, None, 0)]}.items():
        spark.createDataFrame(rows, "case_no long, f double, g string, label int").write.option("header", True).csv(f"{tmp_path}/{split}.csv")
    paths = {s: f"{tmp_path}/{s}.csv" for s in tables.SPLITS}
    rows = tables.read_splits(spark, paths, ["f", "g"], "case_no", "label")
    assert {(r.id, r.split, r.f, r.g) for r in rows.collect()} == {(1, "train", 0.5, "a"), (2, "train", None, "b"), (3, "validation", 1.5, "c"), (4, "test", 2.5, None)}
    with pytest.raises(KeyError):
        tables.read_splits(spark, paths, ["nothing"], "case_no", "label")
    a = cli.arguments(["score", "--setting", str(tmp_path), "--format", "csv", "--id", "case_no", "--K", "2"])
    rows, features = cli.loaded(spark, a)
    got = {r.id: r.x for r in rows.collect()}
    assert len(got) == 4 and all(len(x) == 2 for x in got.values()) and got[1][1] == 0
    # Gaps stay gaps: the range of train is that of its one value.
    assert got[2][0] is None and (features.low, features.high, features.encoded) == ((0.5, 0.0), (0.5, 1.0), (("g", 2),))


def test_saved_sets_keep_names_and_gaps(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", 0, 2.0, None), (2, "train", 1, 6.0, 3.0), (3, "test", 1, 4.0, 5.0)], "id long, split string, label int, a double, `b c` double")
    features = tables.features_of(rows, ["a", "b c"])
    whole = rows.withColumn("x", features.vector())
    sinks.write_context(whole.where("split = 'train'"), f"{tmp_path}/set.csv")
    got = tables.saved_context(spark, f"{tmp_path}/set.csv", features)
    assert got.columns == ["id", "a", "b c", "label", "x"]
    want = {r.id: r for r in whole.collect()}
    for r in got.collect():
        assert (r.a, r["b c"], r.label, r.x) == (want[r.id].a, want[r.id]["b c"], want[r.id].label, want[r.id].x)


def test_commands_write_what_they_name(spark, tmp_path):
    """Every command on a small folder of tables: files, runs from 1, names of methods, and sets that can be read back."""
    rows = tables.vectors(spark, SMALL).where("id < 160").select("id", "split", "label", *(F.col("x")[i].alias(f"f{i}") for i in range(4)))
    for s in tables.SPLITS:
        rows.where(F.col("split") == s).drop("split").write.parquet(f"{tmp_path}/in/{s}.parquet")
    spark.createDataFrame([("f2",), ("f0",), ("f1",)], "feature string").coalesce(1).write.option("header", True).csv(f"{tmp_path}/ranking.csv")
    common = ["--setting", f"{tmp_path}/in", "--features", f"{tmp_path}/ranking.csv", "--top-features", "2"]
    few = ["--K", "2", "--support-size", "10"]
    for command, more in (("select", [*few, "--target-size", "11", "--eval-test"]), ("baseline", ["--n-runs", "2", "--target-size", "11"]), ("score", few), ("ablation", [*few, "--target-sizes", "10", "--baseline-runs", "2"])):
        cli.main([command, *common, "--output", f"{tmp_path}/{command}", *more])
    (select,), (base,), (score,), (ablation,) = (list((tmp_path / c).iterdir()) for c in ("select", "baseline", "score", "ablation"))
    chosen = tables.read_split(spark, f"{select}/best_support_set.csv")
    assert chosen.columns == ["id", "f2", "f0", "label"] and {r.label: r["count"] for r in chosen.groupBy("label").count().collect()} == {0: 5, 1: 5}
    assert tables.read_split(spark, f"{select}/test_metrics.csv").count() == 1
    assert {r.run for r in tables.read_split(spark, f"{base}/val_metrics.csv").collect()} == {1, 2}
    assert tables.read_split(spark, f"{score}/reliability_scores_all.csv").count() == rows.count()
    found = {(r.method, r.run) for r in tables.read_split(spark, f"{ablation}/ablation_results.csv").collect()}
    assert found == {("baseline_random", 1), ("baseline_random", 2)} | {(m, 1) for m in ("random", "reliable", "informed", "kmeans", "boundary", "hybrid")}
    assert tables.read_split(spark, f"{ablation}/target_10/support_set_hybrid.csv").columns == ["id", "f2", "f0", "label"]
    assert tables.read_split(spark, f"{ablation}/reliability_scores.csv").count() == rows.where("split = 'train' AND label = 1").count()


def test_cost_command(spark, tmp_path):
    cli.main(["cost", "--target-sizes", "100, 200", "--top-features", "298", "--empirical", "--output", f"{tmp_path}"])
    (out,) = tmp_path.iterdir()
    table = tables.read_split(spark, f"{out}/flops_target_size.csv").collect()
    assert [r.per_query_flops for r in table] == [4428058624, 4447719424]
    checked = tables.read_split(spark, f"{out}/empirical_validation.csv").collect()
    assert len(checked) == 6 and all(r.measured == r.analytical for r in checked)


def test_target_sizes():
    assert [sampling.target_sizes(7, t) for t in (None, 10, 11)] == [(7, 7), (5, 5), (5, 5)]


def test_gaps_are_filled_for_clusters_alone(spark):
    rows = spark.createDataFrame([(1, [1.0, None]), (2, [float("nan"), 4.0]), (3, [5.0, 6.0]), (4, [2.0, 9.0])], "id long, v array<double>")
    assert {r.id: r.v for r in filled(rows).collect()} == {1: [1, 6], 2: [2, 4], 3: [5, 6], 4: [2, 9]}
    x = np.array([[1.0, np.nan], [0.0, 1.0]])
    assert np.isfinite(predict.AttentionVote().fit(x, np.array([0.0, 1.0]))(x)).all()


def test_names_and_wide_vectors(spark):
    assert sinks.run_dir("exp", "cost").startswith("exp/2") and sinks.run_dir("exp", "score", "s1").endswith("_score_s1")
    rows = spark.createDataFrame([(1, 0, 0.25), (1, 1, 0.75)], "id long, k int, p double")
    assert sinks.wide_predictions(rows, 2).collect()[0].asDict() == {"id": 1, "p_fraud_probe_0": 0.25, "p_fraud_probe_1": 0.75}


def test_streamed_rows_are_scored(spark, tmp_path):
    from sieveline.streaming.scoring import score_stream

    rows = tables.vectors(spark, SMALL)
    rows.select("id", "x").where("id < 30").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, x array<double>").parquet(f"{tmp_path}/in")
    score_stream(stream, sampling.probes(rows, 2, 20), 0.6, 0.4, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 30 and got.where("classification IS NULL").count() == 0
