"""Hand-worked fixtures of scoring, classes, selection and metrics."""

import math

import pytest
from pyspark.sql import functions as F

from sieveline.config import Scoring
from sieveline.operators import metrics, reliability, selection
from sieveline.operators.neighbours import nearest

VECTORS = {1: [0.9, 0.8, 0.95, 0.85], 2: [0.2, 0.9, 0.4, 0.7], 3: [0.1, 0.2, 0.15, 0.05], 4: [0.6, 0.55, 0.7, 0.65], 5: [0.9, 0.85, 0.9, 0.9], 6: [0.5] * 4}
# mu, sigma, entropy, agreement, density, score, class
EXPECTED = {
    1: (0.875, 0.111803, 0.543564, 1.0, 0.547856, 0.790783, "reliable"),
    2: (0.55, 0.538516, 0.992774, 0.5, 0.0, 0.358381, "suspect"),
    3: (0.125, 0.111803, 0.543564, 0.5, 0.001145, 0.383776, "suspect"),
    4: (0.625, 0.111803, 0.954434, 1.0, 0.347486, 0.624097, "uncertain"),
    5: (0.8875, 0.043301, 0.507411, 0.5, 1.0, 0.781478, "reliable"),
    6: (0.5, 0.0, 1.0, 1.0, 0.608177, 0.641227, "uncertain"),
}


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, k, p) for i, v in VECTORS.items() for k, p in enumerate(v)]
    return reliability.scores(spark.createDataFrame(rows, "id long, k int, p double"), Scoring(neighbours=2))


def test_scores_and_classes(scored):
    high, low = reliability.thresholds(scored)
    assert (round(high, 6), round(low, 6)) == (0.711352, 0.503937)
    for r in reliability.classified(scored, high, low).collect():
        want = EXPECTED[r.id]
        got = (r.mu, r.sigma, r.entropy, r.agreement, r.density, r.reliability_score)
        assert got == pytest.approx(want[:6], abs=1e-6)
        assert r.classification == want[6]


def test_scores_stay_in_range(scored):
    r = scored.agg(*(f(c).alias(f"{c}{n}") for c in ("mu", "sigma", "entropy", "agreement", "density") for f, n in ((F.min, 0), (F.max, 1)))).collect()[0]
    assert all(0 <= x <= 1 for x in r)


def test_overlapping_percentiles_prefer_reliable(scored):
    o = Scoring(reliable_percent=80, suspect_percent=60)
    high, low = reliability.thresholds(scored, o)
    assert high < low
    names = {r.classification for r in reliability.classified(scored, high, low).collect()}
    assert names == {"reliable", "suspect"}


def test_selection_orders(scored):
    pool = scored.where(F.col("id").isin(1, 4, 5, 6))
    assert [r.id for r in selection.by_reliability(pool, 3).orderBy("ord").collect()] == [1, 5, 6]
    assert [r.id for r in selection.by_information(pool, 3).orderBy("ord").collect()] == [1, 5, 4]
    assert [r.id for r in selection.by_boundary(pool, 3).orderBy("ord").collect()] == [1, 5, 4]
    for choose in selection.CHOICES.values():
        assert choose(pool, 9, 42).count() == 4


def test_hybrid_quotas():
    assert selection.quotas(7) == (2, 1, 1, 3)


def test_hybrid_size(spark):
    rows = [(i, [i / 100, (i * 7 % 100) / 100], i / 100) for i in range(100)]
    pool = spark.createDataFrame(rows, "id long, v array<double>, reliability_score double")
    found = [r.id for r in selection.hybrid(pool, 20).collect()]
    assert len(found) == len(set(found)) == 20


def test_unknown_strategy(scored):
    with pytest.raises(ValueError, match="no strategy"):
        selection.choose(scored, 2, "best")


ROWS = [(0.9, 1), (0.8, 1), (0.8, 0), (0.6, 1), (0.6, 0), (0.4, 0), (0.2, 1), (0.1, 0)]


def test_metrics(spark):
    found = metrics.evaluate(spark.createDataFrame(ROWS, "s double, y int"))
    want = {"pr_auc": 0.709524, "roc_auc": 0.6875, "threshold": 0.2, "f1": 0.727273, "precision": 0.571429, "recall": 1.0, "n_predicted": 7}
    assert found == pytest.approx(want, abs=1e-6)


def test_metrics_are_the_same_for_monotone_scores(spark):
    rows = spark.createDataFrame(ROWS, "s double, y int")
    a, b = metrics.evaluate(rows), metrics.evaluate(rows.withColumn("s", F.exp(F.col("s") * 3)))
    assert (a["pr_auc"], a["roc_auc"], a["f1"]) == (b["pr_auc"], b["roc_auc"], b["f1"])


def test_metrics_without_positives(spark):
    found = metrics.evaluate(spark.createDataFrame([(0.3, 0), (0.7, 0)], "s double, y int"))
    assert found["threshold"] == 0.5 and found["f1"] == found["recall"] == 0 and found["roc_auc"] is None


@pytest.mark.parametrize("most_sent", [0, 100])
def test_neighbours_of_copies_and_zero_vectors(spark, most_sent):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, [1.0, 0.0])], "id long, v array<double>")
    near = nearest(rows, 2, block=2, most_sent=most_sent)
    assert nearest(rows.limit(0), 2, most_sent=most_sent).count() == 0
    assert [(r.nid, r.dist) for r in near.where("id = 3").orderBy("rank").collect()] == [(1, 0.0), (4, 0.0)]
    assert [(r.nid, r.dist) for r in near.where("id = 2").orderBy("rank").collect()] == [(1, 1.0), (3, 1.0)]


def test_entropy_is_kept_off_the_ends(spark):
    r = spark.range(1).select(reliability.entropy(F.lit(0.0)).alias("a"), reliability.entropy(F.lit(0.5)).alias("b")).collect()[0]
    assert 0 < r.a < 1e-5 and math.isclose(r.b, 1)
