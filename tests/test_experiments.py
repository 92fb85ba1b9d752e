"""Registered experiments against their SQL where there are more trusted rows than half of a target."""

import tracemalloc

import duckdb
import numpy as np
import pytest
from compare import same
from conftest import SF
from pyspark.sql import functions as F

from sieveline.operators import clustering, predict
from sieveline.plans import experiments
from sieveline.plans.construct import Construction
from sieveline.plans.oracle import ORACLE_SQL, diverse, split_sql
from sieveline.plans.queries import QUERIES, SIZES
from sieveline.sources import tables


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """A folder with the vectors twice, the copies under ids of their own, and a connection to it."""
    folder = str(tmp_path_factory.mktemp("copies"))
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    last = rows.agg(F.max("vec_id")).collect()[0][0]
    rows.unionByName(rows.withColumn("vec_id", F.col("vec_id") + last + 1)).coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    assert tables.vectors(spark, folder).where("split = 'train' AND label = 0").count() > max(SIZES) // 2
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    return folder, con


@pytest.mark.parametrize("name", ["ablation_results", "baseline_runs", "ablation_summary", "baseline_best_set", "baseline_summary", "best_run", "convergence_lag"])
def test_all_trusted_rows_are_kept(spark, copies, name):
    folder, con = copies
    same(QUERIES[name](spark, folder), con, ORACLE_SQL[name])


def test_last_bits_make_no_step(spark):
    class LastBits:
        """P(1) of 0.8, which half of the queries get as 0.1 + 0.7."""

        def fit(self, x, y):
            return lambda q: np.where(q[:, 0] > 0, 0.8, 0.1 + 0.7)

    rows = spark.createDataFrame([(i, "validation", i % 2, [float(i > 1)]) for i in range(4)], "id long, split string, label int, x array<double>")
    found = experiments.predicted(Construction(rows, model=LastBits()), rows.withColumn("k", F.lit(0)))
    assert {r.s for r in found.collect()} == {0.2}


def test_large_sets_are_met_in_passes():
    """A batch of queries and a set of 4,000 rows make 320 MB of products, which are never held at once."""
    rng = np.random.default_rng(1)
    x, y, q = rng.normal(size=(4000, 4)), rng.integers(0, 2, 4000).astype(float), rng.normal(size=(10_000, 4))
    tracemalloc.start()
    got = predict.AttentionVote().fit(x, y)(q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    w = np.exp(q[:50] @ x.T / 0.1 - (q[:50] @ x.T / 0.1).max(axis=1, keepdims=True))
    assert np.allclose(got[:50], (w * y).sum(axis=1) / w.sum(axis=1), rtol=0, atol=1e-12)


def test_shared_rows_are_sent_once(spark, monkeypatch):
    """Two sets that share rows, one of them twice, with gaps: what is sent holds each different row once, and predictions are those of the sets."""
    nan = float("nan")
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0]), (1, 1, [0.0, 1.0]), (0, 1, [nan, 0.5]), (1, 1, [1.0, 0.0])]
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or send(self, value))
    queries = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3, nan])], "id long, x array<double>")
    found = predict.predict(queries, spark.createDataFrame(rows, "k int, label int, x array<double>"))
    got = {(r.id, r.k): r.p for r in found.collect()}
    assert len(sent[0][0]) == 4
    q = np.array([[0.1, 0.2], [0.3, 0.0]])
    for k in (0, 1):
        x, y = np.array([r[2] for r in rows if r[0] == k]), np.array([float(r[1]) for r in rows if r[0] == k])
        assert [got[1, k], got[2, k]] == pytest.approx(list(predict.AttentionVote().fit(x, y)(q)), abs=1e-12)


@pytest.fixture(scope="module", params=["sp <> 'validation' OR label > 2", "sp <> 'validation'"], ids=["no trusted validation", "no validation"])
def without(request, spark, tmp_path_factory):
    """A folder with the vectors but trusted validation rows, or but all of them, and a connection to it."""
    folder = str(tmp_path_factory.mktemp("without"))
    con = duckdb.connect()
    kept = f"SELECT vec_id, embedding, label FROM (SELECT *, {split_sql('vec_id')} AS sp FROM '{SF}/embeddings.parquet') WHERE {request.param}"
    con.execute(f"COPY ({kept}) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["ablation_results", "ablation_summary", "baseline_runs", "baseline_best_set", "baseline_summary", "best_run", "convergence_lag"])
def test_areas_may_be_unknown(spark, without, name):
    folder, con = without
    same(QUERIES[name](spark, folder), con, ORACLE_SQL[name])


def test_summary_is_over_diverse_halves(spark, tmp_path, monkeypatch):
    """More trusted rows than half of a target, in clumps: each set holds as many trusted as noisy rows, those that the SQL keeps."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6))[rng.integers(0, 40, 900)] + 0.3 * rng.normal(size=(900, 6))
    rows = [(i, [float(a) for a in v], i % 6) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert tables.vectors(spark, str(tmp_path)).where("split = 'train' AND label = 0").count() > max(SIZES)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    met, measure = [], experiments.measured
    monkeypatch.setattr(experiments, "measured", lambda plan, contexts: met.append(contexts) or measure(plan, contexts))
    same(QUERIES["ablation_summary"](spark, str(tmp_path)), con, ORACLE_SQL["ablation_summary"])
    counts = {(r.k, r.label): r["count"] for r in met[0].groupBy("k", "label").count().collect()}
    assert counts == {(k, label): SIZES[k // 6] // 2 for k in range(12) for label in (0, 1)}


@pytest.mark.parametrize("most", [clustering.MOST_POINTS, 0], ids=["on the driver", "in passes"])
def test_repeatable_kmeans(spark, monkeypatch, most):
    """Clumps with gaps between them, a grid full of ties, rows with copies, and fewer different rows than are asked for; a table no larger is kept whole."""
    monkeypatch.setattr(clustering, "MOST_POINTS", most)
    rng = np.random.default_rng(5)
    clumps = [[float(a), float(b)] for a, b in np.repeat(rng.normal(size=(6, 2)) * 9, 20, axis=0) + rng.normal(size=(120, 2))]
    grid = [[float(i % 9), float(i // 9)] for i in range(81)]
    for points, n, different in ((clumps, 25, None), (grid, 12, None), (clumps[:30] * 4, 12, None), (grid[:5] * 9, 8, 5), (grid[:7], 7, 7)):
        con = duckdb.connect()
        con.execute("CREATE TABLE pos (id bigint, x double[])")
        con.executemany("INSERT INTO pos VALUES (?, ?)", list(enumerate(points)))
        want = [i for (i,) in con.execute(f"WITH RECURSIVE {diverse('pos', {1: n})} SELECT id FROM kept ORDER BY id").fetchall()]
        got = clustering.repeatable(spark.createDataFrame(list(enumerate(points)), "id long, v array<double>").repartition(3), n)
        assert sorted(r.id for r in got.collect()) == want
        assert len(want) == (different or n)
