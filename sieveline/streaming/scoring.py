"""Scoring of rows as they arrive, against probes and thresholds that a batch run has fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveline.operators import predict, reliability


def score_stream(rows: DataFrame, probes: DataFrame, high: float, low: float, path: str, checkpoint: str, model: predict.Model | None = None) -> StreamingQuery:
    """Appends id, mu, sigma, entropy and a provisional class of each arriving row (id, x) to a Parquet folder.

    Agreement and density need the population, so the class uses the three
    parts of the score that a row has by itself, rescaled to weight 1. Every
    micro-batch is one batch job; a batch that is repeated after a failure
    overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = reliability.moments(predict.predict(batch, probes, model))
        alone = (0.30 * F.col("mu") + 0.20 * (1 - F.col("sigma")) + 0.15 * (1 - F.col("entropy"))) / 0.65
        scored = reliability.classified(found.withColumn("reliability_score", alone), high, low)
        scored.drop("v").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
