"""A local session for tests and benchmarks; on a cluster the given one is used as it is."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local(cpus: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A session on this machine, with as many shuffle partitions as cores."""
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | more
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("sieveline").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share: the one that ``spark.checkpoint.dir`` names.

    Without that setting a local session gets a folder of its own; a cluster is refused, as a folder of one machine dies with it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """The rows, stored in the shared checkpoint folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
