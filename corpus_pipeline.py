"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner
writes it as Parquet and reads it again for the next one. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import decontamination, language, mixing, secret_scan, shingle_join
from sieveline.llm.common import saved, shared_dir, table

#: Columns that stages read. Others are set aside under names that no operator uses, and get their own names back.
OWN = ("doc_id", "text", "lang", "source", "n_chars")

#: Keys of 17 bytes that may be sent to every task; texts meet more of them in a shuffle.
MOST_SENT = 500_000


def sent(keys: DataFrame) -> DataFrame:
    keys = saved(keys)
    return F.broadcast(keys) if keys.limit(MOST_SENT + 1).count() <= MOST_SENT else keys.hint("merge")


def aside(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(f"`{c}`").alias(c if c in OWN else f"_kept_{c}") for c in docs.columns))


def back(docs: DataFrame) -> list[Column]:
    """The documents' columns from a frame made of those set aside."""
    return [F.col(f"`{c}`") if c in OWN else F.col(f"`_kept_{c}`").alias(c) for c in docs.columns]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters go, and those whose best two languages are less than 5 % apart in size.

    The dictionaries are learned from the documents of this stage, and without labelled ones nothing is told, and nothing stays.
    Nulls in other columns don't matter, repeated rows are told each, an empty table stays empty.
    """
    return language.classify(aside(docs), language.fit(docs)).where("accepted").select(back(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id, then the least hash of its text; null ids come last.

    Documents link at a Jaccard index of ``percent`` hundredths on shingles of ``width`` words. Rows are told apart by id and text,
    so another text under a dropped one's id stays; of rows that repeat both, one stays, the least by its columns. Documents
    without words are in no group and stay. An empty table stays empty.
    """
    # Sixteen bytes in the order of ids and hashes, after one that puts null ids last.
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    text_hash = F.lpad(F.hex(F.xxhash64(F.coalesce("text", F.lit("")))), 16, "0")
    key = F.unhex(F.concat(F.coalesce(F.concat(F.lit("00"), number), F.lit("01")), text_hash))
    keyed = aside(docs).withColumn("_key", key)
    found = shingle_join.join(keyed.select("_key", "text"), id_col="_key", width=width, percent=percent).where("n_shingles > 0")
    found = saved(found.select("_key", "component_id"))
    kept = keyed.join(sent(found.where("_key <> component_id").select("_key").distinct()), "_key", "left_anti")
    # Only rows that repeat id and text are shuffled to find one of them.
    repeated = sent(found.where("_key = component_id").groupBy("_key").count().where("count > 1").select("_key"))
    one = kept.join(repeated, "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(*aside(docs).columns)).alias("row")).select("row.*")
    return kept.join(repeated, "_key", "left_anti").drop("_key").unionByName(one).select(back(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; those without words hold none, and rows are judged each by its own text."""
    return decontamination.find_hits(aside(docs), table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(back(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets replaced by their kind; n_chars follows the text, and a null text keeps what it has.

    Values that many sources hold are copied examples and stay. Rows that repeat an id are cleaned each by its own text.
    """
    clean = secret_scan.redact(aside(docs), secret_scan.scan(docs))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(back(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, n_slots and first_slot: what the mix takes of each document, null and empty ones included."""
    return mixing.mix(docs.select("doc_id", "text", "source"))


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("mixture", mixture),
]

#: Compression sizes have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the cluster's shared checkpoint folder and read again, and goes when the next one is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return docs
