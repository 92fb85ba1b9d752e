"""Ordinal encoding of categorical columns, fitted on the training split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.config import MANY_CATEGORIES, UNSEEN


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each id and column: id, split, col, category."""
    pairs = F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("category")) for c in columns))
    return df.select("id", "split", F.explode(pairs).alias("p")).select("id", "split", "p.*")


def fit(train: DataFrame, columns: list[str]) -> DataFrame:
    """col, category, code: categories of the training split in string order, from 0; missing ones have no code."""
    found = long_form(train, columns).where(F.col("category").isNotNull()).select("col", "category").distinct()
    return found.withColumn("code", F.row_number().over(Window.partitionBy("col").orderBy("category")) - 1)


def apply(df: DataFrame, codes: DataFrame, columns: list[str], as_type: str = "double") -> DataFrame:
    """The rows with each column replaced by its code; unseen and missing categories become -1.

    The codes are one small dimension table a column; Spark broadcasts them
    while they are small and shuffles by category otherwise.
    """
    out = df
    for c in columns:
        one = codes.where(F.col("col") == c).select(F.col("category").alias(f"_{c}"), F.col("code").alias(f"_code_{c}"))
        joined = out.join(one, F.col(c).cast("string") == F.col(f"_{c}"), "left")
        out = joined.withColumn(c, F.coalesce(F.col(f"_code_{c}"), F.lit(UNSEEN)).cast(as_type)).drop(f"_{c}", f"_code_{c}")
    return out.select(df.columns)


def unseen(df: DataFrame, codes: DataFrame, columns: list[str]) -> DataFrame:
    """split, col, n_unseen: categories that are there but not in training, by split and column."""
    rows = long_form(df, columns).groupBy("split", "col", "category").agg(F.count(F.lit(1)).alias("n"))
    joined = rows.join(codes, ["col", "category"], "left")
    strange = F.col("category").isNotNull() & F.col("code").isNull()
    return joined.groupBy("split", "col").agg(F.sum(F.when(strange, F.col("n")).otherwise(0)).cast("long").alias("n_unseen"))


def cardinality(codes: DataFrame, limit: int = MANY_CATEGORIES) -> DataFrame:
    """col, n_categories and whether that is more than the limit."""
    return codes.groupBy("col").agg(F.count(F.lit(1)).alias("n_categories")).withColumn("high", F.col("n_categories") > limit)


def cardinality_map(codes: DataFrame) -> DataFrame:
    """One row: a map of column to number of categories, for manifests."""
    sizes = codes.groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("col", "n")))).alias("encoding_sizes"))
