"""Labelled tables with splits: read from files, or derived from the corpus folder's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLITS = ("train", "validation", "test")


def split_of(key: Column) -> Column:
    """train, validation or test by the first hex digit of the id's md5: ten, three and three of sixteen."""
    digit = F.substring(F.md5(key.cast("string").cast("binary")), 1, 1)
    return F.when(digit.isin("a", "b", "c"), "validation").when(digit.isin("d", "e", "f"), "test").otherwise("train")


def read_split(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table of one split: CSV with a header, or Parquet by its suffix. Give CSV a schema, so that splits cannot drift apart."""
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return spark.read.parquet(path)


def read_splits(spark: SparkSession, paths: dict[str, str], features: list[str], id_col: str, label_col: str) -> DataFrame:
    """All splits as one frame: id, split, label and the features; validation and test take the types of train."""
    train = read_split(spark, paths["train"])
    columns = [id_col, label_col, *features]
    missing = [c for c in columns if c not in train.columns]
    if missing:
        raise KeyError(f"train lacks {missing}")
    schema = train.schema
    parts = [train if name == "train" else read_split(spark, path, schema) for name, path in paths.items()]
    tagged = [
        part.select(F.col(id_col).alias("id"), F.lit(name).alias("split"), F.col(label_col).cast("int").alias("label"), *features)
        for name, part in zip(paths, parts, strict=True)
    ]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part)
    return out


def top_features(ranking: DataFrame, n: int, feature_col: str = "feature", order_col: str = "ord") -> DataFrame:
    """The first n features in the ranking's explicit order."""
    return ranking.orderBy(order_col).limit(n).select(feature_col)


@dataclass(frozen=True)
class Features:
    """Named features and the range of each in the training split: how rows become vectors."""

    names: tuple[str, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    #: Categories of each encoded column.
    encoded: tuple[tuple[str, int], ...] = ()

    def vector(self) -> Column:
        """The features brought to 0..1 by the training ranges; missing ones stay missing."""
        return F.array(*((F.col(f"`{c}`").cast("double") - a) / (b - a + 1e-8) for c, a, b in zip(self.names, self.low, self.high, strict=True)))


def features_of(rows: DataFrame, names: list[str], encoded: tuple[tuple[str, int], ...] = ()) -> Features:
    """The ranges of the named columns over the training rows; of a column without values, 0."""
    ranges = [F.coalesce(f(F.col(f"`{c}`").cast("double")), F.lit(0.0)) for c in names for f in (F.min, F.max)]
    found = rows.where("split = 'train'").agg(*ranges).collect()[0] if names else ()
    return Features(tuple(names), tuple(found[::2]), tuple(found[1::2]), encoded)


def saved_context(spark: SparkSession, path: str, features: Features | None = None, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """A stored context set: id, its features as doubles, label, and the vector x.

    x comes from the named features, or, without names, is the file's feature columns as they stand.
    """
    df = read_split(spark, path)
    names = [c for c in df.columns if c not in (id_col, label_col)]
    rows = df.select(F.col(id_col).alias("id"), *(F.col(f"`{c}`").cast("double").alias(c) for c in names), F.col(label_col).cast("int").alias("label"))
    return rows.withColumn("x", features.vector() if features else F.array(*(F.col(f"`{c}`") for c in names)))


def class_rows(df: DataFrame, label: int) -> DataFrame:
    """Rows of one class."""
    return df.where(F.col("label") == label)


def not_class_rows(df: DataFrame, label: int) -> DataFrame:
    """Rows of any other class."""
    return df.where(F.col("label") != label)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, split, label and vector x: the embeddings; labels 0 to 2 are the trusted class."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("label") <= 2, 0).otherwise(1).alias("label")
    return df.select(F.col("vec_id").alias("id"), split_of(F.col("vec_id")).alias("split"), label, F.col("embedding").cast("array<double>").alias("x"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, split, label and mixed features: documents that have a quality label."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    text = F.coalesce("text", F.lit(""))
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"),
        split_of(F.col("doc_id")).alias("split"),
        "label",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.length(text).cast("double").alias("n_code_points"),
        F.size(F.split(text, "\n")).cast("double").alias("n_lines"),
        "lang",
        "source",
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, split, label and mixed features: orders with their customer and nation; status P is the trusted class.

    One priority is missing, and one segment has another name in the test split, so that encodings meet both cases.
    """
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    split = split_of(F.col("o_orderkey"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.select(
        F.col("o_orderkey").alias("id"),
        split.alias("split"),
        F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("label"),
        "o_totalprice",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"),
        F.when((split == "test") & (F.col("c_mktsegment") == "MACHINERY"), "ROBOTICS").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.col("n_name").alias("nation"),
    )
