"""Edge lists, tracked tags and LibSVM files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_edges(lines: DataFrame, comment: str | None = None) -> DataFrame:
    """``src dst`` per line, split by white space, weight 1; ``comment`` lines are left out."""
    if comment is not None:
        lines = lines.where(~F.contains(F.col("value"), F.lit(comment)))
    ends = F.split(F.trim(F.col("value")), r"\s+")
    return (
        lines.where(F.trim("value") != "")
        .select(ends.alias("ends"))
        .select(
            F.get("ends", F.lit(0)).try_cast("bigint").alias("src"),
            F.get("ends", F.lit(1)).try_cast("bigint").alias("dst"),
            F.lit(1).alias("weight"),
        )
        .where("src IS NOT NULL AND dst IS NOT NULL")
    )


def read_edges(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    return parse_edges(spark.read.text(path), comment)


def tracked_tags(lines: DataFrame) -> DataFrame:
    """The tag dimension: lower case, each tag once."""
    return (
        lines.select(F.lower(F.trim("value")).alias("hashtag")).where("hashtag <> ''").distinct()
    )


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """Labelled vectors. Naming ``num_features`` saves the pass that would find it."""
    reader = spark.read.format("libsvm")
    if num_features is not None:
        reader = reader.option("numFeatures", num_features)
    return reader.load(path)
