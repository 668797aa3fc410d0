"""The three feeds as streams of files. No socket is opened: the source is a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.sources.wire import decode_wire


def lines_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def wire_stream(
    spark: SparkSession, path: str, kind: str, max_files: int | None = None
) -> DataFrame:
    """One feed of wire text, decoded (``relations``, ``tag_uses`` or ``profiles``)."""
    return decode_wire(lines_stream(spark, path, max_files), kind)


def table_stream(
    spark: SparkSession,
    path: str,
    schema: str,
    fmt: str = "parquet",
    max_files: int | None = None,
) -> DataFrame:
    """A feed that lands as structured files."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def feeds(
    spark: SparkSession, relations: str, tag_uses: str, profiles: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        wire_stream(spark, relations, "relations"),
        wire_stream(spark, tag_uses, "tag_uses"),
        wire_stream(spark, profiles, "profiles"),
    )
