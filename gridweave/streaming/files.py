"""Extraction over a stream of text files: an extension, since parameter grids know no streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.extract import extract


def stream_rows(spark: SparkSession, folder: str, patterns: Mapping[str, str], files_per_trigger: int = 1000) -> DataFrame:
    """Typed rows of files as they arrive, with their path; stateless, so any sink and trigger will do."""
    texts = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return extract(texts.selectExpr("_metadata.file_path AS path", "value AS text"), patterns, ["path"])


def stream_table(spark: SparkSession, folder: str, schema: str, patterns: Mapping[str, str], keep: Sequence[str], text: str) -> DataFrame:
    """Typed rows of a streamed Parquet table's text column."""
    return extract(spark.readStream.schema(schema).parquet(folder), patterns, keep, text)
