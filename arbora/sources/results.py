"""Result rows that are added run by run, whose columns may grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append_results(rows: DataFrame, path: str) -> None:
    """Adds rows with whatever columns they have; those of earlier runs aren't written again."""
    rows.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All rows, with all columns that any run had; null where a run hadn't one."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def export_csv(results: DataFrame, path: str) -> None:
    """CSV files with one header for all rows."""
    results.write.mode("overwrite").option("header", "true").csv(path)
