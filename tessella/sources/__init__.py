"""Inputs and outputs: tables of a folder, and aligned writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_aligned(rows: DataFrame, path: str) -> None:
    """Writes (sid, pos, out) rows, each segment in one file and in order of pos."""
    rows.repartition("sid").sortWithinPartitions("sid", "pos").write.parquet(path)
