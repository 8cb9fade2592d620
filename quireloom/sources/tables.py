"""Parquet tables of one data directory, read by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``data_dir``: one Parquet file or a folder of parts."""
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


def with_text(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows whose null texts are empty texts."""
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})
