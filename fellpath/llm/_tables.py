"""Reading input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fellpath.plans.staging import fresh_path, materialise, shared_dir

__all__ = ["fresh_path", "materialise", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, read through Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
