"""Tables of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..store import written  # noqa: F401  used by the plans


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
