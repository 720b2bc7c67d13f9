"""Parquet table registry: one name, one Parquet path below a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "zones sites scrapers farms stocks web_articles publications raw_records "
    "unit_reference mix_targets size_limits"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; columns are pruned by Catalyst at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Register the named tables as temporary views."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
