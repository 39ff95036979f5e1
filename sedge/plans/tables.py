"""The driver's Parquet tables as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES[:8]) -> None:
    """Register the named tables as views, with UTC times."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
