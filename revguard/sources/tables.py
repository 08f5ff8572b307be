"""Scans of the driver's parquet tables.

Every scan names its columns, so the Parquet reader only decodes those
(``ReadSchema`` in the plan) and filters written later on the DataFrame reach
the reader as ``PushedFilters``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read(spark: SparkSession, sf_dir: str, name: str, cols: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path(sf_dir, name))
    return df.select(*cols) if cols else df
