"""Optional source: the billing tables straight from a relational database.

A partitioned JDBC read: ``partitionColumn`` + bounds split the key range into
``num_partitions`` parallel range queries, and ``fetchsize`` batches rows per
round trip.  Column lists and filters written on the DataFrame are pushed into
the generated SQL.  Needs a JDBC driver on the classpath; not exercised by the
tests (no database is started here).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, table: str, *, key: str, lower: int, upper: int,
               num_partitions: int, props: dict | None = None, fetchsize: int = 10_000) -> DataFrame:
    opts = {"url": url, "dbtable": table, "partitionColumn": key, "lowerBound": str(lower),
            "upperBound": str(upper), "numPartitions": str(num_partitions), "fetchsize": str(fetchsize)}
    opts.update(props or {})
    return spark.read.format("jdbc").options(**opts).load()


def key_bounds(spark: SparkSession, url: str, table: str, key: str, props: dict | None = None) -> tuple[int, int]:
    """min/max of the partition key, pushed down as one aggregate query."""
    q = f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}) b"
    r = spark.read.format("jdbc").options(url=url, dbtable=q, **(props or {})).load().first()
    return int(r["lo"]), int(r["hi"])
