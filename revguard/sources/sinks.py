"""Sinks S3-S11: idempotent Parquet writes instead of row-by-row inserts.

Writes are task-parallel (one file per task); re-runs are made idempotent with
anti-joins on the natural key instead of driver-side id sets.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revguard.session import cut_lineage


def exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds a readable Parquet table."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this run has written."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def write_alerts(alerts: DataFrame, path: str, *, detected_at: _dt.datetime, mode: str = "append") -> None:
    """S3: alert rows partitioned by rule code (one directory per rule)."""
    alerts.withColumn("detected_at", F.lit(detected_at).cast("timestamp")) \
        .withColumn("is_resolved", F.lit(False)) \
        .write.mode(mode).partitionBy("rule_code").parquet(path)


def replace_or_skip(df: DataFrame, path: str, *, clear: bool, writer=None) -> bool:
    """``clear`` -> overwrite; otherwise write only when the target is absent or empty.

    Returns True when something was written.  The emptiness test is
    ``isEmpty()`` (a limit-1 job), not a count.
    """
    spark = df.sparkSession
    if not clear and exists(spark, path) and not spark.read.parquet(path).isEmpty():
        return False
    (writer or (lambda d, p: d.write.mode("overwrite").parquet(p)))(df, path)
    return True


def new_rows(candidates: DataFrame, existing: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows whose key is not in ``existing`` (left anti-join), one row per key."""
    c = candidates.dropDuplicates(keys)
    return c if existing is None else c.join(existing.select(*keys).distinct(), keys, "left_anti")


def append_new(df: DataFrame, path: str, keys: list[str], *, partition_by: list[str] | None = None) -> int:
    """Append only rows whose key is not yet written; returns rows appended.

    The new rows are checkpointed first so that the appended set and the count
    come from one evaluation (the anti-join reads the same path it appends to).
    """
    spark = df.sparkSession
    existing = spark.read.parquet(path) if exists(spark, path) else None
    fresh = cut_lineage(new_rows(df, existing, keys))
    n = fresh.count()
    if n:
        w = fresh.write.mode("append")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
    return n


def write_csv(df: DataFrame, path: str, *, single_file: bool = False) -> None:
    """CSV with header; ``single_file`` only for small, bounded report frames."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, *, limit: int | None = None) -> None:
    """JSON records (``limit`` for the top-n / sample reports)."""
    (df.limit(limit) if limit else df).write.mode("overwrite").json(path)


def write_attributions(contribs: DataFrame, cols: list[str], path: str, *, key: str = "invoice_id") -> None:
    """The full attribution matrix as ``(key, feature -> contribution)`` Parquet."""
    m = F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(f"c_{c}") for c in cols]))
    contribs.select(key, m.alias("contributions")).write.mode("overwrite").parquet(path)


def soft_delete(df: DataFrame, keys: DataFrame, key: str, *, at: _dt.datetime) -> DataFrame:
    """Mark rows whose key is in ``keys`` as deleted (flag + timestamp), others unchanged.

    Returns the rewritten table (Parquet has no in-place update).
    """
    k = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    j = df.join(k, key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = j.withColumn("is_deleted", F.col("is_deleted") | hit)
    ts = F.lit(at).cast("timestamp")
    if "deleted_at" in df.columns:
        out = out.withColumn("deleted_at", F.when(hit & F.col("deleted_at").isNull(), ts)
                             .otherwise(F.col("deleted_at")))
    else:
        out = out.withColumn("deleted_at", F.when(hit, ts))
    return out.drop("_hit")


def update_partitions(spark: SparkSession, path: str, keys: DataFrame, key: str, change: Callable[[DataFrame], DataFrame], *,
                      partition_by: str) -> list:
    """Applies ``change`` to the partitions of a table that hold rows with a key in ``keys``; returns their values.

    Only these partitions are read whole and written again, in one dynamic overwrite; the files of all others stay as they
    are.  The new rows are checkpointed before the old files go, and a change that gives the same rows again (as
    ``soft_delete`` and ``explain.attach`` do) makes a replay change nothing.  Partition values are at most as many as the
    table's folders.
    """
    table = spark.read.parquet(path)
    hit = table.select(key, partition_by).join(keys.select(key).distinct(), key, "left_semi").select(partition_by).distinct()
    touched = [r[0] for r in hit.collect()]
    if not touched:
        return []
    mine = F.col(partition_by).isin([v for v in touched if v is not None])
    if None in touched:
        mine = mine | F.col(partition_by).isNull()
    new = cut_lineage(change(table.filter(mine)).select(*table.columns))
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path))
    spark.catalog.refreshByPath(path)
    return touched


def soft_delete_rows(spark: SparkSession, path: str, keys: DataFrame, key: str, *, at: _dt.datetime, partition_by: str) -> list:
    """S11 on a stored table that has ``is_deleted`` and ``deleted_at``: only partitions with such keys are written again.

    Rows that were deleted before keep their time.
    """
    return update_partitions(spark, path, keys, key, lambda rows: soft_delete(rows, keys, key, at=at), partition_by=partition_by)
