"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revguard.session import cut_lineage, ensure_checkpoint_dir

# Words are runs of anything but ASCII white space, everywhere in this package.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\f\r"

__all__ = ["SPACES", "SPACE_CLASS", "bounded_broadcast", "cut_lineage", "ensure_checkpoint_dir", "let",
           "new_folder", "pick", "read_table", "shuffle_width", "spread_join", "words_of", "written"]


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Column-pruned scan of one table of the folder."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, by exact position, so that clashing extra columns do no harm."""
    return df.select(*[df[c] for c in columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda variable is bound once; a plain Column would be inlined into every
    place (and into every step of an inner lambda) that mentions it.
    """
    return F.transform(F.array(value), lambda v: body(v))[0]


def words_of(text: Column) -> Column:
    """The words of a text; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"[{SPACE_CLASS}]+"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint if the (materialised) frame has at most ``max_rows`` rows; else the frame as it is,
    which Spark then joins by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined to ``table`` (materialised, each key once, ``n`` rows of it in ``rows``) on ``key``.

    Keys with more rows than a partition's share, of which there are at most as many as partitions, are salted: their
    rows are dealt to as many salts as they fill shares, and their entry is repeated for each, so all repeated entries
    together are at most twice as many as partitions.
    """
    parts = shuffle_width(rows.sparkSession)
    share = max((table.agg(F.sum(n)).first()[0] or 0) / parts, 1)
    count = F.when(F.col(n) > share, F.ceil(F.col(n) / share)).otherwise(1).cast("int")
    hot = table.where(F.col(n) > share).select(F.col(key).alias("__hot"), count.alias("__salts"))
    salted = rows.join(F.broadcast(hot), rows[key] == F.col("__hot"), "left").withColumn("__salt", F.pmod(
        F.monotonically_increasing_id(), F.coalesce("__salts", F.lit(1))).cast("int"))
    spread = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), count - 1)))
    return salted.join(spread, [key, "__salt"]).drop("__hot", "__salts", "__salt")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a compressed table to the shared folder and read again.

    Cuts the lineage as a checkpoint does, for rows that are many: columns take a fraction of a checkpoint's space.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
