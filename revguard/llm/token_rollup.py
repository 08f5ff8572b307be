"""Operator 7: token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are additive: an insert adds a
document's count, a delete takes it away, a revised count adds the difference.
A batch of changes carries each document's count before and after (null: not
there), is summed per group before the shuffle, and is committed as one
partition of a Parquet table in a single dynamic overwrite.  Committing a batch
again, after a lost driver or by mistake, replaces it by the same sums, so
batches count once.  ``totals`` adds the committed batches up; ``compact`` folds
the batches up to a number into a base that later reads begin from.

Defined cases: a null text has no tokens; null source and language are groups of
their own; a change that is null before and after counts nothing; repeated rows
count each; groups whose documents are all gone vanish; an empty batch replaces
an earlier one of its number and an empty store gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revguard.llm.common import cut_lineage, pick, spread_join, words_of

GROUP = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
STORE = SUMS + ", batch_id long"


def word_count(text: Column) -> Column:
    """Version words-1: runs of anything but ASCII white space."""
    return F.size(words_of(text)).cast("long")


def piece_count(text: Column) -> Column:
    """Version pieces-1: runs of ASCII letters, runs of digits, and every other mark by itself."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")).cast("long")


def deltas(changes: DataFrame) -> DataFrame:
    """Sums by group of changes (source, lang, tokenizer, before, after)."""
    def there(c: str) -> Column:
        return F.col(c).isNotNull().cast("long")

    summed = pick(changes, *GROUP, "before", "after").groupBy(*GROUP).agg(
        F.sum(there("after") - there("before")).alias("n_docs"),
        F.sum(F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("n_tokens"))
    return summed.where("n_docs <> 0 or n_tokens <> 0")


def commit(changes: DataFrame, store: str, batch_id: int) -> None:
    """Makes ``changes`` batch ``batch_id`` of the store, in place of any earlier commit of that batch.

    A batch without changes is written as one row of zeros, so that it replaces what was there.  A number that a base has
    already folded in is an error: its rows would never be read.
    """
    spark = changes.sparkSession
    folded = _read(spark, f"{store}/base").agg(F.max("batch_id")).first()[0]
    if folded is not None and batch_id <= folded:
        raise ValueError(f"batch {batch_id} comes late: all batches up to {folded} are folded into the base")
    nothing = spark.createDataFrame([(None, None, None, 0, 0)], SUMS)
    (deltas(changes).unionByName(nothing).withColumn("batch_id", F.lit(batch_id).cast("long")).coalesce(1)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
     .parquet(f"{store}/deltas"))


def _read(spark: SparkSession, path: str) -> DataFrame:
    """A table of the store; empty if no batch has written it yet."""
    home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(home)
    return spark.read.schema(STORE).parquet(path) if there else spark.createDataFrame([], STORE)


def totals(spark: SparkSession, store: str) -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
    base = _read(spark, f"{store}/base")
    upto = base.agg(F.max("batch_id").alias("upto"))  # one row
    # of the bases only the last counts, and of the batches those after it
    live = base.crossJoin(F.broadcast(upto)).where("batch_id = upto").drop("upto", "batch_id")
    late = (_read(spark, f"{store}/deltas").crossJoin(F.broadcast(upto)).where("upto is null or batch_id > upto")
            .drop("upto", "batch_id"))
    out = live.unionByName(late).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return out.where("n_docs <> 0 or n_tokens <> 0")


def compact(spark: SparkSession, store: str, upto: int) -> None:
    """Folds all batches up to ``upto`` into a base; batches must be numbered in the order they were committed."""
    last = _read(spark, f"{store}/base").agg(F.max("batch_id")).first()[0]
    old = _read(spark, f"{store}/base").where(F.lit(last is not None) & (F.col("batch_id") == F.lit(last or 0)))
    new = _read(spark, f"{store}/deltas").where((F.col("batch_id") <= upto) & (F.col("batch_id") > F.lit(
        last if last is not None else -1 << 62)))
    folded = cut_lineage(old.unionByName(new).groupBy(*GROUP).agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")))
    (folded.withColumn("batch_id", F.lit(upto).cast("long")).coalesce(1).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{store}/base"))


def corpus_changes(docs: DataFrame) -> list[tuple[int, DataFrame]]:
    """A corpus's history as change batches, from its documents.

    1 inserts every document (words-1); 2 revises the count of documents whose repeated lines are taken out; 3 deletes
    documents whose text a smaller doc_id has; 4 counts what is left by another tokenizer version (pieces-1).
    """
    own = pick(docs, "doc_id", "text", "lang", "source")
    text = F.coalesce("text", F.lit(""))
    once = F.array_join(F.array_distinct(F.split(text, "\n")), "\n")
    rows = cut_lineage(own.select(
        "doc_id", "source", "lang", F.sha2(text, 256).alias("digest"), word_count(F.col("text")).alias("words"),
        word_count(once).alias("once"), piece_count(once).alias("pieces")))
    first = cut_lineage(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    marked = cut_lineage(spread_join(rows, first, "digest", "n").select(
        "source", "lang", "words", "once", "pieces", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy")))
    none = F.lit(None).cast("long")

    def change(rows_: DataFrame, tokenizer: str, before: Column, after: Column) -> DataFrame:
        return rows_.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), before.alias("before"),
                            after.alias("after"))

    return [(1, change(marked, "words-1", none, F.col("words"))),
            (2, change(marked.where("once <> words"), "words-1", F.col("words"), F.col("once"))),
            (3, change(marked.where("copy"), "words-1", F.col("once"), none)),
            (4, change(marked.where("not copy"), "pieces-1", none, F.col("pieces")))]
