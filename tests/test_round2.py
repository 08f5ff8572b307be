"""Checks of the second round's changes: hot keys, NULL keys, patience, folds, shared folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from revguard import session
from revguard.functions import exprs as X
from revguard.operators import boosting, models, rank


def test_percent_rank_with_one_score_on_half_the_rows(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, F.lit(0.5)).otherwise(
        (F.col("id") % 97) / 97.0).alias("score"))
    got = {r.id: r.pr for r in rank.percent_rank(df, "score", out="pr", num_partitions=8).collect()}
    rows = df.collect()
    ordered = np.sort([r.score for r in rows])
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.id] == pytest.approx(np.searchsorted(ordered, r.score) / (len(rows) - 1))
    # the hot score's rows are joined on several partitions
    joined = rank.percent_rank(df, "score", out="pr", num_partitions=8)
    parts = joined.where("score = 0.5").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1 or "Broadcast" in joined._jdf.queryExecution().executedPlan().toString()


def test_ranking_more_rows_than_the_bound(spark, monkeypatch):
    df = spark.range(300).select("id", (F.col("id") % 7 / 7.0).alias("score"), (F.col("id") % 2).alias("g"))
    rows = df.where("id < 40")
    few = {tuple(r) for r in rank.percent_rank_of(rows, df, "score", partition_cols=["g"]).collect()}
    monkeypatch.setattr(rank, "MAX_RANKED_ROWS", 10)
    assert few == {tuple(r) for r in rank.percent_rank_of(rows, df, "score", partition_cols=["g"]).collect()}


def test_null_keys_spread_over_partitions(spark):
    inv = spark.range(4000).select(F.col("id").alias("invoice_id"),
                                   F.when(F.col("id") % 10 == 0, F.col("id") % 50).alias("subscription_id"))
    dim = spark.range(0, 50, 10).select(F.col("id").alias("subscription_id"), (F.col("id") * 2).alias("mrr"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = X.left_lookup(inv, dim, "subscription_id", "invoice_id")
        nulls = out.where("subscription_id is null").groupBy(F.spark_partition_id().alias("p")).count().collect()
        rows = {r.invoice_id: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert out.columns == ["invoice_id", "subscription_id", "mrr"] and len(rows) == 4000
    assert len(nulls) > 4 and max(r["count"] for r in nulls) < 1200
    assert all(r.mrr == (None if r.subscription_id is None else r.subscription_id * 2) for r in rows.values())


def test_patience():
    assert boosting.best_round([.5, .6, .7, .7, .69, .7], 3) == (3, True)
    assert boosting.best_round([.5, .6, .7, .7, .69, .71], 3) == (6, False)
    assert boosting.best_round([.5, .6, .55, .56], 40) == (2, False)


def test_folds_are_stratified(spark):
    df = spark.range(6000).select(F.col("id").alias("invoice_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    rows = models.stratified_folds(df, "label", "invoice_id", 5, 42).groupBy("_fold").agg(
        F.count("*").alias("n"), F.avg("label").alias("rate")).collect()
    assert len(rows) == 5 and all(abs(r["n"] - 1200) < 120 and abs(r["rate"] - .1) < .02 for r in rows)


class _Cluster:
    """What ``ensure_checkpoint_dir`` reads of a session on a cluster without a checkpoint folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_no_local_checkpoint_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Cluster)
