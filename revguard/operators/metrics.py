"""Model evaluation V1-V7 over a long-form score table.

Input: ``(model_name, label, score)`` rows (U3: every model in one table, so
all reports are one grouped job instead of a loop).  Threshold metrics are
``count_if`` aggregates; ranking metrics (exact ROC-AUC with tie-averaged ranks,
step-wise average precision, Youden-optimal threshold) are computed from
per-(model, distinct score) counts and one distributed prefix-sum pass
(``rank.prefix_sums``), never by collecting scores or sorting in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revguard.functions import exprs as X
from revguard.operators.rank import prefix_sums


def confusion(long: DataFrame, threshold: float = 0.5) -> DataFrame:
    """V1: confusion counts and accuracy / precision / recall / F1 at a cut (zero-division 0)."""
    pred = F.col("score") >= threshold
    pos = F.col("label") == 1
    g = long.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(pos).alias("n_positive"),
        F.count_if(pos & pred).alias("tp"),
        F.count_if(~pos & pred).alias("fp"),
        F.count_if(~pos & ~pred).alias("tn"),
        F.count_if(pos & ~pred).alias("fn"),
    )
    d = lambda c: F.col(c).cast("double")
    prec = F.coalesce(F.try_divide(d("tp"), d("tp") + d("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(d("tp"), d("tp") + d("fn")), F.lit(0.0))
    return g.select(
        "*",
        (F.col("n_positive").cast("double") / d("n_samples") * 100).alias("leakage_rate_pct"),
        ((d("tp") + d("tn")) / d("n_samples")).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        F.coalesce(F.try_divide(2 * d("tp"), 2 * d("tp") + d("fp") + d("fn")), F.lit(0.0)).alias("f1_score"),
    )


def ranking(long: DataFrame) -> DataFrame:
    """V2-V4: exact ROC-AUC, average precision and Youden-optimal threshold per model."""
    grp = long.groupBy("model_name", "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") != 1).alias("neg"))
    # Descending order: before_* = counts at strictly higher scores of the same model
    # once the model's own starting offset is removed.
    pre = prefix_sums(grp, ["model_name", "score"], ["pos", "neg"], descending=True)
    start = pre.groupBy("model_name").agg(
        F.min("before_pos").alias("_p0"), F.min("before_neg").alias("_n0"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = pre.join(start, "model_name")
    hi_pos = F.col("before_pos") - F.col("_p0")
    hi_neg = F.col("before_neg") - F.col("_n0")
    tp = hi_pos + F.col("pos")
    fp = hi_neg + F.col("neg")
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    lo_neg = F.col("N") - hi_neg - F.col("neg")
    j = j.select(
        "model_name", "score", "P", "N",
        # rank-sum AUC term: positives beat the negatives below them, tie counts half
        (F.col("pos") * (lo_neg.cast("double") + F.col("neg").cast("double") / 2)).alias("_auc"),
        # average precision: recall step x precision at this threshold
        F.try_divide(F.col("pos") * tp.cast("double"), (tp + fp).cast("double")).alias("_ap"),
        (F.try_divide(tp.cast("double"), P) - F.try_divide(fp.cast("double"), N)).alias("_j"),
    )
    return j.groupBy("model_name").agg(
        F.try_divide(F.sum("_auc"), F.first("P").cast("double") * F.first("N").cast("double"))
        .alias("roc_auc"),
        F.try_divide(F.sum("_ap"), F.first("P").cast("double")).alias("pr_auc"),
        F.max_by("score", F.struct("_j", "score")).alias("optimal_threshold"),
        F.max("_j").alias("youden_j"),
    )


def evaluate(long: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One comparison row per model (all of V1-V4)."""
    return confusion(long, threshold).join(ranking(long), "model_name")


def class_report(long: DataFrame, threshold: float = 0.5) -> DataFrame:
    """V5: per-class, macro and weighted precision / recall / F1 / support."""
    c = confusion(long, threshold)
    d = lambda x: F.col(x).cast("double")
    z = lambda e: F.coalesce(e, F.lit(0.0))
    p1, r1 = z(F.try_divide(d("tp"), d("tp") + d("fp"))), z(F.try_divide(d("tp"), d("tp") + d("fn")))
    p0, r0 = z(F.try_divide(d("tn"), d("tn") + d("fn"))), z(F.try_divide(d("tn"), d("tn") + d("fp")))
    f = lambda p, r: z(F.try_divide(2 * p * r, p + r))
    s1, s0 = d("tp") + d("fn"), d("tn") + d("fp")
    rows = c.select("model_name", F.explode(F.array(
        F.struct(F.lit("0").alias("cls"), p0.alias("precision"), r0.alias("recall"),
                 f(p0, r0).alias("f1"), s0.alias("support")),
        F.struct(F.lit("1").alias("cls"), p1.alias("precision"), r1.alias("recall"),
                 f(p1, r1).alias("f1"), s1.alias("support")),
        F.struct(F.lit("macro avg").alias("cls"), ((p0 + p1) / 2).alias("precision"),
                 ((r0 + r1) / 2).alias("recall"), ((f(p0, r0) + f(p1, r1)) / 2).alias("f1"),
                 (s0 + s1).alias("support")),
        F.struct(F.lit("weighted avg").alias("cls"),
                 z(F.try_divide(p0 * s0 + p1 * s1, s0 + s1)).alias("precision"),
                 z(F.try_divide(r0 * s0 + r1 * s1, s0 + s1)).alias("recall"),
                 z(F.try_divide(f(p0, r0) * s0 + f(p1, r1) * s1, s0 + s1)).alias("f1"),
                 (s0 + s1).alias("support")),
    )).alias("r"))
    return rows.select("model_name", "r.*")


def anomaly_proxy(scores: DataFrame, score_col: str = "if_score", out: str = "score",
                  by: list[str] | None = None) -> DataFrame:
    """``s = -score`` min-max normalised to [0, 1] (higher = more anomalous).

    The min/max is a one-row (or one-row-per-group) aggregate joined back.
    """
    s = (-F.col(score_col)).alias("_s")
    keys = list(by or [])
    mm = scores.groupBy(*keys).agg(F.min(-F.col(score_col)).alias("_lo"),
                                   F.max(-F.col(score_col)).alias("_hi"))
    j = scores.join(F.broadcast(mm), keys) if keys else scores.crossJoin(F.broadcast(mm))
    return j.withColumn(out, X.minmax_norm(-F.col(score_col), "_lo", "_hi")).drop("_lo", "_hi")


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Counts, positive rate and the neg/pos weight."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.count_if(F.col(label) == 1).alias("n_pos"),
                  F.avg(F.col(label).cast("double")).alias("positive_rate")) \
        .withColumn("neg_pos_ratio", F.try_divide((F.col("n") - F.col("n_pos")).cast("double"),
                                                   F.col("n_pos").cast("double")))
