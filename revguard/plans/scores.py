"""Score tables in the shape the serving queries read.

``risk_scores`` and ``anomaly_scores`` are produced by the model pipeline
(``revguard.plans.pipeline``).  For SQL-checkable serving queries the same
tables are built from the deterministic stand-in score (``features.rule_score``),
in two versions scored at different times so that "latest score" logic has
something to choose between.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revguard.functions import exprs as X
from revguard.operators import features, rank
from revguard.session import cut_lineage


def scored_at_ts(as_of: _dt.date, days_back: int = 0) -> _dt.datetime:
    return _dt.datetime.combine(as_of - _dt.timedelta(days=days_back), _dt.time())


def with_percentile(risk: DataFrame) -> DataFrame:
    """``rank_percentile`` = percent rank of the probability x 100 per model and version."""
    return rank.percent_rank(risk, "leakage_probability",
                             partition_cols=["model_name", "model_version"], out="_pr") \
        .withColumn("rank_percentile", F.col("_pr") * 100).drop("_pr")


def risk_table(scored: DataFrame, prob: str, *, model_name: str, model_version: str,
               scored_at: _dt.datetime, extra_snapshot: dict | None = None,
               percentile: bool = True) -> DataFrame:
    """Risk-score records: probability, severity band, rank percentile, top features.

    ``scored`` holds invoice features plus the ``prob`` column.  The percentile
    is the distributed percent rank (W1b) per model and version.
    """
    snap = {"prob": F.col(prob)}
    snap.update(extra_snapshot or {})
    df = scored.select(
        "customer_id", "invoice_id",
        F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version"),
        F.col(prob).cast("double").alias("leakage_probability"),
        X.risk_severity(F.col(prob)).alias("risk_severity"),
        X.top_abs_names(features.TOP_FEATURE_CANDIDATES, 5).alias("top_features"),
        F.create_map(*[x for k, v in snap.items() for x in (F.lit(k), v.cast("double"))])
        .alias("feature_snapshot"),
        F.lit(scored_at).cast("timestamp").alias("scored_at"),
        F.lit(scored_at.strftime("%Y-%m")).alias("period_month"),
    )
    return with_percentile(df) if percentile else df


def anomaly_table(scored: DataFrame, score: str, *, model_version: str,
                  scored_at: _dt.datetime, threshold: float = 0.0, proxy: bool = True,
                  snapshot: list[str] | None = None) -> DataFrame:
    """Anomaly-score records: score, flag (score < threshold), min-max proxy, top features.

    ``snapshot`` names the feature columns to keep as ``feature_snapshot``.

    The proxy needs a global min/max, i.e. a second pass over ``scored``;
    ``proxy=False`` leaves it out for reads that only count or group the flags.
    """
    from revguard.operators.metrics import anomaly_proxy
    base = scored.select(
        "customer_id", "invoice_id", F.lit(model_version).alias("model_version"),
        F.col(score).cast("double").alias("score"),
        (F.col(score) < threshold).alias("is_anomaly"),
        F.lit(threshold).cast("double").alias("threshold_used"),
        top_names(scored).alias("top_features"),
        F.lit(scored_at).cast("timestamp").alias("scored_at"),
        F.lit(scored_at.strftime("%Y-%m")).alias("period_month"),
        *([F.create_map(*[x for c in snapshot for x in (F.lit(c), F.col(c).cast("double"))])
           .alias("feature_snapshot")] if snapshot else []),
    )
    return anomaly_proxy(base, "score", out="if_prob_proxy") if proxy else base


def top_names(feat: DataFrame) -> F.Column:
    """F21 of the candidates, or the column that ``stand_in_features`` has made of them."""
    return F.col("top_features") if "top_features" in feat.columns else X.top_abs_names(features.TOP_FEATURE_CANDIDATES, 5)


def stand_in_features(feat: DataFrame) -> DataFrame:
    """What both stand-in tables are made from, written once: the top features and what the two scores read.

    For reads that rank and list both tables: ranks, rows, the proxy's bounds and the anomalies are a pass each, and
    every pass would otherwise join and aggregate the billing tables again, two of them sort the candidates again.
    """
    return cut_lineage(feat.select("customer_id", "invoice_id", "outstanding_ratio", *features.INVOICE_FLAGS,
                                   top_names(feat).alias("top_features")))


def stand_in_risk_scores(feat: DataFrame, as_of: _dt.date, *, percentile: bool = True) -> DataFrame:
    """Two stand-in versions: v0 (30 days earlier, outstanding ratio) and v1 (rule blend).

    Both versions come from one pass over the features, as two structs per row;
    ``percentile=False`` skips the rank for reads that do not use it.
    """
    def version(name: str, days_back: int, prob) -> F.Column:
        at = scored_at_ts(as_of, days_back)
        return F.struct(F.lit(name).alias("model_version"), prob.cast("double").alias("leakage_probability"),
                        F.lit(at).cast("timestamp").alias("scored_at"),
                        F.lit(at.strftime("%Y-%m")).alias("period_month"))

    versions = F.array(version("v1", 0, features.rule_score(feat)),
                       version("v0", 30, features.clipped("outstanding_ratio")))
    both = feat.select("customer_id", "invoice_id",
                       top_names(feat).alias("top_features"),
                       F.explode(versions).alias("_v")).select("customer_id", "invoice_id", "top_features", "_v.*")
    both = both.select(
        "customer_id", "invoice_id", F.lit("rule_blend").alias("model_name"), "model_version", "leakage_probability",
        X.risk_severity(F.col("leakage_probability")).alias("risk_severity"), "top_features",
        F.create_map(F.lit("prob"), F.col("leakage_probability")).alias("feature_snapshot"), "scored_at",
        "period_month")
    return with_percentile(both) if percentile else both


def stand_in_anomaly_scores(feat: DataFrame, as_of: _dt.date, *, proxy: bool = True) -> DataFrame:
    f = feat.withColumn("_s", F.lit(0.3) - features.rule_score(feat))
    return anomaly_table(f, "_s", model_version="v1", scored_at=scored_at_ts(as_of), proxy=proxy)
