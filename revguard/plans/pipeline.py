"""End-to-end batch runs (the reference's pipeline, rules run and forecast run).

``score_pipeline`` is load -> engineer -> split -> train -> evaluate -> score ->
explain, all as Spark jobs:

* the engineered invoice table is materialised once, by the chronological
  split's checkpoint (every learner, the evaluation and the scoring read it);
* the chronological split is the distributed row index (W6b);
* isolation forest, logistic regression and boosted trees train in the
  executors; scoring is ``transform`` / ``mapInPandas`` with broadcast models
  whose size is bounded by the model, not the data;
* evaluation is one grouped job over a long-form ``(model, label, score)`` table.
"""

from __future__ import annotations

import datetime as _dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revguard.functions import exprs as X
from revguard.operators import explain, features, forest, marts, metrics, models, rank, rules
from revguard.plans import scores
from revguard.session import cut_lineage
from revguard.sources.billing import AS_OF, Billing, billing_views

# Blend weights and the decision cut of the scoring run.
GBT_WEIGHT, LR_WEIGHT = 0.70, 0.30
THRESHOLD = 0.50


@dataclass
class ScoreRun:
    features: DataFrame
    scored: DataFrame
    evaluation: DataFrame
    risk_scores: DataFrame
    anomaly_scores: DataFrame
    importance: DataFrame
    explanations: DataFrame | None = None
    global_importance: DataFrame | None = None
    contributions: DataFrame | None = None
    models: dict = field(default_factory=dict)


def engineered(b: Billing) -> DataFrame:
    """M1 -> M4 -> M7 with the chronological split column."""
    feat = features.invoice_features(marts.invoice_mart(b), b.as_of)
    split = rank.time_split(feat, "issue_date", "invoice_id")
    return features.feature_matrix(split, features.INVOICE_FEATURE_COLS,
                                   keep=["invoice_id", "customer_id", "issue_date", "split"])


def score_all(df: DataFrame, iso: forest.IsolationForestModel, lr, gbt) -> DataFrame:
    """Isolation forest, logistic regression, boosted trees, blend and IF proxy."""
    # The proxy's minimum and maximum are a pass of their own over these scores: the trees are walked once.
    s = cut_lineage(forest.score(df, iso, out="if_score", flag="if_is_anomaly"))
    s = models.positive_prob(lr, s, "lr_probability", "lr_leakage_prob")
    s = models.positive_prob(gbt, s, "gbt_probability", "gbt_leakage_prob", pred="gbt_leakage_pred")
    s = s.withColumn("ensemble_prob", X.blend("gbt_leakage_prob", "lr_leakage_prob", GBT_WEIGHT, LR_WEIGHT)) \
         .withColumn("ensemble_pred", (F.col("ensemble_prob") >= THRESHOLD).cast("int"))
    return metrics.anomaly_proxy(s, "if_score", out="if_prob_proxy")


def long_scores(scored: DataFrame) -> DataFrame:
    """One ``(model_name, label, score)`` row per model and invoice."""
    arr = F.array(
        F.struct(F.lit("isolation_forest").alias("model_name"), F.col("if_prob_proxy").alias("score")),
        F.struct(F.lit("logistic_regression").alias("model_name"), F.col("lr_leakage_prob").alias("score")),
        F.struct(F.lit("gbt").alias("model_name"), F.col("gbt_leakage_prob").alias("score")),
        F.struct(F.lit("ensemble").alias("model_name"), F.col("ensemble_prob").alias("score")))
    return scored.select(F.col("label").cast("int").alias("label"), F.explode(arr).alias("m")) \
        .select("m.model_name", "label", "m.score")


def score_records(scored: DataFrame, as_of: _dt.date, *, model_version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """Risk and anomaly records of scored rows, alike whether the models were just fitted or loaded."""
    snap = {"lr_prob": F.col("lr_leakage_prob"), "ensemble_prob": F.col("ensemble_prob"),
            "if_anomaly": F.col("if_is_anomaly")}
    at = scores.scored_at_ts(as_of)
    risk = scores.risk_table(scored, "gbt_leakage_prob", model_name="gbt", model_version=model_version,
                             scored_at=at, extra_snapshot=snap)
    anomaly = scores.anomaly_table(scored, "if_score", model_version=model_version, scored_at=at,
                                   snapshot=features.TOP_FEATURE_CANDIDATES)
    return risk, anomaly


def explained(data: DataFrame, risk: DataFrame, gbt, *, model_version: str = "v1") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The contribution matrix (written once), local explanations, and the risk records that carry them."""
    cols = features.INVOICE_FEATURE_COLS
    contrib = cut_lineage(explain.tree_contributions(data, gbt, cols, keys=["invoice_id"]))
    local = explain.local_explanations(contrib, cols)
    return contrib, local, explain.attach(risk, local, model_name="gbt", model_version=model_version)


def score_pipeline(b: Billing, *, n_trees: int = 200, psi: int = 256, gbt_iters: int = 600,
                   explain_rows: bool = True, model_version: str = "v1") -> ScoreRun:
    cols = features.INVOICE_FEATURE_COLS
    # ``engineered`` already reads from the split's checkpoint (rows written once in
    # range order); what follows is a projection and a broadcast join of offsets.
    data = engineered(b)
    train = data.filter(F.col("split") == "train")
    val = data.filter(F.col("split") == "val")

    # Iterations of the logistic regression are small jobs; the forest grows beside them.
    with ThreadPoolExecutor(1) as pool:
        fitted = pool.submit(inheritable_thread_target(train.sparkSession)(models.train_logistic), train, cols)
        iso = forest.fit(train, cols, n_trees=n_trees, max_samples=psi)
        lr = fitted.result()
    gbt = models.train_gbt(train, val, cols, max_iter=gbt_iters)

    # Scores feed the evaluation, both score tables and the attributions: materialise once.
    scored = cut_lineage(score_all(data, iso, lr, gbt))
    evaluation = metrics.evaluate(long_scores(scored.filter(F.col("split") == "test")), THRESHOLD)
    # The IF proxy is normalised over the rows evaluated, as the reference does on the test split.
    if_test = metrics.anomaly_proxy(scored.filter(F.col("split") == "test").drop("if_prob_proxy"),
                                    "if_score", out="score") \
        .select(F.lit("isolation_forest").alias("model_name"), F.col("label").cast("int").alias("label"),
                "score")
    evaluation = evaluation.filter(F.col("model_name") != "isolation_forest") \
        .unionByName(metrics.evaluate(if_test, THRESHOLD))

    risk, anomaly = score_records(scored, b.as_of, model_version=model_version)
    run = ScoreRun(features=data, scored=scored, evaluation=evaluation, risk_scores=risk,
                   anomaly_scores=anomaly, importance=models.feature_importance(gbt, cols),
                   models={"isolation_forest": iso, "logistic_regression": lr, "gbt": gbt})
    if explain_rows:
        run.contributions, run.explanations, run.risk_scores = explained(data, risk, gbt, model_version=model_version)
        run.global_importance = explain.global_importance(run.contributions, cols)
    return run


def rules_run(b: Billing) -> tuple[DataFrame, DataFrame]:
    """All alerts and the per (rule, severity) summary."""
    alerts = rules.run_rules(b)
    return alerts, rules.rule_summary(alerts)


def open_billing(spark: SparkSession, sf_dir: str, as_of: _dt.date = AS_OF) -> Billing:
    return billing_views(spark, sf_dir, as_of)
