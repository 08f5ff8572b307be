"""Batch jobs end to end at sf0.001: outputs exist and re-runs add nothing."""
import os
import tempfile

from revguard.plans import jobs
from tests.conftest import SF0001


def test_rules_job_replace_or_skip(spark):
    out = tempfile.mkdtemp(prefix="rg-jobs-")
    assert jobs.run_rule_engine(spark, SF0001, out)
    n = spark.read.parquet(os.path.join(out, "rule_alerts")).count()
    assert n > 0
    assert not jobs.run_rule_engine(spark, SF0001, out)          # skipped: table not empty
    assert jobs.run_rule_engine(spark, SF0001, out, clear=True)  # replaced
    assert spark.read.parquet(os.path.join(out, "rule_alerts")).count() == n


def test_forecast_job_insert_if_absent(spark):
    out = tempfile.mkdtemp(prefix="rg-jobs-")
    first = jobs.run_forecasting(spark, SF0001, out, by=["segment"])
    assert first > 0
    assert jobs.run_forecasting(spark, SF0001, out, by=["segment"]) == 0
    rows = spark.read.parquet(os.path.join(out, "forecast_results"))
    assert rows.count() == first
    by_model = {r["model_name"]: r["count"] for r in rows.groupBy("model_name").count().collect()}
    assert by_model["trend"] == by_model["additive"] == first // 2
    summary = spark.read.option("header", True).csv(os.path.join(out, "forecast_summary")).collect()
    assert {r.model_name for r in summary} == {"trend", "additive"}
    assert all(float(r.cv_rmse_mean) > 0 for r in summary if r.cv_rmse_mean)


def test_scoring_job_train_then_load(spark):
    out = tempfile.mkdtemp(prefix="rg-jobs-")
    c1 = jobs.run_scoring(spark, SF0001, out, n_trees=20, gbt_iters=5, cv_folds=2)
    assert c1["risk_scores"] > 0 and c1["anomaly_scores"] == c1["risk_scores"]
    c2 = jobs.run_scoring(spark, SF0001, out, train=False)
    assert c2 == {"anomaly_scores": 0, "risk_scores": 0}
    assert spark.read.json(os.path.join(out, "reports/evaluation")).count() == 4
    cv = spark.read.json(os.path.join(out, "reports/logistic_cv")).first()
    assert cv["folds"] == 2 and 0.5 < cv["cv_auc_mean"] <= 1
    assert spark.read.parquet(os.path.join(out, "attributions")).count() == c1["risk_scores"]
