"""Batch jobs with outputs: the rules run, the scoring run and the forecast run.

Each job reads the billing tables, runs the operators and writes Parquet
through the idempotent sinks, so a re-run (or a retried job after executor
loss) adds no duplicate rows:

* ``run_rule_engine``: alerts partitioned by rule code; an existing non-empty
  alert table is kept unless ``clear`` (replace-or-skip), plus the summary.
* ``run_scoring``: trains (or loads) the models, appends anomaly and risk scores
  whose ``(invoice_id, model_version)`` is new, and writes the evaluation
  report, the global importance and the attribution matrix.
* ``run_forecasting``: appends forecast rows whose
  ``(model_name, series_key, metric, period_month, model_version)`` is new and writes the
  per-series summary.

    python -m revguard.plans.jobs rules|score|forecast --sf-dir DIR --out DIR
"""

from __future__ import annotations

import argparse
import datetime as _dt
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from revguard.operators import features, forecast, marts, models, rules
from revguard.plans import pipeline
from revguard.session import cut_lineage
from revguard.sources import sinks
from revguard.sources.billing import AS_OF, billing_views


def _p(out: str, name: str) -> str:
    return os.path.join(out, name)


def run_rule_engine(spark: SparkSession, sf_dir: str, out: str, *, clear: bool = False,
                    as_of: _dt.date = AS_OF) -> bool:
    """R8 + S3/S4: write all alerts (skip when present unless ``clear``) and the summary."""
    b = billing_views(spark, sf_dir, as_of)
    alerts = rules.run_rules(b)
    detected = _dt.datetime.combine(as_of, _dt.time())
    wrote = sinks.replace_or_skip(
        alerts, _p(out, "rule_alerts"), clear=clear,
        writer=lambda d, p: sinks.write_alerts(d, p, detected_at=detected, mode="overwrite"))
    summary = rules.rule_summary(spark.read.parquet(_p(out, "rule_alerts")))
    sinks.write_csv(summary, _p(out, "rule_summary"), single_file=True)  # <= rules x severities rows
    return wrote


def run_scoring(spark: SparkSession, sf_dir: str, out: str, *, train: bool = True, sink: bool = True,
                model_version: str = "v1", n_trees: int = 200, gbt_iters: int = 600, cv_folds: int = 5,
                as_of: _dt.date = AS_OF) -> dict:
    """Train (with a stratified cross-validation of the logistic model) or load, score,
    append new scores, write reports."""
    b = billing_views(spark, sf_dir, as_of)
    model_dir = _p(out, f"models/{model_version}")
    if train:
        run = pipeline.score_pipeline(b, n_trees=n_trees, gbt_iters=gbt_iters, model_version=model_version)
        models.save(run.models["logistic_regression"], _p(model_dir, "logistic_regression"))
        models.save(run.models["gbt"], _p(model_dir, "gbt"))
        run.models["isolation_forest"].save(spark, _p(model_dir, "isolation_forest"))
        risk, anomaly = run.risk_scores, run.anomaly_scores
        reports = {"evaluation": run.evaluation, "global_importance": run.global_importance,
                   "feature_importance": run.importance}
        if cv_folds:
            reports["logistic_cv"] = models.cross_validate_logistic(
                run.features.filter(F.col("split") == "train"), features.INVOICE_FEATURE_COLS, folds=cv_folds)
    else:
        from revguard.operators import forest
        iso = forest.IsolationForestModel.load(spark, _p(model_dir, "isolation_forest"))
        lr = models.load(_p(model_dir, "logistic_regression"))
        gbt = models.load(_p(model_dir, "gbt"))
        data = pipeline.engineered(b)
        scored = pipeline.cut_lineage(pipeline.score_all(data, iso, lr, gbt))
        risk, anomaly = pipeline.score_records(scored, as_of, model_version=model_version)
        _, _, risk = pipeline.explained(data, risk, gbt, model_version=model_version)
        reports = {}
    counts = {}
    if sink:
        key = ["invoice_id", "model_version"]
        counts["anomaly_scores"] = sinks.append_new(anomaly, _p(out, "anomaly_scores"), key,
                                                    partition_by=["period_month"])
        counts["risk_scores"] = sinks.append_new(risk, _p(out, "risk_scores"), key,
                                                 partition_by=["period_month"])
        for name, df in reports.items():
            sinks.write_json(df, _p(out, f"reports/{name}"))
        if train:
            sinks.write_attributions(run.contributions, features.INVOICE_FEATURE_COLS, _p(out, "attributions"))
    return counts


def run_forecasting(spark: SparkSession, sf_dir: str, out: str, *, by: list[str] | None = None,
                    model_version: str = "v1", as_of: _dt.date = AS_OF) -> int:
    """T1-T8 + S6/S7: back-test, cross-validate and forecast every series with the trend fit and the additive
    (trend x yearly season) fit, insert new rows, write a summary row per series and model."""
    b = billing_views(spark, sf_dir, as_of)
    series = cut_lineage(forecast.series_frame(marts.monthly_revenue(b, by=by), keys=by))  # read by every fit
    fits = {"trend": (forecast.forecast_backtest(series), forecast.cross_validate(series)),
            "additive": (forecast.additive_backtest(series), forecast.cross_validate_additive(series))}
    rows = summaries = anomalies = None
    for name, (bt, cv) in fits.items():
        bt = cut_lineage(bt)
        own = (forecast.forecast_rows(bt, model_name=name, model_version=model_version),
               forecast.summary(bt, cv).withColumn("model_name", F.lit(name)),
               bt.filter(F.col("is_anomalous")).select(F.lit(name).alias("model_name"), "series_key", "metric",
                                                       "period_month", "actual", "yhat", "deviation_pct"))
        rows, summaries, anomalies = own if rows is None else (
            x.unionByName(y) for x, y in zip((rows, summaries, anomalies), own))
    n = sinks.append_new(rows, _p(out, "forecast_results"),
                         ["model_name", "series_key", "metric", "period_month", "model_version"],
                         partition_by=["metric"])
    sinks.write_csv(summaries, _p(out, "forecast_summary"))
    sinks.write_csv(anomalies, _p(out, "forecast_anomalies"))
    return n


def main(argv: list[str] | None = None) -> None:
    from revguard.session import get_spark
    ap = argparse.ArgumentParser(prog="revguard.plans.jobs")
    ap.add_argument("job", choices=["rules", "score", "forecast"])
    ap.add_argument("--sf-dir", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--clear", action="store_true", help="rules: replace existing alerts")
    ap.add_argument("--skip-train", action="store_true", help="score: load saved models")
    ap.add_argument("--no-db-write", action="store_true", help="score: do not append scores")
    ap.add_argument("--by", nargs="*", default=None, help="forecast: extra series keys")
    a = ap.parse_args(argv)
    spark = get_spark()
    if a.job == "rules":
        print(run_rule_engine(spark, a.sf_dir, a.out, clear=a.clear))
    elif a.job == "score":
        print(run_scoring(spark, a.sf_dir, a.out, train=not a.skip_train, sink=not a.no_db_write))
    else:
        print(run_forecasting(spark, a.sf_dir, a.out, by=a.by))


if __name__ == "__main__":
    main()
