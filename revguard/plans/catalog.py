"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Names follow the survey's inventory ids.  Each callable reads the whole driver
tables through the billing views and returns a flat result (no map/array/text
columns that the oracle cannot hash); money is cast to double last.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from revguard.functions import exprs as X
from revguard.operators import features, lifecycle, marts, metrics, rank, rules
from revguard.sources.billing import AS_OF, billing_views, contract_terms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def flat(df: DataFrame) -> DataFrame:
    """Comparable projection: decimals -> double, dates/timestamps -> text."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            out.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out.append(F.col(f.name).cast("string").alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            continue
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _b(fn, **kw) -> Query:
    """Query over the billing views: ``fn(billing) -> DataFrame``, flattened."""
    return lambda spark, sf_dir: flat(fn(billing_views(spark, sf_dir), **kw))


def _rule(fn, **kw) -> Query:
    return lambda spark, sf_dir: rules.flat(fn(billing_views(spark, sf_dir), **kw))


QUERIES.update({
    "r1_missing_payment": _rule(rules.missing_payment),
    "r1_missing_payment_literal": _rule(rules.missing_payment, settled_status="completed"),
    "r2_duplicate_refund": _rule(rules.duplicate_refund),
    "r3_abnormal_discount": _rule(rules.abnormal_discount),
    "r4_underbilling": _rule(rules.underbilling),
    "r5_payment_delay": _rule(rules.payment_delay),
    "r6_failed_payment_streak": _rule(rules.failed_payment_streak),
    "r7_overdue_invoice": _rule(rules.overdue_invoice),
    "r8_all_alerts": _rule(rules.run_rules),
})


@register("r8_rule_summary")
def _r8_summary(spark, sf_dir):
    s = rules.rule_summary(rules.run_rules(billing_views(spark, sf_dir)))
    return s.withColumn("leakage", F.col("leakage").cast("double"))


@register("r9_alert_metadata")
def _r9_metadata(spark, sf_dir):
    alerts = rules.with_metadata_fields(rules.run_rules(billing_views(spark, sf_dir)))
    return flat(alerts.select("rule_code", "source_ref", *rules.METADATA_FIELDS))


QUERIES.update({
    "lc1_failed_payment_runs": _b(lifecycle.failed_payment_runs),
    "lc2_no_invoice_gaps": _b(lifecycle.no_invoice_gaps),
    "lc3_zero_revenue_months": _b(lifecycle.zero_revenue_months),
    "lc4_contract_mismatches": _b(lifecycle.contract_mismatches),
    "lc4_contract_term_mismatches": lambda spark, sf_dir: flat(lifecycle.contract_mismatches(dataclasses.replace(
        billing_views(spark, sf_dir), contracts=contract_terms(spark, sf_dir)))),
    "lc5_contract_succession": lambda spark, sf_dir: flat(lifecycle.contract_succession(contract_terms(spark, sf_dir))),
    "lc6_missing_renewals": lambda spark, sf_dir: flat(lifecycle.missing_renewals(contract_terms(spark, sf_dir), AS_OF)),
})


QUERIES.update({
    "a1_payments_by_invoice": _b(lambda b: marts.payments_by_invoice(b.payments)),
    "a2_refunds_by_invoice": _b(lambda b: marts.refunds_by_invoice(b.refunds)),
    "a3_subscriptions_by_customer": _b(lambda b: marts.subscriptions_by_customer(b.subscriptions)),
    "a4_invoices_by_customer": _b(lambda b: marts.invoices_by_customer(b.invoices)),
    "a5_payments_by_customer": _b(lambda b: marts.payments_by_customer(b.payments)),
    "a6_refunds_by_customer": _b(lambda b: marts.refunds_by_customer(b.refunds)),
    "m1_invoice_mart": _b(marts.invoice_mart),
    "m2_customer_mart": _b(marts.customer_mart),
    "m3_monthly_revenue": _b(marts.monthly_revenue),
    "m3_monthly_revenue_by_segment": _b(marts.monthly_revenue, by=["segment"]),
})


def invoice_features(b):
    """M1 -> M4 (the engineered invoice table every model reads)."""
    return features.invoice_features(marts.invoice_mart(b), b.as_of)


def customer_features(b):
    return features.customer_features(marts.customer_mart(b))


_M4_OUT = (["invoice_id", "customer_id", "issue_date"] + features._INVOICE_NUMERIC +
           ["billed_vs_expected_ratio", "paid_vs_billed_ratio", "refund_ratio", "discount_ratio",
            "outstanding_ratio", "tax_ratio", "contract_gap", "overdue_days",
            "payment_delay_ratio", "failed_payment_rate", "retry_rate"] + features.INVOICE_FLAGS +
           ["leakage_label", "issue_month", "issue_quarter", "issue_year", "period_length_days",
            "is_annual_billing", "mrr_log"])

QUERIES.update({
    "m4_invoice_features": _b(lambda b: invoice_features(b).select(*_M4_OUT)),
    "m5_customer_features": _b(lambda b: customer_features(b)),
    "m6_time_series_features": _b(
        lambda b: features.time_series_features(marts.monthly_revenue(b))),
    "m6_time_series_features_by_segment": _b(
        lambda b: features.time_series_features(marts.monthly_revenue(b, by=["segment"]),
                                                 keys=["segment"])),
})


TRAIN, VAL = 0.70, 0.15


def test_scores(b):
    """Stand-in scores of the test split (last 15 % by (issue_date, invoice_id))."""
    feat = rank.time_split(invoice_features(b), "issue_date", "invoice_id", train=TRAIN, val=VAL)
    return features.stand_in_scores(feat.filter(F.col("split") == "test"))


QUERIES.update({
    "w6_time_split_summary": _b(lambda b: rank.split_summary(
        rank.time_split(invoice_features(b), "issue_date", "invoice_id", train=TRAIN, val=VAL),
        "issue_date")),
    "w1_percent_rank": _b(lambda b: rank.percent_rank(
        invoice_features(b).select("invoice_id", features.rule_score(invoice_features(b)).alias("score")),
        "score").select("invoice_id", "score", (F.col("percent_rank") * 100).alias("rank_percentile"))),
    "w1_percent_rank_by_billing": _b(lambda b: rank.percent_rank(
        invoice_features(b).select("invoice_id", "is_annual_billing",
                                   features.rule_score(invoice_features(b)).alias("score")),
        "score", partition_cols=["is_annual_billing"])
        .select("invoice_id", "is_annual_billing", "score",
                (F.col("percent_rank") * 100).alias("rank_percentile"))),
    "v7_model_comparison": _b(lambda b: metrics.evaluate(test_scores(b))),
    "v5_class_report": _b(lambda b: metrics.class_report(test_scores(b))),
    "v6_anomaly_proxy_eval": _b(lambda b: metrics.evaluate(
        metrics.anomaly_proxy(test_scores(b).filter(F.col("model_name") == "rule_blend")
                              .withColumn("if_score", -F.col("score")), "if_score")
        .withColumn("model_name", F.lit("rule_blend_proxy")))),
    "a14_class_balance": _b(lambda b: metrics.class_balance(
        invoice_features(b).withColumn("label", F.col("leakage_label")))),
})


# ---------------------------------------------------------------------------
# Serving queries D1-D13, E1-E7 over the stand-in score tables
# ---------------------------------------------------------------------------
from revguard.plans import entities  # noqa: E402
from revguard.plans import scores as S  # noqa: E402
from revguard.plans import serve as D  # noqa: E402

STAND_IN = "rule_blend"


def _risk(b, percentile=True):
    return S.stand_in_risk_scores(invoice_features(b), b.as_of, percentile=percentile)


def _anom(b, proxy=True):
    return S.stand_in_anomaly_scores(invoice_features(b), b.as_of, proxy=proxy)


def _scores(b):
    """Both stand-in score tables, ranks and proxy included, over features that are written once."""
    feat = S.stand_in_features(invoice_features(b))
    return S.stand_in_risk_scores(feat, b.as_of), S.stand_in_anomaly_scores(feat, b.as_of)


def _page(rows_and_count, part):
    return rows_and_count[0] if part == "rows" else rows_and_count[1]


QUERIES.update({
    "f21_top_invoice_features": _b(lambda b: invoice_features(b).select(
        "invoice_id", *[F.element_at(X.top_abs_names(features.TOP_FEATURE_CANDIDATES, 5), i + 1)
                        .alias(f"top_feature_{i + 1}") for i in range(5)])),
    "w5_latest_risk_per_invoice": _b(lambda b: D.latest(
        _risk(b, False).select("invoice_id", "model_version", "leakage_probability", "risk_severity",
                        "scored_at"), "invoice_id")),
    "d1_kpis": _b(lambda b: D.kpis(b, _risk(b, False), _anom(b, False), model_name=STAND_IN)),
    "d2_revenue_trend_actuals": _b(lambda b: D.revenue_by_month(b).select("month", "invoiced", "collected")),
    "d3_top_risks": _b(lambda b: D.top_risks(b, _risk(b, False), model_name=STAND_IN, limit=15)),
    "d4_risk_distribution": _b(lambda b: D.risk_distribution(_risk(b, False), model_name=STAND_IN)),
    "d5_leakage_by_rule": _b(lambda b: D.leakage_by_rule(rules.run_rules(b))),
    "d6_anomaly_timeline": _b(lambda b: D.anomaly_timeline(_anom(b, False))),
    "d7_invoice_detail": _b(lambda b: D.invoice_detail(
        b, *_scores(b), rules.run_rules(b), model_name=STAND_IN).select(
            "*", F.array_join("risk_top_features", ",").alias("risk_top"), F.col("risk_snapshot")["prob"].alias("risk_snapshot_prob"),
            F.array_join("anomaly_top_features", ",").alias("anomaly_top"))),
    "d7_invoice_alerts": _b(lambda b: D.alert_details(rules.run_rules(b))),
    "d8_revenue_breakdown": _b(D.revenue_by_month),
    "d9_outstanding_invoices": _b(lambda b: D.outstanding_invoices(b, limit=100)),
    "d9_outstanding_total": _b(lambda b: D.list_total(D.outstanding_rows(b), "outstanding_amount",
                                                      "total_outstanding")),
    "d10_overdue_invoices": _b(lambda b: D.overdue_invoices(b, limit=200)),
    "d10_overdue_total": _b(lambda b: D.list_total(D.overdue_rows(b), "outstanding_amount",
                                                   "total_overdue_amount")),
    "d11_high_risk_top": _b(lambda b: D.top_risks(b, _risk(b, False), model_name=STAND_IN, limit=100,
                                                  severities=["critical", "high"], n_features=2)
                            .drop("invoice_status")),
    "d12_anomaly_totals": _b(lambda b: D.anomaly_totals(_anom(b, False))),
    "d12_top_anomalies": _b(lambda b: D.top_anomalies(b, _anom(b), limit=100)),
    "d13_duplicate_refunds": _b(D.duplicate_refunds),
    "d13_duplicate_refund_total": _b(lambda b: D.list_total(D.duplicate_refunds(b), "amount",
                                                            "total_amount")),
    "e1_customers_page": _b(lambda b: D.list_entity(
        D.customers_view(b), key="customer_id", filters={"segment": "enterprise"},
        search="customer#00000", search_cols=["name", "external_id"],
        default=["-acquisition_date"], page=2)[0]),
    "e1_customers_count": _b(lambda b: D.list_entity(
        D.customers_view(b), key="customer_id", filters={"segment": "enterprise"},
        search="customer#00000", search_cols=["name", "external_id"],
        default=["-acquisition_date"], page=2)[1]),
    "e1_customer_rollup": _b(lambda b: D.customer_rollup(b, _risk(b, False))),
    "e2_invoices_page": _b(lambda b: D.with_latest_risk(D.list_entity(
        D.invoices_view(b), key="invoice_id", filters={"status": "overdue"},
        ordering="-total_amount", allowed=["issue_date", "due_date", "total_amount",
                                           "outstanding_amount"], default=["-issue_date"])[0], _risk(b, False),
        order=[F.col("total_amount").desc(), F.col("invoice_id").asc()])),
    "e2_invoices_seek_page": _b(lambda b: D.seek_page(
        D.invoices_view(b), key="invoice_id", ordering="-total_amount", allowed=["total_amount", "issue_date"], page=3)),
    "e3_alerts_page": _b(lambda b: D.alerts_view(b, D.list_entity(
        rules.flat(rules.run_rules(b)), key="source_ref",
        filters={"rule_code": "UNDERBILLING", "severity": "high"}, ordering="-leakage_amount",
        allowed=["leakage_amount", "severity"], page=3)[0])),
    "e3_alerts_search_page": _b(lambda b: entities.entity_page(
        "alerts", D.alert_details(rules.run_rules(b)).withColumn("source_ref", F.col("invoice_id")),
        filters={"severity": "critical"}, search="DAYS overdue", ordering="-leakage_amount", page=2)[0].drop("source_ref")),
    "e5_risk_page": _b(lambda b: D.ranked_page(D.list_entity(
        D.scores_view(b, _risk(b, False)).drop("top_features", "feature_snapshot"), key="invoice_id",
        filters={"risk_severity": "medium", "model_version": "v1"}, search="customer#",
        search_cols=["customer_name"], default=["-leakage_probability"])[0], _risk(b, False),
        order=[F.col("leakage_probability").desc(), F.col("invoice_id").asc()])),
    "e6_anomaly_page": _b(lambda b: D.list_entity(
        D.scores_view(b, _anom(b)).drop("top_features"), key="invoice_id",
        filters={"is_anomaly": True}, default=["score"], page=4)[0]),
})


# ---------------------------------------------------------------------------
# Forecasting T1-T8 (global series and segment series)
# ---------------------------------------------------------------------------
from revguard.operators import forecast as FC  # noqa: E402


def series(b, by=None):
    return FC.series_frame(marts.monthly_revenue(b, by=by), keys=by)


def _checked_additive(bt: DataFrame) -> DataFrame:
    """T2b per month: the actual, the hold-out flag, and whether the band holds the fitted value."""
    return bt.select("series_key", "metric", "period_month", "actual", "held_out",
                     ((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper")))
                     .alias("band_ordered"),
                     (F.col("is_anomalous") == F.coalesce(F.abs("deviation_pct") > 15, F.lit(False)))
                     .alias("flag_agrees"))


QUERIES.update({
    "t1_series_frame": _b(lambda b: series(b)),
    "t4_trend_backtest": _b(lambda b: FC.forecast_backtest(series(b))),
    "t4_trend_backtest_by_segment": _b(lambda b: FC.forecast_backtest(series(b, ["segment"]))),
    "t5_cross_validation_by_segment": _b(lambda b: FC.cross_validate(series(b, ["segment"]))),
    "t7_forecast_summary": _b(lambda b: FC.summary(FC.forecast_backtest(series(b)),
                                                  FC.cross_validate(series(b)))),
    # T2b is a fitted model (numpy ridge per series): rows-only check, properties in tests.
    "t2b_additive_backtest_by_segment": _b(lambda b: _checked_additive(FC.additive_backtest(series(b, ["segment"])))),
})


# ---------------------------------------------------------------------------
# Attribution X2-X4 on a fixed linear score (exact, SQL-checkable)
# ---------------------------------------------------------------------------
from revguard.operators import explain as EX  # noqa: E402

# The stand-in rule score is linear in these six inputs with weight 1/6 each.
LINEAR_COEFS = {c: 1.0 / 6.0 for c in features.INVOICE_FLAGS + ["outstanding_ratio"]}
LINEAR_COLS = list(LINEAR_COEFS)


def linear_contribs(b):
    feat = invoice_features(b)
    return EX.linear_contributions(feat, LINEAR_COEFS)


QUERIES.update({
    "x2_linear_contributions": _b(linear_contribs),
    "x3_global_importance_linear": _b(lambda b: EX.global_importance(linear_contribs(b), LINEAR_COLS)),
    "x4_local_explanations_linear": _b(lambda b: EX.local_explanations(linear_contribs(b), LINEAR_COLS)
                                       .select("invoice_id", *[F.element_at("top_features", i + 1)
                                                               .alias(f"top_feature_{i + 1}")
                                                               for i in range(3)])),
})


# ---------------------------------------------------------------------------
# Learning and scoring L1-L12, X1 (model outputs: rows-only checks)
# ---------------------------------------------------------------------------
from revguard.plans import pipeline as PL  # noqa: E402

# The registered model queries run the library defaults (200 trees, up to 600
# boosting rounds with early stopping).  One scoring run serves all of them: its outputs read from reliable checkpoints, so they are trained once per
# session and data folder, not once per query.
_RUNS: dict = {}


def _run(spark: SparkSession, sf_dir: str):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        _RUNS[key] = PL.score_pipeline(billing_views(spark, sf_dir))
    return _RUNS[key]


def _m(fn) -> Query:
    """Query over the shared scoring run: ``fn(run) -> DataFrame``, flattened."""
    return lambda spark, sf_dir: flat(fn(_run(spark, sf_dir)))


def _checked_evaluation(r) -> DataFrame:
    """L9 per model: rows and positives of the test split, and whether its metrics lie where they must."""
    e = r.evaluation
    inside = F.lit(True)
    for c in ("roc_auc", "pr_auc", "accuracy", "precision", "recall", "f1_score"):
        inside = inside & F.coalesce(F.col(c).between(0, 1 + 1e-9), F.lit(False))
    return e.select("model_name", "n_samples", "n_positive", inside.alias("metrics_in_range"),
                    ((F.col("model_name") == "isolation_forest") | (F.col("roc_auc") > 0.8)).alias("auc_high"))


def _checked_risk(r) -> DataFrame:
    """L11 per invoice: severity, percentile and attribution agree with the record's probability."""
    p, pr = F.col("leakage_probability"), F.col("rank_percentile")
    return r.risk_scores.select(
        "customer_id", "invoice_id", "model_name", "model_version", p.between(0, 1).alias("probability_in_range"),
        (F.col("risk_severity") == X.risk_severity(p)).alias("severity_agrees"),
        pr.between(0, 100).alias("percentile_in_range"), (F.size("top_features") == 3).alias("has_attribution"),
        F.col("explanation").startswith("Flagged due to: ").alias("has_sentence"))


def _checked_contributions(r) -> DataFrame:
    """X1 per invoice: bias and contributions add up to the margin, and the margin to the probability."""
    total = F.col("bias")
    for c in features.INVOICE_FEATURE_COLS:
        total = total + F.col(f"c_{c}")
    prob = 1 / (1 + F.exp(-2 * F.col("margin")))
    return r.contributions.join(r.risk_scores.select("invoice_id", "leakage_probability"), "invoice_id").select(
        "invoice_id", (F.abs(total - F.col("margin")) < 1e-9).alias("adds_up"),
        (F.abs(prob - F.col("leakage_probability")) < 1e-9).alias("gives_probability"))


QUERIES.update({
    "l9_model_comparison": _m(_checked_evaluation),
    "l11_risk_scores": _m(_checked_risk),
    "x1_tree_contributions": _m(_checked_contributions),
    "x1_tree_global_importance": _m(lambda r: r.global_importance.select(
        "feature", "label", (F.col("mean_abs_contribution") >= 0).alias("not_negative"),
        F.col("rank").between(1, len(features.INVOICE_FEATURE_COLS)).alias("ranked"))),
    # X5 on the linear score: v1 of the stand-in scores takes its attributions, v0 keeps its own features.
    "x5_attached_top_features": _b(lambda b: EX.attach(
        _risk(b, False).select("invoice_id", "model_name", "model_version", "top_features"),
        EX.local_explanations(linear_contribs(b), LINEAR_COLS), model_name=STAND_IN, model_version="v1").select(
            "invoice_id", "model_version", *[F.element_at("top_features", i + 1).alias(f"top_feature_{i + 1}")
                                             for i in range(3)], F.col("explanation").isNotNull().alias("explained"))),
})


# ---------------------------------------------------------------------------
# Constraint checks Q-D1..3, idempotent-append key logic S5/S6
# ---------------------------------------------------------------------------
from revguard.operators import checks as QC  # noqa: E402
from revguard.sources import sinks as SK  # noqa: E402

QUERIES.update({
    "qd1_enum_violations": _b(lambda b: QC.enum_violations(QC.billing_tables(b))),
    "qd2_duplicate_keys": _b(lambda b: QC.duplicate_keys(QC.billing_tables(b))),
    "qd3_orphan_keys": _b(lambda b: QC.orphans(QC.billing_tables(b))),
    # Candidates = both stand-in score versions; already written = version v0.
    "s5_new_score_rows": _b(lambda b: SK.new_rows(
        _risk(b, False).select("invoice_id", "model_version", "leakage_probability"),
        _risk(b, False).filter(F.col("model_version") == "v0"), ["invoice_id", "model_version"])),
    # Candidates = forecast rows of both metrics; already written = the revenue rows.
    "s6_new_forecast_rows": _b(lambda b: SK.new_rows(
        FC.forecast_rows(FC.forecast_backtest(series(b))).select(
            "model_name", "model_version", "metric", "period_month", "deviation_pct", "is_anomalous"),
        FC.forecast_rows(FC.forecast_backtest(series(b))).filter(F.col("metric") == "revenue"),
        ["model_name", "metric", "period_month", "model_version"])),
})


QUERIES.update({
    "a15_feature_profile": _b(lambda b: features.profile(invoice_features(b), features.INVOICE_FEATURE_COLS)),
    "d2_revenue_trend_forecasts": _b(lambda b: D.forecast_trend(
        FC.forecast_rows(FC.forecast_backtest(series(b))), metric="revenue")),
    "e7_forecast_page": _b(lambda b: D.list_entity(
        FC.forecast_rows(FC.forecast_backtest(series(b))), key="period_month",
        filters={"metric": "collections", "is_anomalous": True}, ordering="-deviation_pct",
        allowed=["period_month", "deviation_pct"], default=["metric", "period_month"])[0]),
})
