"""Engineered features M4-M7 and the time-series windows W2-W4.

M4/M5 are one projection each over the marts (whole-stage codegen, no shuffle).
M6 is a set of row-frame windows partitioned by series key; a series holds one
row per month, so each window partition is bounded by the number of months,
not by the data volume.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revguard.functions import exprs as X

# The feature lists the models consume (order matters), the
# category codes and the label thresholds.
INVOICE_FEATURE_COLS = [
    "total_amount", "paid_amount", "outstanding_amount", "discount_amount", "tax_amount",
    "total_paid", "payment_count", "failed_payment_count", "max_days_late", "avg_days_late",
    "total_attempts", "refund_count", "refund_amount", "duplicate_refund_count",
    "mrr", "sub_discount_pct", "quantity", "payment_terms_days",
    "billed_vs_expected_ratio", "paid_vs_billed_ratio", "refund_ratio", "discount_ratio",
    "outstanding_ratio", "contract_gap", "overdue_days", "payment_delay_ratio",
    "failed_payment_rate", "retry_rate", "is_annual_billing", "mrr_log",
    "issue_month", "issue_quarter",
]

CUSTOMER_FEATURE_COLS = [
    "tenure_days", "tenure_years", "active_subscriptions", "total_subscriptions",
    "avg_mrr", "total_arr", "avg_discount_pct", "invoice_count", "total_invoiced",
    "total_outstanding", "overdue_invoice_count", "payment_count", "failed_payment_count",
    "total_paid", "avg_days_late", "refund_count", "total_refunded", "duplicate_refund_count",
    "collection_rate", "overdue_rate", "failed_payment_rate", "refund_rate",
    "duplicate_refund_rate", "outstanding_ratio", "mrr_log",
    "segment_code", "risk_tier_code", "churn_flag",
]

# Features whose largest |value| names an invoice's "top features".
TOP_FEATURE_CANDIDATES = [
    "failed_payment_rate", "overdue_days", "contract_gap",
    "refund_ratio", "discount_ratio", "outstanding_ratio",
    "billed_vs_expected_ratio", "duplicate_refund_count",
    "payment_delay_ratio", "retry_rate",
]

SEGMENT_CODES = {"enterprise": 3, "mid_market": 2, "smb": 1, "startup": 0}
RISK_TIER_CODES = {"high": 2, "medium": 1, "low": 0}

INVOICE_FLAGS = ["flag_missing_payment", "flag_underbilling", "flag_duplicate_refund",
                 "flag_abnormal_discount", "flag_payment_delay"]

_INVOICE_NUMERIC = ["subtotal", "tax_amount", "discount_amount", "total_amount", "paid_amount",
                    "outstanding_amount", "total_paid", "payment_count", "failed_payment_count",
                    "max_days_late", "avg_days_late", "total_attempts", "refund_count",
                    "refund_amount", "duplicate_refund_count", "mrr", "sub_discount_pct",
                    "quantity", "contracted_value", "payment_terms_days", "contract_discount_pct"]


def invoice_features(mart: DataFrame, as_of: _dt.date) -> DataFrame:
    """M4: ratios, gaps, behaviour, flags, label and date parts, in one projection.

    Numeric inputs are coerced to double with NULL -> 0 (the contract value of an
    invoice without contract is 0, so its expected-billing ratio is huge and its
    contract gap is ``-total``).  The delay ratio uses ``coalesce(terms, 30)``.
    Dates are real dates.
    """
    d = {k: F.coalesce(X.dbl(k), F.lit(0.0)) for k in _INVOICE_NUMERIC}
    status = F.col("invoice_status")
    bve = d["total_amount"] / (d["contracted_value"] / 12 + F.lit(X.EPS))
    disc_ratio = d["discount_amount"] / (d["subtotal"] + F.lit(X.EPS))
    cols = {k: d[k] for k in _INVOICE_NUMERIC}
    cols.update({
        "billed_vs_expected_ratio": bve,
        "paid_vs_billed_ratio": d["total_paid"] / (d["total_amount"] + F.lit(X.EPS)),
        "refund_ratio": d["refund_amount"] / (d["total_paid"] + F.lit(X.EPS)),
        "discount_ratio": disc_ratio,
        "outstanding_ratio": d["outstanding_amount"] / (d["total_amount"] + F.lit(X.EPS)),
        "tax_ratio": d["tax_amount"] / (d["total_amount"] + F.lit(X.EPS)),
        "contract_gap": d["contracted_value"] / 12 - d["total_amount"],
        "overdue_days": F.when(status == "overdue", X.days_since("due_date", as_of))
                         .otherwise(F.lit(0)).cast("double"),
        "payment_delay_ratio": d["max_days_late"] /
            (F.coalesce(X.dbl("payment_terms_days"), F.lit(30.0)) + F.lit(X.EPS)),
        "failed_payment_rate": d["failed_payment_count"] / (d["payment_count"] + F.lit(X.EPS)),
        "retry_rate": d["total_attempts"] / (d["payment_count"] + F.lit(X.EPS)),
        "flag_missing_payment": X.flag(status.isin("overdue", "issued") & (d["total_paid"] == 0) &
                                       (F.col("due_date") < F.lit(as_of))),
        "flag_underbilling": X.flag(bve < 0.85),
        "flag_duplicate_refund": X.flag(d["duplicate_refund_count"] > 0),
        "flag_abnormal_discount": X.flag(disc_ratio > 0.30),
        "flag_payment_delay": X.flag(d["max_days_late"] > 30),
        "issue_month": F.month("issue_date").cast("double"),
        "issue_quarter": F.quarter("issue_date").cast("double"),
        "issue_year": F.year("issue_date"),
        "period_length_days": F.datediff("period_end", "period_start"),
        "is_annual_billing": X.flag(F.col("billing_cycle") == "annual").cast("double"),
        "mrr_log": X.log1p_pos(d["mrr"]),
    })
    base = mart.select("invoice_id", "customer_id", "subscription_id", "issue_date",
                       *[v.alias(k) for k, v in cols.items()])
    return base.withColumn("leakage_label", X.any_flag(*INVOICE_FLAGS))


_CUSTOMER_NUMERIC = ["tenure_days", "active_subscriptions", "total_subscriptions", "avg_mrr",
                     "total_arr", "avg_discount_pct", "invoice_count", "total_invoiced",
                     "total_outstanding", "overdue_invoice_count", "payment_count",
                     "failed_payment_count", "total_paid", "avg_days_late", "refund_count",
                     "total_refunded", "duplicate_refund_count"]


def customer_features(mart: DataFrame) -> DataFrame:
    """M5: customer rates, codes, churn flag and the OR-of-thresholds label."""
    d = {k: F.coalesce(X.dbl(k), F.lit(0.0)) for k in _CUSTOMER_NUMERIC}
    eps = F.lit(X.EPS)
    cols = dict(d)
    cols.update({
        "collection_rate": d["total_paid"] / (d["total_invoiced"] + eps),
        "overdue_rate": d["overdue_invoice_count"] / (d["invoice_count"] + eps),
        "failed_payment_rate": d["failed_payment_count"] / (d["payment_count"] + eps),
        "refund_rate": d["refund_count"] / (d["invoice_count"] + eps),
        "duplicate_refund_rate": d["duplicate_refund_count"] / (d["refund_count"] + eps),
        "outstanding_ratio": d["total_outstanding"] / (d["total_invoiced"] + eps),
        "mrr_log": X.log1p_pos(d["avg_mrr"]),
        "tenure_years": d["tenure_days"] / 365.25,
        "segment_code": X.code_map("segment", SEGMENT_CODES, 1).cast("int"),
        "risk_tier_code": X.code_map("risk_tier", RISK_TIER_CODES, 1).cast("int"),
        "churn_flag": X.flag(F.col("customer_status") == "churned"),
    })
    base = mart.select("customer_id", "segment", "nation_key", *[v.alias(k) for k, v in cols.items()])
    label = ((F.col("failed_payment_rate") > 0.15) | (F.col("overdue_rate") > 0.10) |
             (F.col("duplicate_refund_count") > 0) | (F.col("avg_discount_pct") > 30) |
             (F.col("outstanding_ratio") > 0.20))
    return base.withColumn("leakage_label", label.cast("int"))


def _pct_change(x: str, w: Window, n: int = 1):
    """``x / lag(x, n) - 1`` with inf/NaN/NULL -> 0."""
    return F.coalesce(F.try_divide(X.dbl(x), F.lag(X.dbl(x), n).over(w)) - 1, F.lit(0.0))


def time_series_features(monthly: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """M6: trailing means (W2), month-over-month (W3) and year-over-year (W4) change.

    ``monthly`` has ``period_month`` plus measures; ``keys`` are series keys
    (window partitions).  Frames are by rows, like the position-based rolling
    of a sorted series.
    """
    keys = list(keys or [])
    w = Window.partitionBy(*keys).orderBy("period_month")
    df = monthly
    for m in ("total_invoiced", "total_collected", "total_outstanding", "overdue_amount"):
        df = df.withColumn(m, F.coalesce(X.dbl(m), F.lit(0.0)))
    df = df.withColumn("collection_rate", X.safe_ratio("total_collected", "total_invoiced"))
    for n in (3, 6, 12):
        fr = w.rowsBetween(-(n - 1), 0)
        df = df.withColumn(f"invoiced_ma{n}", F.avg("total_invoiced").over(fr)) \
               .withColumn(f"collected_ma{n}", F.avg("total_collected").over(fr))
    df = df.withColumn("invoiced_mom_pct", _pct_change("total_invoiced", w)) \
           .withColumn("collected_mom_pct", _pct_change("total_collected", w)) \
           .withColumn("invoiced_yoy_pct", _pct_change("total_invoiced", w, 12))
    dt = X.month_start("period_month")
    return df.withColumn("period_dt", dt).withColumn("month_num", F.month(dt)) \
             .withColumn("quarter", F.quarter(dt))


def feature_matrix(df: DataFrame, cols: list[str], label: str | None = "leakage_label",
                   keep: list[str] | None = None) -> DataFrame:
    """M7: available features of the ordered list, inf/NaN/NULL -> 0, plus label.

    Returns named double columns (model code assembles them into a vector).
    """
    avail = [c for c in cols if c in df.columns]  # P9
    out = [F.col(k) for k in (keep or []) if k in df.columns]
    out += [X.finite_or_zero(c).alias(c) for c in avail]
    if label and label in df.columns:
        out.append(F.col(label).cast("double").alias("label"))
    return df.select(*out)


def rule_score(feat: DataFrame) -> Column:
    """Deterministic stand-in probability: mean of the five flags and the clipped
    outstanding ratio.  Used where a score is needed but no model is trained
    (serving queries, metric checks), so results stay reproducible in SQL.
    """
    orr = F.least(F.greatest(F.col("outstanding_ratio"), F.lit(0.0)), F.lit(1.0))
    s = sum((F.col(f).cast("double") for f in INVOICE_FLAGS), orr)
    return s / 6.0


def clipped(col: str) -> Column:
    return F.least(F.greatest(F.col(col).cast("double"), F.lit(0.0)), F.lit(1.0))


# Deterministic score columns evaluated side by side (long-form, one row per model).
def stand_in_scores(feat: DataFrame) -> DataFrame:
    """Long-form ``(invoice_id, model_name, label, score)`` of deterministic scores."""
    models = {
        "rule_blend": rule_score(feat),
        "outstanding_ratio": clipped("outstanding_ratio"),
        "failed_payment_rate": clipped("failed_payment_rate"),
        "discount_ratio": clipped("discount_ratio"),
    }
    arr = F.array(*[F.struct(F.lit(k).alias("model_name"), v.alias("score")) for k, v in models.items()])
    return feat.select("invoice_id", F.col("leakage_label").alias("label"),
                       F.explode(arr).alias("m")).select("invoice_id", "m.model_name", "label", "m.score")


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, sample std, min, max per feature (one aggregate, its single row unpivoted)."""
    parts = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[fn(X.dbl(c)).alias(f"{name}_{i}") for i, c in enumerate(cols) for name, fn in parts.items()])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{name}_{i}").alias(name) for name in parts])
        for i, c in enumerate(cols)])).alias("s")).select("s.*")
