"""Reconciliation rules R1-R8: each rule is one lazy DataFrame in the alert schema.

Every rule is a filter / anti-join / join / aggregate over the billing views;
severity, description and metadata (a JSON object with typed values) are Column
expressions, so no row leaves the JVM.  ``run_rules`` unions them into one alert table (one action for all
seven rules); ``rule_summary`` is the per (rule, severity) roll-up.

Scale notes: R1 is a shuffle anti-join on ``invoice_id`` (settled payments are
projected to the key first, so only 8-byte keys are exchanged); R4 joins the
subscription dimension on its key and lets AQE broadcast it only when its
measured size is under the broadcast threshold; R6 is an algebraic aggregate, so
partial aggregation collapses a hot customer to one row per map task before the
shuffle.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revguard.functions import exprs as X
from revguard.sources.billing import Billing

# Rule codes, severity cut-offs and alert texts as the reconciliation
# rules define them.
MISSING_PAYMENT = "MISSING_PAYMENT"
DUPLICATE_REFUND = "DUPLICATE_REFUND"
ABNORMAL_DISCOUNT = "ABNORMAL_DISCOUNT"
UNDERBILLING = "UNDERBILLING"
PAYMENT_DELAY = "PAYMENT_DELAY"
FAILED_PAYMENT_STREAK = "FAILED_PAYMENT_STREAK"
MISSING_RENEWAL = "MISSING_RENEWAL"  # the overdue-invoice rule writes this code

TEXT_MISSING_PAYMENT = "Invoice %s (%s) has no completed payment."
TEXT_DUPLICATE_REFUND = "Duplicate refund detected: %s (%s)."
TEXT_ABNORMAL_DISCOUNT = "Invoice %s: discount ratio %s (%s on %s)."
TEXT_UNDERBILLING = "Invoice %s: billed %s vs MRR %s (%s)."
TEXT_PAYMENT_DELAY = "Invoice %s: payment received %s days late (paid %s)."
TEXT_FAILED_STREAK = "Customer has %s failed payments totalling %s."
TEXT_OVERDUE = "Invoice %s is %s days overdue (due %s). Outstanding: %s."

ALERT_COLUMNS = ["customer_id", "invoice_id", "rule_code", "severity", "description",
                 "leakage_amount", "metadata", "source_ref"]

MONEY = "decimal(14,2)"


def _alert(df: DataFrame, *, rule_code: str, severity, description, amount, metadata: dict,
           source_ref, invoice_id=None) -> DataFrame:
    meta = F.to_json(F.struct(*[v.alias(k) for k, v in metadata.items()])) if metadata else F.lit("{}")
    return df.select(
        F.col("customer_id").cast("bigint").alias("customer_id"),
        (F.col("invoice_id") if invoice_id is None else invoice_id).cast("bigint").alias("invoice_id"),
        F.lit(rule_code).alias("rule_code"),
        severity.alias("severity"),
        description.alias("description"),
        amount.cast(MONEY).alias("leakage_amount"),
        meta.alias("metadata"),
        source_ref.cast("string").alias("source_ref"),
    )


def _live(df: DataFrame) -> DataFrame:
    """Soft-delete filter."""
    return df.filter(~F.col("is_deleted"))


def missing_payment(b: Billing, *, settled_status: str = "succeeded") -> DataFrame:
    """issued/overdue positive invoice with no settled payment (anti-join).

    ``settled_status="completed"`` reproduces the literal behaviour of the
    original rule, whose status never occurs (every candidate fires).
    """
    inv = _live(b.invoices).filter(F.col("status").isin("issued", "overdue") &
                                   (F.col("total_amount") > 0))
    settled = b.payments.filter(F.col("status") == settled_status).select("invoice_id")
    hit = inv.join(settled, "invoice_id", "left_anti")
    sev = F.when(F.col("due_date") < F.lit(b.as_of), "high").otherwise("medium")
    amount = F.coalesce(F.nullif(F.col("outstanding_amount"), F.lit(Decimal("0.00"))),
                        F.col("total_amount"))
    return _alert(
        hit, rule_code=MISSING_PAYMENT, severity=sev,
        description=F.format_string(TEXT_MISSING_PAYMENT, "invoice_number", X.money_text("total_amount")),
        amount=amount, metadata={}, source_ref=F.col("invoice_number"))


def refund_alerts(refunds: DataFrame) -> DataFrame:
    """R2 alerts of the refunds that are flagged as duplicates."""
    return _alert(
        refunds.filter(F.col("is_duplicate")), rule_code=DUPLICATE_REFUND, severity=F.lit("high"),
        description=F.format_string(TEXT_DUPLICATE_REFUND, "refund_number", X.money_text("amount")),
        amount=F.col("amount"),
        metadata={"refund_number": F.col("refund_number")}, source_ref=F.col("refund_number"))


def duplicate_refund(b: Billing) -> DataFrame:
    """R2: refunds flagged as duplicates (deleted rows included, as the rule does)."""
    return refund_alerts(b.refunds)


def abnormal_discount(b: Billing, *, threshold: float = 0.35) -> DataFrame:
    """``discount / total > threshold``; >0.60 critical, >0.45 high."""
    ratio = X.dbl("discount_amount") / X.dbl("total_amount")
    inv = _live(b.invoices).filter(F.col("total_amount") > 0).withColumn("_r", ratio) \
        .filter(F.col("_r") > threshold)
    sev = X.banded("_r", [("critical", 0.60), ("high", 0.45)], "medium", op=">")
    desc = F.format_string(TEXT_ABNORMAL_DISCOUNT, "invoice_number", X.pct_text("_r"),
                           X.money_text("discount_amount"), X.money_text("total_amount"))
    return _alert(inv, rule_code=ABNORMAL_DISCOUNT, severity=sev, description=desc,
                  amount=F.col("discount_amount"),
                  metadata={"discount_ratio": F.round("_r", 4)}, source_ref=F.col("invoice_number"))


def underbilling(b: Billing, *, threshold: str = "0.85") -> DataFrame:
    """``0 < total < mrr * threshold`` (decimal compare); <0.50 critical, <0.70 high."""
    subs = b.subscriptions.select("subscription_id", "mrr").filter(F.col("mrr") > 0)
    j = _live(b.invoices).filter(F.col("total_amount") > 0) \
        .join(subs, "subscription_id", "inner") \
        .filter(F.col("total_amount") < F.col("mrr") * F.lit(Decimal(threshold))) \
        .withColumn("_r", X.dbl("total_amount") / X.dbl("mrr"))
    sev = X.banded("_r", [("critical", 0.50), ("high", 0.70)], "medium", op="<")
    desc = F.format_string(TEXT_UNDERBILLING, "invoice_number", X.money_text("total_amount"),
                           X.money_text("mrr"), X.pct_text("_r"))
    return _alert(j, rule_code=UNDERBILLING, severity=sev, description=desc,
                  amount=F.col("mrr") - F.col("total_amount"),
                  metadata={"billed": X.dbl("total_amount"), "mrr": X.dbl("mrr"),
                            "ratio": F.round("_r", 4)},
                  source_ref=F.col("invoice_number"))


def late_payments(payments: DataFrame, *, settled_status: str = "succeeded", min_days: int = 30) -> DataFrame:
    """Settled payments that came ``min_days`` late or later."""
    return payments.filter((F.col("status") == settled_status) & F.col("is_late") & (F.col("days_late") >= min_days)) \
        .select("invoice_id", "transaction_id", "days_late", "payment_date")


def delay_alerts(late: DataFrame) -> DataFrame:
    """R5 alerts of late payments with their invoice's customer_id and invoice_number."""
    sev = F.when(F.col("days_late") >= 90, "high").otherwise("medium")
    desc = F.format_string(TEXT_PAYMENT_DELAY, "invoice_number", F.col("days_late").cast("string"),
                           F.col("payment_date").cast("string"))
    return _alert(late, rule_code=PAYMENT_DELAY, severity=sev, description=desc,
                  amount=F.lit(Decimal("0.00")),
                  metadata={"days_late": F.col("days_late"), "payment_date": F.col("payment_date")},
                  source_ref=F.col("transaction_id"))


def payment_delay(b: Billing, *, settled_status: str = "succeeded", min_days: int = 30) -> DataFrame:
    """Settled late payment >= ``min_days`` late on a live invoice; >=90 high."""
    p = late_payments(b.payments, settled_status=settled_status, min_days=min_days)
    inv = _live(b.invoices).select("invoice_id", "customer_id", "invoice_number")
    return delay_alerts(p.join(inv, "invoice_id", "inner"))


def failed_totals(payments: DataFrame) -> DataFrame:
    """Number and sum of failed live payments per customer."""
    return payments.filter((F.col("status") == "failed") & ~F.col("is_deleted")) \
        .groupBy("customer_id") \
        .agg(F.count(F.lit(1)).alias("fails"), F.sum("amount").alias("at_risk"))


def streak_alerts(totals: DataFrame, *, min_fails: int = 3) -> DataFrame:
    """R6 alerts of the totals per customer."""
    sev = X.banded("fails", [("critical", 10), ("high", 6)], "medium")
    desc = F.format_string(TEXT_FAILED_STREAK, F.col("fails").cast("string"), X.money_text("at_risk"))
    return _alert(totals.filter(F.col("fails") >= min_fails), rule_code=FAILED_PAYMENT_STREAK, severity=sev,
                  description=desc, amount=X.round_money("at_risk"),
                  metadata={"failed_count": F.col("fails"), "total_at_risk": X.dbl("at_risk")},
                  source_ref=F.col("customer_id"), invoice_id=F.lit(None))


def failed_payment_streak(b: Billing, *, min_fails: int = 3) -> DataFrame:
    """Customers with >= ``min_fails`` failed live payments (a count, not a run; runs: ``lifecycle``)."""
    return streak_alerts(failed_totals(b.payments), min_fails=min_fails)


def overdue_invoice(b: Billing) -> DataFrame:
    """Overdue invoice past due; >=90 days critical, >=30 high (code MISSING_RENEWAL)."""
    inv = _live(b.invoices).filter((F.col("status") == "overdue") &
                                   (F.col("due_date") < F.lit(b.as_of))) \
        .withColumn("_d", F.datediff(F.lit(b.as_of), F.col("due_date")))
    sev = X.banded("_d", [("critical", 90), ("high", 30)], "medium")
    desc = F.format_string(TEXT_OVERDUE, "invoice_number", F.col("_d").cast("string"),
                           F.col("due_date").cast("string"), X.money_text("outstanding_amount"))
    return _alert(inv, rule_code=MISSING_RENEWAL, severity=sev, description=desc,
                  amount=F.coalesce(F.col("outstanding_amount"), F.lit(Decimal("0.00"))),
                  metadata={"days_overdue": F.col("_d"), "due_date": F.col("due_date")},
                  source_ref=F.col("invoice_number"))


RULES = {
    MISSING_PAYMENT: missing_payment,
    DUPLICATE_REFUND: duplicate_refund,
    ABNORMAL_DISCOUNT: abnormal_discount,
    UNDERBILLING: underbilling,
    PAYMENT_DELAY: payment_delay,
    FAILED_PAYMENT_STREAK: failed_payment_streak,
    MISSING_RENEWAL: overdue_invoice,
}


def run_rules(b: Billing, *, settled_status: str = "succeeded", codes: list[str] | None = None) -> DataFrame:
    """All rules -> one alert table (U1: ``unionByName``)."""
    frames = []
    for code, fn in RULES.items():
        if codes and code not in codes:
            continue
        if fn in (missing_payment, payment_delay):
            frames.append(fn(b, settled_status=settled_status))
        else:
            frames.append(fn(b))
    return reduce(DataFrame.unionByName, frames)


def rule_summary(alerts: DataFrame) -> DataFrame:
    """R8 summary / A10: alerts and leakage per (rule_code, severity)."""
    return alerts.groupBy("rule_code", "severity").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.sum("leakage_amount").cast("decimal(38,2)").alias("leakage"),
    )


#: Every field that a rule's metadata may have, with its type.
METADATA_FIELDS = {"refund_number": "string", "discount_ratio": "double", "billed": "double", "mrr": "double", "ratio": "double",
                   "days_late": "int", "payment_date": "date", "failed_count": "bigint", "total_at_risk": "double",
                   "days_overdue": "int", "due_date": "date"}


def with_metadata_fields(alerts: DataFrame) -> DataFrame:
    """alerts with their JSON metadata as typed columns; null where a rule has no such field, or the text is no JSON."""
    read = F.from_json("metadata", ", ".join(f"{k} {t}" for k, t in METADATA_FIELDS.items()))
    return alerts.withColumn("_m", read).select(*alerts.columns, "_m.*")


def flat(alerts: DataFrame) -> DataFrame:
    """Alert rows without text/map columns (what the oracle compares)."""
    return alerts.select("customer_id", "invoice_id", "rule_code", "severity",
                         X.dbl("leakage_amount").alias("leakage_amount"), "source_ref")
