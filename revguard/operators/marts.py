"""Feature marts M1-M3 (aggregates A1-A7, joins J1, J2, J8).

Each fact table is aggregated to the join key *before* it is joined (the
pre-aggregate-then-join shape): without it the join would fan out and sums
would be wrong, and with it the exchange carries one row per key instead of one
per payment.  All aggregates are algebraic (sum/count/max), so Spark's partial
aggregation collapses hot keys on the map side before the shuffle; averages are
``sum / count`` in double so both engines give the same value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revguard.functions import exprs as X
from revguard.sources.billing import Billing


def _sum_if(pred: Column, value) -> Column:
    return F.sum(F.when(pred, X.c(value)).otherwise(F.lit(0)))


def _count_if(pred: Column) -> Column:
    return F.sum(F.when(pred, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def _mean(col) -> Column:
    """Average as exact sum / count in double (NULLs skipped, NULL on empty)."""
    return F.try_divide(F.sum(X.c(col)).cast("double"), F.count(X.c(col)).cast("double"))


def payments_by_invoice(payments: DataFrame) -> DataFrame:
    """A1: payment aggregates per invoice (all payment rows, as the mart reads them)."""
    s = F.col("status")
    return payments.groupBy("invoice_id").agg(
        _sum_if(s == "succeeded", "amount").alias("total_paid"),
        F.count(F.lit(1)).alias("payment_count"),
        _count_if(s == "failed").alias("failed_payment_count"),
        F.max("days_late").alias("max_days_late"),
        _mean("days_late").alias("avg_days_late"),
        F.sum("attempt_count").cast("bigint").alias("total_attempts"),
    )


def refunds_by_invoice(refunds: DataFrame) -> DataFrame:
    """A2: refund aggregates per invoice."""
    return refunds.groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("refund_count"),
        F.sum("amount").alias("refund_amount"),
        _count_if(F.col("is_duplicate")).alias("duplicate_refund_count"),
    )


def invoice_mart(b: Billing) -> DataFrame:
    """M1: 31-column invoice mart (live invoices; payment/refund aggregates 0-filled)."""
    pay = payments_by_invoice(b.payments)
    ref = refunds_by_invoice(b.refunds)
    subs = b.subscriptions.select("subscription_id", "billing_cycle", "mrr",
                                  F.col("discount_pct").alias("sub_discount_pct"), "quantity")
    ctr = b.contracts.select("contract_id", "contracted_value", "payment_terms_days",
                             F.col("discount_pct").alias("contract_discount_pct"))
    inv = b.invoices.filter(~F.col("is_deleted")).select(
        "invoice_id", "customer_id", "subscription_id", "contract_id", "invoice_number",
        F.col("status").alias("invoice_status"), "issue_date", "due_date", "period_start",
        "period_end", "subtotal", "tax_amount", "discount_amount", "total_amount", "paid_amount",
        "outstanding_amount")
    j = inv.join(pay, "invoice_id", "left").join(ref, "invoice_id", "left")
    j = X.left_lookup(j, subs, "subscription_id", "invoice_id")
    j = X.left_lookup(j, ctr, "contract_id", "invoice_id")
    z = X.zero_if_null
    return j.select(
        "invoice_id", "customer_id", "subscription_id", "invoice_number", "invoice_status",
        "issue_date", "due_date", "period_start", "period_end", "subtotal", "tax_amount",
        "discount_amount", "total_amount", "paid_amount", "outstanding_amount",
        z("total_paid").alias("total_paid"),
        z("payment_count").alias("payment_count"),
        z("failed_payment_count").alias("failed_payment_count"),
        z("max_days_late").alias("max_days_late"),
        F.coalesce("avg_days_late", F.lit(0.0)).alias("avg_days_late"),
        z("total_attempts").alias("total_attempts"),
        z("refund_count").alias("refund_count"),
        z("refund_amount").alias("refund_amount"),
        z("duplicate_refund_count").alias("duplicate_refund_count"),
        "billing_cycle", "mrr", "sub_discount_pct", "quantity",
        "contracted_value", "payment_terms_days", "contract_discount_pct",
    )


def subscriptions_by_customer(subscriptions: DataFrame) -> DataFrame:
    """A3: live subscriptions per customer."""
    return subscriptions.filter(~F.col("is_deleted")).groupBy("customer_id").agg(
        _count_if(F.col("status") == "active").alias("active_subscriptions"),
        F.count(F.lit(1)).alias("total_subscriptions"),
        _mean("mrr").alias("avg_mrr"),
        F.sum("arr").alias("total_arr"),
        _mean("discount_pct").alias("avg_discount_pct"))


def invoices_by_customer(invoices: DataFrame) -> DataFrame:
    """A4: live invoices per customer."""
    return invoices.filter(~F.col("is_deleted")).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("invoice_count"),
        F.sum("total_amount").alias("total_invoiced"),
        F.sum("outstanding_amount").alias("total_outstanding"),
        _count_if(F.col("status") == "overdue").alias("overdue_invoice_count"))


def payments_by_customer(payments: DataFrame) -> DataFrame:
    """A5: live payments per customer."""
    return payments.filter(~F.col("is_deleted")).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("payment_count"),
        _count_if(F.col("status") == "failed").alias("failed_payment_count"),
        _sum_if(F.col("status") == "succeeded", "amount").alias("total_paid"),
        _mean("days_late").alias("avg_days_late"))


def refunds_by_customer(refunds: DataFrame) -> DataFrame:
    """Live refunds per customer."""
    return refunds.filter(~F.col("is_deleted")).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("refund_count"),
        F.sum("amount").alias("total_refunded"),
        _count_if(F.col("is_duplicate")).alias("duplicate_refund_count"))


def customer_mart(b: Billing) -> DataFrame:
    """M2: 23-column customer mart (J8: four pre-aggregated left joins on customer_id).

    All four aggregates come out hash-partitioned on ``customer_id``, so the
    join chain only exchanges the customer side.
    """
    live = ~F.col("is_deleted")
    s_agg = subscriptions_by_customer(b.subscriptions)
    i_agg = invoices_by_customer(b.invoices)
    p_agg = payments_by_customer(b.payments)
    r_agg = refunds_by_customer(b.refunds)
    cust = b.customers.filter(live).select(
        "customer_id", "segment", F.col("status").alias("customer_status"), "acquisition_date",
        "churn_date", "risk_tier", "nation_key",
        F.datediff(F.lit(b.as_of), F.col("acquisition_date")).alias("tenure_days"))
    j = cust.join(s_agg, "customer_id", "left").join(i_agg, "customer_id", "left") \
        .join(p_agg, "customer_id", "left").join(r_agg, "customer_id", "left")
    z = X.zero_if_null
    zd = lambda x: F.coalesce(F.col(x), F.lit(0.0)).alias(x)
    return j.select(
        "customer_id", "segment", "customer_status", "acquisition_date", "churn_date", "risk_tier",
        "nation_key", "tenure_days",
        z("active_subscriptions").alias("active_subscriptions"),
        z("total_subscriptions").alias("total_subscriptions"),
        zd("avg_mrr"), z("total_arr").alias("total_arr"), zd("avg_discount_pct"),
        z("invoice_count").alias("invoice_count"), z("total_invoiced").alias("total_invoiced"),
        z("total_outstanding").alias("total_outstanding"),
        z("overdue_invoice_count").alias("overdue_invoice_count"),
        z("payment_count").alias("payment_count"),
        z("failed_payment_count").alias("failed_payment_count"),
        z("total_paid").alias("total_paid"), zd("avg_days_late"),
        z("refund_count").alias("refund_count"), z("total_refunded").alias("total_refunded"),
        z("duplicate_refund_count").alias("duplicate_refund_count"),
    )


def monthly_revenue(b: Billing, by: list[str] | None = None) -> DataFrame:
    """Monthly revenue mart keyed by ``yyyy-MM`` (optionally per extra keys).

    ``by`` adds series keys (e.g. ``["segment"]``), joined from customers, so
    that many series are built in one aggregate.
    """
    inv = b.invoices.filter(~F.col("is_deleted"))
    keys = list(by or [])
    if keys:
        inv = inv.join(b.customers.select("customer_id", *keys), "customer_id", "left")
    return inv.groupBy(*keys, X.month_key("issue_date").alias("period_month")).agg(
        F.sum("total_amount").alias("total_invoiced"),
        F.sum("paid_amount").alias("total_collected"),
        F.count(F.lit(1)).alias("invoice_count"),
        F.sum("discount_amount").alias("total_discounted"),
        F.sum("tax_amount").alias("total_tax"),
        F.sum("outstanding_amount").alias("total_outstanding"),
        _sum_if(F.col("status") == "overdue", "outstanding_amount").alias("overdue_amount"),
    )
