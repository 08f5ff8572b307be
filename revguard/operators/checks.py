"""Table-constraint checks Q-D1..3 as aggregate / anti-join reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Allowed values of the enumerated billing columns.
ALLOWED = {
    ("customers", "segment"): ["enterprise", "mid_market", "smb", "startup"],
    ("customers", "status"): ["active", "churned", "suspended", "prospect"],
    ("customers", "risk_tier"): ["low", "medium", "high"],
    ("contracts", "status"): ["draft", "active", "expired", "terminated", "renewed"],
    ("subscriptions", "status"): ["active", "cancelled", "suspended", "trial", "expired", "pending"],
    ("invoices", "status"): ["draft", "issued", "paid", "partially_paid", "overdue", "void", "written_off"],
    ("payments", "status"): ["pending", "succeeded", "failed", "refunded", "partially_refunded",
                             "disputed", "cancelled"],
    ("payments", "method"): ["credit_card", "bank_transfer", "ach", "wire", "check", "crypto"],
    ("refunds", "reason"): ["duplicate_charge", "service_cancellation", "billing_error", "contract_termination",
                            "customer_request", "fraud", "other"],
    ("refunds", "status"): ["pending", "approved", "processed", "rejected", "reversed"],
}

UNIQUE_KEYS = {"invoices": ["invoice_number"], "payments": ["transaction_id"],
               "refunds": ["refund_number"]}

FOREIGN_KEYS = [("invoices", "customer_id", "customers", "customer_id"),
                ("invoices", "subscription_id", "subscriptions", "subscription_id"),
                ("invoices", "contract_id", "contracts", "contract_id"),
                ("payments", "invoice_id", "invoices", "invoice_id"),
                ("refunds", "transaction_id", "payments", "transaction_id"),
                ("subscriptions", "customer_id", "customers", "customer_id"),
                ("contracts", "customer_id", "customers", "customer_id"),
                ("payments", "customer_id", "customers", "customer_id"),
                ("refunds", "invoice_id", "invoices", "invoice_id"),
                ("refunds", "customer_id", "customers", "customer_id")]


def enum_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Q-D1: rows per (table, column) whose value is outside the allowed set."""
    parts = [tables[t].agg(F.count_if(~F.col(c).isin(*vals) | F.col(c).isNull()).alias("violations"))
             .select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "violations")
             for (t, c), vals in ALLOWED.items() if t in tables]
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Q-D2: duplicated key values and the rows they cover, per unique key."""
    parts = []
    for t, keys in UNIQUE_KEYS.items():
        d = tables[t].groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        parts.append(d.agg(F.count(F.lit(1)).alias("duplicate_keys"),
                           F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("duplicate_rows"))
                     .select(F.lit(t).alias("table_name"), F.lit(",".join(keys)).alias("key"),
                             "duplicate_keys", "duplicate_rows"))
    return reduce(DataFrame.unionByName, parts)


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Q-D3: non-null foreign keys with no parent row (anti-join), per relation."""
    parts = []
    for child, fk, parent, pk in FOREIGN_KEYS:
        c = tables[child].select(F.col(fk).alias("_k")).filter(F.col("_k").isNotNull())
        p = tables[parent].select(F.col(pk).alias("_k"))
        parts.append(c.join(p, "_k", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
                     .select(F.lit(f"{child}.{fk}").alias("relation"), "orphans"))
    return reduce(DataFrame.unionByName, parts)


def billing_tables(b) -> dict[str, DataFrame]:
    return {n: getattr(b, n) for n in ("customers", "contracts", "subscriptions", "invoices",
                                        "payments", "refunds")}
