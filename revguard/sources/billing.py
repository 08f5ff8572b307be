"""Billing tables derived from the TPC-H-like driver tables.

The reconciliation, mart and scoring operators work on six billing tables
(customers, contracts, subscriptions, invoices, payments, refunds).  The test
data ships TPC-H-like tables instead, so each billing table is a *view* over
them.  The view text is one SQL string per table, written in the common subset
of Spark SQL and DuckDB, so that the Spark job and the DuckDB oracle start from
identical inputs.  Only the operators on top of these views are written twice
(DataFrame API here, SQL in ``revguard.plans.oracle``).

Placeholders: ``{customer}``, ``{orders}``, ``{lineitem}`` are the raw tables
(Spark binds DataFrames to them through ``spark.sql(text, **frames)``, DuckDB
uses the registered view names) and ``{as_of}`` is a date literal.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from revguard.sources import tables

# Fixed evaluation date used instead of "today" (every operator takes as_of).
AS_OF = _dt.date(2001, 8, 2)

# ---------------------------------------------------------------------------
# View definitions (fixed derivation rules of the test fixture).
# ---------------------------------------------------------------------------

_ACQ = "date '1993-01-01' + cast(c_custkey % 700 AS int)"

CUSTOMERS_SQL = f"""
SELECT
  c_custkey                                             AS customer_id,
  'CUST-' || cast(c_custkey AS string)                  AS external_id,
  c_name                                                AS name,
  c_nationkey                                           AS nation_key,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'enterprise'
                    WHEN 'BUILDING'  THEN 'mid_market'
                    WHEN 'FURNITURE' THEN 'startup'
                    ELSE 'smb' END                      AS segment,
  CASE WHEN c_custkey % 100 < 75 THEN 'active'
       WHEN c_custkey % 100 < 90 THEN 'churned'
       WHEN c_custkey % 100 < 97 THEN 'suspended'
       ELSE 'prospect' END                              AS status,
  {_ACQ}                                                AS acquisition_date,
  CASE WHEN c_custkey % 100 >= 75 AND c_custkey % 100 < 90
       THEN {_ACQ} + 400 END                            AS churn_date,
  cast(c_acctbal AS decimal(14,2))                      AS credit_limit,
  CASE c_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium'
                     ELSE 'high' END                    AS risk_tier,
  c_custkey % 97 = 5                                    AS is_deleted
FROM {{customer}}
"""

_DISC_PCT = "CASE WHEN c_custkey % 20 = 3 THEN 30 + c_custkey % 31 ELSE 0 END"

CONTRACTS_SQL = f"""
SELECT
  c_custkey                                             AS contract_id,
  c_custkey                                             AS customer_id,
  'CTR-' || cast(c_custkey AS string)                   AS contract_number,
  'active'                                              AS status,
  {_ACQ}                                                AS start_date,
  {_ACQ} + 3650                                         AS end_date,
  cast(12 * (120000 + 30000 * (c_custkey % 7)) AS decimal(16,2)) AS contracted_value,
  cast(15 * (1 + c_custkey % 4) AS int)                 AS payment_terms_days,
  c_custkey % 2 = 0                                     AS auto_renew,
  cast({_DISC_PCT} AS decimal(5,2))                     AS discount_pct,
  false                                                 AS is_deleted
FROM {{customer}}
"""

SUBSCRIPTIONS_SQL = f"""
SELECT
  c_custkey                                             AS subscription_id,
  c_custkey                                             AS customer_id,
  c_custkey                                             AS contract_id,
  cast(1 + c_custkey % 5 AS bigint)                     AS product_id,
  CASE c_custkey % 10 WHEN 8 THEN 'cancelled' WHEN 9 THEN 'expired'
                      ELSE 'active' END                 AS status,
  CASE WHEN c_custkey % 4 = 1 THEN 'annual' ELSE 'monthly' END AS billing_cycle,
  cast(100000 + 25000 * (c_custkey % 9) AS decimal(12,2))        AS mrr,
  cast(12 * (100000 + 25000 * (c_custkey % 9)) AS decimal(14,2)) AS arr,
  cast(1 + c_custkey % 5 AS int)                        AS quantity,
  cast({_DISC_PCT} AS decimal(5,2))                     AS discount_pct,
  {_ACQ}                                                AS start_date,
  c_custkey % 89 = 7                                    AS is_deleted
FROM {{customer}}
"""

INVOICES_SQL = """
SELECT
  o_orderkey                                            AS invoice_id,
  o_custkey                                             AS customer_id,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS contract_id,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_custkey END  AS subscription_id,
  'INV-' || cast(o_orderkey AS string)                  AS invoice_number,
  CASE o_orderstatus WHEN 'F' THEN 'paid'
                     WHEN 'P' THEN 'partially_paid'
                     ELSE CASE WHEN due_date < {as_of} AND o_orderkey % 3 = 0
                               THEN 'overdue' ELSE 'issued' END
  END                                                   AS status,
  issue_date,
  due_date,
  issue_date                                            AS period_start,
  issue_date + 30                                       AS period_end,
  cast(total - cast(total * cast(0.07 AS decimal(3,2)) AS decimal(12,2)) AS decimal(14,2)) AS subtotal,
  cast(total * cast(0.07 AS decimal(3,2)) AS decimal(12,2))                AS tax_amount,
  cast(total * cast(disc_pct AS decimal(5,2)) * cast(0.01 AS decimal(3,2)) AS decimal(12,2)) AS discount_amount,
  total                                                 AS total_amount,
  CASE o_orderstatus WHEN 'F' THEN total
                     WHEN 'P' THEN cast(total * cast(0.5 AS decimal(2,1)) AS decimal(14,2))
                     ELSE cast(0 AS decimal(14,2)) END  AS paid_amount,
  total - CASE o_orderstatus WHEN 'F' THEN total
                     WHEN 'P' THEN cast(total * cast(0.5 AS decimal(2,1)) AS decimal(14,2))
                     ELSE cast(0 AS decimal(14,2)) END  AS outstanding_amount,
  o_orderkey % 101 = 50                                 AS is_deleted
FROM (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         cast(o_orderdate AS date)                                          AS issue_date,
         cast(o_orderdate AS date) + cast(15 * (1 + o_custkey % 4) AS int)  AS due_date,
         cast(o_totalprice AS decimal(14,2))                                AS total,
         CASE WHEN o_orderkey % 20 = 0 THEN 36 + o_orderkey % 37
              WHEN o_orderkey % 5 = 0 THEN o_orderkey % 21
              ELSE 0 END                                                    AS disc_pct
  FROM {orders}
) o
"""

_TXN = ("cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) || '-' || "
        "cast(l_partkey AS string) || '-' || cast(l_suppkey AS string)")

PAYMENTS_SQL = f"""
SELECT
  {_TXN}                                                AS transaction_id,
  o_custkey                                             AS customer_id,
  l_orderkey                                            AS invoice_id,
  CASE l_returnflag WHEN 'A' THEN 'succeeded' WHEN 'R' THEN 'failed'
                    ELSE 'pending' END                  AS status,
  'card'                                                AS method,
  cast(l_extendedprice AS decimal(14,2))                AS amount,
  cast(l_shipdate AS date)                              AS payment_date,
  cast(1 + l_linenumber % 3 AS int)                     AS attempt_count,
  l_partkey % 8 = 0                                     AS is_late,
  cast(CASE WHEN l_partkey % 8 = 0
            THEN 1 + (l_suppkey * 7 + l_linenumber) % 120 ELSE 0 END AS int) AS days_late,
  l_partkey % 103 = 9                                   AS is_deleted
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
"""

REFUNDS_SQL = f"""
SELECT
  'RF-' || {_TXN}                                       AS refund_number,
  {_TXN}                                                AS transaction_id,
  o_custkey                                             AS customer_id,
  l_orderkey                                            AS invoice_id,
  'processed'                                           AS status,
  'billing_error'                                       AS reason,
  cast(cast(l_extendedprice AS decimal(14,2)) * cast(0.5 AS decimal(2,1)) AS decimal(14,2)) AS amount,
  cast(l_shipdate AS timestamp)                         AS requested_at,
  cast(l_shipdate AS timestamp)                         AS processed_at,
  l_suppkey % 33 = 0                                    AS is_duplicate,
  l_partkey % 103 = 9                                   AS is_deleted
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
WHERE l_returnflag = 'A' AND l_partkey % 9 = 0
"""

# Dated contract terms of a customer, several in a row: the contracts view has one contract per customer.
CONTRACT_TERMS_SQL = """
SELECT
  o_orderkey                                            AS contract_id,
  o_custkey                                             AS customer_id,
  cast(o_orderdate AS date)                             AS start_date,
  cast(o_orderdate AS date) + cast(60 + 30 * (o_orderkey % 9) AS int) AS end_date,
  o_orderkey % 4 = 0                                    AS auto_renew,
  o_orderkey % 50 = 7                                   AS is_deleted
FROM {orders}
WHERE o_orderkey % 3 = 0
"""

VIEWS = {
    "customers": CUSTOMERS_SQL,
    "contracts": CONTRACTS_SQL,
    "subscriptions": SUBSCRIPTIONS_SQL,
    "invoices": INVOICES_SQL,
    "payments": PAYMENTS_SQL,
    "refunds": REFUNDS_SQL,
}

# Raw columns each view needs: the scan reads only these (column pruning is
# also done by Catalyst; listing them keeps the ReadSchema obvious).
_RAW_COLS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
                 "l_returnflag", "l_shipdate"],
}


def as_of_literal(as_of: _dt.date) -> str:
    return f"date '{as_of.isoformat()}'"


def duckdb_ctes(as_of: _dt.date = AS_OF) -> str:
    """The six views as a DuckDB ``WITH`` prefix over the driver's base tables."""
    parts = []
    for name, sql in VIEWS.items():
        body = sql.format(customer="customer", orders="orders", lineitem="lineitem",
                          as_of=as_of_literal(as_of))
        parts.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n"


@dataclass(frozen=True)
class Billing:
    """The six billing tables as lazy DataFrames, plus the raw nation table."""

    customers: DataFrame
    contracts: DataFrame
    subscriptions: DataFrame
    invoices: DataFrame
    payments: DataFrame
    refunds: DataFrame
    as_of: _dt.date


def contract_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dated contract terms."""
    return spark.sql(CONTRACT_TERMS_SQL, orders=tables.read(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]))


def billing_views(spark: SparkSession, sf_dir: str, as_of: _dt.date = AS_OF) -> Billing:
    raw = {t: tables.read(spark, sf_dir, t, cols) for t, cols in _RAW_COLS.items()}
    lit = as_of_literal(as_of)
    frames = {}
    for name, sql in VIEWS.items():
        # ``{as_of}`` is substituted as text; DataFrames are bound by spark.sql.
        text = sql.replace("{as_of}", lit)
        needed = {k: v for k, v in raw.items() if "{" + k + "}" in text}
        frames[name] = spark.sql(text, **needed)
    return Billing(as_of=as_of, **frames)
