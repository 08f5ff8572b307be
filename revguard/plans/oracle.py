"""DuckDB oracle SQL, one independent formulation per registered query.

Each string starts with the shared billing views as CTEs (the fixture
derivation, identical text on both engines) and then states the operator in
plain SQL, written separately from the DataFrame code it checks.
"""

from __future__ import annotations

from revguard.sources.billing import AS_OF, CONTRACT_TERMS_SQL, duckdb_ctes

AS_OF_SQL = f"DATE '{AS_OF.isoformat()}'"


def _q(body: str) -> str:
    return duckdb_ctes(AS_OF) + body


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


# ---------------------------------------------------------------------------
# Rules R1-R8
# ---------------------------------------------------------------------------

def _r1(settled: str) -> str:
    return f"""
SELECT i.customer_id, i.invoice_id, 'MISSING_PAYMENT' AS rule_code,
       CASE WHEN i.due_date < {AS_OF_SQL} THEN 'high' ELSE 'medium' END AS severity,
       {_d("COALESCE(NULLIF(i.outstanding_amount, 0), i.total_amount)")} AS leakage_amount,
       i.invoice_number AS source_ref
FROM invoices i
WHERE NOT i.is_deleted AND i.status IN ('issued', 'overdue') AND i.total_amount > 0
  AND NOT EXISTS (SELECT 1 FROM payments p
                  WHERE p.invoice_id = i.invoice_id AND p.status = '{settled}')"""


R2 = """
SELECT customer_id, invoice_id, 'DUPLICATE_REFUND' AS rule_code, 'high' AS severity,
       CAST(amount AS DOUBLE) AS leakage_amount, refund_number AS source_ref
FROM refunds WHERE is_duplicate"""

R3 = """
SELECT customer_id, invoice_id, 'ABNORMAL_DISCOUNT' AS rule_code,
       CASE WHEN r > 0.60 THEN 'critical' WHEN r > 0.45 THEN 'high' ELSE 'medium' END AS severity,
       CAST(discount_amount AS DOUBLE) AS leakage_amount, invoice_number AS source_ref
FROM (SELECT *, CAST(discount_amount AS DOUBLE) / CAST(total_amount AS DOUBLE) AS r
      FROM invoices WHERE NOT is_deleted AND total_amount > 0) t
WHERE r > 0.35"""

R4 = """
SELECT i.customer_id, i.invoice_id, 'UNDERBILLING' AS rule_code,
       CASE WHEN CAST(i.total_amount AS DOUBLE) / CAST(s.mrr AS DOUBLE) < 0.50 THEN 'critical'
            WHEN CAST(i.total_amount AS DOUBLE) / CAST(s.mrr AS DOUBLE) < 0.70 THEN 'high'
            ELSE 'medium' END AS severity,
       CAST(s.mrr - i.total_amount AS DOUBLE) AS leakage_amount, i.invoice_number AS source_ref
FROM invoices i JOIN subscriptions s ON i.subscription_id = s.subscription_id
WHERE NOT i.is_deleted AND i.total_amount > 0 AND s.mrr > 0
  AND i.total_amount < s.mrr * CAST(0.85 AS DECIMAL(3,2))"""

R5 = """
SELECT i.customer_id, i.invoice_id, 'PAYMENT_DELAY' AS rule_code,
       CASE WHEN p.days_late >= 90 THEN 'high' ELSE 'medium' END AS severity,
       CAST(0 AS DOUBLE) AS leakage_amount, p.transaction_id AS source_ref
FROM payments p JOIN invoices i ON p.invoice_id = i.invoice_id
WHERE p.status = 'succeeded' AND p.is_late AND p.days_late >= 30 AND NOT i.is_deleted"""

R6 = """
SELECT customer_id, CAST(NULL AS BIGINT) AS invoice_id, 'FAILED_PAYMENT_STREAK' AS rule_code,
       CASE WHEN fails >= 10 THEN 'critical' WHEN fails >= 6 THEN 'high' ELSE 'medium' END AS severity,
       CAST(ROUND(at_risk, 2) AS DOUBLE) AS leakage_amount, CAST(customer_id AS VARCHAR) AS source_ref
FROM (SELECT customer_id, COUNT(*) AS fails, SUM(amount) AS at_risk
      FROM payments WHERE status = 'failed' AND NOT is_deleted
      GROUP BY customer_id HAVING COUNT(*) >= 3) g"""

R7 = f"""
SELECT customer_id, invoice_id, 'MISSING_RENEWAL' AS rule_code,
       CASE WHEN d >= 90 THEN 'critical' WHEN d >= 30 THEN 'high' ELSE 'medium' END AS severity,
       CAST(COALESCE(outstanding_amount, 0) AS DOUBLE) AS leakage_amount, invoice_number AS source_ref
FROM (SELECT *, date_diff('day', due_date, {AS_OF_SQL}) AS d FROM invoices
      WHERE NOT is_deleted AND status = 'overdue' AND due_date < {AS_OF_SQL}) t"""

ALL_ALERTS = " UNION ALL ".join(f"({x})" for x in (_r1("succeeded"), R2, R3, R4, R5, R6, R7))

R8_SUMMARY = f"""
SELECT rule_code, severity, COUNT(*) AS alert_count, CAST(SUM(leakage_amount) AS DOUBLE) AS leakage
FROM ({ALL_ALERTS}) a GROUP BY rule_code, severity"""

_META = ["refund_number VARCHAR", "discount_ratio DOUBLE", "billed DOUBLE", "mrr DOUBLE", "ratio DOUBLE", "days_late INTEGER",
         "payment_date VARCHAR", "failed_count BIGINT", "total_at_risk DOUBLE", "days_overdue INTEGER", "due_date VARCHAR"]


def _meta(code: str, ref: str, body: str, **fields: str) -> str:
    """Alerts of one rule with its metadata; ``body`` is what follows the select list."""
    cols = ", ".join(f"CAST({fields.get(c.split()[0], 'NULL')} AS {c.split()[1]}) AS {c.split()[0]}" for c in _META)
    return f"SELECT '{code}' AS rule_code, CAST({ref} AS VARCHAR) AS source_ref, {cols} {body}"


_RATIO = "CAST({0} AS DOUBLE) / CAST({1} AS DOUBLE)"
METADATA = " UNION ALL ".join([
    _meta("MISSING_PAYMENT", "source_ref", f"FROM ({_r1('succeeded')}) a"),
    _meta("DUPLICATE_REFUND", "refund_number", "FROM refunds WHERE is_duplicate", refund_number="refund_number"),
    _meta("ABNORMAL_DISCOUNT", "invoice_number", f"""FROM invoices WHERE NOT is_deleted AND total_amount > 0
          AND {_RATIO.format('discount_amount', 'total_amount')} > 0.35""",
          discount_ratio=f"ROUND({_RATIO.format('discount_amount', 'total_amount')}, 4)"),
    _meta("UNDERBILLING", "i.invoice_number", """FROM invoices i JOIN subscriptions s ON i.subscription_id = s.subscription_id
          WHERE NOT i.is_deleted AND i.total_amount > 0 AND s.mrr > 0 AND i.total_amount < s.mrr * CAST(0.85 AS DECIMAL(3,2))""",
          billed="i.total_amount", mrr="s.mrr", ratio=f"ROUND({_RATIO.format('i.total_amount', 's.mrr')}, 4)"),
    _meta("PAYMENT_DELAY", "p.transaction_id", """FROM payments p JOIN invoices i ON p.invoice_id = i.invoice_id
          WHERE p.status = 'succeeded' AND p.is_late AND p.days_late >= 30 AND NOT i.is_deleted""",
          days_late="p.days_late", payment_date="p.payment_date"),
    _meta("FAILED_PAYMENT_STREAK", "customer_id", """FROM payments WHERE status = 'failed' AND NOT is_deleted
          GROUP BY customer_id HAVING COUNT(*) >= 3""", failed_count="COUNT(*)", total_at_risk="SUM(amount)"),
    _meta("MISSING_RENEWAL", "invoice_number", f"""FROM invoices
          WHERE NOT is_deleted AND status = 'overdue' AND due_date < {AS_OF_SQL}""",
          days_overdue=f"date_diff('day', due_date, {AS_OF_SQL})", due_date="due_date")])

ORACLE: dict[str, str] = {
    "r9_alert_metadata": _q(METADATA),
    "r1_missing_payment": _q(_r1("succeeded")),
    "r1_missing_payment_literal": _q(_r1("completed")),
    "r2_duplicate_refund": _q(R2),
    "r3_abnormal_discount": _q(R3),
    "r4_underbilling": _q(R4),
    "r5_payment_delay": _q(R5),
    "r6_failed_payment_streak": _q(R6),
    "r7_overdue_invoice": _q(R7),
    "r8_all_alerts": _q(ALL_ALERTS),
    "r8_rule_summary": _q(R8_SUMMARY),
}


# ---------------------------------------------------------------------------
# Rules over time
# ---------------------------------------------------------------------------

RUNS = """
SELECT customer_id, CAST(MIN(payment_date) AS VARCHAR) AS run_start, CAST(MAX(payment_date) AS VARCHAR) AS run_end,
       COUNT(*) AS fails, CAST(SUM(amount) AS DOUBLE) AS at_risk,
       CASE WHEN COUNT(*) >= 10 THEN 'critical' WHEN COUNT(*) >= 6 THEN 'high' ELSE 'medium' END AS severity
FROM (SELECT *, COUNT(CASE WHEN status = 'succeeded' THEN 1 END) OVER (
          PARTITION BY customer_id ORDER BY payment_date, transaction_id ROWS UNBOUNDED PRECEDING) AS run
      FROM payments WHERE NOT is_deleted AND status IN ('failed', 'succeeded') AND customer_id IS NOT NULL) p
WHERE status = 'failed' GROUP BY customer_id, run HAVING COUNT(*) >= 3"""


def _m(d: str) -> str:
    return f"(year({d}) * 12 + month({d}) - 1)"


def _first_day(m: str) -> str:
    return f"CAST(make_date({m} // 12, {m} % 12 + 1, 1) AS VARCHAR)"


ACTIVE = f"""
, act AS (
  SELECT customer_id, mrr, unnest(range(first, last + 1)) AS m
  FROM (SELECT c.customer_id, s.mrr, {_m("s.start")} AS first,
               {_m(f"LEAST(COALESCE(c.churn_date, {AS_OF_SQL}), {AS_OF_SQL})")} - 1 AS last
        FROM customers c JOIN (SELECT customer_id, MIN(start_date) AS start, SUM(mrr) AS mrr FROM subscriptions
                               WHERE NOT is_deleted AND status = 'active' GROUP BY customer_id) s USING (customer_id)
        WHERE NOT c.is_deleted) t
  WHERE first <= last)
"""
NO_INVOICE = ACTIVE + f"""
SELECT customer_id, 'NO_INVOICE' AS rule_code, {_first_day("MIN(m)")} AS first_month, {_first_day("MAX(m)")} AS last_month,
       COUNT(*) AS months, CAST(ANY_VALUE(mrr) * COUNT(*) AS DOUBLE) AS expected_revenue,
       CASE WHEN COUNT(*) >= 12 THEN 'critical' WHEN COUNT(*) >= 6 THEN 'high' ELSE 'medium' END AS severity
FROM (SELECT *, m - row_number() OVER (PARTITION BY customer_id ORDER BY m) AS run FROM act
      WHERE NOT EXISTS (SELECT 1 FROM invoices i WHERE NOT i.is_deleted AND i.customer_id = act.customer_id
                        AND {_m("i.issue_date")} = act.m)) g
GROUP BY customer_id, run HAVING COUNT(*) >= 3"""

ZERO_REVENUE = ACTIVE + f"""
SELECT act.customer_id, 'ZERO_REVENUE' AS rule_code, {_first_day("act.m")} AS month, b.invoices,
       CAST(b.billed AS DOUBLE) AS billed, CASE WHEN b.billed >= act.mrr THEN 'high' ELSE 'medium' END AS severity
FROM act JOIN (SELECT i.customer_id, {_m("i.issue_date")} AS m, COUNT(*) AS invoices, SUM(i.total_amount) AS billed,
                      SUM(COALESCE((SELECT SUM(p.amount) FROM payments p
                                    WHERE p.invoice_id = i.invoice_id AND p.status = 'succeeded'), 0)) AS collected
               FROM invoices i WHERE NOT i.is_deleted GROUP BY 1, 2) b
     ON b.customer_id = act.customer_id AND b.m = act.m
WHERE b.billed > 0 AND b.collected = 0"""

MISMATCH = """
SELECT customer_id, invoice_id, contract_id, 'CONTRACT_MISMATCH' AS rule_code, reason,
       CAST(total_amount AS DOUBLE) AS total_amount,
       CASE WHEN reason IN ('no_contract', 'other_customer') THEN 'high' ELSE 'medium' END AS severity
FROM (SELECT i.*, CASE WHEN c.contract_id IS NULL OR c.is_deleted THEN 'no_contract'
                       WHEN c.customer_id IS DISTINCT FROM i.customer_id THEN 'other_customer'
                       WHEN i.issue_date < c.start_date THEN 'before_start'
                       WHEN i.issue_date > c.end_date THEN 'after_end' END AS reason
      FROM invoices i LEFT JOIN contracts c ON c.contract_id = i.contract_id
      WHERE NOT i.is_deleted AND i.contract_id IS NOT NULL) t
WHERE reason IS NOT NULL"""

SUCCESSION = f"""
WITH terms AS ({CONTRACT_TERMS_SQL.format(orders="orders")}),
n AS (SELECT *, LEAD(contract_id) OVER w AS next_contract_id, LEAD(start_date) OVER w AS next_start
      FROM terms WHERE NOT is_deleted WINDOW w AS (PARTITION BY customer_id ORDER BY start_date, contract_id)),
s AS (SELECT contract_id, customer_id, start_date, end_date, auto_renew, next_contract_id, next_start,
             date_diff('day', end_date, next_start) - 1 AS gap_days,
             CASE WHEN next_start IS NULL THEN 'last' WHEN next_start <= end_date THEN 'overlap'
                  WHEN date_diff('day', end_date, next_start) = 1 THEN 'renewed' ELSE 'gap' END AS succession FROM n)
"""
SUCCESSION_ROWS = SUCCESSION + """
SELECT contract_id, customer_id, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, auto_renew,
       next_contract_id, CAST(next_start AS VARCHAR) AS next_start, gap_days, succession FROM s"""
LAPSED = SUCCESSION + f"""
SELECT customer_id, contract_id, CAST(end_date AS VARCHAR) AS end_date, CAST(next_start AS VARCHAR) AS next_start, open_days,
       CASE WHEN open_days >= 365 THEN 'critical' WHEN open_days >= 90 THEN 'high' ELSE 'medium' END AS severity
FROM (SELECT *, COALESCE(gap_days, date_diff('day', end_date, {AS_OF_SQL})) AS open_days FROM s) t
WHERE NOT auto_renew AND (succession = 'last' OR gap_days > 30) AND date_diff('day', end_date, {AS_OF_SQL}) >= 30"""

ORACLE.update({
    "lc1_failed_payment_runs": _q(RUNS),
    "lc2_no_invoice_gaps": _q(NO_INVOICE),
    "lc3_zero_revenue_months": _q(ZERO_REVENUE),
    "lc4_contract_mismatches": _q(MISMATCH),
    "lc4_contract_term_mismatches": _q(f", terms AS ({CONTRACT_TERMS_SQL.format(orders='orders')})" + MISMATCH.replace(
        "contracts c", "terms c")),
    "lc5_contract_succession": SUCCESSION_ROWS,
    "lc6_missing_renewals": LAPSED,
})


# ---------------------------------------------------------------------------
# Aggregates A1-A7 and marts M1-M6
# ---------------------------------------------------------------------------

A1 = """
SELECT invoice_id,
       SUM(CASE WHEN status = 'succeeded' THEN amount ELSE 0 END) AS total_paid,
       COUNT(*) AS payment_count,
       CAST(SUM(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed_payment_count,
       MAX(days_late) AS max_days_late,
       AVG(days_late) AS avg_days_late,
       CAST(SUM(attempt_count) AS BIGINT) AS total_attempts
FROM payments GROUP BY invoice_id"""

A2 = """
SELECT invoice_id, COUNT(*) AS refund_count, SUM(amount) AS refund_amount,
       CAST(SUM(CASE WHEN is_duplicate THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_refund_count
FROM refunds GROUP BY invoice_id"""

A3 = """
SELECT customer_id,
       CAST(SUM(CASE WHEN status = 'active' THEN 1 ELSE 0 END) AS BIGINT) AS active_subscriptions,
       COUNT(*) AS total_subscriptions,
       CAST(SUM(mrr) AS DOUBLE) / COUNT(mrr) AS avg_mrr,
       SUM(arr) AS total_arr,
       CAST(SUM(discount_pct) AS DOUBLE) / COUNT(discount_pct) AS avg_discount_pct
FROM subscriptions WHERE NOT is_deleted GROUP BY customer_id"""

A4 = """
SELECT customer_id, COUNT(*) AS invoice_count, SUM(total_amount) AS total_invoiced,
       SUM(outstanding_amount) AS total_outstanding,
       CAST(SUM(CASE WHEN status = 'overdue' THEN 1 ELSE 0 END) AS BIGINT) AS overdue_invoice_count
FROM invoices WHERE NOT is_deleted GROUP BY customer_id"""

A5 = """
SELECT customer_id, COUNT(*) AS payment_count,
       CAST(SUM(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed_payment_count,
       SUM(CASE WHEN status = 'succeeded' THEN amount ELSE 0 END) AS total_paid,
       AVG(days_late) AS avg_days_late
FROM payments WHERE NOT is_deleted GROUP BY customer_id"""

A6 = """
SELECT customer_id, COUNT(*) AS refund_count, SUM(amount) AS total_refunded,
       CAST(SUM(CASE WHEN is_duplicate THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_refund_count
FROM refunds WHERE NOT is_deleted GROUP BY customer_id"""


M1_RAW = f"""
SELECT i.invoice_id, i.customer_id, i.subscription_id, i.invoice_number,
       i.status AS invoice_status, i.issue_date, i.due_date, i.period_start, i.period_end,
       i.subtotal, i.tax_amount, i.discount_amount, i.total_amount, i.paid_amount,
       i.outstanding_amount,
       COALESCE(p.total_paid, 0) AS total_paid,
       COALESCE(p.payment_count, 0) AS payment_count,
       COALESCE(p.failed_payment_count, 0) AS failed_payment_count,
       COALESCE(p.max_days_late, 0) AS max_days_late,
       COALESCE(p.avg_days_late, 0) AS avg_days_late,
       COALESCE(p.total_attempts, 0) AS total_attempts,
       COALESCE(r.refund_count, 0) AS refund_count,
       COALESCE(r.refund_amount, 0) AS refund_amount,
       COALESCE(r.duplicate_refund_count, 0) AS duplicate_refund_count,
       s.billing_cycle, s.mrr, s.discount_pct AS sub_discount_pct, s.quantity,
       c.contracted_value, c.payment_terms_days, c.discount_pct AS contract_discount_pct
FROM invoices i
LEFT JOIN ({A1}) p ON p.invoice_id = i.invoice_id
LEFT JOIN ({A2}) r ON r.invoice_id = i.invoice_id
LEFT JOIN subscriptions s ON s.subscription_id = i.subscription_id
LEFT JOIN contracts c ON c.contract_id = i.contract_id
WHERE NOT i.is_deleted"""

M1_MONEY = ["subtotal", "tax_amount", "discount_amount", "total_amount", "paid_amount",
            "outstanding_amount", "total_paid", "refund_amount", "mrr", "sub_discount_pct",
            "contracted_value", "contract_discount_pct"]
M1_DATES = ["issue_date", "due_date", "period_start", "period_end"]


def _flat(body: str, money: list[str], dates: list[str] = ()) -> str:
    ex = list(money) + list(dates)
    parts = [f"CAST(t.{c} AS DOUBLE) AS {c}" for c in money]
    parts += [f"CAST(t.{c} AS VARCHAR) AS {c}" for c in dates]
    return f"SELECT t.* EXCLUDE ({', '.join(ex)}), {', '.join(parts)} FROM ({body}) t"


M2_RAW = f"""
SELECT c.customer_id, c.segment, c.status AS customer_status, c.acquisition_date, c.churn_date,
       c.risk_tier, c.nation_key,
       CAST(date_diff('day', c.acquisition_date, {AS_OF_SQL}) AS INTEGER) AS tenure_days,
       COALESCE(s.active_subscriptions, 0) AS active_subscriptions,
       COALESCE(s.total_subscriptions, 0) AS total_subscriptions,
       COALESCE(s.avg_mrr, 0) AS avg_mrr, COALESCE(s.total_arr, 0) AS total_arr,
       COALESCE(s.avg_discount_pct, 0) AS avg_discount_pct,
       COALESCE(i.invoice_count, 0) AS invoice_count,
       COALESCE(i.total_invoiced, 0) AS total_invoiced,
       COALESCE(i.total_outstanding, 0) AS total_outstanding,
       COALESCE(i.overdue_invoice_count, 0) AS overdue_invoice_count,
       COALESCE(p.payment_count, 0) AS payment_count,
       COALESCE(p.failed_payment_count, 0) AS failed_payment_count,
       COALESCE(p.total_paid, 0) AS total_paid,
       COALESCE(p.avg_days_late, 0) AS avg_days_late,
       COALESCE(r.refund_count, 0) AS refund_count,
       COALESCE(r.total_refunded, 0) AS total_refunded,
       COALESCE(r.duplicate_refund_count, 0) AS duplicate_refund_count
FROM customers c
LEFT JOIN ({A3}) s ON s.customer_id = c.customer_id
LEFT JOIN ({A4}) i ON i.customer_id = c.customer_id
LEFT JOIN ({A5}) p ON p.customer_id = c.customer_id
LEFT JOIN ({A6}) r ON r.customer_id = c.customer_id
WHERE NOT c.is_deleted"""

M2_MONEY = ["total_arr", "total_invoiced", "total_outstanding", "total_paid", "total_refunded"]


def _m3(by: list[str]) -> str:
    k = "".join(f"c.{x}, " for x in by)
    g = "".join(f"c.{x}, " for x in by)
    join = "LEFT JOIN customers c ON c.customer_id = i.customer_id" if by else ""
    return f"""
SELECT {k}strftime(i.issue_date, '%Y-%m') AS period_month,
       SUM(i.total_amount) AS total_invoiced, SUM(i.paid_amount) AS total_collected,
       COUNT(*) AS invoice_count, SUM(i.discount_amount) AS total_discounted,
       SUM(i.tax_amount) AS total_tax, SUM(i.outstanding_amount) AS total_outstanding,
       SUM(CASE WHEN i.status = 'overdue' THEN i.outstanding_amount ELSE 0 END) AS overdue_amount
FROM invoices i {join}
WHERE NOT i.is_deleted
GROUP BY {g}strftime(i.issue_date, '%Y-%m')"""


M3_MONEY = ["total_invoiced", "total_collected", "total_discounted", "total_tax",
            "total_outstanding", "overdue_amount"]

_INV_NUM = ["subtotal", "tax_amount", "discount_amount", "total_amount", "paid_amount",
            "outstanding_amount", "total_paid", "payment_count", "failed_payment_count",
            "max_days_late", "avg_days_late", "total_attempts", "refund_count",
            "refund_amount", "duplicate_refund_count", "mrr", "sub_discount_pct",
            "quantity", "contracted_value", "payment_terms_days", "contract_discount_pct"]

M4 = f"""
SELECT invoice_id, customer_id, CAST(issue_date AS VARCHAR) AS issue_date, {", ".join(_INV_NUM)},
  bve AS billed_vs_expected_ratio,
  total_paid / (total_amount + 1e-6) AS paid_vs_billed_ratio,
  refund_amount / (total_paid + 1e-6) AS refund_ratio,
  dr AS discount_ratio,
  outstanding_amount / (total_amount + 1e-6) AS outstanding_ratio,
  tax_amount / (total_amount + 1e-6) AS tax_ratio,
  contracted_value / 12 - total_amount AS contract_gap,
  CAST(CASE WHEN invoice_status = 'overdue'
            THEN GREATEST(date_diff('day', due_date, {AS_OF_SQL}), 0) ELSE 0 END AS DOUBLE) AS overdue_days,
  max_days_late / (COALESCE(terms_raw, 30.0) + 1e-6) AS payment_delay_ratio,
  failed_payment_count / (payment_count + 1e-6) AS failed_payment_rate,
  total_attempts / (payment_count + 1e-6) AS retry_rate,
  CASE WHEN invoice_status IN ('overdue', 'issued') AND total_paid = 0
            AND due_date < {AS_OF_SQL} THEN 1 ELSE 0 END AS flag_missing_payment,
  CASE WHEN bve < 0.85 THEN 1 ELSE 0 END AS flag_underbilling,
  CASE WHEN duplicate_refund_count > 0 THEN 1 ELSE 0 END AS flag_duplicate_refund,
  CASE WHEN dr > 0.30 THEN 1 ELSE 0 END AS flag_abnormal_discount,
  CASE WHEN max_days_late > 30 THEN 1 ELSE 0 END AS flag_payment_delay,
  GREATEST(CASE WHEN invoice_status IN ('overdue', 'issued') AND total_paid = 0
                     AND due_date < {AS_OF_SQL} THEN 1 ELSE 0 END,
           CASE WHEN bve < 0.85 THEN 1 ELSE 0 END,
           CASE WHEN duplicate_refund_count > 0 THEN 1 ELSE 0 END,
           CASE WHEN dr > 0.30 THEN 1 ELSE 0 END,
           CASE WHEN max_days_late > 30 THEN 1 ELSE 0 END) AS leakage_label,
  CAST(month(issue_date) AS DOUBLE) AS issue_month,
  CAST(quarter(issue_date) AS DOUBLE) AS issue_quarter,
  CAST(year(issue_date) AS INTEGER) AS issue_year,
  CAST(date_diff('day', period_start, period_end) AS INTEGER) AS period_length_days,
  CAST(CASE WHEN billing_cycle = 'annual' THEN 1 ELSE 0 END AS DOUBLE) AS is_annual_billing,
  ln(1 + GREATEST(mrr, 0.0)) AS mrr_log
FROM (
  SELECT invoice_id, customer_id, invoice_status, due_date, issue_date, period_start, period_end,
         billing_cycle, payment_terms_days AS terms_raw,
         {", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in _INV_NUM)},
         COALESCE(CAST(total_amount AS DOUBLE), 0.0)
           / (COALESCE(CAST(contracted_value AS DOUBLE), 0.0) / 12 + 1e-6) AS bve,
         COALESCE(CAST(discount_amount AS DOUBLE), 0.0)
           / (COALESCE(CAST(subtotal AS DOUBLE), 0.0) + 1e-6) AS dr
  FROM ({M1_RAW}) m
) d"""

_CUST_NUM = ["tenure_days", "active_subscriptions", "total_subscriptions", "avg_mrr",
             "total_arr", "avg_discount_pct", "invoice_count", "total_invoiced",
             "total_outstanding", "overdue_invoice_count", "payment_count",
             "failed_payment_count", "total_paid", "avg_days_late", "refund_count",
             "total_refunded", "duplicate_refund_count"]

M5 = f"""
SELECT customer_id, segment, nation_key, {", ".join(_CUST_NUM)},
  collection_rate, overdue_rate, failed_payment_rate, refund_rate, duplicate_refund_rate,
  outstanding_ratio, mrr_log, tenure_years, segment_code, risk_tier_code, churn_flag,
  CASE WHEN failed_payment_rate > 0.15 OR overdue_rate > 0.10 OR duplicate_refund_count > 0
            OR avg_discount_pct > 30 OR outstanding_ratio > 0.20 THEN 1 ELSE 0 END AS leakage_label
FROM (
  SELECT *,
    total_paid / (total_invoiced + 1e-6) AS collection_rate,
    overdue_invoice_count / (invoice_count + 1e-6) AS overdue_rate,
    failed_payment_count / (payment_count + 1e-6) AS failed_payment_rate,
    refund_count / (invoice_count + 1e-6) AS refund_rate,
    duplicate_refund_count / (refund_count + 1e-6) AS duplicate_refund_rate,
    total_outstanding / (total_invoiced + 1e-6) AS outstanding_ratio,
    ln(1 + GREATEST(avg_mrr, 0.0)) AS mrr_log,
    tenure_days / 365.25 AS tenure_years,
    CAST(CASE segment WHEN 'enterprise' THEN 3 WHEN 'mid_market' THEN 2 WHEN 'smb' THEN 1
                      WHEN 'startup' THEN 0 ELSE 1 END AS INTEGER) AS segment_code,
    CAST(CASE risk_tier WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0
                        ELSE 1 END AS INTEGER) AS risk_tier_code,
    CASE WHEN customer_status = 'churned' THEN 1 ELSE 0 END AS churn_flag
  FROM (SELECT customer_id, segment, nation_key, customer_status, risk_tier,
               {", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in _CUST_NUM)}
        FROM ({M2_RAW}) m) d
) e"""


def _m6(by: list[str]) -> str:
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    w = f"(w ROWS BETWEEN {{n}} PRECEDING AND CURRENT ROW)"
    mas = ",\n  ".join(
        f"AVG(total_invoiced) OVER {w.format(n=n - 1)} AS invoiced_ma{n}, "
        f"AVG(total_collected) OVER {w.format(n=n - 1)} AS collected_ma{n}" for n in (3, 6, 12))
    keys = "".join(f"{x}, " for x in by)
    return f"""
SELECT {keys}period_month, total_invoiced, total_collected, invoice_count, total_outstanding,
  overdue_amount, total_discounted, total_tax,
  total_collected / (total_invoiced + 1e-6) AS collection_rate,
  {mas},
  COALESCE(total_invoiced / NULLIF(LAG(total_invoiced) OVER w, 0) - 1, 0) AS invoiced_mom_pct,
  COALESCE(total_collected / NULLIF(LAG(total_collected) OVER w, 0) - 1, 0) AS collected_mom_pct,
  COALESCE(total_invoiced / NULLIF(LAG(total_invoiced, 12) OVER w, 0) - 1, 0) AS invoiced_yoy_pct,
  CAST(CAST(period_month || '-01' AS DATE) AS VARCHAR) AS period_dt,
  CAST(month(CAST(period_month || '-01' AS DATE)) AS INTEGER) AS month_num,
  CAST(quarter(CAST(period_month || '-01' AS DATE)) AS INTEGER) AS quarter
FROM (SELECT {keys}period_month, invoice_count,
             COALESCE(CAST(total_invoiced AS DOUBLE), 0.0) AS total_invoiced,
             COALESCE(CAST(total_collected AS DOUBLE), 0.0) AS total_collected,
             COALESCE(CAST(total_outstanding AS DOUBLE), 0.0) AS total_outstanding,
             COALESCE(CAST(overdue_amount AS DOUBLE), 0.0) AS overdue_amount,
             CAST(total_discounted AS DOUBLE) AS total_discounted,
             CAST(total_tax AS DOUBLE) AS total_tax
      FROM ({_m3(by)}) m) t
WINDOW w AS ({part}ORDER BY period_month)"""


ORACLE.update({
    "a1_payments_by_invoice": _q(_flat(A1, ["total_paid"])),
    "a2_refunds_by_invoice": _q(_flat(A2, ["refund_amount"])),
    "a3_subscriptions_by_customer": _q(_flat(A3, ["total_arr"])),
    "a4_invoices_by_customer": _q(_flat(A4, ["total_invoiced", "total_outstanding"])),
    "a5_payments_by_customer": _q(_flat(A5, ["total_paid"])),
    "a6_refunds_by_customer": _q(_flat(A6, ["total_refunded"])),
    "m1_invoice_mart": _q(_flat(M1_RAW, M1_MONEY, M1_DATES)),
    "m2_customer_mart": _q(_flat(M2_RAW, M2_MONEY, ["acquisition_date", "churn_date"])),
    "m3_monthly_revenue": _q(_flat(_m3([]), M3_MONEY)),
    "m3_monthly_revenue_by_segment": _q(_flat(_m3(["segment"]), M3_MONEY)),
    "m4_invoice_features": _q(M4),
    "m5_customer_features": _q(M5),
    "m6_time_series_features": _q(_m6([])),
    "m6_time_series_features_by_segment": _q(_m6(["segment"])),
})


# ---------------------------------------------------------------------------
# Windows W1/W6 and metrics V1-V7 over deterministic stand-in scores
# ---------------------------------------------------------------------------

_CUT2 = repr(0.70 + 0.15)
_RULE = ("(flag_missing_payment + flag_underbilling + flag_duplicate_refund + flag_abnormal_discount"
         " + flag_payment_delay + LEAST(GREATEST(outstanding_ratio, 0.0), 1.0)) / 6.0")


def _clip(c: str) -> str:
    return f"LEAST(GREATEST(CAST({c} AS DOUBLE), 0.0), 1.0)"


FEAT = f", feat AS ({M4})\n"
SPLIT = f"""
, sp AS (SELECT *, row_number() OVER (ORDER BY issue_date, invoice_id) - 1 AS i,
                COUNT(*) OVER () AS n FROM feat)
, test AS (SELECT * FROM sp WHERE i >= floor(n * {_CUT2}))
, long AS (
  SELECT invoice_id, 'rule_blend' AS model_name, leakage_label AS label, {_RULE} AS score FROM test
  UNION ALL SELECT invoice_id, 'outstanding_ratio', leakage_label, {_clip("outstanding_ratio")} FROM test
  UNION ALL SELECT invoice_id, 'failed_payment_rate', leakage_label, {_clip("failed_payment_rate")} FROM test
  UNION ALL SELECT invoice_id, 'discount_ratio', leakage_label, {_clip("discount_ratio")} FROM test)
"""


def _eval(src: str) -> str:
    return f"""
, conf AS (
  SELECT model_name, COUNT(*) AS n_samples,
         COUNT(*) FILTER (WHERE label = 1) AS n_positive,
         COUNT(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp,
         COUNT(*) FILTER (WHERE label <> 1 AND score >= 0.5) AS fp,
         COUNT(*) FILTER (WHERE label <> 1 AND score < 0.5) AS tn,
         COUNT(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn
  FROM {src} GROUP BY model_name)
, g AS (SELECT model_name, score,
               CAST(COUNT(*) FILTER (WHERE label = 1) AS DOUBLE) AS pos,
               CAST(COUNT(*) FILTER (WHERE label <> 1) AS DOUBLE) AS neg
        FROM {src} GROUP BY model_name, score)
, c AS (SELECT *,
          SUM(pos) OVER (PARTITION BY model_name ORDER BY score DESC
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_,
          SUM(neg) OVER (PARTITION BY model_name ORDER BY score DESC
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp_,
          SUM(pos) OVER (PARTITION BY model_name) AS P,
          SUM(neg) OVER (PARTITION BY model_name) AS N
        FROM g)
, rk AS (SELECT model_name,
           SUM(pos * ((N - fp_) + neg / 2)) / (MAX(P) * MAX(N)) AS roc_auc,
           SUM(pos * tp_ / (tp_ + fp_)) / MAX(P) AS pr_auc,
           FIRST(score ORDER BY tp_ / P - fp_ / N DESC, score DESC) AS optimal_threshold,
           MAX(tp_ / P - fp_ / N) AS youden_j
         FROM c GROUP BY model_name)
SELECT conf.*, CAST(n_positive AS DOUBLE) / n_samples * 100 AS leakage_rate_pct,
       CAST(tp + tn AS DOUBLE) / n_samples AS accuracy,
       COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0) AS precision,
       COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS recall,
       COALESCE(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS f1_score,
       rk.roc_auc, rk.pr_auc, rk.optimal_threshold, rk.youden_j
FROM conf JOIN rk USING (model_name)"""


V5 = """
, conf AS (
  SELECT model_name,
         CAST(COUNT(*) FILTER (WHERE label = 1 AND score >= 0.5) AS DOUBLE) AS tp,
         CAST(COUNT(*) FILTER (WHERE label <> 1 AND score >= 0.5) AS DOUBLE) AS fp,
         CAST(COUNT(*) FILTER (WHERE label <> 1 AND score < 0.5) AS DOUBLE) AS tn,
         CAST(COUNT(*) FILTER (WHERE label = 1 AND score < 0.5) AS DOUBLE) AS fn
  FROM long GROUP BY model_name)
, pr AS (SELECT model_name, tp + fn AS s1, tn + fp AS s0,
           COALESCE(tp / NULLIF(tp + fp, 0), 0) AS p1, COALESCE(tp / NULLIF(tp + fn, 0), 0) AS r1,
           COALESCE(tn / NULLIF(tn + fn, 0), 0) AS p0, COALESCE(tn / NULLIF(tn + fp, 0), 0) AS r0
         FROM conf)
, f AS (SELECT *, COALESCE(2 * p1 * r1 / NULLIF(p1 + r1, 0), 0) AS f1,
                  COALESCE(2 * p0 * r0 / NULLIF(p0 + r0, 0), 0) AS f0 FROM pr)
SELECT model_name, '0' AS cls, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
UNION ALL SELECT model_name, '1', p1, r1, f1, s1 FROM f
UNION ALL SELECT model_name, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM f
UNION ALL SELECT model_name, 'weighted avg',
       COALESCE((p0 * s0 + p1 * s1) / NULLIF(s0 + s1, 0), 0),
       COALESCE((r0 * s0 + r1 * s1) / NULLIF(s0 + s1, 0), 0),
       COALESCE((f0 * s0 + f1 * s1) / NULLIF(s0 + s1, 0), 0), s0 + s1 FROM f"""

V6 = """
, rb AS (SELECT invoice_id, label, -score AS if_score FROM long WHERE model_name = 'rule_blend')
, mm AS (SELECT MIN(-if_score) AS lo, MAX(-if_score) AS hi FROM rb)
, prox AS (SELECT 'rule_blend_proxy' AS model_name, label,
                  (-if_score - lo) / (hi - lo + 1e-9) AS score FROM rb, mm)
"""

W6 = f"""
, sp AS (SELECT *, row_number() OVER (ORDER BY issue_date, invoice_id) - 1 AS i,
                COUNT(*) OVER () AS n FROM feat)
SELECT CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * {_CUT2}) THEN 'val'
            ELSE 'test' END AS split,
       COUNT(*) AS rows, MIN(issue_date) AS min_date, MAX(issue_date) AS max_date
FROM sp GROUP BY 1"""

ORACLE.update({
    "w6_time_split_summary": _q(FEAT + W6),
    "w1_percent_rank": _q(FEAT + f"""
SELECT invoice_id, {_RULE} AS score,
       PERCENT_RANK() OVER (ORDER BY {_RULE}) * 100 AS rank_percentile FROM feat"""),
    "w1_percent_rank_by_billing": _q(FEAT + f"""
SELECT invoice_id, is_annual_billing, {_RULE} AS score,
       PERCENT_RANK() OVER (PARTITION BY is_annual_billing ORDER BY {_RULE}) * 100 AS rank_percentile
FROM feat"""),
    "v7_model_comparison": _q(FEAT + SPLIT + _eval("long")),
    "v5_class_report": _q(FEAT + SPLIT + V5),
    "v6_anomaly_proxy_eval": _q(FEAT + SPLIT + V6 + _eval("prox")),
    "a14_class_balance": _q(FEAT + """
SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE leakage_label = 1) AS n_pos,
       AVG(CAST(leakage_label AS DOUBLE)) AS positive_rate,
       CAST(COUNT(*) - COUNT(*) FILTER (WHERE leakage_label = 1) AS DOUBLE)
         / COUNT(*) FILTER (WHERE leakage_label = 1) AS neg_pos_ratio FROM feat"""),
})


# ---------------------------------------------------------------------------
# Serving queries D1-D13, E1-E7 over the stand-in score tables
# ---------------------------------------------------------------------------

_TOPF = ["failed_payment_rate", "overdue_days", "contract_gap", "refund_ratio", "discount_ratio",
         "outstanding_ratio", "billed_vs_expected_ratio", "duplicate_refund_count",
         "payment_delay_ratio", "retry_rate"]
_V0_TS = "TIMESTAMP '2001-07-03 00:00:00'"
_V1_TS = "TIMESTAMP '2001-08-02 00:00:00'"
_ALERTS_DEC = ALL_ALERTS  # leakage as double; sums compared after rounding

SCORES = f"""
, rs AS (
  SELECT customer_id, invoice_id, 'rule_blend' AS model_name, 'v1' AS model_version,
         {_RULE} AS p, {_V1_TS} AS scored_at FROM feat
  UNION ALL
  SELECT customer_id, invoice_id, 'rule_blend', 'v0', {_clip("outstanding_ratio")}, {_V0_TS} FROM feat)
, risk AS (
  SELECT customer_id, invoice_id, model_name, model_version, scored_at, p AS leakage_probability,
         CASE WHEN p >= 0.8 THEN 'critical' WHEN p >= 0.6 THEN 'high' WHEN p >= 0.4 THEN 'medium'
              ELSE 'low' END AS risk_severity,
         PERCENT_RANK() OVER (PARTITION BY model_name, model_version ORDER BY p) * 100 AS rank_percentile
  FROM rs)
, an0 AS (SELECT customer_id, invoice_id, 'v1' AS model_version, 0.3 - {_RULE} AS score,
                 0.3 - {_RULE} < 0 AS is_anomaly, {_V1_TS} AS scored_at FROM feat)
, anom AS (SELECT an0.*, (-score - lo) / (hi - lo + 1e-9) AS if_prob_proxy
           FROM an0, (SELECT MIN(-score) AS lo, MAX(-score) AS hi FROM an0) mm)
, tfl AS (
  SELECT invoice_id, name,
         ROW_NUMBER() OVER (PARTITION BY invoice_id ORDER BY ABS(v) DESC, idx) AS r
  FROM (SELECT invoice_id, {", ".join(_TOPF)} FROM feat)
       UNPIVOT (v FOR name IN ({", ".join(_TOPF)})) u
  JOIN (VALUES {", ".join(f"('{n}', {i})" for i, n in enumerate(_TOPF))}) AS o(oname, idx)
    ON o.oname = u.name)
, tf AS (SELECT invoice_id, {", ".join(f"MAX(CASE WHEN r = {k} THEN name END) AS top_feature_{k}"
                                        for k in range(1, 6))}
         FROM tfl GROUP BY invoice_id)
, alerts AS ({ALL_ALERTS})
"""


def _top_risk(limit: int, sev: str, nfeat: int, status: bool) -> str:
    feats = ", ".join(f"tf.top_feature_{k}" for k in range(1, nfeat + 1))
    st = ", i.status AS invoice_status" if status else ""
    return f"""
SELECT r.invoice_id, i.invoice_number, c.name AS customer_name, c.segment AS customer_segment,
       r.leakage_probability, r.risk_severity, r.rank_percentile, {feats},
       CAST(i.total_amount AS DOUBLE) AS invoice_amount{st}, r.model_version
FROM (SELECT * FROM risk WHERE model_name = 'rule_blend' {sev}
      ORDER BY leakage_probability DESC, invoice_id, model_version LIMIT {limit}) r
JOIN customers c ON c.customer_id = r.customer_id
LEFT JOIN invoices i ON i.invoice_id = r.invoice_id
LEFT JOIN tf ON tf.invoice_id = r.invoice_id"""


D_PRE = FEAT + SCORES

D9_LIST = f"""
SELECT i.invoice_number, i.invoice_id, c.name AS customer_name, c.segment AS customer_segment,
       CAST(i.total_amount AS DOUBLE) AS total_amount,
       CAST(i.outstanding_amount AS DOUBLE) AS outstanding_amount,
       CAST(i.due_date AS VARCHAR) AS due_date, i.status,
       CAST(CASE WHEN i.due_date < {AS_OF_SQL} THEN GREATEST(date_diff('day', i.due_date, {AS_OF_SQL}), 0)
            ELSE 0 END AS INTEGER) AS days_overdue
FROM (SELECT * FROM invoices WHERE NOT is_deleted AND outstanding_amount > 0
      ORDER BY outstanding_amount DESC, invoice_id LIMIT 100) i
JOIN customers c ON c.customer_id = i.customer_id"""

D10_LIST = f"""
SELECT i.invoice_id, i.invoice_number, c.name AS customer_name, c.segment,
       CAST(i.total_amount AS DOUBLE) AS total_amount,
       CAST(i.outstanding_amount AS DOUBLE) AS outstanding_amount,
       CAST(i.due_date AS VARCHAR) AS due_date,
       CAST(date_diff('day', i.due_date, {AS_OF_SQL}) AS INTEGER) AS days_overdue
FROM invoices i JOIN customers c ON c.customer_id = i.customer_id
WHERE NOT i.is_deleted AND i.status = 'overdue'
ORDER BY days_overdue DESC, i.invoice_id LIMIT 200"""

D13_LIST = """
SELECT r.refund_number, c.name AS customer_name, c.segment AS customer_segment, i.invoice_number,
       CAST(r.amount AS DOUBLE) AS amount, r.reason, r.status,
       strftime(r.requested_at, '%Y-%m-%d %H:%M') AS requested_at,
       strftime(r.processed_at, '%Y-%m-%d %H:%M') AS processed_at
FROM refunds r JOIN customers c ON c.customer_id = r.customer_id
LEFT JOIN invoices i ON i.invoice_id = r.invoice_id
WHERE r.is_duplicate"""

ORACLE.update({
    "f21_top_invoice_features": _q(D_PRE + """
SELECT f.invoice_id, tf.top_feature_1, tf.top_feature_2, tf.top_feature_3, tf.top_feature_4,
       tf.top_feature_5 FROM feat f LEFT JOIN tf USING (invoice_id)"""),
    "w5_latest_risk_per_invoice": _q(D_PRE + """
SELECT invoice_id, model_version, leakage_probability, risk_severity,
       CAST(scored_at AS VARCHAR) AS scored_at
FROM risk QUALIFY ROW_NUMBER() OVER (PARTITION BY invoice_id
                                     ORDER BY scored_at DESC, model_version DESC) = 1"""),
    "d1_kpis": _q(D_PRE + """
SELECT CAST(i.total_invoiced AS DOUBLE) AS total_invoiced,
       CAST(i.total_collected AS DOUBLE) AS total_collected,
       CAST(i.total_outstanding AS DOUBLE) AS total_outstanding,
       CAST(i.total_discounted AS DOUBLE) AS total_discounted, i.overdue_invoices,
       rk.high_risk_invoices, an.anomalies_detected, d.duplicate_refunds,
       CAST(d.duplicate_refund_amount AS DOUBLE) AS duplicate_refund_amount,
       cu.customers_total, cu.customers_active, cu.customers_churned,
       COALESCE(CAST(i.total_collected AS DOUBLE) * 100 / NULLIF(CAST(i.total_invoiced AS DOUBLE), 0), 0)
         AS collection_rate_pct,
       COALESCE(CAST(cu.customers_churned AS DOUBLE) * 100 / NULLIF(cu.customers_total, 0), 0)
         AS churn_rate_pct
FROM (SELECT SUM(total_amount) AS total_invoiced, SUM(paid_amount) AS total_collected,
             SUM(outstanding_amount) AS total_outstanding, SUM(discount_amount) AS total_discounted,
             COUNT(*) FILTER (WHERE status = 'overdue') AS overdue_invoices
      FROM invoices WHERE NOT is_deleted) i,
     (SELECT COUNT(*) FILTER (WHERE risk_severity IN ('high', 'critical')
                              AND model_name = 'rule_blend') AS high_risk_invoices FROM risk) rk,
     (SELECT COUNT(*) FILTER (WHERE is_anomaly) AS anomalies_detected FROM anom) an,
     (SELECT COUNT(*) AS duplicate_refunds, COALESCE(SUM(amount), 0) AS duplicate_refund_amount
      FROM refunds WHERE is_duplicate) d,
     (SELECT COUNT(*) AS customers_total,
             COUNT(*) FILTER (WHERE status = 'active') AS customers_active,
             COUNT(*) FILTER (WHERE status = 'churned') AS customers_churned
      FROM customers WHERE NOT is_deleted) cu"""),
    "d2_revenue_trend_actuals": _q("""
SELECT strftime(issue_date, '%Y-%m') AS month, CAST(SUM(total_amount) AS DOUBLE) AS invoiced,
       CAST(SUM(paid_amount) AS DOUBLE) AS collected
FROM invoices WHERE NOT is_deleted GROUP BY 1"""),
    "d3_top_risks": _q(D_PRE + _top_risk(15, "", 3, True)),
    "d4_risk_distribution": _q(D_PRE + """
SELECT risk_severity, COUNT(*) AS count FROM risk WHERE model_name = 'rule_blend' GROUP BY 1"""),
    "d5_leakage_by_rule": _q(D_PRE + """
SELECT rule_code, severity, COUNT(*) AS count, SUM(leakage_amount) AS total_amount,
       COUNT(*) AS unresolved FROM alerts GROUP BY rule_code, severity"""),
    "d6_anomaly_timeline": _q(D_PRE + """
SELECT strftime(scored_at, '%Y-%m') AS month, COUNT(*) AS total_scored,
       CAST(SUM(CASE WHEN is_anomaly THEN 1 ELSE 0 END) AS BIGINT) AS anomalies FROM anom GROUP BY 1"""),
    "d7_invoice_detail": _q(D_PRE + """
SELECT i.invoice_id, i.customer_id, i.invoice_number, i.status,
       CAST(i.issue_date AS VARCHAR) AS issue_date, CAST(i.due_date AS VARCHAR) AS due_date,
       CAST(i.total_amount AS DOUBLE) AS total_amount, CAST(i.paid_amount AS DOUBLE) AS paid_amount,
       CAST(i.outstanding_amount AS DOUBLE) AS outstanding_amount,
       CAST(i.discount_amount AS DOUBLE) AS discount_amount,
       c.name AS customer_name, c.segment AS customer_segment, c.status AS customer_status,
       lr.leakage_probability, lr.risk_severity, lr.rank_percentile,
       la.score AS anomaly_score, la.is_anomaly, la.if_prob_proxy,
       COALESCE(ag.alert_count, 0) AS alert_count, ag.alert_leakage, lr.leakage_probability AS risk_snapshot_prob,
       CASE WHEN lr.invoice_id IS NOT NULL THEN concat_ws(',', top_feature_1, top_feature_2, top_feature_3, top_feature_4,
                                                          top_feature_5) END AS risk_top,
       CASE WHEN la.invoice_id IS NOT NULL THEN concat_ws(',', top_feature_1, top_feature_2, top_feature_3, top_feature_4,
                                                          top_feature_5) END AS anomaly_top
FROM invoices i
LEFT JOIN customers c ON c.customer_id = i.customer_id
LEFT JOIN tf ON tf.invoice_id = i.invoice_id
LEFT JOIN (SELECT * FROM risk WHERE model_name = 'rule_blend'
           QUALIFY ROW_NUMBER() OVER (PARTITION BY invoice_id
                                      ORDER BY scored_at DESC, model_version DESC) = 1) lr
  ON lr.invoice_id = i.invoice_id
LEFT JOIN (SELECT * FROM anom QUALIFY ROW_NUMBER() OVER (PARTITION BY invoice_id
                                      ORDER BY scored_at DESC, model_version DESC) = 1) la
  ON la.invoice_id = i.invoice_id
LEFT JOIN (SELECT invoice_id, COUNT(*) AS alert_count, SUM(leakage_amount) AS alert_leakage
           FROM alerts GROUP BY invoice_id) ag ON ag.invoice_id = i.invoice_id"""),
    "d8_revenue_breakdown": _q("""
SELECT month, invoice_count, CAST(invoiced AS DOUBLE) AS invoiced,
       CAST(collected AS DOUBLE) AS collected, CAST(outstanding AS DOUBLE) AS outstanding,
       COALESCE(CAST(collected AS DOUBLE) * 100 / NULLIF(CAST(invoiced AS DOUBLE), 0), 0) AS collection_rate
FROM (SELECT strftime(issue_date, '%Y-%m') AS month, COUNT(*) AS invoice_count,
             SUM(total_amount) AS invoiced, SUM(paid_amount) AS collected,
             SUM(outstanding_amount) AS outstanding
      FROM invoices WHERE NOT is_deleted GROUP BY 1) m"""),
    "d9_outstanding_invoices": _q(D9_LIST),
    "d9_outstanding_total": _q("""
SELECT CAST(COALESCE(SUM(outstanding_amount), 0) AS DOUBLE) AS total_outstanding, COUNT(*) AS count
FROM invoices WHERE NOT is_deleted AND outstanding_amount > 0"""),
    "d10_overdue_invoices": _q(D10_LIST),
    "d10_overdue_total": _q("""
SELECT CAST(COALESCE(SUM(outstanding_amount), 0) AS DOUBLE) AS total_overdue_amount, COUNT(*) AS count
FROM invoices WHERE NOT is_deleted AND status = 'overdue'"""),
    "d11_high_risk_top": _q(D_PRE + _top_risk(100, "AND risk_severity IN ('critical', 'high')", 2, False)),
    "d12_anomaly_totals": _q(D_PRE + """
SELECT COUNT(*) FILTER (WHERE is_anomaly) AS total_anomalies, COUNT(*) AS total_scored,
       COALESCE(CAST(COUNT(*) FILTER (WHERE is_anomaly) AS DOUBLE) * 100 / NULLIF(COUNT(*), 0), 0)
         AS anomaly_rate_pct FROM anom"""),
    "d12_top_anomalies": _q(D_PRE + """
SELECT a.invoice_id, i.invoice_number, c.name AS customer_name, c.segment AS customer_segment,
       a.score AS if_score, COALESCE(a.if_prob_proxy, 0) AS if_prob_proxy,
       tf.top_feature_1, tf.top_feature_2, tf.top_feature_3,
       CAST(i.total_amount AS DOUBLE) AS invoice_amount
FROM (SELECT * FROM anom WHERE is_anomaly ORDER BY score, invoice_id LIMIT 100) a
LEFT JOIN customers c ON c.customer_id = a.customer_id
LEFT JOIN invoices i ON i.invoice_id = a.invoice_id
LEFT JOIN tf ON tf.invoice_id = a.invoice_id"""),
    "d13_duplicate_refunds": _q(D13_LIST),
    "d13_duplicate_refund_total": _q(f"""
SELECT COALESCE(SUM(amount), 0) AS total_amount, COUNT(*) AS count FROM ({D13_LIST}) t"""),
    "e1_customers_page": _q("""
SELECT customer_id, external_id, name, segment, status, nation_key,
       CAST(acquisition_date AS VARCHAR) AS acquisition_date, CAST(churn_date AS VARCHAR) AS churn_date,
       risk_tier, CAST(credit_limit AS DOUBLE) AS credit_limit
FROM customers
WHERE NOT is_deleted AND segment = 'enterprise'
  AND (lower(name) LIKE '%customer#00000%' OR lower(external_id) LIKE '%customer#00000%')
ORDER BY acquisition_date DESC, customer_id LIMIT 50 OFFSET 50"""),
    "e1_customers_count": _q("""
SELECT COUNT(*) AS count FROM customers
WHERE NOT is_deleted AND segment = 'enterprise'
  AND (lower(name) LIKE '%customer#00000%' OR lower(external_id) LIKE '%customer#00000%')"""),
    "e1_customer_rollup": _q(D_PRE + """
SELECT c.customer_id, c.name, c.segment, COALESCE(a.total_invoices, 0) AS total_invoices,
       CAST(COALESCE(a.total_invoiced, 0) AS DOUBLE) AS total_invoiced,
       CAST(COALESCE(a.total_paid, 0) AS DOUBLE) AS total_paid,
       lr.leakage_probability, lr.risk_severity
FROM customers c
LEFT JOIN (SELECT customer_id, COUNT(*) AS total_invoices, SUM(total_amount) AS total_invoiced,
                  SUM(paid_amount) AS total_paid FROM invoices WHERE NOT is_deleted
           GROUP BY customer_id) a ON a.customer_id = c.customer_id
LEFT JOIN (SELECT * FROM risk QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id
                                       ORDER BY scored_at DESC, invoice_id DESC) = 1) lr
  ON lr.customer_id = c.customer_id
WHERE NOT c.is_deleted"""),
    "e2_invoices_seek_page": _q("""
SELECT i.invoice_id, i.invoice_number, i.customer_id, c.name AS customer_name, c.segment AS customer_segment, i.status,
       CAST(i.issue_date AS VARCHAR) AS issue_date, CAST(i.due_date AS VARCHAR) AS due_date,
       CAST(i.total_amount AS DOUBLE) AS total_amount, CAST(i.paid_amount AS DOUBLE) AS paid_amount,
       CAST(i.outstanding_amount AS DOUBLE) AS outstanding_amount
FROM invoices i JOIN customers c ON c.customer_id = i.customer_id
WHERE NOT i.is_deleted ORDER BY i.total_amount DESC, i.invoice_id LIMIT 50 OFFSET 100"""),
    "e2_invoices_page": _q(D_PRE + """
SELECT i.invoice_id, i.invoice_number, i.customer_id, c.name AS customer_name,
       c.segment AS customer_segment, i.status, CAST(i.issue_date AS VARCHAR) AS issue_date,
       CAST(i.due_date AS VARCHAR) AS due_date, CAST(i.total_amount AS DOUBLE) AS total_amount,
       CAST(i.paid_amount AS DOUBLE) AS paid_amount,
       CAST(i.outstanding_amount AS DOUBLE) AS outstanding_amount,
       lr.leakage_probability AS risk_probability,
       'Flagged due to: ' || replace(tf.top_feature_1, '_', ' ') || ', '
         || replace(tf.top_feature_2, '_', ' ') || ', ' || replace(tf.top_feature_3, '_', ' ') AS explanation
FROM invoices i JOIN customers c ON c.customer_id = i.customer_id
LEFT JOIN (SELECT * FROM risk QUALIFY ROW_NUMBER() OVER (PARTITION BY invoice_id
                                       ORDER BY scored_at DESC, model_version DESC) = 1) lr
  ON lr.invoice_id = i.invoice_id
LEFT JOIN tf ON tf.invoice_id = i.invoice_id
WHERE NOT i.is_deleted AND i.status = 'overdue'
ORDER BY i.total_amount DESC, i.invoice_id LIMIT 50"""),
    "e3_alerts_page": _q(D_PRE + """
SELECT a.*, c.name AS customer_name, false AS is_resolved
FROM alerts a LEFT JOIN customers c ON c.customer_id = a.customer_id
WHERE a.rule_code = 'UNDERBILLING' AND a.severity = 'high'
ORDER BY a.leakage_amount DESC, a.source_ref LIMIT 50 OFFSET 100"""),
    "e5_risk_page": _q(D_PRE + """
SELECT r.customer_id, r.invoice_id, r.model_name, r.model_version, r.leakage_probability,
       r.risk_severity, CAST(r.scored_at AS VARCHAR) AS scored_at, '2001-08' AS period_month,
       r.rank_percentile, c.name AS customer_name
FROM risk r LEFT JOIN customers c ON c.customer_id = r.customer_id
WHERE r.risk_severity = 'medium' AND r.model_version = 'v1' AND lower(c.name) LIKE '%customer#%'
ORDER BY r.leakage_probability DESC, r.invoice_id LIMIT 50"""),
    "e6_anomaly_page": _q(D_PRE + """
SELECT a.customer_id, a.invoice_id, a.model_version, a.score, a.is_anomaly,
       CAST(0 AS DOUBLE) AS threshold_used, CAST(a.scored_at AS VARCHAR) AS scored_at,
       '2001-08' AS period_month, a.if_prob_proxy, c.name AS customer_name
FROM anom a LEFT JOIN customers c ON c.customer_id = a.customer_id
WHERE a.is_anomaly ORDER BY a.score, a.invoice_id LIMIT 50 OFFSET 150"""),
})


# ---------------------------------------------------------------------------
# Forecasting T1-T8 with the closed-form trend fit
# ---------------------------------------------------------------------------

def _series(by: list[str]) -> str:
    keys = "".join(f"{k}, " for k in by)
    sk = ", ".join(["metric"] + [f"CAST({k} AS VARCHAR)" for k in by])
    return f"""
, m3 AS ({_m3(by)})
, sf AS (
  SELECT {keys}'revenue' AS metric, CAST(period_month || '-01' AS DATE) AS ds,
         COALESCE(CAST(total_invoiced AS DOUBLE), 0.0) AS y FROM m3
  UNION ALL
  SELECT {keys}'collections' AS metric, CAST(period_month || '-01' AS DATE) AS ds,
         COALESCE(CAST(total_collected AS DOUBLE), 0.0) AS y FROM m3)
, s AS (SELECT concat_ws('|', {sk}) AS series_key, *, year(ds) * 12 + month(ds) - 1 AS t FROM sf)
"""


BACKTEST = """
, s2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_key ORDER BY ds DESC) <= 6 AS held_out FROM s)
, fit AS (SELECT series_key, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept
          FROM s2 WHERE NOT held_out GROUP BY series_key)
, sig AS (SELECT s2.series_key, COALESCE(stddev_samp(y - (intercept + slope * t)), 0) AS sigma
          FROM s2 JOIN fit USING (series_key) WHERE NOT held_out GROUP BY s2.series_key)
, span AS (SELECT series_key, metric, MIN(ds) AS first, MAX(ds) AS last FROM s GROUP BY series_key, metric)
, fut AS (SELECT series_key, metric,
                 CAST(unnest(generate_series(first, last + INTERVAL 6 MONTH, INTERVAL 1 MONTH)) AS DATE) AS ds
          FROM span)
, pred AS (SELECT f.series_key, f.metric, f.ds,
                  intercept + slope * (year(f.ds) * 12 + month(f.ds) - 1) AS yhat, sigma
           FROM fut f JOIN fit USING (series_key) JOIN sig USING (series_key))
, bt AS (
  SELECT p.series_key, p.metric, p.ds, yhat, yhat - 1.645 * sigma AS yhat_lower,
         yhat + 1.645 * sigma AS yhat_upper, a.y AS actual, a.held_out,
         strftime(p.ds, '%Y-%m') AS period_month,
         CASE WHEN a.y IS NOT NULL AND yhat <> 0 THEN (a.y - yhat) / abs(yhat) * 100 END AS deviation_pct
  FROM pred p LEFT JOIN s2 a ON a.series_key = p.series_key AND a.ds = p.ds)
, bt2 AS (SELECT *, COALESCE(abs(deviation_pct) > 15, false) AS is_anomalous FROM bt)
"""

CV = """
, span2 AS (SELECT series_key, MIN(t) AS t0, MAX(t) AS t1 FROM s GROUP BY series_key)
, cuts AS (SELECT series_key, unnest(generate_series(t1 - 6, t0 + 18, -3)) AS cutoff
           FROM span2 WHERE t1 - 6 >= t0 + 18)
, pts AS (SELECT s.*, c.cutoff FROM s JOIN cuts c USING (series_key))
, cfit AS (SELECT series_key, cutoff, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept
           FROM pts WHERE t <= cutoff GROUP BY series_key, cutoff)
, ev AS (SELECT p.series_key, p.t - p.cutoff AS h, y, intercept + slope * t AS yhat
         FROM pts p JOIN cfit USING (series_key, cutoff) WHERE t > p.cutoff AND t <= p.cutoff + 6)
, ph AS (SELECT series_key, h, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat)) AS mae,
                avg(CASE WHEN y <> 0 THEN abs(y - yhat) / abs(y) END) AS mape
         FROM ev GROUP BY series_key, h)
, cvm AS (SELECT series_key, avg(rmse) AS cv_rmse_mean, avg(mae) AS cv_mae_mean,
                 avg(mape) AS cv_mape_mean, COUNT(*) AS cv_horizons FROM ph GROUP BY series_key)
"""

_BT_OUT = """
SELECT series_key, metric, CAST(ds AS VARCHAR) AS ds, yhat, yhat_lower, yhat_upper, actual, held_out,
       period_month, deviation_pct, is_anomalous FROM bt2"""

ORACLE.update({
    "t1_series_frame": _q(_series([]) + """
SELECT series_key, metric, CAST(ds AS VARCHAR) AS ds, y, CAST(t AS INTEGER) AS t FROM s"""),
    "t4_trend_backtest": _q(_series([]) + BACKTEST + _BT_OUT),
    "t4_trend_backtest_by_segment": _q(_series(["segment"]) + BACKTEST + _BT_OUT),
    "t5_cross_validation_by_segment": _q(_series(["segment"]) + CV + "SELECT * FROM cvm"),
    "t7_forecast_summary": _q(_series([]) + BACKTEST + CV + """
SELECT b.series_key, b.metric, COUNT(actual) AS training_months,
       COALESCE(string_agg(period_month, ',' ORDER BY period_month) FILTER (WHERE is_anomalous), '')
         AS anomalous_months,
       COUNT(*) FILTER (WHERE is_anomalous) AS n_anomalous,
       avg(abs(actual - yhat)) AS backtest_mae,
       avg(CASE WHEN actual <> 0 THEN abs(actual - yhat) / abs(actual) END) AS backtest_mape,
       avg(CASE WHEN held_out THEN abs(actual - yhat) END) AS heldout_mae,
       avg(CASE WHEN held_out AND actual <> 0 THEN abs(actual - yhat) / abs(actual) END) AS heldout_mape,
       MAX(cvm.cv_rmse_mean) AS cv_rmse_mean, MAX(cvm.cv_mae_mean) AS cv_mae_mean,
       MAX(cvm.cv_mape_mean) AS cv_mape_mean, MAX(cvm.cv_horizons) AS cv_horizons
FROM bt2 b LEFT JOIN cvm USING (series_key) GROUP BY b.series_key, b.metric"""),
})


# ---------------------------------------------------------------------------
# Attribution X2-X4 on the fixed linear stand-in score
# ---------------------------------------------------------------------------

_LIN = ["flag_missing_payment", "flag_underbilling", "flag_duplicate_refund",
        "flag_abnormal_discount", "flag_payment_delay", "outstanding_ratio"]
_LABELS = {"outstanding_ratio": "outstanding balance ratio"}
LIN = FEAT + f"""
, mu AS (SELECT {", ".join(f"AVG(CAST({c} AS DOUBLE)) AS m_{c}" for c in _LIN)} FROM feat)
, lc AS (SELECT invoice_id, {", ".join(f"{1.0 / 6.0!r} * (CAST({c} AS DOUBLE) - m_{c}) AS c_{c}" for c in _LIN)}
         FROM feat, mu)
, lcl AS (SELECT invoice_id, name, v FROM lc UNPIVOT (v FOR name IN ({", ".join(f"c_{c}" for c in _LIN)})))
"""

ORACLE.update({
    "x2_linear_contributions": _q(LIN + "SELECT * FROM lc"),
    "x3_global_importance_linear": _q(LIN + """
SELECT feature,
       CASE feature WHEN 'outstanding_ratio' THEN 'outstanding balance ratio'
                    ELSE replace(feature, '_', ' ') END AS label,
       mean_abs_contribution,
       CAST(ROW_NUMBER() OVER (ORDER BY mean_abs_contribution DESC, feature) AS INTEGER) AS rank
FROM (SELECT substr(name, 3) AS feature, AVG(ABS(v)) AS mean_abs_contribution
      FROM lcl GROUP BY name) g"""),
    "x4_local_explanations_linear": _q(LIN + f"""
, r AS (SELECT invoice_id, substr(l.name, 3) AS n,
               ROW_NUMBER() OVER (PARTITION BY invoice_id ORDER BY ABS(v) DESC, o.idx) AS k
        FROM lcl l JOIN (VALUES {", ".join(f"('c_{c}', {i})" for i, c in enumerate(_LIN))}) AS o(nm, idx)
          ON o.nm = l.name)
SELECT invoice_id, MAX(CASE WHEN k = 1 THEN n END) AS top_feature_1,
       MAX(CASE WHEN k = 2 THEN n END) AS top_feature_2, MAX(CASE WHEN k = 3 THEN n END) AS top_feature_3
FROM r GROUP BY invoice_id"""),
})


# ---------------------------------------------------------------------------
# Constraint checks and idempotent-append keys
# ---------------------------------------------------------------------------

def _enum(t: str, c: str, vals: list[str]) -> str:
    v = ", ".join(f"'{x}'" for x in vals)
    return (f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
            f"COUNT(*) FILTER (WHERE {c} NOT IN ({v}) OR {c} IS NULL) AS violations FROM {t}")


def _dups(t: str, k: str) -> str:
    return (f"SELECT '{t}' AS table_name, '{k}' AS key, COUNT(*) AS duplicate_keys, "
            f"CAST(COALESCE(SUM(n), 0) AS BIGINT) AS duplicate_rows "
            f"FROM (SELECT {k}, COUNT(*) AS n FROM {t} GROUP BY {k} HAVING COUNT(*) > 1) d")


def _orph(c: str, fk: str, p: str, pk: str) -> str:
    return (f"SELECT '{c}.{fk}' AS relation, COUNT(*) AS orphans FROM {c} x "
            f"WHERE x.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{pk} = x.{fk})")


def _checks():
    from revguard.operators.checks import ALLOWED, FOREIGN_KEYS, UNIQUE_KEYS
    return {
        "qd1_enum_violations": _q(" UNION ALL ".join(_enum(t, c, v) for (t, c), v in ALLOWED.items())),
        "qd2_duplicate_keys": _q(" UNION ALL ".join(_dups(t, ",".join(k)) for t, k in UNIQUE_KEYS.items())),
        "qd3_orphan_keys": _q(" UNION ALL ".join(_orph(*r) for r in FOREIGN_KEYS)),
    }


ORACLE.update(_checks())
ORACLE.update({
    "s5_new_score_rows": _q(D_PRE + """
SELECT invoice_id, model_version, leakage_probability FROM risk r
WHERE NOT EXISTS (SELECT 1 FROM risk e WHERE e.model_version = 'v0'
                  AND e.invoice_id = r.invoice_id AND e.model_version = r.model_version)"""),
    "s6_new_forecast_rows": _q(_series([]) + BACKTEST + """
SELECT 'trend' AS model_name, 'v1' AS model_version, metric, period_month, deviation_pct, is_anomalous
FROM bt2 WHERE metric <> 'revenue'"""),
})


_FROWS = """
, frows AS (
  SELECT 'trend' AS model_name, 'v1' AS model_version, metric, series_key, period_month,
         CAST(ROUND(CAST(yhat AS DECIMAL(20,4)), 2) AS DOUBLE) AS forecasted_value,
         CAST(ROUND(CAST(actual AS DECIMAL(20,4)), 2) AS DOUBLE) AS actual_value,
         CAST(ROUND(CAST(yhat_lower AS DECIMAL(20,4)), 2) AS DOUBLE) AS lower_bound,
         CAST(ROUND(CAST(yhat_upper AS DECIMAL(20,4)), 2) AS DOUBLE) AS upper_bound,
         deviation_pct, is_anomalous, 15.0::DOUBLE AS anomaly_threshold_pct
  FROM bt2)
"""

ORACLE.update({
    "a15_feature_profile": _q(FEAT + """
SELECT feature, AVG(v) AS mean, stddev_samp(v) AS std, MIN(v) AS min, MAX(v) AS max
FROM (SELECT * FROM (SELECT """ + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in
      ["total_amount", "paid_amount", "outstanding_amount", "discount_amount", "tax_amount",
       "total_paid", "payment_count", "failed_payment_count", "max_days_late", "avg_days_late",
       "total_attempts", "refund_count", "refund_amount", "duplicate_refund_count",
       "mrr", "sub_discount_pct", "quantity", "payment_terms_days",
       "billed_vs_expected_ratio", "paid_vs_billed_ratio", "refund_ratio", "discount_ratio",
       "outstanding_ratio", "contract_gap", "overdue_days", "payment_delay_ratio",
       "failed_payment_rate", "retry_rate", "is_annual_billing", "mrr_log",
       "issue_month", "issue_quarter"]) + """ FROM feat) f
      UNPIVOT (v FOR feature IN (COLUMNS(*)))) u
GROUP BY feature"""),
    "d2_revenue_trend_forecasts": _q(_series([]) + BACKTEST + _FROWS + """
SELECT period_month, forecasted_value, lower_bound, upper_bound, is_anomalous, deviation_pct
FROM frows WHERE metric = 'revenue'"""),
    "e7_forecast_page": _q(_series([]) + BACKTEST + _FROWS + """
SELECT * FROM frows WHERE metric = 'collections' AND is_anomalous
ORDER BY deviation_pct DESC, period_month LIMIT 50"""),
})


# ---------------------------------------------------------------------------
# Model queries: what SQL can determine of each row of a fitted model's output
# ---------------------------------------------------------------------------
from revguard.operators import features as _features  # noqa: E402
from revguard.operators.explain import FEATURE_LABELS as _LABELS  # noqa: E402

_FEATURE_ROWS = ", ".join(f"('{c}', '{_LABELS.get(c, c.replace('_', ' '))}')" for c in _features.INVOICE_FEATURE_COLS)


def _money(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def _pct(x: str) -> str:
    return f"format('{{:.1f}}', round(({x}) * 100, 1)) || '%'"


ORACLE.update({
    "l9_model_comparison": _q(FEAT + SPLIT + """
SELECT m AS model_name, COUNT(*) AS n_samples, COUNT(*) FILTER (WHERE leakage_label = 1) AS n_positive,
       true AS metrics_in_range, true AS auc_high
FROM test CROSS JOIN (VALUES ('isolation_forest'), ('logistic_regression'), ('gbt'), ('ensemble')) t(m) GROUP BY m"""),
    "l11_risk_scores": _q(FEAT + """
SELECT customer_id, invoice_id, 'gbt' AS model_name, 'v1' AS model_version, true AS probability_in_range,
       true AS severity_agrees, true AS percentile_in_range, true AS has_attribution, true AS has_sentence FROM feat"""),
    "x1_tree_contributions": _q(FEAT + """
SELECT invoice_id, true AS adds_up, true AS gives_probability FROM feat"""),
    "x1_tree_global_importance": f"""
SELECT f AS feature, l AS label, true AS not_negative, true AS ranked FROM (VALUES {_FEATURE_ROWS}) t(f, l)""",
    "x5_attached_top_features": _q(D_PRE + LIN.replace(FEAT, "", 1) + f"""
, r AS (SELECT invoice_id, substr(l.name, 3) AS n,
               ROW_NUMBER() OVER (PARTITION BY invoice_id ORDER BY ABS(v) DESC, o.idx) AS k
        FROM lcl l JOIN (VALUES {", ".join(f"('c_{c}', {i})" for i, c in enumerate(_LIN))}) AS o(nm, idx)
          ON o.nm = l.name)
SELECT invoice_id, 'v1' AS model_version, MAX(CASE WHEN k = 1 THEN n END) AS top_feature_1,
       MAX(CASE WHEN k = 2 THEN n END) AS top_feature_2, MAX(CASE WHEN k = 3 THEN n END) AS top_feature_3,
       true AS explained
FROM r GROUP BY invoice_id
UNION ALL SELECT invoice_id, 'v0', top_feature_1, top_feature_2, top_feature_3, false FROM tf"""),
    "t2b_additive_backtest_by_segment": _q(_series(["segment"]) + BACKTEST + """
SELECT series_key, metric, period_month, actual, held_out, true AS band_ordered, true AS flag_agrees FROM bt2"""),
    "d7_invoice_alerts": _q(f""", alerts AS ({ALL_ALERTS})
SELECT a.invoice_id, a.rule_code, a.severity, CASE a.rule_code
    WHEN 'MISSING_PAYMENT' THEN 'Invoice ' || i.invoice_number || ' (' || {_money("i.total_amount")}
      || ') has no completed payment.'
    WHEN 'DUPLICATE_REFUND' THEN 'Duplicate refund detected: ' || r.refund_number || ' (' || {_money("r.amount")} || ').'
    WHEN 'ABNORMAL_DISCOUNT' THEN 'Invoice ' || i.invoice_number || ': discount ratio '
      || {_pct("CAST(i.discount_amount AS DOUBLE) / CAST(i.total_amount AS DOUBLE)")}
      || ' (' || {_money("i.discount_amount")} || ' on ' || {_money("i.total_amount")} || ').'
    WHEN 'UNDERBILLING' THEN 'Invoice ' || i.invoice_number || ': billed ' || {_money("i.total_amount")} || ' vs MRR '
      || {_money("s.mrr")} || ' (' || {_pct("CAST(i.total_amount AS DOUBLE) / CAST(s.mrr AS DOUBLE)")} || ').'
    WHEN 'PAYMENT_DELAY' THEN 'Invoice ' || i.invoice_number || ': payment received ' || p.days_late
      || ' days late (paid ' || CAST(p.payment_date AS VARCHAR) || ').'
    ELSE 'Invoice ' || i.invoice_number || ' is ' || date_diff('day', i.due_date, {AS_OF_SQL}) || ' days overdue (due '
      || CAST(i.due_date AS VARCHAR) || '). Outstanding: ' || {_money("i.outstanding_amount")} || '.' END AS description,
       a.leakage_amount, false AS is_resolved
FROM alerts a LEFT JOIN invoices i ON i.invoice_id = a.invoice_id
LEFT JOIN subscriptions s ON s.subscription_id = i.subscription_id
LEFT JOIN payments p ON a.rule_code = 'PAYMENT_DELAY' AND p.transaction_id = a.source_ref
LEFT JOIN refunds r ON a.rule_code = 'DUPLICATE_REFUND' AND r.refund_number = a.source_ref
WHERE a.invoice_id IS NOT NULL"""),
})

ORACLE["e3_alerts_search_page"] = f"""SELECT * FROM ({ORACLE["d7_invoice_alerts"]}) a
WHERE severity = 'critical' AND lower(description) LIKE '%days overdue%' ORDER BY leakage_amount DESC, invoice_id LIMIT 50 OFFSET 50"""
