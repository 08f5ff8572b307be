"""Rules over the course of time: runs of failed payments, months without invoice or revenue, contracts that do not fit.

They extend the seven reconciliation rules (``rules``) by the case types that need an order or a calendar:

* ``failed_payment_runs``   consecutive failed payments (gaps and islands);
* ``no_invoice_gaps``       months of a customer's active interval in which nothing was billed;
* ``zero_revenue_months``   months in which something was billed and nothing collected;
* ``contract_mismatches``   invoices that their contract does not cover;
* ``contract_succession``   every contract term with the next one of its customer: renewed, gap, overlap, last;
* ``missing_renewals``      terms that ended without a successor in time.

Scale: an order within customers is taken from one global order (range partitions, ``rank.prefix_sums`` and
``rank.row_index``), so a customer with a third of all payments or contracts is spread over many tasks; the customer x month
spine is generated per customer with ``sequence`` and joined by equality, never crossed and never broadcast (a planner takes
its size for that of the customers it was made from); windows run over the months of one customer only, which the calendar
bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revguard.functions import exprs as X
from revguard.operators import rank
from revguard.session import cut_lineage
from revguard.sources.billing import Billing

#: Months without invoice that are worth an alert, and from which it is high or critical.
MIN_GAP, HIGH_GAP, CRITICAL_GAP = 3, 6, 12
#: Days after the end of a term within which the next one counts as a renewal.
GRACE_DAYS = 30


def _live(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_deleted"))


def failed_payment_runs(b: Billing, *, min_run: int = 3, settled_status: str = "succeeded") -> DataFrame:
    """Runs of at least ``min_run`` failed payments of a customer without a settled one in between.

    Payments are taken in the order of date and transaction id, so a day with several is defined; pending payments neither
    count nor end a run, deleted ones and those without customer are left out.  The number of settled payments before a
    failed one, over all customers in one order, is the same within a run and differs between a customer's runs.
    """
    p = _live(b.payments).filter(F.col("status").isin("failed", settled_status) & F.col("customer_id").isNotNull()).select(
        "customer_id", "payment_date", "transaction_id", "amount", (F.col("status") == settled_status).cast("long").alias("settled"))
    runs = rank.prefix_sums(p, ["customer_id", "payment_date", "transaction_id"], ["settled"])
    g = runs.filter("settled = 0").groupBy("customer_id", "before_settled").agg(
        F.min("payment_date").alias("run_start"), F.max("payment_date").alias("run_end"),
        F.count(F.lit(1)).alias("fails"), F.sum("amount").alias("at_risk")).filter(F.col("fails") >= min_run)
    return g.select("customer_id", "run_start", "run_end", "fails", "at_risk",
                    X.banded("fails", [("critical", 10), ("high", 6)], "medium").alias("severity"))


def _month(d: Column) -> Column:
    """Months since year 0, so that neighbours differ by one."""
    return F.year(d) * 12 + F.month(d) - 1


def _month_start(m: Column) -> Column:
    return F.make_date((m / 12).cast("int"), (m % 12 + 1).cast("int"), F.lit(1))


def active_months(b: Billing) -> DataFrame:
    """(customer_id, mrr, m) for every whole month of a customer's active interval.

    Live customers with a live, active subscription, from the month of the earliest such subscription's start to the month
    before the one of churn or ``as_of``; ``mrr`` is the sum over these subscriptions.
    """
    subs = _live(b.subscriptions).filter(F.col("status") == "active").groupBy("customer_id").agg(
        F.min("start_date").alias("start"), F.sum("mrr").alias("mrr"))
    until = F.least(F.coalesce("churn_date", F.lit(b.as_of)), F.lit(b.as_of))
    j = _live(b.customers).select("customer_id", until.alias("until")).join(subs, "customer_id")
    j = j.withColumn("first", _month(F.col("start"))).withColumn("last", _month(F.col("until")) - 1).filter("first <= last")
    return j.select("customer_id", "mrr", F.explode(F.sequence("first", "last")).alias("m"))


def _billed_months(b: Billing) -> DataFrame:
    """(customer_id, m, invoices, billed, collected) of live invoices, settled payments summed per invoice first."""
    paid = b.payments.filter(F.col("status") == "succeeded").groupBy("invoice_id").agg(F.sum("amount").alias("paid"))
    inv = _live(b.invoices).select("invoice_id", "customer_id", _month(F.col("issue_date")).alias("m"), "total_amount")
    return inv.join(paid, "invoice_id", "left").groupBy("customer_id", "m").agg(
        F.count(F.lit(1)).alias("invoices"), F.sum("total_amount").alias("billed"), F.sum("paid").alias("collected"))


def no_invoice_gaps(b: Billing, *, min_months: int = MIN_GAP) -> DataFrame:
    """NO_INVOICE: runs of at least ``min_months`` active months without a live invoice, with the revenue they should have
    brought (``mrr`` per month)."""
    billed = _live(b.invoices).select("customer_id", _month(F.col("issue_date")).alias("m"))
    empty = active_months(b).join(billed, ["customer_id", "m"], "left_anti")
    at = F.row_number().over(Window.partitionBy("customer_id").orderBy("m"))  # months of one customer
    g = empty.withColumn("run", F.col("m") - at).groupBy("customer_id", "mrr", "run").agg(
        F.min("m").alias("first"), F.max("m").alias("last"), F.count(F.lit(1)).alias("months")).filter(F.col("months") >= min_months)
    return g.select("customer_id", F.lit("NO_INVOICE").alias("rule_code"),
                    _month_start(F.col("first")).alias("first_month"), _month_start(F.col("last")).alias("last_month"), "months",
                    (F.col("mrr") * F.col("months")).alias("expected_revenue"),
                    X.banded("months", [("critical", CRITICAL_GAP), ("high", HIGH_GAP)], "medium").alias("severity"))


def zero_revenue_months(b: Billing) -> DataFrame:
    """ZERO_REVENUE: active months with live invoices over a positive amount of which nothing was collected."""
    m = _billed_months(b).filter((F.col("billed") > 0) & (F.coalesce("collected", F.lit(0)) == 0))
    j = active_months(b).join(m.hint("merge"), ["customer_id", "m"])
    return j.select("customer_id", F.lit("ZERO_REVENUE").alias("rule_code"), _month_start(F.col("m")).alias("month"),
                    "invoices", "billed", F.when(F.col("billed") >= F.col("mrr"), "high").otherwise("medium").alias("severity"))


def contract_mismatches(b: Billing) -> DataFrame:
    """CONTRACT_MISMATCH: live invoices whose contract is unknown or deleted, another customer's, or not in force on the day
    of issue (both ends of a contract are in force); the first reason that holds is given."""
    c = b.contracts.select("contract_id", F.col("customer_id").alias("owner"), "start_date", "end_date",
                           F.col("is_deleted").alias("gone"))
    inv = _live(b.invoices).filter(F.col("contract_id").isNotNull()).select(
        "invoice_id", "customer_id", "contract_id", "issue_date", "total_amount")
    j = inv.join(c, "contract_id", "left")
    reason = (F.when(F.col("gone").isNull() | F.col("gone"), "no_contract")
              .when(~F.col("owner").eqNullSafe(F.col("customer_id")), "other_customer")
              .when(F.col("issue_date") < F.col("start_date"), "before_start")
              .when(F.col("issue_date") > F.col("end_date"), "after_end"))
    return j.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(
        "customer_id", "invoice_id", "contract_id", F.lit("CONTRACT_MISMATCH").alias("rule_code"), "reason", "total_amount",
        F.when(F.col("reason").isin("no_contract", "other_customer"), "high").otherwise("medium").alias("severity"))


def contract_succession(contracts: DataFrame) -> DataFrame:
    """Every live term with its customer's next one by start date (and contract_id).

    ``succession`` is ``overlap`` if the next term starts on or before the last day, ``renewed`` if it starts on the day
    after, ``gap`` if later, ``last`` if there is none; ``gap_days`` counts the days between the two (negative where they
    overlap).  Terms without customer, start or end are left out.
    """
    terms = _live(contracts).select("contract_id", "customer_id", "start_date", "end_date", "auto_renew").dropna(
        subset=["contract_id", "customer_id", "start_date", "end_date"])
    at = cut_lineage(rank.row_index(terms, ["customer_id", "start_date", "contract_id"], out="at"))
    after = at.select((F.col("at") - 1).alias("at"), F.col("customer_id").alias("_owner"),
                      F.col("contract_id").alias("next_contract_id"), F.col("start_date").alias("next_start"))
    j = at.join(after, (at["at"] == after["at"]) & (F.col("customer_id") == F.col("_owner")), "left").drop("at", "_owner")
    days = F.datediff("next_start", "end_date") - 1
    return j.withColumn("gap_days", days).withColumn("succession", F.when(F.col("next_start").isNull(), "last").when(
        F.col("gap_days") < 0, "overlap").when(F.col("gap_days") == 0, "renewed").otherwise("gap"))


def missing_renewals(contracts: DataFrame, as_of, *, grace_days: int = GRACE_DAYS) -> DataFrame:
    """Terms without auto-renewal that ended at least ``grace_days`` before ``as_of`` and had no successor by then."""
    late = (F.col("succession") == "last") | (F.col("gap_days") > grace_days)
    s = contract_succession(contracts).filter(~F.col("auto_renew") & late & (
        F.datediff(F.lit(as_of), F.col("end_date")) >= grace_days))
    open_days = F.coalesce(F.col("gap_days"), F.datediff(F.lit(as_of), F.col("end_date")))
    return s.select("customer_id", "contract_id", "end_date", "next_start", open_days.alias("open_days"),
                    X.banded(open_days, [("critical", 365), ("high", 90)], "medium").alias("severity"))
