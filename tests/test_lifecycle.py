"""Rules over time with hand-worked rows: run ends and ties, calendar bounds, renewal on the day, gap and overlap."""
import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from revguard.operators import lifecycle
from tests.conftest import SF0001

DAY = dt.date(2001, 1, 1)
NEVER = dt.date(1990, 1, 1)


def pay(n, status, day=0, **kw):
    return dict(transaction_id=f"T-{n:03}", status=status, payment_date=DAY + dt.timedelta(day), **kw)


def test_runs_end_at_settled_payments(make_billing):
    b = make_billing(payments=[
        pay(1, "failed", 0), pay(2, "failed", 1), pay(3, "pending", 1), pay(4, "failed", 2),        # a run of 3
        pay(5, "succeeded", 3), pay(6, "failed", 4), pay(7, "failed", 5),                            # 2 only
        pay(8, "succeeded", 6, is_deleted=True), pay(9, "failed", 7),                                # a deleted one ends nothing: 3
        pay(20, "failed", 0, customer_id=2), pay(21, "failed", 0, customer_id=2), pay(22, "succeeded", 0, customer_id=2),
        pay(23, "failed", 0, customer_id=2),                                                         # one day: by transaction
        pay(30, "failed", 0, customer_id=None), pay(31, "failed", 0, customer_id=None), pay(32, "failed", 0, customer_id=None)])
    got = sorted((r.customer_id, r.run_start, r.run_end, r.fails, r.at_risk, r.severity)
                 for r in lifecycle.failed_payment_runs(b).collect())
    assert got == [(1, DAY, DAY + dt.timedelta(2), 3, D("30.00"), "medium"),
                   (1, DAY + dt.timedelta(4), DAY + dt.timedelta(7), 3, D("30.00"), "medium")]


def test_runs_do_not_cross_customers_or_partitions(make_billing):
    rows = [pay(i, "failed", i % 50, customer_id=7) for i in range(300)] + [pay(900 + i, "failed", i, customer_id=8) for i in range(9)]
    got = {r.customer_id: (r.fails, r.severity) for r in lifecycle.failed_payment_runs(make_billing(payments=rows)).collect()}
    assert got == {7: (300, "critical"), 8: (9, "high")}


def test_no_invoice_gaps_and_zero_revenue(make_billing):
    b = make_billing(
        as_of=dt.date(2001, 8, 2), customers=[dict(), dict(customer_id=2, churn_date=dt.date(2001, 3, 31)),
                                              dict(customer_id=3, is_deleted=True), dict(customer_id=4)],
        subscriptions=[dict(start_date=dt.date(2000, 12, 31)), dict(subscription_id=2, customer_id=2),
                       dict(subscription_id=3, customer_id=3), dict(subscription_id=4, customer_id=4, status="cancelled")],
        invoices=[dict(invoice_id=1, issue_date=dt.date(2001, 1, 31)), dict(invoice_id=2, issue_date=dt.date(2001, 5, 1)),
                  dict(invoice_id=3, issue_date=dt.date(2001, 3, 1), is_deleted=True),
                  dict(invoice_id=4, issue_date=dt.date(2001, 7, 1), total_amount=D("0.00"))],
        payments=[dict(invoice_id=2), dict(invoice_id=1, status="failed")])
    gaps = [(r.customer_id, r.first_month, r.last_month, r.months, r.expected_revenue, r.severity)
            for r in lifecycle.no_invoice_gaps(b).collect()]
    # customer 1: February to April; June alone is short, August has not ended; customer 2 left in March: two months only
    assert gaps == [(1, dt.date(2001, 2, 1), dt.date(2001, 4, 1), 3, D("300.00"), "medium")]
    zero = [(r.customer_id, r.month, r.invoices, r.billed, r.severity) for r in lifecycle.zero_revenue_months(b).collect()]
    assert zero == [(1, dt.date(2001, 1, 1), 1, D("100.00"), "high")]


def test_spine_is_no_cross_join(spark):
    from revguard.plans.catalog import QUERIES
    for name in ("lc2_no_invoice_gaps", "lc3_zero_revenue_months"):
        plan = QUERIES[name](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_spine_is_no_broadcast(spark):
    """The months of all active customers are many times the rows that a planner expects of them."""
    from revguard.plans.catalog import QUERIES
    df = QUERIES["lc3_zero_revenue_months"](spark, SF0001)
    assert df.count() > 0
    on_month = [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line and ", m#" in line]
    assert on_month and not any("Broadcast" in line for line in on_month)


def test_contract_mismatch_reasons(make_billing):
    c = dict(start_date=dt.date(2001, 1, 1), end_date=dt.date(2001, 12, 31))
    on = lambda i, d, **kw: dict(invoice_id=i, issue_date=d, **kw)
    b = make_billing(contracts=[c, {**c, "contract_id": 2, "is_deleted": True}, {**c, "contract_id": 3, "customer_id": 9}],
                     invoices=[on(1, dt.date(2001, 1, 1)), on(2, dt.date(2001, 12, 31)), on(3, dt.date(2000, 12, 31)),
                               on(4, dt.date(2002, 1, 1)), on(5, DAY, contract_id=2), on(6, DAY, contract_id=3),
                               on(7, DAY, contract_id=77), on(8, DAY, contract_id=None), on(9, NEVER, is_deleted=True)])
    assert {r.invoice_id: r.reason for r in lifecycle.contract_mismatches(b).collect()} == {
        3: "before_start", 4: "after_end", 5: "no_contract", 6: "other_customer", 7: "no_contract"}


def terms(spark, rows):
    return spark.createDataFrame([(i, c, s, e, False, False) for i, c, s, e in rows],
                                 "contract_id long, customer_id long, start_date date, end_date date, auto_renew boolean, is_deleted boolean")


def test_succession_boundaries(spark):
    d = lambda n: DAY + dt.timedelta(n)
    t = terms(spark, [(1, 1, d(0), d(10)), (2, 1, d(11), d(20)),    # renewed on the day after
                      (3, 1, d(20), d(30)),                          # starts on the last day: overlap
                      (4, 1, d(62), d(70)),                          # 31 days open
                      (5, 2, d(0), d(5)), (6, 2, d(0), d(9)),        # same start: by contract_id
                      (7, None, d(0), d(1)), (8, 3, d(0), None)])
    got = {r.contract_id: (r.next_contract_id, r.gap_days, r.succession) for r in lifecycle.contract_succession(t).collect()}
    assert got == {1: (2, 0, "renewed"), 2: (3, -1, "overlap"), 3: (4, 31, "gap"), 4: (None, None, "last"),
                   5: (6, -6, "overlap"), 6: (None, None, "last")}
    late = {r.contract_id: (r.open_days, r.severity) for r in lifecycle.missing_renewals(t, d(100)).collect()}
    assert late == {3: (31, "medium"), 4: (30, "medium"), 6: (91, "high")}
    none = lifecycle.missing_renewals(t.where(F.lit(False)), d(100))
    assert none.count() == 0
