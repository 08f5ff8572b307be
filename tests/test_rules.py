"""Rule boundaries with hand-worked rows (R1-R7) and the alert shape."""
import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from revguard.operators import rules

AS_OF = dt.date(2001, 8, 2)


def sev(df):
    return {r["invoice_id"] if r["invoice_id"] is not None else r["customer_id"]: r["severity"]
            for r in df.collect()}


def test_missing_payment_anti_join_and_severity(make_billing):
    b = make_billing(invoices=[
        dict(invoice_id=1, due_date=dt.date(2001, 8, 1)),                      # past due, unpaid
        dict(invoice_id=2, due_date=dt.date(2001, 8, 2)),                      # due today -> medium
        dict(invoice_id=3, status="overdue", due_date=dt.date(2001, 1, 1)),    # settled below
        dict(invoice_id=4, status="paid"),                                     # wrong status
        dict(invoice_id=5, total_amount=D("0.00")),                            # not positive
        dict(invoice_id=6, is_deleted=True),                                   # deleted
        dict(invoice_id=7, outstanding_amount=D("0.00"), total_amount=D("70.00")),
    ], payments=[dict(invoice_id=3, status="succeeded"), dict(invoice_id=1, status="failed")])
    out = rules.missing_payment(b)
    assert sev(out) == {1: "high", 2: "medium", 7: "high"}
    amounts = {r["invoice_id"]: r["leakage_amount"] for r in out.collect()}
    assert amounts[7] == D("70.00") and amounts[1] == D("100.00")
    literal = rules.missing_payment(b, settled_status="completed")
    assert {r["invoice_id"] for r in literal.collect()} == {1, 2, 3, 7}


def test_abnormal_discount_bands(make_billing):
    rows = [dict(invoice_id=i, total_amount=D("100.00"), discount_amount=D(d))
            for i, d in [(1, "35.00"), (2, "35.01"), (3, "45.00"), (4, "45.01"), (5, "60.00"), (6, "60.01")]]
    out = rules.abnormal_discount(make_billing(invoices=rows))
    assert sev(out) == {2: "medium", 3: "medium", 4: "high", 5: "high", 6: "critical"}


def test_underbilling_bands(make_billing):
    inv = [dict(invoice_id=i, subscription_id=1, total_amount=D(t))
           for i, t in [(1, "85.00"), (2, "84.99"), (3, "70.00"), (4, "69.99"), (5, "50.00"), (6, "49.99"),
                        (7, "0.00")]]
    out = rules.underbilling(make_billing(invoices=inv, subscriptions=[dict(mrr=D("100.00"))]))
    assert sev(out) == {2: "medium", 3: "medium", 4: "high", 5: "high", 6: "critical"}
    assert {r["invoice_id"]: r["leakage_amount"] for r in out.collect()}[6] == D("50.01")


def test_payment_delay_bands(make_billing):
    pays = [dict(transaction_id=f"T{i}", invoice_id=i, is_late=True, days_late=d)
            for i, d in [(1, 29), (2, 30), (3, 89), (4, 90)]]
    pays.append(dict(transaction_id="T5", invoice_id=5, is_late=True, days_late=100, status="pending"))
    inv = [dict(invoice_id=i) for i in range(1, 6)]
    out = rules.payment_delay(make_billing(invoices=inv, payments=pays))
    assert sev(out) == {2: "medium", 3: "medium", 4: "high"}


def test_failed_streak_bands(make_billing):
    pays = []
    for cust, n in [(1, 2), (2, 3), (3, 5), (4, 6), (5, 9), (6, 10)]:
        pays += [dict(transaction_id=f"{cust}-{k}", customer_id=cust, status="failed", amount=D("1.50"))
                 for k in range(n)]
    pays.append(dict(transaction_id="del", customer_id=1, status="failed", is_deleted=True))
    out = rules.failed_payment_streak(make_billing(payments=pays))
    assert sev(out) == {2: "medium", 3: "medium", 4: "high", 5: "high", 6: "critical"}
    assert {r["customer_id"]: r["leakage_amount"] for r in out.collect()}[6] == D("15.00")
    assert all(r["invoice_id"] is None for r in out.collect())


def test_overdue_bands(make_billing):
    inv = [dict(invoice_id=i, status="overdue", due_date=AS_OF - dt.timedelta(days=d))
           for i, d in [(1, 0), (2, 1), (3, 29), (4, 30), (5, 89), (6, 90)]]
    out = rules.overdue_invoice(make_billing(invoices=inv))
    assert sev(out) == {2: "medium", 3: "medium", 4: "high", 5: "high", 6: "critical"}
    assert {r["rule_code"] for r in out.collect()} == {"MISSING_RENEWAL"}


def test_duplicate_refund_includes_deleted(make_billing):
    out = rules.duplicate_refund(make_billing(refunds=[
        dict(refund_number="A", is_duplicate=True, is_deleted=True),
        dict(refund_number="B", is_duplicate=False)]))
    assert [r["source_ref"] for r in out.collect()] == ["A"]


def test_run_rules_shape_and_summary(make_billing):
    b = make_billing(invoices=[dict(invoice_id=1, due_date=dt.date(2001, 1, 1))])
    alerts = rules.run_rules(b)
    assert alerts.columns == rules.ALERT_COLUMNS
    r = alerts.collect()[0]
    assert r["description"] == "Invoice INV-1 ($100.00) has no completed payment."
    s = rules.rule_summary(alerts).collect()
    assert [(x["rule_code"], x["severity"], x["alert_count"]) for x in s] == [("MISSING_PAYMENT", "high", 1)]


def test_fixture_counts_sf001(spark):
    from revguard.sources.billing import billing_views
    from tests.conftest import SF001
    b = billing_views(spark, SF001)
    counts = {r["rule_code"]: r["n"] for r in rules.run_rules(b).groupBy("rule_code")
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"MISSING_PAYMENT": 1328, "DUPLICATE_REFUND": 91, "ABNORMAL_DISCOUNT": 743,
                      "UNDERBILLING": 4373, "PAYMENT_DELAY": 1877, "FAILED_PAYMENT_STREAK": 1490,
                      "MISSING_RENEWAL": 1631}
