import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from revguard.session import get_spark  # noqa: E402
from revguard.sources.billing import AS_OF, Billing, billing_views  # noqa: E402

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", shuffle_partitions=8, extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def schemas(spark):
    b = billing_views(spark, SF0001)
    return {n: getattr(b, n).schema for n in ("customers", "contracts", "subscriptions", "invoices",
                                               "payments", "refunds")}


D = Decimal
DAY = dt.date(2001, 1, 1)

DEFAULTS = {
    "customers": dict(customer_id=1, external_id="CUST-1", name="Customer#1", nation_key=1,
                      segment="smb", status="active", acquisition_date=DAY, churn_date=None,
                      credit_limit=D("100.00"), risk_tier="low", is_deleted=False),
    "contracts": dict(contract_id=1, customer_id=1, contract_number="CTR-1", status="active",
                      start_date=DAY, end_date=DAY, contracted_value=D("1200.00"), payment_terms_days=30,
                      auto_renew=False, discount_pct=D("0.00"), is_deleted=False),
    "subscriptions": dict(subscription_id=1, customer_id=1, contract_id=1, product_id=1, status="active",
                          billing_cycle="monthly", mrr=D("100.00"), arr=D("1200.00"), quantity=1,
                          discount_pct=D("0.00"), start_date=DAY, is_deleted=False),
    "invoices": dict(invoice_id=1, customer_id=1, contract_id=1, subscription_id=1, invoice_number="INV-1",
                     status="issued", issue_date=DAY, due_date=DAY, period_start=DAY, period_end=DAY,
                     subtotal=D("100.00"), tax_amount=D("0.00"), discount_amount=D("0.00"),
                     total_amount=D("100.00"), paid_amount=D("0.00"), outstanding_amount=D("100.00"),
                     is_deleted=False),
    "payments": dict(transaction_id="T-1", customer_id=1, invoice_id=1, status="succeeded", method="card",
                     amount=D("10.00"), payment_date=DAY, attempt_count=1, is_late=False, days_late=0,
                     is_deleted=False),
    "refunds": dict(refund_number="RF-1", transaction_id="T-1", customer_id=1, invoice_id=1,
                    status="processed", reason="x", amount=D("5.00"),
                    requested_at=dt.datetime(2001, 1, 1, 10, 30), processed_at=None,
                    is_duplicate=False, is_deleted=False),
}


@pytest.fixture
def make_billing(spark, schemas):
    def make(as_of=AS_OF, **tables):
        frames = {}
        for name, schema in schemas.items():
            rows = [{**DEFAULTS[name], **r} for r in tables.get(name, [])]
            rows = [tuple(r[f.name] for f in schema.fields) for r in rows]
            frames[name] = spark.createDataFrame(rows, schema)
        return Billing(as_of=as_of, **frames)
    return make
