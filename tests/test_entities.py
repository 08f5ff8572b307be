"""Entity lists: what may be filtered, searched and ordered, and the invoice detail's score parts."""
import datetime as dt
from decimal import Decimal as D

import pytest

from revguard.operators import rules
from revguard.plans import entities, serve
from revguard.sources.billing import billing_views
from tests.conftest import SF0001


def test_every_entity_offers_its_columns(spark):
    b = billing_views(spark, SF0001)
    shown = {"customers": serve.customers_view(b), "invoices": serve.invoices_view(b),
             "alerts": serve.alerts_view(b, rules.run_rules(b))}
    for name, rows in shown.items():
        e = entities.ENTITIES[name]
        assert {e.key, *e.filters, *e.search} <= set(rows.columns)
        page, count = entities.entity_page(name, rows, page_size=5)
        assert len(page.collect()) == 5 and count.first()["count"] >= 5


def test_alerts_are_searched_by_description(make_billing):
    b = make_billing(invoices=[dict(invoice_id=1, status="overdue", due_date=dt.date(2001, 7, 1)),
                               dict(invoice_id=2, discount_amount=D("50.00"), total_amount=D("100.00"))], customers=[dict(name="Days Overdue Ltd")])
    rows = serve.alerts_view(b, rules.run_rules(b))
    found = entities.entity_page("alerts", rows, search="DISCOUNT ratio")[0].collect()
    assert [r.rule_code for r in found] == ["ABNORMAL_DISCOUNT"]
    assert {r.rule_code for r in entities.entity_page("alerts", rows, search="days overdue")[0].collect()} == set(
        r.rule_code for r in rows.collect())  # every alert is this customer's


def test_cases_filter_search_order_and_seek(spark):
    cases = spark.createDataFrame([(i, f"LC-{i}", "late fees" if i % 2 else "refunds", "open" if i < 8 else "closed", "high", i % 3,
                                    dt.datetime(2001, 1, 1 + i), float(i)) for i in range(10)],
                                  "case_id long, case_number string, title string, status string, priority string, customer_id long, "
                                  "created_at timestamp, estimated_leakage_amount double")
    links = spark.createDataFrame([(1, 100), (1, 101)], "case_id long, alert_id long")
    names = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "customer_id long, name string")
    rows = serve.cases_view(cases, links, names)
    page, count = entities.entity_page("cases", rows, filters={"status": "open"}, search="LATE", ordering="-estimated_leakage_amount")
    assert [r.case_id for r in page.collect()] == [7, 5, 3, 1] and count.first()["count"] == 4
    first = entities.entity_after("cases", rows, None, page_size=4)
    mark = serve.last_row(first, key="case_id", default=entities.ENTITIES["cases"].default)
    assert [r.case_id for r in entities.entity_after("cases", rows, mark, page_size=4).collect()] == [5, 4, 3, 2]


@pytest.mark.parametrize("kw", [dict(filters={"name": "x"}), dict(ordering="status")])
def test_what_is_not_offered_is_refused(spark, kw):
    with pytest.raises(ValueError):
        entities.entity_page("customers", serve.customers_view(billing_views(spark, SF0001)), **kw)
    with pytest.raises(ValueError):
        entities.entity_page("forecasts", spark.range(1), search="x")
