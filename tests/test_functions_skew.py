"""Scalar helpers, the alert sink, point lookups and a hot-key fixture."""
import datetime as dt
import os
import tempfile
from decimal import Decimal as D

from pyspark.sql import functions as F

from revguard.functions import exprs as X
from revguard.operators import marts, rules
from revguard.plans import serve
from revguard.sources import sinks


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("12.5", '{"a": "0.7"}', D("1.00"), D("3.00")),
                                ("x", "{}", D("1.00"), D("0.00"))],
                               "s string, j string, a decimal(10,2), b decimal(10,2)")
    r = df.select(X.num_or_zero("s").alias("n"), X.json_field("j", "a", "0").alias("v"),
                  X.pct_guarded("a", "b", 2).alias("p"), X.signed_text(F.lit(0.1234)).alias("t"),
                  X.money_text(F.lit(D("1234.5"))).alias("m")).collect()
    assert [(x["n"], x["v"], x["p"]) for x in r] == [(12.5, "0.7", 33.33), (0.0, "0", 0.0)]
    assert r[0]["t"] == "+0.123" and r[0]["m"] == "$1,234.50"


def test_write_alerts_partitioned(spark, make_billing):
    b = make_billing(invoices=[dict(invoice_id=1, due_date=dt.date(2001, 1, 1))],
                     refunds=[dict(is_duplicate=True)])
    p = os.path.join(tempfile.mkdtemp(prefix="rg-alerts-"), "alerts")
    sinks.write_alerts(rules.run_rules(b), p, detected_at=dt.datetime(2001, 8, 2))
    assert {d for d in os.listdir(p) if d.startswith("rule_code=")} == {
        "rule_code=DUPLICATE_REFUND", "rule_code=MISSING_PAYMENT"}
    back = spark.read.parquet(p)
    assert back.count() == 2 and back.filter("is_resolved").count() == 0


def test_invoice_detail_point_lookup(spark, make_billing):
    b = make_billing(invoices=[dict(invoice_id=1, due_date=dt.date(2001, 1, 1)), dict(invoice_id=2)])
    risk = spark.createDataFrame(
        [(1, 1, "m", "v0", 0.2, "low", 10.0, dt.datetime(2001, 7, 1)),
         (1, 1, "m", "v1", 0.9, "critical", 90.0, dt.datetime(2001, 8, 1))],
        "customer_id long, invoice_id long, model_name string, model_version string, "
        "leakage_probability double, risk_severity string, rank_percentile double, scored_at timestamp")
    anom = spark.createDataFrame([(1, "v1", -0.1, True, 0.8, dt.datetime(2001, 8, 1))],
                                 "invoice_id long, model_version string, score double, is_anomaly boolean, "
                                 "if_prob_proxy double, scored_at timestamp")
    alerts = rules.run_rules(b)
    one = serve.invoice_detail(b, risk, anom, alerts, model_name="m", invoice_ids=[1]).collect()
    full = {r["invoice_id"]: r for r in serve.invoice_detail(b, risk, anom, alerts, model_name="m").collect()}
    assert len(one) == 1 and one[0].asDict() == full[1].asDict()
    assert one[0]["leakage_probability"] == 0.9 and one[0]["alert_count"] == 1
    assert full[2]["leakage_probability"] is None and full[2]["alert_count"] == 1
    assert serve.invoice_alerts(alerts, [1]).count() == 1


def test_hot_customer(make_billing):
    """One customer holds a third of all payments: aggregates stay exact."""
    pays, n = [], 300
    for k in range(n):
        hot = k % 3 == 0
        pays.append(dict(transaction_id=f"T{k}", customer_id=1 if hot else 2 + k, invoice_id=k + 1,
                         status="failed" if k % 2 == 0 else "succeeded", amount=D("2.50"),
                         days_late=k % 40))
    inv = [dict(invoice_id=k + 1, customer_id=1 if k % 3 == 0 else 2 + k) for k in range(n)]
    b = make_billing(payments=pays, invoices=inv)
    hot_rows = [p for p in pays if p["customer_id"] == 1]
    got = {r["customer_id"]: r for r in marts.payments_by_customer(b.payments).collect()}
    assert got[1]["payment_count"] == len(hot_rows)
    assert got[1]["failed_payment_count"] == sum(p["status"] == "failed" for p in hot_rows)
    assert got[1]["total_paid"] == sum(p["amount"] for p in hot_rows if p["status"] == "succeeded")
    streak = {r["customer_id"]: r for r in rules.failed_payment_streak(b).collect()}
    assert list(streak) == [1] and streak[1]["severity"] == "critical"
    mart = {r["invoice_id"]: r for r in marts.invoice_mart(b).collect()}
    assert len(mart) == n and all(mart[p["invoice_id"]]["payment_count"] == 1 for p in pays)


def test_cluster_conf_sizes_partitions():
    from revguard.session import cluster_conf
    c = cluster_conf(100 * (1 << 40), executors=1000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert int(cluster_conf(1 << 20, executors=2)["spark.sql.shuffle.partitions"]) == 16


def test_invoice_detail_reads_features_that_are_written_once(spark):
    """Ranks, rows and anomalies are a pass each: none joins the billing tables or sorts the candidates again."""
    from revguard.plans import catalog, scores
    from revguard.sources.billing import billing_views
    from tests.conftest import SF0001
    plan = catalog.QUERIES["d7_invoice_detail"](spark, SF0001)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan
    b = billing_views(spark, SF0001)
    feat = catalog.invoice_features(b)
    once = scores.stand_in_features(feat)
    for make in (lambda f: scores.stand_in_risk_scores(f, b.as_of).withColumn("feature_snapshot", scores.F.col("feature_snapshot")["prob"]),
                 lambda f: scores.stand_in_anomaly_scores(f, b.as_of)):
        assert make(once).exceptAll(make(feat)).count() == 0 == make(feat).exceptAll(make(once)).count()
