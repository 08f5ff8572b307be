"""Sinks (idempotent append, replace-or-skip, soft delete) and the driver contract."""
import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as entry
from revguard.sources import sinks


def test_append_new_is_idempotent(spark):
    d = tempfile.mkdtemp(prefix="rg-sink-")
    p = os.path.join(d, "scores")
    df = spark.createDataFrame([(i, "v1", float(i)) for i in range(10)], "invoice_id long, v string, s double")
    assert sinks.append_new(df, p, ["invoice_id", "v"]) == 10
    assert sinks.append_new(df, p, ["invoice_id", "v"]) == 0
    more = spark.createDataFrame([(i, "v1", 0.0) for i in range(5, 15)], "invoice_id long, v string, s double")
    assert sinks.append_new(more, p, ["invoice_id", "v"]) == 5
    assert spark.read.parquet(p).count() == 15


def test_replace_or_skip(spark):
    p = os.path.join(tempfile.mkdtemp(prefix="rg-sink-"), "alerts")
    a = spark.createDataFrame([(1,)], "x int")
    assert sinks.replace_or_skip(a, p, clear=False)
    assert not sinks.replace_or_skip(a.union(a), p, clear=False)
    assert sinks.replace_or_skip(a.union(a), p, clear=True)
    assert spark.read.parquet(p).count() == 2


def test_soft_delete(spark):
    t = spark.createDataFrame([(1, False), (2, False), (3, True)], "id long, is_deleted boolean")
    out = sinks.soft_delete(t, spark.createDataFrame([(2,)], "id long"), "id", at=dt.datetime(2001, 1, 1))
    got = {r["id"]: (r["is_deleted"], r["deleted_at"] is not None) for r in out.collect()}
    assert got == {1: (False, False), 2: (True, True), 3: (True, False)}


def test_csv_json_attribution_sinks(spark):
    d = tempfile.mkdtemp(prefix="rg-sink-")
    df = spark.createDataFrame([(1, 0.5, -0.25)], "invoice_id long, c_a double, c_b double")
    sinks.write_csv(df, os.path.join(d, "c"), single_file=True)
    sinks.write_json(df, os.path.join(d, "j"), limit=1)
    sinks.write_attributions(df, ["a", "b"], os.path.join(d, "m"))
    assert spark.read.option("header", True).csv(os.path.join(d, "c")).count() == 1
    assert spark.read.json(os.path.join(d, "j")).count() == 1
    m = spark.read.parquet(os.path.join(d, "m")).first()["contributions"]
    assert m == {"a": 0.5, "b": -0.25}


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"rule_code", "severity", "alert_count", "leakage"}


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_rules_idempotent(spark):
    from revguard.operators import rules
    from revguard.sources.billing import billing_views
    from revguard.streaming import rules_stream
    from tests.conftest import SF0001

    b = billing_views(spark, SF0001)
    d = tempfile.mkdtemp(prefix="rg-stream-")
    src, alerts, ck = (os.path.join(d, x) for x in ("in", "alerts", "ck"))
    inv = b.invoices
    cut = F.lit(dt.date(1998, 1, 1))
    inv.filter(F.col("issue_date") < cut).write.mode("append").parquet(src)
    inv.filter(F.col("issue_date") >= cut).write.mode("append").parquet(src)
    rules_stream.start(spark, src, b, alerts, ck).awaitTermination()
    got = spark.read.parquet(alerts)
    want = rules_stream.batch_alerts(inv, b)
    assert got.count() == want.count()
    # a second run over the same files (fresh checkpoint = full replay) appends nothing
    rules_stream.start(spark, src, b, alerts, os.path.join(d, "ck2")).awaitTermination()
    assert spark.read.parquet(alerts).count() == want.count()
    assert {r["rule_code"] for r in got.select("rule_code").distinct().collect()} <= set(rules.RULES)


def test_cases_view_counts(spark):
    from revguard.plans import serve
    cases = spark.createDataFrame([(1, 10), (2, 11)], "case_id long, customer_id long")
    links = spark.createDataFrame([(1, 100), (1, 101)], "case_id long, alert_id long")
    cust = spark.createDataFrame([(10, "A"), (11, "B")], "customer_id long, name string")
    got = {r["case_id"]: r["alert_count"] for r in serve.cases_view(cases, links, cust).collect()}
    assert got == {1: 2, 2: 0}
