"""Seek paging against offset paging, typed JSON metadata, and write-backs that leave other partitions' files alone."""
import datetime as dt
import glob
import os
import tempfile
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from revguard.operators import explain, rules
from revguard.plans import serve
from revguard.sources import sinks

AT, LATER = dt.datetime(2001, 8, 2), dt.datetime(2001, 9, 1)


@pytest.mark.parametrize("ordering", ["v", "-v", "w", "-w", None])
def test_seek_equals_offset(spark, ordering):
    rows = [(i, None if i % 7 == 0 else i * 37 % 10, float(i % 4) if i % 5 else None) for i in range(43)]
    df = spark.createDataFrame(rows, "k long, v long, w double").repartition(5)
    options = dict(key="k", ordering=ordering, allowed=["v", "w"], default=["-w", "v"], page_size=10)
    for page in range(1, 7):
        by_offset, _ = serve.list_entity(df, page=page, **options)
        assert serve.seek_page(df, page=page, **options).collect() == by_offset.collect()
    with pytest.raises(ValueError):
        serve.list_after(df, None, key="k", ordering="x", allowed=["v"])


def test_seek_keeps_a_page_per_task(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    plan = serve.list_after(df, {"k": 900}, key="k")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=50" in plan


def test_metadata_is_typed_json(make_billing):
    b = make_billing(invoices=[dict(invoice_id=1, discount_amount=D("40.00"), total_amount=D("100.00"), status="overdue")],
                     payments=[dict(transaction_id=f"T-{i}", status="failed") for i in range(3)])
    got = {r.rule_code: r for r in rules.with_metadata_fields(rules.run_rules(b)).collect()}
    assert got["ABNORMAL_DISCOUNT"].metadata == '{"discount_ratio":0.4}' and got["ABNORMAL_DISCOUNT"].discount_ratio == 0.4
    assert got["FAILED_PAYMENT_STREAK"].failed_count == 3 and got["FAILED_PAYMENT_STREAK"].total_at_risk == 30.
    assert got["MISSING_RENEWAL"].due_date == dt.date(2001, 1, 1) and got["MISSING_PAYMENT"].metadata == "{}"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_soft_delete_rewrites_touched_partitions_only(spark):
    path = tempfile.mkdtemp(prefix="rg-back-") + "/t"
    rows = [(i, f"p{i % 4}", i == 5, AT if i == 5 else None) for i in range(40)]
    spark.createDataFrame(rows, "k long, p string, is_deleted boolean, deleted_at timestamp").coalesce(1) \
        .write.partitionBy("p").parquet(path)
    before = files(path)
    keys = spark.createDataFrame([(5,), (9,), (2,), (77,)], "k long")  # partitions p1 and p2
    assert sorted(sinks.soft_delete_rows(spark, path, keys, "k", at=LATER, partition_by="p")) == ["p1", "p2"]
    after = files(path)
    for p, same in (("p0", True), ("p1", False), ("p2", False), ("p3", True)):
        own = [{f: m for f, m in x.items() if f"p={p}/" in f} for x in (before, after)]
        assert (own[0] == own[1]) == same
    state = {r.k: (r.is_deleted, r.deleted_at) for r in spark.read.parquet(path).collect()}
    assert len(state) == 40 and {k for k, v in state.items() if v[0]} == {5, 9, 2}
    assert state[5][1] == AT and state[9][1] == LATER  # deleted before: keeps its time
    sinks.soft_delete_rows(spark, path, keys, "k", at=dt.datetime(2002, 1, 1), partition_by="p")  # a replay, later
    assert {r.k: (r.is_deleted, r.deleted_at) for r in spark.read.parquet(path).collect()} == state
    untouched = files(path)
    assert sinks.soft_delete_rows(spark, path, keys.where("k = 77"), "k", at=AT, partition_by="p") == []
    assert files(path) == untouched


def test_attach_writes_back_explained_partitions(spark):
    path = tempfile.mkdtemp(prefix="rg-back-") + "/scores"
    spark.createDataFrame([(i, "m", "v1", "old", i % 3) for i in range(9)],
                          "invoice_id long, model_name string, model_version string, explanation string, bucket int") \
        .coalesce(1).write.partitionBy("bucket").parquet(path)
    ex = spark.createDataFrame([(4, "new")], "invoice_id long, explanation string")
    before = files(path)
    assert explain.attach_rows(spark, path, ex, partition_by="bucket", model_name="m", model_version="v1") == [1]
    assert {r.invoice_id: r.explanation for r in spark.read.parquet(path).collect()} == {i: "new" if i == 4 else "old" for i in range(9)}
    assert {f for f in before if "bucket=1" not in f} <= set(files(path))
    assert spark.read.parquet(path).where(F.col("explanation") == "new").count() == 1
