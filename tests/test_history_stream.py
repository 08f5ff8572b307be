"""Streams of payments, invoices and refunds give what the batch rules give, in any order of arrival and after a replay."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from revguard.operators import rules
from revguard.sources.billing import billing_views
from revguard.streaming import history_stream
from tests.conftest import SF0001

TABLES = ("payments", "invoices", "refunds")


def rows_of(alerts):
    return sorted(tuple(r) for r in rules.flat(alerts).select(
        "rule_code", "source_ref", "severity", "leakage_amount", F.coalesce("customer_id", F.lit(-1)),
        F.coalesce("invoice_id", F.lit(-1))).collect())


@pytest.mark.parametrize("order", ["forward", "backward"])
def test_equals_batch_in_any_order(spark, order):
    b = billing_views(spark, SF0001)
    d = tempfile.mkdtemp(prefix="rg-history-")
    frames = {t: getattr(b, t) for t in TABLES}
    key = {"payments": "transaction_id", "invoices": "invoice_id", "refunds": "refund_number"}
    for t, frame in frames.items():  # three files each, rows dealt by a hash of the key, later files first or last
        for k in (range(3) if order == "forward" else range(2, -1, -1)):
            frame.filter(F.pmod(F.xxhash64(key[t]), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{d}/in/{t}")
    dirs, schemas = {t: f"{d}/in/{t}" for t in TABLES}, {t: frames[t].schema for t in TABLES}

    def run(out, checkpoint):
        # the test tables' payment dates lie anywhere around the issue
        for q in history_stream.start(spark, dirs, schemas, out, checkpoint, files_per_batch=1, days_before=5000, days_after=5000):
            q.awaitTermination()
        return rows_of(history_stream.alerts(spark, out))

    want = rows_of(rules.duplicate_refund(b).unionByName(rules.payment_delay(b)).unionByName(rules.failed_payment_streak(b)))
    got = run(f"{d}/out", f"{d}/ck")
    assert got == want and len({r[0] for r in got}) == 3
    assert spark.read.parquet(f"{d}/out/failed").select("batch_id").distinct().count() == 3  # several micro-batches
    assert run(f"{d}/out", f"{d}/ck") == want      # nothing new: nothing changes
    assert run(f"{d}/out", os.path.join(d, "ck2")) == want  # a replay from the start replaces each batch by itself
