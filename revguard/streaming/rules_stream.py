"""Invoice-level reconciliation rules over a stream of invoice batches.

Structured Streaming reads new invoice files; every micro-batch runs the
invoice-level rules (R1 missing payment against the payments table, R3
abnormal discount, R4 underbilling against subscriptions, R7 overdue) with the
same DataFrame operators as the batch run, and appends only alerts whose key
``(rule_code, source_ref)`` is not yet in the alert table (S5 anti-join).  With
the stream's checkpoint in the shared folder, a replayed batch adds nothing, so
the sink is idempotent under executor or driver restarts.
"""

from __future__ import annotations

import dataclasses
import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from revguard.operators import rules
from revguard.sources import sinks
from revguard.sources.billing import Billing

STREAM_RULES = (rules.missing_payment, rules.abnormal_discount, rules.underbilling, rules.overdue_invoice)
ALERT_KEY = ["rule_code", "source_ref"]


def batch_alerts(invoices: DataFrame, reference: Billing) -> DataFrame:
    """Alerts of one micro-batch: the batch's invoices with the reference tables."""
    b = dataclasses.replace(reference, invoices=invoices)
    out = None
    for fn in STREAM_RULES:
        a = fn(b)
        out = a if out is None else out.unionByName(a)
    return out


def start(spark: SparkSession, invoice_dir: str, reference: Billing, alert_path: str, checkpoint: str, *,
          available_now: bool = True) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops."""
    schema = reference.invoices.schema
    stream = spark.readStream.schema(schema).parquet(invoice_dir)
    detected = _dt.datetime.combine(reference.as_of, _dt.time())

    def each(batch: DataFrame, batch_id: int) -> None:
        alerts = batch_alerts(batch, reference)
        fresh = sinks.new_rows(alerts, spark.read.parquet(alert_path)
                               if sinks.exists(spark, alert_path) else None, ALERT_KEY)
        sinks.write_alerts(fresh, alert_path, detected_at=detected)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
