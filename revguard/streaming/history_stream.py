"""Rules that need history over streams of payments, invoices and refunds: R2, R5, R6.

* R2 duplicate refunds: a filter, no state.
* R5 payment delay: a stream-stream join.  A late payment waits for its invoice, or an invoice for its payments, as state
  keyed by invoice; watermarks on both event times and a bound on the days between issue and payment let Spark drop state
  that nothing can match any more.
* R6 failed payments: running totals per customer as streaming aggregation state, given out again for each customer that a
  micro-batch touches.

Every micro-batch is written as its own partition (``batch_id``) in one dynamic overwrite, so a batch that is replayed after
a lost driver replaces itself.  ``alerts`` reads the tables back: for R6 the last totals of each customer count.  The result
equals the batch rules over the same rows in any order of arrival, as long as no row is later than ``delay`` behind the
newest event time seen and payments lie within the bounds around their invoice's issue (R5; R2 and R6 have no such bounds).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from revguard.operators import rules
from revguard.sources import sinks

#: Days that a payment may come before the issue of its invoice, and after it.
DAYS_BEFORE, DAYS_AFTER = 31, 730
DELAY = "3650 days"


def delayed(payments: DataFrame, invoices: DataFrame, *, delay: str = DELAY, days_before: int = DAYS_BEFORE,
            days_after: int = DAYS_AFTER) -> DataFrame:
    """R5 over two streams: alerts of late payments joined to their live invoices.

    Payments outside the bounds on the days around the issue find no invoice; wider bounds keep more state.
    """
    p = rules.late_payments(payments).withColumn("paid_at", F.col("payment_date").cast("timestamp")).withWatermark("paid_at", delay)
    i = invoices.filter(~F.col("is_deleted")).select(
        F.col("invoice_id").alias("_invoice_id"), "customer_id", "invoice_number",
        F.col("issue_date").cast("timestamp").alias("issued_at")).withWatermark("issued_at", delay)
    near = ((F.col("invoice_id") == F.col("_invoice_id"))
            & (F.col("paid_at") >= F.col("issued_at") - F.expr(f"INTERVAL {days_before} DAYS"))
            & (F.col("paid_at") <= F.col("issued_at") + F.expr(f"INTERVAL {days_after} DAYS")))
    return rules.delay_alerts(p.join(i, near))


def _write(frame: DataFrame, path: str, checkpoint: str, mode: str, available_now: bool) -> StreamingQuery:
    def each(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))

    w = frame.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()


def start(spark: SparkSession, dirs: dict[str, str], schemas: dict, out: str, checkpoint: str, *, delay: str = DELAY,
          days_before: int = DAYS_BEFORE, days_after: int = DAYS_AFTER, available_now: bool = True,
          files_per_batch: int | None = None) -> list[StreamingQuery]:
    """Starts the three queries over the folders of ``payments``, ``invoices`` and ``refunds``."""
    def stream(name: str) -> DataFrame:
        r = spark.readStream.schema(schemas[name])
        return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(dirs[name])

    refunds = rules.refund_alerts(stream("refunds"))
    late = delayed(stream("payments"), stream("invoices"), delay=delay, days_before=days_before, days_after=days_after)
    totals = rules.failed_totals(stream("payments"))
    return [_write(frame, f"{out}/{name}", f"{checkpoint}/{name}", mode, available_now)
            for name, frame, mode in (("refunds", refunds, "append"), ("delays", late, "append"), ("failed", totals, "update"))]


def alerts(spark: SparkSession, out: str) -> DataFrame:
    """The alerts of R2, R5 and R6 as the streams have left them."""
    found = []
    for name in ("refunds", "delays", "failed"):
        if not sinks.exists(spark, f"{out}/{name}"):
            continue
        rows = spark.read.parquet(f"{out}/{name}")
        if name == "failed":  # the last totals of each customer
            last = rows.groupBy("customer_id").agg(F.max(F.struct("batch_id", "fails", "at_risk")).alias("t"))
            found.append(rules.streak_alerts(last.select("customer_id", "t.fails", "t.at_risk")))
        else:
            found.append(rows.drop("batch_id"))
    return reduce(DataFrame.unionByName, found)
