"""Serving queries D1-D13 and entity lists E1-E7.

These are the dashboard / API reads.  Each returns a DataFrame; top-k reads end
their ordering in a unique key so the limited set is deterministic, and run as
``TakeOrderedAndProject`` (per-partition top-k, then a k-row merge).  "Latest
score" (W5) is one ``max_by`` aggregate instead of a query per row.  Nothing
collects an unbounded group: the invoice detail view returns its alerts as a
separate flat frame instead of an array per invoice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revguard.functions import exprs as X
from revguard.operators import rank
from revguard.session import cut_lineage
from revguard.sources.billing import Billing

HIGH = ["high", "critical"]
ALERT_FIELDS = ["invoice_id", "rule_code", "severity", "description", "leakage_amount", "is_resolved"]


def _live(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_deleted"))


def _cust(b: Billing) -> DataFrame:
    return b.customers.select("customer_id", F.col("name").alias("customer_name"),
                              F.col("segment").alias("customer_segment"))


# ----------------------------------------------------------------------------- D1
def kpis(b: Billing, risk: DataFrame, anomaly: DataFrame, *, model_name: str) -> DataFrame:
    """Revenue, risk and customer KPIs as one row (four one-row aggregates)."""
    inv = _live(b.invoices).agg(
        F.sum("total_amount").alias("total_invoiced"), F.sum("paid_amount").alias("total_collected"),
        F.sum("outstanding_amount").alias("total_outstanding"),
        F.sum("discount_amount").alias("total_discounted"),
        F.count_if(F.col("status") == "overdue").alias("overdue_invoices"))
    rk = risk.agg(F.count_if(F.col("risk_severity").isin(*HIGH) &
                             (F.col("model_name") == model_name)).alias("high_risk_invoices"))
    an = anomaly.agg(F.count_if(F.col("is_anomaly")).alias("anomalies_detected"))
    dup = b.refunds.filter(F.col("is_duplicate")).agg(
        F.count(F.lit(1)).alias("duplicate_refunds"),
        F.coalesce(F.sum("amount"), F.lit(0)).alias("duplicate_refund_amount"))
    cu = _live(b.customers).agg(
        F.count(F.lit(1)).alias("customers_total"),
        F.count_if(F.col("status") == "active").alias("customers_active"),
        F.count_if(F.col("status") == "churned").alias("customers_churned"))
    one = reduce(lambda a, c: a.crossJoin(c), [inv, rk, an, dup, cu])  # five one-row frames
    return one.select(
        "*",
        F.coalesce(F.try_divide(X.dbl("total_collected") * 100, X.dbl("total_invoiced")),
                   F.lit(0.0)).alias("collection_rate_pct"),
        F.coalesce(F.try_divide(X.dbl("customers_churned") * 100, X.dbl("customers_total")),
                   F.lit(0.0)).alias("churn_rate_pct"))


# ----------------------------------------------------------------------------- D2, D8
def revenue_by_month(b: Billing) -> DataFrame:
    """D2 (actuals) / D8: per month invoice count, invoiced, collected, outstanding, rate."""
    m = _live(b.invoices).groupBy(X.month_key("issue_date").alias("month")).agg(
        F.count(F.lit(1)).alias("invoice_count"), F.sum("total_amount").alias("invoiced"),
        F.sum("paid_amount").alias("collected"), F.sum("outstanding_amount").alias("outstanding"))
    return m.withColumn("collection_rate", F.coalesce(
        F.try_divide(X.dbl("collected") * 100, X.dbl("invoiced")), F.lit(0.0))).orderBy("month")


def forecast_trend(forecasts: DataFrame, *, metric: str = "revenue") -> DataFrame:
    """D2 (forecasts): forecast rows of one metric in month order."""
    return forecasts.filter(F.col("metric") == metric).select(
        "period_month", "forecasted_value", "lower_bound", "upper_bound", "is_anomalous",
        "deviation_pct").orderBy("period_month")


# ----------------------------------------------------------------------------- D3, D4, D11
def _risk_rows(b: Billing, risk: DataFrame) -> DataFrame:
    inv = b.invoices.select("invoice_id", "invoice_number", F.col("total_amount").alias("invoice_amount"),
                            F.col("status").alias("invoice_status"))
    return risk.join(_cust(b), "customer_id", "inner").join(inv, "invoice_id", "left")


def top_risks(b: Billing, risk: DataFrame, *, model_name: str, limit: int = 15,
              severities: list[str] | None = None, n_features: int = 3) -> DataFrame:
    """D3 (and the D11 list): highest probabilities with customer/invoice fields."""
    r = risk.filter(F.col("model_name") == model_name)
    if severities:
        r = r.filter(F.col("risk_severity").isin(*severities))
    top = r.orderBy(F.col("leakage_probability").desc(), F.col("invoice_id").asc(),
                    F.col("model_version").asc()).limit(limit)
    if "rank_percentile" not in risk.columns:
        # Rank only the k rows shown, against the whole table (W1 per model and version).
        top = rank.percent_rank_of(top, risk, "leakage_probability",
                                   partition_cols=["model_name", "model_version"], out="_pr") \
            .withColumn("rank_percentile", F.col("_pr") * 100).drop("_pr")
    out = _risk_rows(b, top)
    feats = [F.element_at("top_features", i + 1).alias(f"top_feature_{i + 1}")
             for i in range(n_features)]
    return out.select("invoice_id", "invoice_number", "customer_name", "customer_segment",
                      "leakage_probability", "risk_severity", "rank_percentile", *feats,
                      "invoice_amount", "invoice_status", "model_version")


def risk_distribution(risk: DataFrame, *, model_name: str) -> DataFrame:
    """Rows per severity band."""
    return risk.filter(F.col("model_name") == model_name).groupBy("risk_severity") \
        .agg(F.count(F.lit(1)).alias("count"))


# ----------------------------------------------------------------------------- D5
def leakage_by_rule(alerts: DataFrame) -> DataFrame:
    """Alerts, leakage and unresolved alerts per (rule, severity)."""
    a = alerts if "is_resolved" in alerts.columns else alerts.withColumn("is_resolved", F.lit(False))
    return a.groupBy("rule_code", "severity").agg(
        F.count(F.lit(1)).alias("count"), F.sum("leakage_amount").alias("total_amount"),
        F.count_if(~F.col("is_resolved")).alias("unresolved")).orderBy(F.desc("total_amount"), "rule_code", "severity")


# ----------------------------------------------------------------------------- D6
def anomaly_timeline(anomaly: DataFrame) -> DataFrame:
    """Scored rows and anomalies per scoring month."""
    return anomaly.groupBy(X.month_key("scored_at").alias("month")).agg(
        F.count(F.lit(1)).alias("total_scored"),
        F.sum(F.col("is_anomaly").cast("int")).cast("bigint").alias("anomalies"))


# ----------------------------------------------------------------------------- D7
def latest(df: DataFrame, key: str, ts: str = "scored_at", tie: str = "model_version") -> DataFrame:
    """The latest row per key (``max_by`` on ``(ts, tie)``; no sort, no per-row query)."""
    cols = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(ts, tie)).alias("_r"))
    return g.select(key, "_r.*")


def _given(df: DataFrame, name: str) -> Column:
    """A column that a caller's score table may lack: null then."""
    return F.col(name) if name in df.columns else F.lit(None)


def invoice_detail(b: Billing, risk: DataFrame, anomaly: DataFrame, alerts: DataFrame, *,
                   model_name: str, invoice_ids: list[int] | None = None) -> DataFrame:
    """D7 (flat form): invoice, customer, latest risk and latest anomaly with their top features, the risk's feature
    snapshot, and alert roll-up.

    Works for all invoices at once or for a list of ids (a point lookup filters
    every input first, so the scan pushes the predicate down).
    """
    inv = b.invoices
    r = risk.filter(F.col("model_name") == model_name)
    a, al = anomaly, alerts
    if invoice_ids is not None:
        ids = [int(i) for i in invoice_ids]
        inv, r, a, al = [d.filter(F.col("invoice_id").isin(ids)) for d in (inv, r, a, al)]
    lr = latest(r.select("invoice_id", "leakage_probability", "risk_severity", "rank_percentile",
                         _given(r, "top_features").alias("risk_top_features"), _given(r, "feature_snapshot").alias("risk_snapshot"),
                         "scored_at", "model_version"), "invoice_id")
    la = latest(a.select("invoice_id", F.col("score").alias("anomaly_score"), "is_anomaly", "if_prob_proxy",
                         _given(a, "top_features").alias("anomaly_top_features"), "scored_at", "model_version"), "invoice_id")
    ag = al.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("alert_count"),
                                      F.sum("leakage_amount").alias("alert_leakage"))
    cust = b.customers.select("customer_id", F.col("name").alias("customer_name"),
                              F.col("segment").alias("customer_segment"),
                              F.col("status").alias("customer_status"))
    head = inv.select("invoice_id", "customer_id", "invoice_number", "status", "issue_date", "due_date",
                      "total_amount", "paid_amount", "outstanding_amount", "discount_amount")
    out = head.join(cust, "customer_id", "left") \
        .join(lr.drop("scored_at", "model_version"), "invoice_id", "left") \
        .join(la.drop("scored_at", "model_version"), "invoice_id", "left") \
        .join(ag, "invoice_id", "left")
    return out.withColumn("alert_count", F.coalesce("alert_count", F.lit(0)))


def invoice_alerts(alerts: DataFrame, invoice_ids: list[int]) -> DataFrame:
    """D7 (alerts part): the alert rows of the given invoices, flat."""
    return alert_rows(alerts).filter(F.col("invoice_id").isin([int(i) for i in invoice_ids])) \
        .select(*ALERT_FIELDS)


def alert_details(alerts: DataFrame) -> DataFrame:
    """D7 (alerts part): the alert rows of every invoice, with their text and state, flat."""
    return alert_rows(alerts).where("invoice_id is not null").select(*ALERT_FIELDS)


# ----------------------------------------------------------------------------- D9, D10
def outstanding_rows(b: Billing) -> DataFrame:
    """Live invoices with something outstanding."""
    return _live(b.invoices).filter(F.col("outstanding_amount") > 0)


def outstanding_invoices(b: Billing, *, limit: int = 100) -> DataFrame:
    """Largest outstanding amounts with days overdue (0 when not yet due)."""
    inv = outstanding_rows(b).orderBy(F.col("outstanding_amount").desc(), F.col("invoice_id").asc()).limit(limit)
    days = F.when(F.col("due_date") < F.lit(b.as_of), X.days_since("due_date", b.as_of)).otherwise(0)
    return inv.join(_cust(b), "customer_id", "inner").select(
        "invoice_number", "invoice_id", "customer_name", "customer_segment", "total_amount",
        "outstanding_amount", "due_date", "status", days.alias("days_overdue"))


def list_total(df: DataFrame, col: str, out: str) -> DataFrame:
    """Q14: total and count over all rows that qualify for a list, whatever its length limit shows."""
    return df.agg(F.coalesce(F.sum(col), F.lit(0)).alias(out), F.count(F.lit(1)).alias("count"))


def overdue_rows(b: Billing) -> DataFrame:
    """Live overdue invoices."""
    return _live(b.invoices).filter(F.col("status") == "overdue")


def overdue_invoices(b: Billing, *, limit: int = 200) -> DataFrame:
    """Overdue invoices, most days overdue first (invoice id breaks ties); the cut precedes the look-up."""
    order = [F.col("days_overdue").desc(), F.col("invoice_id").asc()]
    top = overdue_rows(b).withColumn("days_overdue", F.datediff(F.lit(b.as_of), F.col("due_date"))) \
        .orderBy(*order).limit(limit)
    j = top.join(b.customers.select("customer_id", F.col("name").alias("customer_name"), "segment"),
                 "customer_id", "inner")
    return j.orderBy(*order).select("invoice_id", "invoice_number", "customer_name", "segment", "total_amount",
                                    "outstanding_amount", "due_date", "days_overdue")


# ----------------------------------------------------------------------------- D12
def anomaly_totals(anomaly: DataFrame) -> DataFrame:
    """D12 (totals): anomalies, scored rows, anomaly rate."""
    t = anomaly.agg(F.count_if(F.col("is_anomaly")).alias("total_anomalies"),
                    F.count(F.lit(1)).alias("total_scored"))
    return t.withColumn("anomaly_rate_pct", F.coalesce(
        F.try_divide(X.dbl("total_anomalies") * 100, X.dbl("total_scored")), F.lit(0.0)))


def top_anomalies(b: Billing, anomaly: DataFrame, *, limit: int = 100, n_features: int = 3) -> DataFrame:
    """D12 (list): lowest (most anomalous) scores with customer/invoice fields."""
    a = anomaly.filter(F.col("is_anomaly")) \
        .orderBy(F.col("score").asc(), F.col("invoice_id").asc()).limit(limit)
    inv = b.invoices.select("invoice_id", "invoice_number", F.col("total_amount").alias("invoice_amount"))
    j = a.join(_cust(b), "customer_id", "left").join(inv, "invoice_id", "left")
    feats = [F.element_at("top_features", i + 1).alias(f"top_feature_{i + 1}")
             for i in range(n_features)]
    return j.select("invoice_id", "invoice_number", "customer_name", "customer_segment",
                    F.col("score").alias("if_score"), F.coalesce("if_prob_proxy", F.lit(0.0))
                    .alias("if_prob_proxy"), *feats, "invoice_amount")


# ----------------------------------------------------------------------------- D13
def duplicate_refunds(b: Billing) -> DataFrame:
    """All duplicate refunds, largest first, with timestamps cut to minutes."""
    r = b.refunds.filter(F.col("is_duplicate"))
    inv = b.invoices.select("invoice_id", "invoice_number")
    j = r.join(_cust(b), "customer_id", "inner").join(inv, "invoice_id", "left")
    return j.select("refund_number", "customer_name", "customer_segment", "invoice_number", "amount",
                    "reason", "status",
                    F.date_format("requested_at", "yyyy-MM-dd HH:mm").alias("requested_at"),
                    F.date_format("processed_at", "yyyy-MM-dd HH:mm").alias("processed_at")) \
        .orderBy(F.col("amount").desc(), F.col("refund_number").asc())


# ----------------------------------------------------------------------------- E1-E7
def list_entity(df: DataFrame, *, key: str, filters: dict | None = None, search: str | None = None,
                search_cols: list[str] | None = None, ordering: str | None = None,
                allowed: list[str] | None = None, default: list[str] | None = None,
                page: int = 1, page_size: int = 50) -> tuple[DataFrame, DataFrame]:
    """Generic list read (P11, P12, O6, O7): filter, search, validated ordering, one page.

    Returns ``(page_rows, total_count)``.  ``ordering`` is a field name with an
    optional ``-`` prefix; it must be in ``allowed``.  The key closes every order.
    """
    d = _found(df, filters, search, search_cols)
    order = [F.col(name).desc() if down else F.col(name).asc() for name, down in _ordering(key, ordering, allowed, default)]
    rows = d.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    return rows, d.agg(F.count(F.lit(1)).alias("count"))


def _found(df: DataFrame, filters: dict | None, search: str | None, search_cols: list[str] | None) -> DataFrame:
    d = df.filter(X.exact_filters(filters)) if filters else df
    return d.filter(X.contains_any(search_cols, search)) if search and search_cols else d


def _ordering(key: str, ordering: str | None, allowed: list[str] | None, default: list[str] | None) -> list[tuple[str, bool]]:
    """(column, whether descending) of a list's order, closed by its key."""
    spec = [(o.lstrip("-"), o.startswith("-")) for o in ([ordering] if ordering else list(default or []))]
    if ordering and allowed is not None and spec[0][0] not in allowed:
        raise ValueError(f"ordering by {spec[0][0]!r} is not allowed")
    return [s for s in spec if s[0] != key] + [(key, next((down for name, down in spec if name == key), False))]


def list_after(df: DataFrame, after: dict | None, *, key: str, filters: dict | None = None, search: str | None = None,
               search_cols: list[str] | None = None, ordering: str | None = None, allowed: list[str] | None = None,
               default: list[str] | None = None, page_size: int = 50) -> DataFrame:
    """O7 by seek: the page that follows the row ``after`` (its values of the ordering and the key; None: the first page).

    Rows at or before that row are filtered out, so a task keeps ``page_size`` rows however deep the page lies.  Nulls come
    first where the order ascends and last where it descends, as in ``list_entity``.
    """
    spec = _ordering(key, ordering, allowed, default)
    d = _found(df, filters, search, search_cols)
    if after is not None:
        beyond, same = F.lit(False), F.lit(True)
        for name, down in spec:
            col, value = F.col(name), after[name]
            if value is None:
                further = F.lit(False) if down else col.isNotNull()
            else:
                at = F.lit(value).cast(df.schema[name].dataType)
                further = (col < at) | col.isNull() if down else col > at
            beyond = beyond | (same & F.coalesce(further, F.lit(False)))
            same = same & col.eqNullSafe(F.lit(value).cast(df.schema[name].dataType))
        d = d.filter(beyond)
    return d.orderBy(*(F.col(name).desc() if down else F.col(name).asc() for name, down in spec)).limit(page_size)


def last_row(page: DataFrame, *, key: str, ordering: str | None = None, default: list[str] | None = None) -> dict | None:
    """The mark of a page for ``list_after``: its last row's values (a page is bounded by its size)."""
    rows = page.select(*(name for name, _ in _ordering(key, ordering, None, default))).collect()
    return rows[-1].asDict() if rows else None


def seek_page(df: DataFrame, *, page: int, key: str, **options) -> DataFrame:
    """Page ``page`` by seeking from page to page."""
    after = None
    marks = {k: options.get(k) for k in ("ordering", "default")}
    for _ in range(page - 1):
        after = last_row(list_after(df, after, key=key, **options), key=key, **marks)
        if after is None:
            return df.limit(0)
    return list_after(df, after, key=key, **options)


def ranked_page(page: DataFrame, risk: DataFrame, *, order: list[Column]) -> DataFrame:
    """E5: add ``rank_percentile`` (W1 per model and version over all of ``risk``) to one page.

    The page is bounded by its page size, so only its rows are ranked
    (``rank.percent_rank_of``); the page order is restored afterwards.
    """
    return rank.percent_rank_of(page, risk, "leakage_probability",
                                partition_cols=["model_name", "model_version"], out="_pr") \
        .withColumn("rank_percentile", F.col("_pr") * 100).drop("_pr").orderBy(*order)


def customers_view(b: Billing) -> DataFrame:
    """E1 list rows (live customers)."""
    return _live(b.customers).select("customer_id", "external_id", "name", "segment", "status",
                                     "nation_key", "acquisition_date", "churn_date", "risk_tier",
                                     "credit_limit")


def customer_rollup(b: Billing, risk: DataFrame) -> DataFrame:
    """E1 detail / A18 + W5: invoice count, invoiced, paid and the latest risk per customer."""
    agg = _live(b.invoices).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_invoices"), F.sum("total_amount").alias("total_invoiced"),
        F.sum("paid_amount").alias("total_paid"))
    lr = latest(risk.select("customer_id", "leakage_probability", "risk_severity", "scored_at",
                            "model_version", "invoice_id"), "customer_id", tie="invoice_id")
    return _live(b.customers).select("customer_id", "name", "segment") \
        .join(agg, "customer_id", "left").join(lr.drop("scored_at"), "customer_id", "left") \
        .select("customer_id", "name", "segment", F.coalesce("total_invoices", F.lit(0)).alias("total_invoices"),
                F.coalesce("total_invoiced", F.lit(0)).alias("total_invoiced"),
                F.coalesce("total_paid", F.lit(0)).alias("total_paid"),
                "leakage_probability", "risk_severity")


def invoices_view(b: Billing) -> DataFrame:
    """E2 rows: live invoices with customer name and segment."""
    return _live(b.invoices).join(b.customers.select("customer_id", F.col("name").alias("customer_name"),
                                                     F.col("segment").alias("customer_segment")),
                                  "customer_id", "inner") \
        .select("invoice_id", "invoice_number", "customer_id", "customer_name", "customer_segment",
                "status", "issue_date", "due_date", "total_amount", "paid_amount", "outstanding_amount")


def with_latest_risk(page: DataFrame, risk: DataFrame, *, order: list[Column]) -> DataFrame:
    """Latest risk and its explanation (F29) for the rows of one page.

    The page is bounded by its size and kept; only its invoices are looked up.
    Scores that carry an attribution sentence show it, others name their top features.
    """
    page = cut_lineage(page)
    ids = page.select("invoice_id")
    cols = ["invoice_id", "leakage_probability", "top_features", "scored_at", "model_version",
            *(["explanation"] if "explanation" in risk.columns else [])]
    lr = latest(risk.select(*cols).join(F.broadcast(ids), "invoice_id", "left_semi"), "invoice_id")
    top3 = F.slice("top_features", 1, 3)
    named = F.when(F.size(top3) > 0, F.concat(F.lit("Flagged due to: "), F.array_join(
        F.transform(top3, lambda x: F.regexp_replace(x, "_", " ")), ", ")))
    expl = F.coalesce("explanation", named) if "explanation" in risk.columns else named
    return page.join(F.broadcast(lr), "invoice_id", "left") \
        .select(*page.columns, F.col("leakage_probability").alias("risk_probability"), expl.alias("explanation")) \
        .orderBy(*order)


def alert_rows(alerts: DataFrame) -> DataFrame:
    """E3 rows before the customer look-up."""
    return alerts if "is_resolved" in alerts.columns else alerts.withColumn("is_resolved", F.lit(False))


def alerts_view(b: Billing, alerts: DataFrame) -> DataFrame:
    """E3 rows: alerts (a page of them, or all) with customer name."""
    return alert_rows(alerts).join(b.customers.select("customer_id", F.col("name").alias("customer_name")),
                  "customer_id", "left")


def cases_view(cases: DataFrame, case_alerts: DataFrame, customers: DataFrame) -> DataFrame:
    """E4 rows: cases with customer name and linked-alert count (A19, 0 when none)."""
    cnt = case_alerts.groupBy("case_id").agg(F.count(F.lit(1)).alias("alert_count"))
    return cases.join(customers.select("customer_id", F.col("name").alias("customer_name")),
                      "customer_id", "left").join(cnt, "case_id", "left") \
        .withColumn("alert_count", F.coalesce("alert_count", F.lit(0)))


def scores_view(b: Billing, scores: DataFrame) -> DataFrame:
    """E5/E6 rows: risk or anomaly scores with customer name."""
    return scores.join(b.customers.select("customer_id", F.col("name").alias("customer_name")),
                       "customer_id", "left")
