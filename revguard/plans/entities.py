"""The seven entity lists E1-E7: which columns each may be filtered, searched and ordered by.

``entity_page`` reads one page by number and ``entity_after`` the page behind a row (seek); both reject a filter or an order
that the entity does not offer, so a list cannot be made to scan or sort by a column that nobody meant it to.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from revguard.plans import serve


class Entity(NamedTuple):
    key: str
    filters: list[str]
    search: list[str]
    ordering: list[str]
    default: list[str]


ENTITIES = {
    "customers": Entity("customer_id", ["segment", "status", "risk_tier", "nation_key"], ["name", "external_id"],
                        ["acquisition_date", "name", "credit_limit"], ["-acquisition_date"]),
    "invoices": Entity("invoice_id", ["status", "customer_id", "customer_segment"], ["invoice_number", "customer_name"],
                       ["issue_date", "due_date", "total_amount", "outstanding_amount"], ["-issue_date"]),
    "cases": Entity("case_id", ["status", "priority", "customer_id"], ["case_number", "title", "customer_name"],
                    ["created_at", "estimated_leakage_amount", "priority"], ["-created_at"]),
    "alerts": Entity("source_ref", ["rule_code", "severity", "is_resolved", "customer_id"], ["customer_name", "description"],
                     ["detected_at", "leakage_amount", "severity"], ["-leakage_amount", "rule_code"]),
    "risk_scores": Entity("invoice_id", ["risk_severity", "model_name", "model_version", "customer_id"], ["customer_name"],
                          ["leakage_probability", "rank_percentile", "scored_at"], ["-leakage_probability"]),
    "anomaly_scores": Entity("invoice_id", ["is_anomaly", "model_version", "customer_id"], ["customer_name"],
                             ["score", "scored_at"], ["score"]),
    "forecasts": Entity("period_month", ["metric", "model_name", "model_version", "is_anomalous"], [],
                        ["period_month", "deviation_pct"], ["period_month"]),
}


def _options(name: str, rows: DataFrame, filters: dict | None, search: str | None, ordering: str | None) -> dict:
    e = ENTITIES[name]
    for column in filters or {}:
        if column not in e.filters:
            raise ValueError(f"{name} cannot be filtered by {column!r}")
    if search and not e.search:
        raise ValueError(f"{name} cannot be searched")
    return {"key": e.key, "filters": filters, "search": search, "search_cols": [c for c in e.search if c in rows.columns],
            "ordering": ordering, "allowed": e.ordering, "default": e.default}


def entity_page(name: str, rows: DataFrame, *, filters: dict | None = None, search: str | None = None,
                ordering: str | None = None, page: int = 1, page_size: int = 50) -> tuple[DataFrame, DataFrame]:
    """(rows of a page, one row with the number of all matches)."""
    return serve.list_entity(rows, **_options(name, rows, filters, search, ordering), page=page, page_size=page_size)


def entity_after(name: str, rows: DataFrame, after: dict | None, *, filters: dict | None = None, search: str | None = None,
                 ordering: str | None = None, page_size: int = 50) -> DataFrame:
    """The page that follows ``after``, a row's values of the order and the key (``serve.last_row``)."""
    return serve.list_after(rows, after, **_options(name, rows, filters, search, ordering), page_size=page_size)
