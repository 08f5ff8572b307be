"""Attributions X1-X5.

* X1 ``tree_contributions``: per-row Shapley values of a boosted-tree model
  (``treeshap``: path-dependent, from the training weight of every node).  The
  trees come from the model's own saved node table (Spark writes it as Parquet;
  its size is bounded by the model, not the data), are broadcast, and applied
  with numpy in ``mapInPandas``.  ``method="path"`` gives the cheaper path form
  (every split adds ``value(child) - value(node)`` to its feature).  Property of
  both: ``bias + sum(contributions) = raw margin``.
* X2 ``linear_contributions``: ``coef_i * (x_i - mean_i)`` as Column maths.
* X3 ``global_importance``: mean |contribution| per feature, label, rank.
* X4 ``local_explanations``: top-k features per row and the sentence.
* X5 ``attach``: write attributions into the score table by key.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revguard.functions import exprs as X
from revguard.operators import treeshap
from revguard.session import cut_lineage, ensure_checkpoint_dir
from revguard.sources.sinks import delete, update_partitions

# Human-readable labels of the invoice features.
FEATURE_LABELS = {
    "billed_vs_expected_ratio": "billing-to-contract ratio",
    "contract_gap": "contract underbilling gap",
    "avg_days_late": "average payment delay",
    "max_days_late": "maximum payment delay",
    "outstanding_ratio": "outstanding balance ratio",
    "failed_payment_rate": "failed payment rate",
    "duplicate_refund_count": "duplicate refund count",
    "refund_ratio": "refund-to-payment ratio",
    "discount_ratio": "discount ratio",
    "sub_discount_pct": "subscription discount %",
    "overdue_days": "days overdue",
    "paid_vs_billed_ratio": "paid-to-billed ratio",
    "payment_delay_ratio": "payment delay ratio",
    "retry_rate": "payment retry rate",
    "total_amount": "invoice total amount",
    "total_paid": "total amount paid",
    "outstanding_amount": "outstanding amount",
    "tax_amount": "tax amount",
    "mrr": "monthly recurring revenue",
    "mrr_log": "MRR (log scale)",
    "failed_payment_count": "failed payment count",
    "refund_count": "refund count",
    "refund_amount": "total refund amount",
    "payment_count": "payment count",
    "total_attempts": "total payment attempts",
    "quantity": "subscription quantity",
    "discount_amount": "discount amount",
    "issue_month": "invoice month",
    "issue_quarter": "invoice quarter",
    "is_annual_billing": "annual billing flag",
    "payment_terms_days": "payment terms (days)",
    "contract_discount_pct": "contract discount %",
}
EXPLAIN_PREFIX = "Flagged due to: "


def label_expr(feature) -> "F.Column":
    """label lookup with the underscore-to-space fallback."""
    m = F.create_map(*[F.lit(x) for kv in FEATURE_LABELS.items() for x in kv])
    return F.coalesce(m[X.c(feature)], X.underscore_label(feature))


# ----------------------------------------------------------------------------- X1
def tree_table(model: PipelineModel) -> tuple[pd.DataFrame, np.ndarray]:
    """Node table and tree weights of the pipeline's boosted-tree stage.

    The model is written once to the shared checkpoint folder and its ``data``
    Parquet node table is read back (small: bounded by the number of trees and
    their depth); tree weights come from the model.
    """
    spark = SparkSession.getActiveSession()
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"gbt-{uuid.uuid4().hex}")
    gbt = model.stages[-1]
    gbt.write().overwrite().save(path)
    nodes = spark.read.parquet(os.path.join(path, "data")).select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"),
        F.try_element_at("nodeData.impurityStats", F.lit(1)).alias("cover")).toPandas()  # the weight of its training rows
    delete(spark, path)
    weights = np.asarray(gbt.treeWeights, dtype=float)
    return nodes, weights


def _arrays(nodes: pd.DataFrame, weights: np.ndarray):
    nodes = nodes.sort_values(["treeID", "id"]).reset_index(drop=True)
    trees = sorted(nodes["treeID"].unique())
    base = {t: int(np.flatnonzero(nodes["treeID"].to_numpy() == t)[0]) for t in trees}
    g = nodes["treeID"].map(base).to_numpy()
    leaf = nodes["leftChild"].to_numpy() < 0
    left = np.where(leaf, -1, nodes["leftChild"].to_numpy() + g)
    right = np.where(leaf, -1, nodes["rightChild"].to_numpy() + g)
    feat = np.where(leaf, -1, nodes["feature"].fillna(-1).to_numpy()).astype(np.int64)
    thr = nodes["threshold"].fillna(0.0).to_numpy(dtype=float)
    pred = nodes["prediction"].to_numpy(dtype=float)
    roots = np.array([base[t] for t in trees], dtype=np.int64)
    w = np.asarray(weights, dtype=float)[: len(trees)]
    return feat, thr, left, right, pred, roots, w


def path_contributions(x: np.ndarray, arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contributions n x d, bias n, margin n) for a batch."""
    feat, thr, left, right, pred, roots, w = arrays
    n, d = x.shape
    contrib = np.zeros((n, d))
    rows = np.arange(n)
    bias = np.full(n, float((pred[roots] * w).sum()))
    margin = np.zeros(n)
    for t, root in enumerate(roots):
        cur = np.full(n, root)
        while True:
            f = feat[cur]
            inner = f >= 0
            if not inner.any():
                break
            fi = np.where(inner, f, 0)
            v = x[rows, fi]
            nxt = np.where(v <= thr[cur], left[cur], right[cur])
            nxt = np.where(inner, nxt, cur)
            delta = np.where(inner, pred[nxt] - pred[cur], 0.0) * w[t]
            contrib[rows[inner], fi[inner]] += delta[inner]  # one entry per row
            cur = nxt
        margin += pred[cur] * w[t]
    return contrib, bias, margin


def tree_contributions(df: DataFrame, model: PipelineModel, cols: list[str], *,
                       keys: list[str] = ("invoice_id",), method: str = "shapley") -> DataFrame:
    """``keys + c_<feature> ... + bias + margin`` for every row of ``df``."""
    spark = df.sparkSession
    table = tree_table(model)
    shapley = {"shapley": True, "path": False}[method]
    # prepared once, not in every task; bounded by the model
    bc = spark.sparkContext.broadcast(treeshap.prepare(treeshap.trees_of(*table)) if shapley else _arrays(*table))
    keys = list(keys)
    out_schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] +
                           [f"c_{c} double" for c in cols] + ["bias double", "margin double"])

    def run(batches):
        prepared, give = bc.value, treeshap.contributions if shapley else path_contributions
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            con, bias, margin = give(x, prepared)
            out = pdf[keys].copy()
            for i, c in enumerate(cols):
                out[f"c_{c}"] = con[:, i]
            out["bias"] = bias
            out["margin"] = margin
            yield out

    return df.select(*keys, *cols).mapInPandas(run, schema=out_schema)


# ----------------------------------------------------------------------------- X2
def linear_contributions(df: DataFrame, coefs: dict[str, float], *,
                         keys: list[str] = ("invoice_id",)) -> DataFrame:
    """``coef_i * (x_i - mean_i)``; the means are one one-row aggregate."""
    means = df.agg(*[F.avg(X.dbl(c)).alias(f"_m_{c}") for c in coefs])
    j = df.crossJoin(F.broadcast(means))  # one row
    return j.select(*keys, *[(F.lit(w) * (X.dbl(c) - F.col(f"_m_{c}"))).alias(f"c_{c}")
                             for c, w in coefs.items()])


# ----------------------------------------------------------------------------- X3
def global_importance(contribs: DataFrame, cols: list[str]) -> DataFrame:
    """Mean |contribution| per feature, label and 1-based rank.

    One aggregate with a mean per feature, whose single row is then unpivoted, so
    the ranking window is feature-sized.
    """
    means = contribs.agg(*[F.avg(F.abs(f"c_{c}")).alias(f"m_{i}") for i, c in enumerate(cols)])
    g = means.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m_{i}").alias("mean_abs_contribution"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*").where("mean_abs_contribution is not null")
    w = Window.orderBy(F.col("mean_abs_contribution").desc(), F.col("feature").asc())
    return g.select("feature", label_expr("feature").alias("label"), "mean_abs_contribution",
                    F.row_number().over(w).alias("rank"))


# ----------------------------------------------------------------------------- X4
def local_explanations(contribs: DataFrame, cols: list[str], *, top_n: int = 3,
                       keys: list[str] = ("invoice_id",)) -> DataFrame:
    """Top-``top_n`` features by |contribution| per row (list order on ties),
    as names, values, a feature -> value map and the explanation sentence (F29)."""
    arr = F.array(*[F.struct(F.abs(F.col(f"c_{c}")).__neg__().alias("k"), F.lit(i).alias("i"),
                             F.lit(c).alias("n"), F.col(f"c_{c}").alias("v"))
                    for i, c in enumerate(cols)])
    top = F.slice(F.array_sort(arr), 1, top_n)
    part = lambda s: F.concat(F.when(s["v"] > 0, F.lit("high ")).otherwise(F.lit("low ")),
                              label_expr(s["n"]), F.lit(" ("), X.signed_text(s["v"]), F.lit(")"))
    d = contribs.select(*keys, top.alias("_top"))
    return d.select(
        *keys,
        F.transform("_top", lambda s: s["n"]).alias("top_features"),
        F.map_from_entries(F.transform("_top", lambda s: F.struct(s["n"], s["v"]))).alias("top_contributions"),
        F.concat(F.lit(EXPLAIN_PREFIX), F.array_join(F.transform("_top", part), ", ")).alias("explanation"),
    )


# ----------------------------------------------------------------------------- X5
def attach(scores: DataFrame, explanations: DataFrame, *, key: str = "invoice_id",
           model_name: str | None = None, model_version: str | None = None) -> DataFrame:
    """Put a model's attributions on its score rows (new value wins, else old).

    ``top_features``, ``attributions`` and ``explanation`` of a score are replaced
    together.  Rows match by ``key``, and by model and version: those that the
    explanations carry, or else the ones given, so that scores of other models
    keep what they have.
    """
    carried = {c: src for c, src in (("top_features", "top_features"), ("attributions", "top_contributions"),
                                     ("explanation", "explanation")) if src in explanations.columns}
    e = explanations.select(
        F.col(key).alias("_key"), *[F.col(src).alias(f"_new_{c}") for c, src in carried.items()],
        *[(F.col(c) if c in explanations.columns else F.lit(v)).alias(f"_{c}")
          for c, v in (("model_name", model_name), ("model_version", model_version))])
    same = F.col(key) == F.col("_key")
    for c, v in (("model_name", model_name), ("model_version", model_version)):
        if c in explanations.columns or v is not None:
            same = same & (F.col(c) == F.col(f"_{c}"))
    out = scores.join(e, same, "left")
    for c in carried:
        new = F.col(f"_new_{c}")
        out = out.withColumn(c, F.coalesce(new, F.col(c)) if c in scores.columns else new)
    return out.drop("_key", "_model_name", "_model_version", *[f"_new_{c}" for c in carried])


def attach_rows(spark: SparkSession, path: str, explanations: DataFrame, *, key: str = "invoice_id",
                partition_by: str, **version) -> list:
    """X5 on a stored score table: only the partitions that hold explained scores are written again."""
    explanations = cut_lineage(explanations)
    return update_partitions(spark, path, explanations, key, lambda rows: attach(rows, explanations, key=key, **version),
                             partition_by=partition_by)
