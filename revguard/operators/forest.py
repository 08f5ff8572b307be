"""Isolation forest (L2 fit, L3 score) as Spark jobs (Liu, Ting & Zhou, 2008).

Fit:
1. a Bernoulli *pool* of rows is drawn by a seeded hash of the row id, with a
   rate chosen so the pool holds about ``3 * psi * n_trees`` rows whatever the
   table size;
2. each pool row is offered to every tree; a second seeded hash of
   ``(id, tree)`` orders the offers and each tree keeps its ``psi`` smallest, so
   samples do not depend on partitioning (a window per tree over a group that is
   bounded by the pool size);
3. ``groupBy(tree_id).applyInPandas`` grows one tree per group (<= psi rows) and
   returns its nodes; the forest is a node table of at most
   ``n_trees * (2 * psi - 1)`` rows.

Score: the node table (bounded by the forest size, never by the data) is
broadcast and ``mapInPandas`` walks all trees level by level with numpy over
Arrow batches.  ``score = -2 ** (-E[h] / c(psi))``; the decision function
subtracts the exact ``contamination`` quantile of the training scores, and a
negative decision marks an anomaly.

Feature standardisation is omitted on purpose: split points are drawn
uniformly between a node's min and max, so a per-feature affine rescaling does
not change the fitted partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revguard.operators import rank

EULER = 0.5772156649

WALK_ROWS = 256
NODE_SCHEMA = ("tree_id int, node_id int, depth int, feature int, threshold double, "
               "left int, right int, size int")


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over ``n`` points."""
    if n > 2:
        return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    return 1.0 if n == 2 else 0.0


def _c_vec(n: np.ndarray) -> np.ndarray:
    out = np.zeros_like(n, dtype=float)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


@dataclass
class IsolationForestModel:
    nodes: pd.DataFrame          # the node table (small: bounded by trees x 2 psi)
    feature_cols: list[str]
    psi: int
    offset: float = 0.0
    contamination: float = 0.25

    def save(self, spark, path: str) -> None:
        meta = {"psi": self.psi, "offset": self.offset, "contamination": self.contamination,
                "features": ",".join(self.feature_cols)}
        spark.createDataFrame(self.nodes).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([meta]).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> "IsolationForestModel":
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        m = spark.read.json(f"{path}/meta").first()
        return cls(nodes=nodes, feature_cols=m["features"].split(","), psi=int(m["psi"]),
                   offset=float(m["offset"]), contamination=float(m["contamination"]))


def _uniform(*cols) -> "F.Column":
    """Seeded hash -> uniform double in [0, 1)."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53)


def tree_samples(df: DataFrame, id_col: str, feature_cols: list[str], *, n_trees: int, psi: int,
                 seed: int, n_rows: int) -> DataFrame:
    """Per-tree samples of ``psi`` rows (see module docstring)."""
    pool_rate = min(1.0, 3.0 * psi * n_trees / max(n_rows, 1))
    pool = df.select(id_col, *feature_cols).filter(_uniform(F.col(id_col), F.lit(seed)) < pool_rate)
    pool_n = max(int(n_rows * pool_rate), 1)
    offer_rate = min(1.0, 3.0 * psi / pool_n)
    pairs = pool.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree_id")) \
        .withColumn("_u", _uniform(F.col(id_col), F.col("tree_id"), F.lit(seed + 1))) \
        .filter(F.col("_u") < offer_rate)
    w = Window.partitionBy("tree_id").orderBy("_u", id_col)
    return pairs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= psi) \
        .drop("_rn", "_u")


def _grow(feature_cols: list[str], psi: int, seed: int):
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["tree_id"].iloc[0])
        x = pdf.sort_values(list(pdf.columns[:1]))[feature_cols].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree_id])
        rows = []
        stack = [(0, np.arange(len(x)), 0)]
        next_id = 1
        while stack:
            nid, idx, depth = stack.pop()
            sub = x[idx]
            if depth >= max_depth or len(idx) <= 1:
                rows.append((tree_id, nid, depth, -1, 0.0, -1, -1, len(idx)))
                continue
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            cand = np.flatnonzero(hi > lo)
            if cand.size == 0:
                rows.append((tree_id, nid, depth, -1, 0.0, -1, -1, len(idx)))
                continue
            f = int(rng.choice(cand))
            thr = float(rng.uniform(lo[f], hi[f]))
            go_left = sub[:, f] <= thr
            left, right = next_id, next_id + 1
            next_id += 2
            rows.append((tree_id, nid, depth, f, thr, left, right, len(idx)))
            stack.append((right, idx[~go_left], depth + 1))
            stack.append((left, idx[go_left], depth + 1))
        return pd.DataFrame(rows, columns=["tree_id", "node_id", "depth", "feature", "threshold",
                                           "left", "right", "size"])
    return grow


def fit(train: DataFrame, feature_cols: list[str], *, id_col: str = "invoice_id", n_trees: int = 200,
        max_samples: int = 256, contamination: float = 0.25, seed: int = 42) -> IsolationForestModel:
    """L2: grow the forest in the executors and set the contamination offset."""
    n = train.count()
    psi = int(min(max_samples, n))
    samples = tree_samples(train, id_col, feature_cols, n_trees=n_trees, psi=psi, seed=seed, n_rows=n)
    nodes = samples.groupBy("tree_id").applyInPandas(_grow(feature_cols, psi, seed), schema=NODE_SCHEMA)
    grown = nodes.toPandas()
    roots = grown[grown["node_id"] == 0].groupby("tree_id")["size"].max()
    if len(roots) < n_trees or int(roots.min()) < psi:
        raise ValueError(f"a tree was offered fewer than {psi} rows; raise the offer rates or lower max_samples")
    model = IsolationForestModel(nodes=grown, feature_cols=list(feature_cols), psi=psi,
                                 contamination=contamination)
    raw = score(train, model, out="_s", raw=True)
    model.offset = rank.quantile(raw, "_s", contamination)
    return model


def _forest_arrays(nodes: pd.DataFrame):
    nodes = nodes.sort_values(["tree_id", "node_id"])
    trees = sorted(nodes["tree_id"].unique())
    base, off = {}, 0
    for t in trees:
        base[t] = off
        off += int((nodes["tree_id"] == t).sum())
    g = nodes["tree_id"].map(base).to_numpy()
    feat = nodes["feature"].to_numpy(dtype=np.int64)
    thr = nodes["threshold"].to_numpy(dtype=float)
    left = np.where(nodes["left"].to_numpy() >= 0, nodes["left"].to_numpy() + g, -1)
    right = np.where(nodes["right"].to_numpy() >= 0, nodes["right"].to_numpy() + g, -1)
    size = nodes["size"].to_numpy(dtype=float)
    leaf_h = nodes["depth"].to_numpy(dtype=float) + _c_vec(size)
    roots = np.array([base[t] for t in trees], dtype=np.int64)
    max_depth = int(nodes["depth"].max()) if len(nodes) else 0
    return feat, thr, left, right, leaf_h, roots, max_depth


def path_lengths(x: np.ndarray, arrays) -> np.ndarray:
    """Mean path length of each row over all trees (level walk over ``WALK_ROWS`` rows at a time, which caches hold)."""
    feat, thr, left, right, leaf_h, roots, max_depth = arrays
    inner, own = feat >= 0, np.arange(len(feat))
    # A leaf is its own child on both sides.
    child = np.column_stack([np.where(inner, left, own), np.where(inner, right, own)]).ravel()
    feat = np.where(inner, feat, 0)
    out = np.empty(len(x))
    for a in range(0, len(x), WALK_ROWS):
        part = np.ascontiguousarray(x[a: a + WALK_ROWS])
        first = (np.arange(len(part)) * x.shape[1])[:, None]
        values = part.ravel()
        cur = np.broadcast_to(roots, (len(part), roots.size)).copy()
        for _ in range(max_depth):
            cur = child.take(2 * cur + ~(values.take(first + feat.take(cur)) <= thr.take(cur)))
        out[a: a + WALK_ROWS] = leaf_h.take(cur).mean(axis=1)
    return out


def score(df: DataFrame, model: IsolationForestModel, *, out: str = "if_score", raw: bool = False,
          flag: str | None = "if_is_anomaly", threshold: float | None = None) -> DataFrame:
    """L3: decision function (``raw``: score_samples) appended to ``df``.

    ``flag`` marks ``decision < threshold`` (default 0, i.e. the contamination cut).
    """
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(_forest_arrays(model.nodes))
    cols = model.feature_cols
    cpsi = c_factor(model.psi)
    shift = 0.0 if raw else model.offset
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.DoubleType())])

    def walk(batches):
        arrays = bc.value
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            s = -np.power(2.0, -path_lengths(x, arrays) / cpsi) if len(pdf) else np.zeros(0)
            pdf[out] = s - shift
            yield pdf

    res = df.mapInPandas(walk, schema=schema)
    if flag and not raw:
        res = res.withColumn(flag, (F.col(out) < (0.0 if threshold is None else threshold)).cast("int"))
    return res
