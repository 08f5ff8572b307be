"""Supervised learners L1, L4-L8 and scoring helpers on ``pyspark.ml``.

* Logistic regression with balanced class weights and C = 1: Spark minimises
  ``mean_w(loss) + regParam/2 |b|^2``; with weights ``n / (2 n_class)`` the
  weights sum to ``n``, so ``regParam = 1 / n`` gives the same optimum as
  ``C * sum_w(loss) + 1/2 |b|^2``.  Features are standardised first (L1).
* Gradient-boosted trees with the positive class weighted by neg/pos, row and
  feature subsampling, gamma / L1 / L2 penalties and early stopping on the
  validation AUC (``boosting``), as a ``pyspark.ml`` model.

Class counts are one aggregate (one action) before fitting; the fits are
distributed (``treeAggregate`` per iteration).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revguard.operators import boosting, metrics
from revguard.session import cut_lineage


def class_weights(df: DataFrame, label: str = "label") -> tuple[int, int, float, float]:
    """(n, n_pos, w_neg, w_pos) for balanced weights ``n / (2 n_class)``."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    n, p = int(r["n"]), int(r["p"])
    neg = n - p
    return n, p, (n / (2.0 * neg) if neg else 1.0), (n / (2.0 * p) if p else 1.0)


def assembler(cols: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep")


def train_logistic(train: DataFrame, cols: list[str], *, label: str = "label", c: float = 1.0,
                   max_iter: int = 1000) -> PipelineModel:
    """L1 + L4: scaler -> balanced, L2-regularised logistic regression."""
    n, _, w_neg, w_pos = class_weights(train, label)
    # Every iteration is a job over these rows: a task per core.
    data = train.withColumn("_w", F.when(F.col(label) == 1, w_pos).otherwise(w_neg)) \
        .coalesce(train.sparkSession.sparkContext.defaultParallelism)
    lr = LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="_w",
                            regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
                            maxIter=max_iter, tol=1e-6, probabilityCol="lr_probability",
                            rawPredictionCol="lr_raw", predictionCol="lr_prediction")
    pipe = Pipeline(stages=[assembler(cols),
                            StandardScaler(inputCol="features", outputCol="scaled", withMean=True,
                                           withStd=True), lr])
    return pipe.fit(data)


def train_gbt(train: DataFrame, val: DataFrame, cols: list[str], *, label: str = "label", id_col: str = "invoice_id",
              max_iter: int = 600, patience: int = 40, subsample: float = 0.8, col_sample: float = 0.8, max_bins: int = 64,
              seed: int = 42, penalties: boosting.Penalties = boosting.Penalties()) -> PipelineModel:
    """Second-order boosted trees with neg/pos weighting; training stops after ``patience`` rounds without a better
    validation AUC and keeps the rounds up to the best one.  No round is trained twice."""
    n, p, _, _ = class_weights(train, label)
    trees, edges, _ = boosting.fit(train, val, cols, label=label, id_col=id_col, rounds=max_iter, patience=patience,
                                   pos_weight=(n - p) / p if p else 1.0, subsample=subsample, col_sample=col_sample,
                                   max_bins=max_bins, seed=seed, penalties=penalties, resident_rows=boosting.RESIDENT_ROWS)
    return boosting.as_model(trees, edges, cols, penalties)


def positive_prob(model: PipelineModel, df: DataFrame, prob_col: str, out: str,
                  threshold: float = 0.5, pred: str | None = None) -> DataFrame:
    """Append P(label = 1) (and the 0/1 prediction at ``threshold``)."""
    drop = [c for c in model.transform(df.limit(0)).columns if c not in df.columns]
    res = model.transform(df).withColumn(out, vector_to_array(prob_col)[1]).drop(*drop)
    if pred:
        res = res.withColumn(pred, (F.col(out) >= threshold).cast("int"))
    return res


def feature_importance(model: PipelineModel, cols: list[str], top_n: int | None = None) -> DataFrame:
    """The tree model's importances as a small (features-sized) DataFrame, ranked."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    imp += [0.0] * (len(cols) - len(imp))  # features after the last one that splits
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(c, float(v)) for c, v in zip(cols, imp)], "feature string, importance double")
    df = df.orderBy(F.col("importance").desc(), F.col("feature").asc())
    return df.limit(top_n) if top_n else df


def stratified_folds(df: DataFrame, label: str, id_col: str, folds: int, seed: int) -> DataFrame:
    """Adds ``_fold``: rows of each label dealt out evenly, in the order of a seeded hash of their id.

    The order is taken inside hash buckets of each label (``folds`` rows apart or
    less from an even deal per bucket), so no label is sorted in one task.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed))).withColumn("_bucket", F.pmod("_h", F.lit(1009)))
    place = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_h", id_col))
    return hashed.withColumn("_fold", F.pmod(place + F.col("_bucket"), F.lit(folds))).drop("_h", "_bucket")


def cross_validate_logistic(df: DataFrame, cols: list[str], *, id_col: str = "invoice_id",
                            label: str = "label", folds: int = 5, seed: int = 42) -> DataFrame:
    """Stratified k-fold CV of L4; exact ROC-AUC per fold, then mean and std.

    Folds come from a seeded hash of the row id (partitioning-independent).
    """
    data = cut_lineage(stratified_folds(df, label, id_col, folds, seed))
    parts = []
    for k in range(folds):
        m = train_logistic(data.filter(F.col("_fold") != k), cols, label=label)
        s = positive_prob(m, data.filter(F.col("_fold") == k), "lr_probability", "score")
        parts.append(s.select(F.lit(f"fold{k}").alias("model_name"), F.col(label).alias("label"), "score"))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    aucs = metrics.ranking(long)
    return aucs.agg(F.avg("roc_auc").alias("cv_auc_mean"), F.stddev_pop("roc_auc").alias("cv_auc_std"),
                    F.count(F.lit(1)).alias("folds"))


def save(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
