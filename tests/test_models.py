"""Isolation forest and boosted-tree attribution properties on the sf0.001 features."""
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from revguard.operators import explain, features, forest, models
from revguard.plans import pipeline
from revguard.sources.billing import billing_views
from tests.conftest import SF0001

COLS = features.INVOICE_FEATURE_COLS


@pytest.fixture(scope="module")
def data(spark):
    b = billing_views(spark, SF0001)
    return pipeline.engineered(b).cache()


def test_c_factor():
    assert forest.c_factor(1) == 0 and forest.c_factor(2) == 1
    assert forest.c_factor(256) == pytest.approx(10.244770920116851, rel=1e-9)


def test_hand_tree_path_length():
    nodes = __import__("pandas").DataFrame(
        [(0, 0, 0, 0, 0.5, 1, 2, 4), (0, 1, 1, -1, 0.0, -1, -1, 1), (0, 2, 1, -1, 0.0, -1, -1, 3)],
        columns=["tree_id", "node_id", "depth", "feature", "threshold", "left", "right", "size"])
    arr = forest._forest_arrays(nodes)
    h = forest.path_lengths(np.array([[0.1], [0.9]]), arr)
    assert h[0] == pytest.approx(1.0) and h[1] == pytest.approx(1.0 + forest.c_factor(3))


def test_forest_flag_rate_and_determinism(spark, data):
    train = data.filter("split = 'train'")
    m = forest.fit(train, COLS, n_trees=50, max_samples=64, contamination=0.25)
    s = forest.score(train, m)
    rate = s.agg(F.avg("if_is_anomaly")).first()[0]
    assert rate == pytest.approx(0.25, abs=0.02)
    m2 = forest.fit(train.repartition(7), COLS, n_trees=50, max_samples=64, contamination=0.25)
    a = m.nodes.sort_values(["tree_id", "node_id"]).reset_index(drop=True)
    b = m2.nodes.sort_values(["tree_id", "node_id"]).reset_index(drop=True)
    assert a.equals(b) and m.offset == pytest.approx(m2.offset)


def test_tree_contributions_sum_to_margin(spark, data):
    train, val = data.filter("split = 'train'"), data.filter("split = 'val'")
    gbt = models.train_gbt(train, val, COLS, max_iter=8)
    c = explain.tree_contributions(data, gbt, COLS)
    p = models.positive_prob(gbt, data, "gbt_probability", "p").select("invoice_id", "p")
    tot = F.col("bias") + sum(F.col(f"c_{x}") for x in COLS)
    chk = c.join(p, "invoice_id").agg(F.max(F.abs(tot - F.col("margin"))).alias("d"),
                                      F.max(F.abs(1 / (1 + F.exp(-2 * F.col("margin"))) - F.col("p"))).alias("e")).first()
    assert chk["d"] < 1e-9 and chk["e"] < 1e-9
    g = explain.global_importance(c, COLS)
    assert sorted(r["rank"] for r in g.collect()) == list(range(1, len(COLS) + 1))
    e = explain.local_explanations(c, COLS).first()
    assert e["explanation"].startswith("Flagged due to: ") and len(e["top_features"]) == 3


def test_logistic_scores_in_range(spark, data):
    train = data.filter("split = 'train'")
    lr = models.train_logistic(train, COLS)
    s = models.positive_prob(lr, data, "lr_probability", "p")
    lo, hi = s.agg(F.min("p"), F.max("p")).first()
    assert 0 <= lo <= hi <= 1


def test_cross_validation_and_persistence(spark, data, tmp_path):
    train = data.filter("split = 'train'")
    cv = models.cross_validate_logistic(train, COLS, folds=3).first()
    assert cv["folds"] == 3 and 0.5 < cv["cv_auc_mean"] <= 1.0 and cv["cv_auc_std"] >= 0
    lr = models.train_logistic(train, COLS)
    models.save(lr, str(tmp_path / "lr"))
    back = models.load(str(tmp_path / "lr"))
    a = models.positive_prob(lr, data, "lr_probability", "p").select("invoice_id", "p")
    b = models.positive_prob(back, data, "lr_probability", "q").select("invoice_id", "q")
    assert a.join(b, "invoice_id").filter(F.abs(F.col("p") - F.col("q")) > 1e-12).count() == 0
    iso = forest.fit(train, COLS, n_trees=10, max_samples=32)
    iso.save(spark, str(tmp_path / "iso"))
    iso2 = forest.IsolationForestModel.load(spark, str(tmp_path / "iso"))
    s1 = forest.score(data, iso).select("invoice_id", F.col("if_score").alias("a"))
    s2 = forest.score(data, iso2).select("invoice_id", F.col("if_score").alias("b"))
    assert s1.join(s2, "invoice_id").filter(F.abs(F.col("a") - F.col("b")) > 1e-12).count() == 0


def test_attach_new_wins(spark):
    scores = spark.createDataFrame([(1, "old"), (2, "old")], "invoice_id long, explanation string")
    ex = spark.createDataFrame([(1, {"a": 1.0}, "new")],
                               "invoice_id long, top_contributions map<string,double>, explanation string")
    got = {r["invoice_id"]: r["explanation"] for r in explain.attach(scores, ex).collect()}
    assert got == {1: "new", 2: "old"}


def test_path_lengths_in_parts_equal_a_walk_row_by_row():
    r = np.random.default_rng(5)
    pdf = __import__("pandas").DataFrame(r.normal(size=(64, 3)), columns=list("abc"))
    pdf.insert(0, "id", range(64))
    nodes = __import__("pandas").concat([forest._grow(list("abc"), 64, t)(pdf.assign(tree_id=t)) for t in range(5)])
    arrays, x = forest._forest_arrays(nodes), r.normal(size=(2 * forest.WALK_ROWS + 3, 3))
    x[::5, 1] = np.nan
    feat, thr, left, right, leaf_h, roots, _ = arrays

    def walk(row, at):
        while feat[at] >= 0:
            at = left[at] if row[feat[at]] <= thr[at] else right[at]
        return leaf_h[at]

    assert np.array_equal(forest.path_lengths(x, arrays), [np.mean([walk(row, i) for i in roots]) for row in x])


def test_forest_and_logistic_regression_are_fitted_side_by_side(spark, monkeypatch):
    begun, got = threading.Event(), []
    monkeypatch.setattr(pipeline, "engineered", lambda b: spark.createDataFrame([(1, "train"), (2, "val")], "invoice_id int, split string"))
    monkeypatch.setattr(models, "train_logistic", lambda train, cols: begun.set())
    monkeypatch.setattr(forest, "fit", lambda *a, **kw: got.append(begun.wait(20)))

    def stop(*a, **kw):
        raise KeyError("after both")

    monkeypatch.setattr(models, "train_gbt", stop)
    with pytest.raises(KeyError):
        pipeline.score_pipeline(None)
    assert got == [True]


def test_iterations_run_a_task_per_core(spark, monkeypatch):
    parts = []
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, df: parts.append(df.rdd.getNumPartitions()))
    models.train_logistic(spark.range(40).selectExpr("id as a", "id % 2 as label").repartition(40), ["a"])
    assert parts == [spark.sparkContext.defaultParallelism]
