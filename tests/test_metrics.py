"""Exact ranking metrics vs brute force; threshold metrics vs the reference's reports."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from revguard.operators import metrics


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    diff = pos[:, None] - neg[None, :]
    return ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / (len(pos) * len(neg))


def brute_ap(y, s):
    order = np.argsort(-s, kind="stable")
    ys, ss = y[order], s[order]
    thr = np.unique(ss)[::-1]
    ap, prev_r = 0.0, 0.0
    for t in thr:
        sel = ss >= t
        tp = (ys[sel] == 1).sum()
        r = tp / (y == 1).sum()
        ap += (r - prev_r) * tp / sel.sum()
        prev_r = r
    return ap


def brute_youden(y, s):
    best = (-np.inf, None)
    for t in np.unique(s)[::-1]:
        pred = s >= t
        j = (pred & (y == 1)).sum() / (y == 1).sum() - (pred & (y == 0)).sum() / (y == 0).sum()
        if j > best[0] + 1e-15:
            best = (j, t)
    return best


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(3)
    rows = []
    data = {}
    for m, k in [("a", 2), ("b", 100), ("c", 1000)]:
        y = rng.integers(0, 2, 400)
        s = np.round(rng.random(400) + 0.3 * y, 3) if k > 2 else rng.integers(0, 2, 400).astype(float)
        data[m] = (y, s)
        rows += [(m, int(a), float(b)) for a, b in zip(y, s)]
    return spark.createDataFrame(rows, "model_name string, label int, score double"), data


def test_ranking_exact(long):
    df, data = long
    got = {r["model_name"]: r for r in metrics.ranking(df).collect()}
    for m, (y, s) in data.items():
        assert got[m]["roc_auc"] == pytest.approx(brute_auc(y, s), abs=1e-12)
        assert got[m]["pr_auc"] == pytest.approx(brute_ap(y, s), abs=1e-12)
        j, t = brute_youden(y, s)
        assert got[m]["youden_j"] == pytest.approx(j, abs=1e-12)
        assert got[m]["optimal_threshold"] == pytest.approx(t)


def _from_confusion(spark, name, tn, fp, fn, tp):
    rows = [(name, 0, 0.0)] * tn + [(name, 0, 1.0)] * fp + [(name, 1, 0.0)] * fn + [(name, 1, 1.0)] * tp
    return spark.createDataFrame(rows, "model_name string, label int, score double")


# Golden: the four confusion matrices and per-class figures of the reference's reports.
GOLDEN = {
    "boosted_trees": ((2567, 5, 9, 4919), (0.9981, 0.999, 0.9982, 0.9986), (0.9965, 0.9981, 0.9973),
                (0.9977, 0.9981, 0.9979), (0.9981, 0.9981, 0.9981)),
    "logistic_regression": ((2259, 313, 836, 4092), (0.8468, 0.9289, 0.8304, 0.8769),
                            (0.7299, 0.8783, 0.7972), (0.8294, 0.8543, 0.8371), (0.8607, 0.8468, 0.8496)),
    "isolation_forest": ((2400, 172, 3977, 951), (0.4468, 0.8468, 0.193, 0.3143),
                         (0.3764, 0.9331, 0.5364), (0.6116, 0.5631, 0.4254), (0.6855, 0.4468, 0.3905)),
    "ensemble": ((2563, 9, 7, 4921), (0.9979, 0.9982, 0.9986, 0.9984), (0.9973, 0.9965, 0.9969),
                 (0.9977, 0.9975, 0.9976), (0.9979, 0.9979, 0.9979)),
}


@pytest.mark.parametrize("name", list(GOLDEN))
def test_confusion_and_report_golden(spark, name):
    (tn, fp, fn, tp), top, c0, macro, weighted = GOLDEN[name]
    df = _from_confusion(spark, name, tn, fp, fn, tp)
    r = metrics.confusion(df, 0.5).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (tn, fp, fn, tp)
    assert [round(r[k], 4) for k in ("accuracy", "precision", "recall", "f1_score")] == list(top)
    rep = {x["cls"]: x for x in metrics.class_report(df, 0.5).collect()}
    assert tuple(round(rep["0"][k], 4) for k in ("precision", "recall", "f1")) == c0
    assert tuple(round(rep["macro avg"][k], 4) for k in ("precision", "recall", "f1")) == macro
    assert tuple(round(rep["weighted avg"][k], 4) for k in ("precision", "recall", "f1")) == weighted
    assert rep["1"]["support"] == tp + fn


def test_anomaly_proxy_range(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([-0.3, 0.1, 0.0, 0.25])], "id int, if_score double")
    out = {r["id"]: r["score"] for r in metrics.anomaly_proxy(df, "if_score").collect()}
    assert out[0] == pytest.approx(1.0, abs=1e-8) and out[3] == pytest.approx(0.0)
    assert all(0 <= v <= 1 for v in out.values())


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=4, max_size=60),
       st.integers(1, 9))
def test_ranking_property(spark, pairs, parts):
    y = np.array([p[0] for p in pairs])
    s = np.array([p[1] / 6.0 for p in pairs])
    if y.min() == y.max():
        return
    df = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, s)],
                               "model_name string, label int, score double").repartition(parts)
    r = metrics.ranking(df).first()
    assert r["roc_auc"] == pytest.approx(brute_auc(y, s), abs=1e-12)
    assert r["pr_auc"] == pytest.approx(brute_ap(y, s), abs=1e-12)
