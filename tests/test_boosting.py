"""Second-order boosting: split gains and whole runs against plain numpy, spread of rows, patience, scoring and saving."""
import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from revguard.operators import boosting as B
from revguard.operators import explain, models

COLS = ["a", "b", "d"]


def rows(n=900, seed=3):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.integers(0, 30, n), np.round(r.normal(size=n), 2), r.integers(0, 2, n)]).astype(float)
    y = (x[:, 0] / 10 + x[:, 1] + x[:, 2] + r.normal(size=n) > 2.2).astype(int)
    return pd.DataFrame({"invoice_id": np.arange(n), **{c: x[:, i] for i, c in enumerate(COLS)}, "label": y})


def objective(g, h, p):
    """Least value of g v + h v^2 / 2 + l1 |v| + l2 v^2 / 2 over a fine grid around its minimum."""
    v = np.linspace(-5, 5, 200_001)
    return (g * v + (h + p.l2) * v * v / 2 + p.l1 * np.abs(v)).min()


def test_gain_is_twice_what_the_objective_falls():
    p = B.Penalties(l1=.4, l2=1.5)
    for gl, hl, gr, hr in ((3., 9., -4., 7.), (.3, 6., 5., 8.), (-.2, 5.5, .1, 6.)):
        want = 2 * (objective(gl + gr, hl + hr, p) - objective(gl, hl, p) - objective(gr, hr, p))
        got = B.quality(gl, hl, p) + B.quality(gr, hr, p) - B.quality(gl + gr, hl + hr, p)
        assert got == pytest.approx(want, abs=1e-6)
    assert B.leaf_value(np.array(3.), np.array(9.), B.Penalties(step=1., l1=.4, l2=1.5)) == pytest.approx(-2.6 / 10.5)


def test_best_split_bounds_and_ties():
    p = B.Penalties(min_child_weight=2., l1=0., l2=0.)
    g, h = np.array([[1., 1, -1, -1], [1, 1, -1, -1]]), np.ones((2, 4))
    assert B.best_split(g, h, p)[1:3] == (0, 1)  # equal gains: the lower feature
    assert B.best_split(g, h, B.Penalties(min_child_weight=2.5)) is None
    assert B.best_split(np.ones((1, 4)), np.ones((1, 4)), p) is None  # nothing to gain


def test_prune_from_the_bottom():
    t = B.Tree()
    for _ in range(5):
        t.add(0., 1.)
    t.feature[0], t.left[0], t.right[0], t.gain[0] = 0, 1, 2, .5
    t.feature[1], t.left[1], t.right[1], t.gain[1] = 0, 3, 4, 2.
    B.prune(t, 1.)
    assert t.feature[:2] == [0, 0]  # a strong split below keeps a weak one
    B.prune(t, 3.)
    assert t.feature[:2] == [-1, -1]


def slow_margins(pdf, edges, p, rounds, weight):
    """Exact greedy boosting in numpy over every cut, without sampling."""
    x, y = pdf[COLS].to_numpy(float), pdf["label"].to_numpy()
    m = np.zeros(len(y))

    def step(k, depth, out):
        g, h = grad[k].sum(), hess[k].sum()
        best = (1e-6, None)
        for f in range(len(COLS)):
            for e in edges[f]:
                left = k[x[k, f] <= e]
                right = k[x[k, f] > e]
                if depth and min(hess[left].sum(), hess[right].sum()) >= p.min_child_weight:
                    gain = sum(B.quality(grad[i].sum(), hess[i].sum(), p) for i in (left, right)) - B.quality(g, h, p)
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
        if best[1]:
            flat = [step(i, depth - 1, out) for i in best[1]]
            if not (all(flat) and best[0] < p.gamma):
                return False
        out[k] = B.leaf_value(g, h, p)
        return True

    for _ in range(rounds):
        s = 1 / (1 + np.exp(-m))
        w = np.where(y == 1, weight, 1.)
        grad, hess = w * (s - y), w * s * (1 - s)
        out = np.zeros(len(y))
        step(np.arange(len(y)), p.depth, out)
        m = m + out
    return m


def test_whole_run_equals_numpy_and_scores_as_a_model(spark, tmp_path):
    pdf = rows()
    df = spark.createDataFrame(pdf)
    p = B.Penalties(step=.3, depth=3, min_child_weight=4., gamma=1., l1=.1, l2=1.)
    trees, edges, aucs = B.fit(df, df, COLS, rounds=5, pos_weight=1.7, subsample=1., col_sample=1., max_bins=16,
                               penalties=p, fold_every=2)
    m = slow_margins(pdf, edges, p, len(trees), 1.7)
    model = B.as_model(trees, edges, COLS, p)
    got = models.positive_prob(model, df, "gbt_probability", "p").select("invoice_id", "p").toPandas().sort_values("invoice_id")
    assert np.abs(got["p"].to_numpy() - 1 / (1 + np.exp(-m))).max() < 1e-5  # sums are fixed-point
    assert len(aucs) == 5 and aucs[-1] > aucs[0] > .5
    models.save(model, str(tmp_path / "m"))
    back = models.positive_prob(models.load(str(tmp_path / "m")), df, "gbt_probability", "q").select("invoice_id", "q").toPandas()
    assert np.array_equal(back.sort_values("invoice_id")["q"].to_numpy(), got["p"].to_numpy())
    c = explain.tree_contributions(df, model, COLS)
    tot = F.col("bias") + sum(F.col(f"c_{x}") for x in COLS)
    assert c.agg(F.max(F.abs(tot - F.col("margin")))).first()[0] < 1e-9
    assert model.stages[-1].featureImportances.toArray().sum() == pytest.approx(1.)


def test_trees_do_not_hang_on_the_spread_of_rows(spark):
    df = spark.createDataFrame(rows()).withColumn("b", F.when(F.col("invoice_id") % 9 > 0, F.col("b")))
    val = spark.createDataFrame(rows(seed=4)).union(spark.createDataFrame(rows(5)).withColumn("label", F.lit(None).cast("long")))
    one = B.fit(df, val, COLS, rounds=6, max_bins=20, fold_every=2)
    two = B.fit(df.repartition(7), val.repartition(3), COLS, rounds=6, max_bins=20, fold_every=4)
    assert one[0] == two[0] and one[2] == two[2]
    probs = models.positive_prob(B.as_model(one[0], one[1], COLS, B.Penalties()), df, "gbt_probability", "p")
    assert probs.where("p is null or p < 0 or p > 1").count() == 0  # rows with a null feature are scored


def test_patience_and_one_label(spark):
    df = spark.createDataFrame(rows(300))
    noise = df.withColumn("label", (F.xxhash64("invoice_id") % 2 == 0).cast("long"))
    trees, _, aucs = B.fit(df, noise, COLS, rounds=30, patience=3)
    assert len(aucs) < 30 and len(trees) == len(aucs) - 3 and max(aucs) == aucs[len(trees) - 1]
    trees, _, aucs = B.fit(df, df.where("label = 1"), COLS, rounds=3)
    assert len(trees) == 3 and aucs == [None] * 3
    with pytest.raises(ValueError):
        B.fit(df, df, COLS, max_bins=300)


def test_a_level_goes_through_no_older_tree_and_asks_for_one_of_two_siblings(spark, monkeypatch):
    df = spark.createDataFrame(rows())
    added, asked = [], []
    with_gradients, level_cells = B.with_gradients, B.level_cells
    monkeypatch.setattr(B, "with_gradients", lambda blocks, trees, **kw: added.append(len(trees)) or with_gradients(blocks, trees, **kw))
    monkeypatch.setattr(B, "level_cells", lambda blocks, tree, slots, *a, **kw: asked.append((len(slots), int(slots.max()) + 1))
                        or level_cells(blocks, tree, slots, *a, **kw))
    B.fit(df, df, COLS, rounds=5, fold_every=3)
    assert added == [0, 1, 1, 0, 1, 1]  # at the third the margins were written
    assert all(slots <= (nodes + 1) // 4 for nodes, slots in asked if nodes > 1)


def test_rounds_in_one_job_give_the_trees_of_a_job_per_level(spark, monkeypatch):
    df = spark.createDataFrame(rows()).withColumn("b", F.when(F.col("invoice_id") % 9 > 0, F.col("b")))
    val = spark.createDataFrame(rows(seed=4)).union(spark.createDataFrame(rows(5)).withColumn("label", F.lit(None).cast("long")))
    by_level = B.fit(df, val, COLS, rounds=5, max_bins=20)
    asked = []
    level_cells = B.level_cells
    monkeypatch.setattr(B, "level_cells", lambda *a, **kw: asked.append(1) or level_cells(*a, **kw))
    for job_rounds in (2, 100):  # the second job starts from the trees of the first
        got = B.fit(df.repartition(3), val, COLS, rounds=5, max_bins=20, resident_rows=2000, job_rounds=job_rounds)
        assert got[0] == by_level[0] and got[2] == by_level[2] and not asked
    assert not [f for f in os.listdir(B.local_folder(spark)) if f.startswith("boosting-")]
    few = B.fit(df, val, COLS, rounds=2, max_bins=20, resident_rows=100)  # more rows than the tasks may keep
    assert asked and few[2] == by_level[2][:2]
    asked.clear()
    monkeypatch.setattr(B, "local_folder", lambda spark: None)
    assert B.fit(df, val, COLS, rounds=2, max_bins=20, resident_rows=2000)[2] == by_level[2][:2] and asked


def test_jobs_of_a_training_do_not_grow_with_its_rounds(spark):
    df, sc, jobs = spark.createDataFrame(rows()), spark.sparkContext, []
    for rounds in (2, 6):
        sc.setJobGroup(f"rounds-{rounds}", "")
        models.train_gbt(df, df, COLS, max_iter=rounds)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"rounds-{rounds}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0


def test_sums_over_tasks(tmp_path):
    tasks = [B.Exchange(str(tmp_path), i, 3) for i in range(3)]
    with ThreadPoolExecutor(3) as pool:
        sums = list(pool.map(lambda t: [t.total(np.array([t.rank, turn])).tolist() for turn in range(20)], tasks))
    assert sums == [[[3, 3 * turn] for turn in range(20)]] * 3
    assert sorted(os.listdir(tmp_path)) == ["19-0", "19-1", "19-2"]


def test_nodes_are_saved_parents_first_without_those_pruned():
    t = B.Tree()
    for i in range(5):
        t.add(float(i), 10. + i)
    t.feature[0], t.cut[0], t.left[0], t.right[0], t.gain[0] = 1, 0, 1, 2, 11.
    t.feature[1], t.left[1], t.right[1], t.gain[1] = 0, 3, 4, .5
    edges = [np.array([7., 8.]), np.array([3., 4.])]
    nodes = B.saved_nodes(t, edges, B.Penalties())
    assert [(n["id"], n["leftChild"], n["rightChild"]) for n in nodes] == [(0, 1, 4), (1, 2, 3), (2, -1, -1), (3, -1, -1), (4, -1, -1)]
    assert [n["split"]["leftCategoriesOrThreshold"] for n in nodes] == [[3.], [7.], [], [], []]
    B.prune(t, 1.)
    nodes = B.saved_nodes(t, edges, B.Penalties())
    assert [n["rawCount"] for n in nodes] == [10, 11, 12] and nodes[0]["gain"] == pytest.approx(1.1)


def test_cuts_pass_over_missing_values(spark):
    df = spark.createDataFrame([(float(i), None, float("nan"), i) for i in range(10)] + [(None, None, 5., 1)],
                               "a double, b double, `d.x` double, e int")
    edges = B.edges_of(df, ["a", "b", "d.x", "e"], 4)
    assert edges[0][0] == edges[3][0] == 0. and len(edges[0]) == len(edges[3]) == 4
    assert edges[1].tolist() == [0.] and edges[2].tolist() == [5.]
