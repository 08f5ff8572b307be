"""Shapley values of trees against the definition: all coalitions, on trees of up to six features."""
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest

from revguard.operators import treeshap

NODE = ["treeID", "id", "prediction", "leftChild", "rightChild", "feature", "threshold", "cover"]


def random_tree(rng, tree, depth, n_features):
    """Preorder node rows with random splits (features may repeat on a path) and covers that add up."""
    rows = []

    def grow(level, cover):
        at = len(rows)
        rows.append(None)
        if level == 0 or rng.random() < .15 and at:
            rows[at] = (tree, at, float(rng.normal()), -1, -1, -1, None, cover)
            return at
        part = float(rng.uniform(.05, .95)) * cover
        f, thr = int(rng.integers(n_features)), float(rng.uniform(-1, 1))
        left = grow(level - 1, part)
        right = grow(level - 1, cover - part)
        rows[at] = (tree, at, 0., left, right, f, thr, cover)
        return at

    grow(depth, 100.)
    return rows


def expected_value(trees, t, x, known):
    """Value of a coalition in one tree: unknown features follow both branches by cover."""
    def walk(node):
        if trees.feature[node] < 0:
            return trees.value[node]
        a, b = trees.left[node], trees.right[node]
        if trees.feature[node] in known:
            return walk(a if x[trees.feature[node]] <= trees.threshold[node] else b)
        ca, cb = trees.cover[a], trees.cover[b]
        return (walk(a) * ca + walk(b) * cb) / (ca + cb)
    return walk(trees.roots[t]) * trees.weights[t]


def by_definition(trees, x, d):
    total = lambda s: sum(expected_value(trees, t, x, s) for t in range(len(trees.roots)))
    phi = np.zeros(d)
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        for k in range(d):
            w = factorial(k) * factorial(d - 1 - k) / factorial(d)
            phi[i] += sum(w * (total({*s, i}) - total(set(s))) for s in combinations(rest, k))
    return phi, total(set())


@pytest.mark.parametrize("seed", range(4))
def test_equals_all_coalitions(seed):
    rng = np.random.default_rng(seed)
    d = 6
    nodes = pd.DataFrame([r for t in range(3) for r in random_tree(rng, t, 5, d)], columns=NODE)
    trees = treeshap.trees_of(nodes, np.array([1., .1, .1]))
    x = rng.uniform(-1, 1, (12, d))
    phi, bias, margin = treeshap.contributions(x, treeshap.prepare(trees))
    for row, got, b, m in zip(x, phi, bias, margin):
        want, base = by_definition(trees, row, d)
        assert np.allclose(got, want, atol=1e-12) and b == pytest.approx(base, abs=1e-12)
        assert got.sum() + b == pytest.approx(m, abs=1e-12)


def test_symmetric_features_share_alike():
    """x0 and x1 play the same part in an AND of both, so they get the same value; an unused feature gets none."""
    rows = [(0, 0, 0., 1, 2, 0, 0., 4.), (0, 1, 0., -1, -1, -1, None, 2.), (0, 2, 0., 3, 4, 1, 0., 2.),
            (0, 3, 0., -1, -1, -1, None, 1.), (0, 4, 1., -1, -1, -1, None, 1.)]
    trees = treeshap.trees_of(pd.DataFrame(rows, columns=NODE), np.ones(1))
    phi, bias, margin = treeshap.contributions(np.array([[1., 1., 5.], [-1., 1., 5.]]), treeshap.prepare(trees))
    assert phi[0].tolist() == pytest.approx([.375, .375, 0.]) and bias.tolist() == [.25, .25] and margin.tolist() == [1., 0.]
    assert phi[1].sum() == pytest.approx(-.25)


def test_single_leaf_missing_value_and_no_rows():
    trees = treeshap.trees_of(pd.DataFrame([(0, 0, 2., -1, -1, -1, None, 5.), (1, 0, 0., 1, 2, 0, 0., 4.),
                                            (1, 1, -1., -1, -1, -1, None, 1.), (1, 2, 1., -1, -1, -1, None, 3.)], columns=NODE),
                              np.array([1., 1.]))
    phi, bias, margin = treeshap.contributions(np.array([[np.nan]]), treeshap.prepare(trees))
    assert margin[0] == 3. and phi[0, 0] + bias[0] == pytest.approx(3.)  # a missing value goes right
    phi, _, margin = treeshap.contributions(np.zeros((0, 1)), treeshap.prepare(trees))
    assert phi.shape == (0, 1) and margin.shape == (0,)


def test_leaves_of_a_tree_share_tables():
    rng = np.random.default_rng(8)
    nodes = pd.DataFrame([r for t in range(3) for r in random_tree(rng, t, 6, 9)] + random_tree(rng, 3, 10, 2), columns=NODE)
    model = treeshap.prepare(treeshap.trees_of(nodes, np.ones(4)))
    leaves = nodes[nodes["leftChild"] < 0].groupby("treeID").size()
    assert all(2 * len(parts) <= n for parts, n in zip(model.parts[:3], leaves))
    assert max(part.table.shape[1] for parts in model.parts for part in parts) <= 1 << treeshap.MAX_BITS


def test_tables_are_made_once_not_in_every_task(spark, monkeypatch):
    from revguard.operators import explain
    from tests.test_boosting import COLS, rows as some
    from revguard.operators import boosting as B
    df = spark.createDataFrame(some(300))
    trees, edges, _ = B.fit(df, df, COLS, rounds=2)
    made, prepare = [], treeshap.prepare
    monkeypatch.setattr(treeshap, "prepare", lambda t: made.append(1) or prepare(t))
    explain.tree_contributions(df, B.as_model(trees, edges, COLS, B.Penalties()), COLS)
    assert made == [1]
