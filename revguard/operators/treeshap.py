"""Shapley values of tree ensembles along their paths.

The game: a feature outside the coalition does not choose a branch, both are followed with the shares of training weight
(cover) that went there.  A leaf then pays its value times, for every feature on its path, either the indicator ``o`` that
the row passes all of the feature's conditions, or the product ``z`` of its cover shares.  So the Shapley value of feature i
at a leaf with m features is

    value * (o_i - z_i) * sum over k of k! (m-1-k)! / m! * coefficient of t^k in prod over j != i of (z_j + o_j t)

which takes time polynomial in the depth.  ``o`` has at most 2^m patterns, so the values of every leaf are tabled once per
pattern for all leaves with equally many features at a time.  The leaves below one node are put into one table over the nodes
above and below it, as long as these are at most ``MAX_BITS``; a batch of rows then needs one comparison per node and one
look-up per table and feature.  Contributions plus bias (the cover-weighted mean of all leaves) equal the margin exactly but
for rounding.
"""


from __future__ import annotations

from collections import defaultdict
from math import factorial
from typing import NamedTuple

import numpy as np
import pandas as pd

MAX_BITS = 8  # a table has up to 2^8 rows


class Trees(NamedTuple):
    """Node arrays of an ensemble; leaves have feature -1."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    roots: np.ndarray
    weights: np.ndarray


class Part(NamedTuple):
    """Leaves of one tree that are looked up together."""
    tests: list[list[tuple[int, bool]]]  # bit by bit: the nodes and branches of which a row must take all
    features: list[int]              # on their paths, each once
    table: np.ndarray                # (features + 1) x patterns: contributions, then the value of the leaf that is reached


class Prepared(NamedTuple):
    trees: Trees
    parts: list[list[Part]]  # by tree
    bias: float


def trees_of(nodes: pd.DataFrame, weights: np.ndarray) -> Trees:
    """Node table (treeID, id, prediction, leftChild, rightChild, feature, threshold, cover) to arrays."""
    nodes = nodes.sort_values(["treeID", "id"]).reset_index(drop=True)
    first = ~nodes["treeID"].duplicated().to_numpy()
    roots = np.flatnonzero(first)
    base = roots[np.cumsum(first) - 1] if len(nodes) else np.zeros(0, np.int64)
    leaf = nodes["leftChild"].to_numpy() < 0
    return Trees(np.where(leaf, -1, nodes["feature"].fillna(-1).to_numpy()).astype(np.int64),
                 nodes["threshold"].fillna(0.).to_numpy(dtype=float),
                 np.where(leaf, -1, nodes["leftChild"].to_numpy() + base), np.where(leaf, -1, nodes["rightChild"].to_numpy() + base),
                 nodes["prediction"].to_numpy(dtype=float), nodes["cover"].to_numpy(dtype=float), roots,
                 np.asarray(weights, dtype=float)[: len(roots)])


def _tables(z: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Contributions of leaves with equally many features: leaves x patterns x features.

    Bit j of a pattern says that the row passes the conditions on the j-th feature of the path.
    """
    n, m = z.shape
    o = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
    out = np.empty((n, 1 << m, m))
    for i in range(m):
        poly = np.zeros((n, 1 << m, m))
        poly[:, :, 0] = 1.
        for j in range(m):
            if j != i:
                up = poly[:, :, :-1] * o[None, :, j, None]
                poly = poly * z[:, None, j, None]
                poly[:, :, 1:] += up
        share = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
        out[:, :, i] = values[:, None] * (o[None, :, i] - z[:, i, None]) * (poly @ share)
    return out


def _part(trees: Trees, nodes: list[int], own: list, tables: list) -> Part:
    """The leaves ``own`` (paths) in one table over ``nodes``; a leaf under too many nodes keeps its own table."""
    features = sorted({f for path in own for f in path[1]})
    if len(nodes) > MAX_BITS:
        _, features, steps, _, value = own[0]
        tests = [[(node, left) for at, node, left in steps if at == j] for j in range(len(features))]
        reached = np.zeros(1 << len(features))
        reached[-1] = value
        return Part(tests, features, np.vstack([tables[0].T, reached]))
    bit = {node: b for b, node in enumerate(nodes)}
    patterns = np.arange(1 << len(nodes))
    out = np.zeros((len(features) + 1, len(patterns)))
    for (_, fs, steps, _, value), table in zip(own, tables):
        passed = np.full(len(patterns), (1 << len(fs)) - 1)
        for at, node, left in steps:
            passed &= ~(((patterns >> bit[node] & 1) != left).astype(int) << at)
        for j, f in enumerate(fs):
            out[features.index(f)] += table[passed, j]
        out[-1] += np.where(passed == (1 << len(fs)) - 1, value, 0.)
    return Part([[(node, True)] for node in nodes], features, out)


def prepare(trees: Trees) -> Prepared:
    """Paths, tables and bias of an ensemble; its size is the model's."""
    paths = {}  # by leaf: (tree, features, steps, z, value)
    bias = 0.
    for t, root in enumerate(trees.roots.tolist()):
        todo = [(root, [], [], [], 1.)]
        while todo:
            node, features, steps, z, reach = todo.pop()
            if trees.feature[node] < 0:
                value = float(trees.value[node] * trees.weights[t])
                bias += value * reach
                paths[node] = (t, features, steps, z, value)
                continue
            f = int(trees.feature[node])
            children = int(trees.left[node]), int(trees.right[node])
            both = trees.cover[children[0]] + trees.cover[children[1]]
            for child, is_left in zip(children, (True, False)):
                share = float(trees.cover[child] / both) if both > 0 else .5
                at = features.index(f) if f in features else len(features)
                zs = [*z, 1.] if at == len(features) else list(z)
                zs[at] *= share
                todo.append((child, features if at < len(features) else [*features, f],
                             [*steps, (at, node, is_left)], zs, reach * share))
    by_size = defaultdict(list)
    for leaf, path in paths.items():
        by_size[len(path[1])].append(leaf)
    tables = {}
    for own in by_size.values():
        tables |= zip(own, _tables(np.array([paths[i][3] for i in own]), np.array([paths[i][4] for i in own])))
    parts: list[list[Part]] = []
    for root in trees.roots.tolist():
        parts.append([])
        todo = [(root, [])]
        while todo:
            node, above = todo.pop()
            inner, own, below = [], [], [node]
            while below:
                i = below.pop()
                (own if trees.feature[i] < 0 else inner).append(i)
                if trees.feature[i] >= 0:
                    below += [int(trees.right[i]), int(trees.left[i])]
            if inner and len(above) + len(inner) > MAX_BITS:
                todo += [(int(child[node]), [*above, node]) for child in (trees.right, trees.left)]
            else:
                parts[-1].append(_part(trees, above + inner, [paths[i] for i in own], [tables[i] for i in own]))
    return Prepared(trees, parts, bias)


def contributions(x: np.ndarray, model: Prepared) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contributions rows x features, bias, margin) of a batch; a missing value goes right, as when scored."""
    trees, n = model.trees, len(x)
    out, margin = np.zeros((x.shape[1], n)), np.zeros(n)
    columns = np.ascontiguousarray(x.T)
    ends = np.append(trees.roots[1:], len(trees.feature))
    for parts, a, b in zip(model.parts, trees.roots.tolist(), ends.tolist()):
        goes_left = {i: columns[trees.feature[i]] <= trees.threshold[i] for i in range(a, b) if trees.feature[i] >= 0}
        for part in parts:
            pattern = np.zeros(n, np.uint8 if len(part.tests) <= 8 else np.intp)
            for j, test in enumerate(part.tests):
                ok = np.ones(n, bool) if len(test) > 1 else None
                for node, left in test:
                    step = goes_left[node] if left else ~goes_left[node]
                    ok = step if ok is None else ok & step
                pattern |= ok.astype(pattern.dtype) << pattern.dtype.type(j)
            pattern = pattern.astype(np.intp)
            for f, row in zip(part.features, part.table):
                out[f] += row.take(pattern)
            margin += part.table[-1].take(pattern)
    return out.T, np.full(n, model.bias), margin

