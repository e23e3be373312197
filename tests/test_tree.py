import math
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moraine.functions.metrics import Metric
from moraine.operators import neighbors, tree_arrays
from moraine.operators import tree as T


def brute_forest(n, edges):
    up = list(range(n))
    out = []
    for k in sorted(range(len(edges)), key=lambda k: (edges[k][2], k)):
        a, b = T.find(up, edges[k][0]), T.find(up, edges[k][1])
        if a != b:
            up[a] = b
            out.append(k)
    return sorted(out)


@given(st.integers(2, 12), st.data())
@settings(max_examples=60, deadline=None)
def test_spanning_forest(n, data):
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(0, 4)), max_size=30))
    edges = [(a, b, float(w)) for a, b, w in edges if a != b]
    a, b, w = (np.array([e[k] for e in edges], float if k == 2 else int) for k in range(3))
    assert T.spanning_forest(n, a, b, w).tolist() == brute_forest(n, edges)
    part = T.components(n, a.astype(int), b.astype(int))
    up = list(range(n))
    for x, y, _ in edges:
        up[T.find(up, x)] = T.find(up, y)
    least = {}
    for x in range(n):
        least.setdefault(T.find(up, x), x)
    assert part.tolist() == [least[T.find(up, x)] for x in range(n)]


def line(gaps):
    return [(i, i + 1, float(g)) for i, g in enumerate(gaps)]


def test_two_groups():
    edges = line([1, 1, 1, 10, 1, 1, 1])
    tree = T.condense(8, T.agglomerate(8, sorted(edges, key=lambda e: e[2])), 3)
    assert sorted(tree.clusters()) == [(8, 9, 0.1, 4), (8, 10, 0.1, 4)]
    weight = T.stability(tree)
    assert weight[8] == pytest.approx(0.8) and weight[9] == pytest.approx(3.6)
    chosen = T.select(tree, weight)
    assert chosen == [9, 10]
    got = T.labels(tree, chosen, weight)
    assert got.label == [0] * 4 + [1] * 4 and set(got.probability) == {1.0}
    assert T.leaf_clusters(tree) == [9, 10]
    assert T.select(tree, T.stability(tree), "leaf") == [9, 10]
    assert T.select(tree, T.stability(tree), epsilon=20.0, single=True) == [8]
    assert T.select(tree, T.stability(tree), epsilon=20.0) == [9, 10]  # without the root, its children
    assert T.select(tree, T.stability(tree), max_size=3) == []
    with pytest.raises(ValueError):
        T.select(tree, weight, "best")


def test_persistence_collapses():
    edges = line([1, 1, 1, 1.2, 1, 1, 1])
    tree = T.condense(8, T.agglomerate(8, sorted(edges, key=lambda e: e[2])), 3)
    assert len(tree.clusters()) == 2
    flat = T.simplify(tree, 0.5)
    assert flat.clusters() == [] and sorted(flat.child) == list(range(8))
    assert T.simplify(tree, 0.01).clusters() == tree.clusters()


def test_duplicates_have_infinite_lambda():
    edges = line([0, 0, 0, 5, 0, 0, 0])
    tree = T.condense(8, T.agglomerate(8, sorted(edges, key=lambda e: e[2])), 3)
    weight = T.stability(tree)
    got = T.labels(tree, T.select(tree, weight), weight)
    assert got.label == [0] * 4 + [1] * 4 and got.persistence == [1.0, 1.0]
    assert T.outlier_scores(tree) == [0.0] * 8


def test_leaf_without_splits_is_all_noise():
    tree = T.condense(4, T.agglomerate(4, line([1, 1, 1])), 3)
    assert T.select(tree, T.stability(tree), "leaf", single=True) == []


def test_cut():
    assert T.cut(6, line([1, 1, 3, 1, 1]), 3.0, 3) == [0, 0, 0, 1, 1, 1]
    assert T.cut(6, line([1, 1, 3, 1, 1]), 1.0, 2) == [-1] * 6  # strictly shorter
    assert T.inverse(0.0) == math.inf


def test_min_size_respected_for_every_size():
    rng = np.random.default_rng(3)
    edges = line(rng.exponential(size=59))
    merges = T.agglomerate(60, sorted(edges, key=lambda e: e[2]))
    for size in range(2, 60):
        tree = T.condense(60, merges, size)
        weight = T.stability(tree)
        got = T.labels(tree, T.select(tree, weight), weight).label
        counts = np.bincount([x for x in got if x >= 0]) if max(got) >= 0 else []
        assert all(c >= size for c in counts)


PLANS = [
    {},
    {"cluster_selection_method": "leaf"},
    {"allow_single_cluster": True},
    {"cluster_selection_epsilon": 0.7},
    {"cluster_selection_method": "leaf", "cluster_selection_epsilon": 0.7, "allow_single_cluster": True},
    {"max_cluster_size": 9, "cluster_selection_epsilon_max": 1.5},
    {"cluster_selection_persistence": 0.4},
    {"match_reference_implementation": True},
]


@pytest.mark.parametrize("plan", PLANS)
def test_arrays_equal_kernels(plan):
    """The arrays' artefacts of random trees, with ties and distances of zero, are those of the kernels."""
    base = {"cluster_selection_persistence": 0.0, "cluster_selection_method": "eom", "allow_single_cluster": False, "cluster_selection_epsilon": 0.0, "max_cluster_size": 0, "cluster_selection_epsilon_max": math.inf, "match_reference_implementation": False}
    for seed in range(60):
        rng = np.random.default_rng(seed)
        n = int(rng.choice([1, 2, 3, 8, 30, 150]))
        place = rng.permutation(n)
        a, b = place[np.arange(1, n)], place[(rng.random(n - 1) * np.arange(1, n)).astype(int)]
        w = rng.integers(0 if seed % 3 else 1, 6, n - 1) / 2.0 if seed % 2 else rng.random(n - 1)
        p = base | plan | {"min_cluster_size": int(rng.choice([2, 3, 5]))}
        order = T.prim_order(n, list(zip(a.tolist(), b.tolist(), w.tolist())))
        merges = T.agglomerate(n, sorted(order, key=lambda e: e[2]))
        tree = T.condense(n, merges, p["min_cluster_size"])
        if p["cluster_selection_persistence"]:
            tree = T.simplify(tree, p["cluster_selection_persistence"])
        weight = T.stability(tree)
        own = dict(weight)
        chosen = T.select(tree, weight, p["cluster_selection_method"], p["allow_single_cluster"], p["cluster_selection_epsilon"], p["max_cluster_size"], p["cluster_selection_epsilon_max"])
        want = T.labels(tree, chosen, weight, p["allow_single_cluster"], p["cluster_selection_epsilon"], p["match_reference_implementation"])
        got = tree_arrays.artefacts(n, a, b, w, p)
        rows = lambda t, *c: list(zip(*(got[t][k].tolist() for k in c)))
        assert rows("mst", "a", "b", "x") == order and rows("linkage", "b", "c", "x", "n") == merges
        assert rows("condensed", "a", "b", "x", "n") == list(tree.rows())
        assert got["points"]["b"].tolist() == want.label and got["clusters"]["a"].tolist() == sorted(own)
        for column, values in (("x", want.probability), ("y", T.outlier_scores(tree))):
            np.testing.assert_allclose(got["points"][column], values)
        np.testing.assert_allclose(got["clusters"]["z"], [own[c] for c in sorted(own)])


def test_hierarchy_memory():
    """One task holds the hierarchy of millions of points: under 200 bytes a point, table by table."""
    n = 60_000
    rng = np.random.default_rng(0)
    b = np.arange(1, n)
    a, w = (rng.random(n - 1) * b).astype(int), rng.random(n - 1).round(3)
    p = {"min_cluster_size": 5, "cluster_selection_method": "eom", "allow_single_cluster": False, "cluster_selection_epsilon": 0.0, "max_cluster_size": 0, "cluster_selection_epsilon_max": math.inf, "match_reference_implementation": False}
    tracemalloc.start()
    for _, columns in tree_arrays.tables(n, a, b, w, p):
        del columns
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * n


def test_core_distances_in_one_task():
    x = np.round(np.random.default_rng(0).normal(size=(2500, 2)), 1)
    for metric in (Metric(), Metric("manhattan")):
        want = neighbors.top_k(metric, x, np.arange(2500), x, np.arange(2500), 7, False)[1][:, 6]
        assert (neighbors.core_in_task(metric, x, np.arange(2500), 7, 100) == want).all()
