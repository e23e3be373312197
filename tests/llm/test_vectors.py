import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.llm import clusters, neighbours, queries
from moraine.llm import vectors as V
from moraine.operators import tree as T

T0 = dt.datetime(2024, 1, 1)


def frame(spark, x, ids=None, label=None):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), v.tolist(), int(0 if label is None else label[k]), 9, 8.0) for k, (i, v) in enumerate(zip(ids, x))]
    return spark.createDataFrame(rows, "id long, vec array<double>, label int, n int, dist double")


def brute(x, ids, k):
    out = set()
    for i, v in enumerate(x):
        d = np.sqrt(((x - v) ** 2).sum(1))
        d[i] = np.inf
        for j in np.lexsort((ids, d))[:k]:
            if np.isfinite(d[j]):
                out.add((int(ids[i]), int(ids[j])))
    return out


def blobs(n=600, seed=0, dim=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + rng.uniform(-40, 40, size=(12, dim))[rng.integers(0, 12, n)]
    x[n // 2 : n // 2 + 60] = x[: 60]  # pairs of copies
    x[n // 2 + 60 : n // 2 + 100] = x[0]  # many copies
    return x, rng.permutation(10 * n)[:n]


@pytest.mark.parametrize("options", [{}, {"centroids": 4, "sample": 100, "block": 40}, {"centroids": 64}, {"centroids": 1, "block": 50}])
def test_knn_exact(spark, options):
    x, ids = blobs()
    got = neighbours.knn(frame(spark, x, ids), 6, 5, **options).collect()
    assert {(r.id, r.nbr) for r in got} == brute(x, ids, 5)
    assert len(got) == 5 * len(x) and {r["rank"] for r in got} == {1, 2, 3, 4, 5}
    pos = {int(i): v for i, v in zip(ids, x)}
    assert all(r.dist == pytest.approx(math.dist(pos[r.id], pos[r.nbr])) for r in got)


def test_knn_all_equal_and_small(spark):
    x = np.ones((40, 4))
    assert {(r.id, r.nbr) for r in neighbours.knn(frame(spark, x), 4, 5).collect()} == brute(x, np.arange(40), 5)
    x = np.array([[0.0, 0], [3, 4], [0, 0]])
    got = {(r.id, r.nbr, r.dist) for r in neighbours.knn(frame(spark, x), 2, 5).collect()}
    assert got == {(0, 2, 0.0), (2, 0, 0.0), (0, 1, 5.0), (2, 1, 5.0), (1, 0, 5.0), (1, 2, 5.0)}
    assert neighbours.knn(frame(spark, x).limit(1), 2, 5).count() == 0
    assert neighbours.knn(frame(spark, x).limit(0), 2, 5).count() == 0
    with pytest.raises(ValueError):
        neighbours.knn(frame(spark, x), 2, 0)


def test_knn_ties_by_smaller_id(spark):
    x = np.array([[0.0, 0], [1, 0], [-1, 0], [0, 1], [0, -1], [5, 5]])
    got = [(r.nbr, r["rank"]) for r in neighbours.knn(frame(spark, x, [9, 7, 3, 5, 1, 2]), 2, 3).where("id = 9").collect()]
    assert sorted(got, key=lambda r: r[1]) == [(1, 1), (3, 2), (5, 3)]


def test_knn_approximate_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8)) * 3 + rng.uniform(-10, 10, size=(30, 8))[rng.integers(0, 30, 1500)]
    ids = np.arange(1500)
    want = brute(x, ids, 5)
    got = {(r.id, r.nbr) for r in neighbours.knn(frame(spark, x, ids), 8, 5, centroids=8, visit=600, complete=False).collect()}
    assert len(got & want) / len(want) >= 0.9
    few = {(r.id, r.nbr) for r in neighbours.knn(frame(spark, x, ids), 8, 5, centroids=8, visit=6, complete=False).collect()}
    assert len(few & want) < len(got & want)


@pytest.mark.parametrize("structure", [False, True])
def test_registered_approximate_recall(spark, tmp_path, structure):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2500, 24))
    if structure:
        x = x * 0.7 + rng.uniform(-6, 6, size=(40, 24))[rng.integers(0, 40, len(x))]
    rows = [(i, v.tolist(), T0, 1) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "id long, raw_data array<double>, loaded_at timestamp, cluster_node long").write.parquet(f"{tmp_path}/prediction_data.parquet")
    got = {(r.id, r.nbr) for r in queries.p5_approximate(spark, str(tmp_path)).collect()}
    want = brute(x, np.arange(len(x)), 5)
    assert len(got & want) / len(want) >= 0.9


def test_approximate_search_starts_from_the_query(spark):
    """With fewer blocks than ``WIDE`` nothing is compared with all; ``visit`` is measured or given."""
    x = np.random.default_rng(6).uniform(size=(3000, 8))
    want = brute(x, np.arange(3000), 5)
    share = []
    for options in ({}, {"visit": 300}, {"visit": 3000}):
        got = {(r.id, r.nbr) for r in neighbours.knn(frame(spark, x), 8, 5, centroids=7, complete=False, **options).collect()}
        share.append(len(got & want) / len(want))
    assert 0.9 <= share[0] < 1 and share[2] == 1 and share[1] < share[0]


def walk(rng, n=400, dim=6, centroids=5, block=20):
    x = rng.normal(size=(n, dim))
    book = V.Codebook(V.kmeans(x[:, : dim // 2], centroids, 1), V.kmeans(x[:, dim // 2 :], centroids, 2))
    cell, count = np.unique(book.assign(x) >> V.SUB_BITS, return_counts=True)
    book.parts[int(cell[count.argmax()])] = V.kmeans(x[book.assign(x) >> V.SUB_BITS == cell[count.argmax()]], 3, 3)
    number, at, count = np.unique(book.assign(x), return_inverse=True, return_counts=True)
    low, high = (np.stack([f(x[at == i], 0) for i in range(len(number))]) for f in (np.min, np.max))
    return x, at, neighbours.Traversal(book, V.Blocks(number, count, low, high))


def test_traversal_is_by_summed_distance_from_the_query():
    x, at, w = walk(np.random.default_rng(1))
    for q in range(0, 400, 17):
        reached = w.reached(x[q : q + 1])[0]
        way = w.order(x[q], reached, int(at[q]), len(x))
        assert sorted(way) == list(range(len(w.blocks.number))) and way[0] == at[q]
        d = reached[np.searchsorted(w.cell, w.blocks.number[way] >> V.SUB_BITS)]
        assert (np.diff(d[1:]) >= 0).all() and d[0] == d.min()
        few = w.order(x[q], reached, int(at[q]), 30)
        assert few == way[: len(few)] and w.blocks.count[few].sum() >= 30 > w.blocks.count[few[:-1]].sum()


def test_candidates_come_from_the_traversal(spark):
    """With a traversal that ends in the own cell other neighbours are found; the exact search is proven all the same."""
    x = np.random.default_rng(2).normal(size=(600, 6))
    run = lambda **o: {(r.id, r.nbr) for r in neighbours.knn(frame(spark, x), 6, 5, centroids=6, **o).collect()}
    want = brute(x, np.arange(600), 5)
    assert len(run(complete=False, visit=1) & want) < len(run(complete=False, visit=200) & want)
    assert run(visit=1) == run(visit=60) == want


def test_rows_that_are_no_records(spark):
    good = [float(i) for i in range(24)]
    rows = [
        (1, good, T0, 1),
        (1, None, T0 + dt.timedelta(1), 1),  # the current version is no record
        (2, good, T0, 1),
        (2, good, T0, 1),
        (3, [*good[:23], float("nan")], T0, 1),
        (4, good[:5], T0, 1),
        (5, [], T0, 1),
        (6, [*good[:23], None], T0, 1),
        (7, [*good[:23], math.inf], T0, 1),
        (None, good, T0, 1),
        (8, good[::-1], None, 1),
        (9, good, T0, None),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], "id long, raw_data array<double>, loaded_at timestamp, cluster_node long, vec int")
    assert sorted(r.id for r in neighbours.records(df).collect()) == [2, 8, 9]
    assert sorted((r.id_a, r.id_b) for r in neighbours.neighbour_pairs(df).collect()) == [(2, 8), (2, 9), (8, 9)]
    m = spark.createDataFrame([(1, 4), (1, 4), (1, None), (2, None), (None, 3)], "cluster_node long, label int")
    assert sorted((r.id, r.label) for r in clusters.labelled_records(df, m).collect()) == [(2, 4), (8, 4)]
    assert neighbours.neighbour_pairs(df.limit(0)).count() == 0


def brute_sets(x, ids, label, radius, min_size=3):
    near = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        near[i] = frozenset(np.flatnonzero((d <= radius) & (label == label[i])).tolist())
    return {(min(int(ids[j]) for j in s), int(ids[i])) for i, s in near.items() if len(s) >= min_size and all(near[j] == s for j in s)}


@pytest.mark.parametrize("options", [{}, {"centroids": 4, "sample": 100, "block": 30}, {"min_samples": 1}, {"centroids": 1, "block": 25}])
def test_sets_against_brute_force(spark, options):
    rng = np.random.default_rng(2)
    centre = rng.uniform(-6, 6, size=(60, 3))
    size = rng.integers(1, 9, 60)
    x = np.repeat(centre, size, 0) + rng.uniform(-0.45, 0.45, size=(size.sum(), 3)) * np.repeat(rng.uniform(0.2, 1.2, 60), size)[:, None]
    x = np.vstack([x, x[:5], x[:5], [[50, 0, 0]] * 3, [[60, 0, 0], [60.9, 0, 0], [61.8, 0, 0]], [[70, 0, 0], [70.5, 0, 0], [71, 0, 0]]])
    label = np.r_[np.repeat(rng.integers(0, 3, 60), size), [0] * 5, [1] * 5, [0] * 9]
    ids = rng.permutation(5 * len(x))[: len(x)]
    got = clusters.similarity_sets(frame(spark, x, ids, label), 3, 1.0, **options)
    assert {(r.first_id, r.id) for r in got.where("mutual").collect()} == brute_sets(x, ids, label, 1.0)
    r = got.groupBy("first_id").agg(F.count(F.lit(1)).alias("n"), F.max("set_size").alias("s"), F.max("typical").alias("t"), F.min("id").alias("least")).collect()
    assert all(g.n == g.s == g.t and g.least == g.first_id for g in r)


def test_sets_edges(spark):
    x = np.array([[0.0, 0], [1, 0], [0, 1], [9, 9]])
    df = frame(spark, x)
    assert clusters.similarity_sets(df, 2, 1.5).where("mutual").count() == 3
    assert clusters.similarity_sets(df.withColumn("label", F.lit(-1)), 2, 1.5).count() == 0
    assert clusters.similarity_sets(df.withColumn("label", F.lit(None).cast("int")), 2, 1.5).count() == 0
    assert clusters.similarity_sets(df.limit(0), 2, 1.5).count() == 0
    same = frame(spark, np.zeros((50, 2)))
    got = clusters.similarity_sets(same, 2, 1.0).collect()
    assert len(got) == 50 and {r.first_id for r in got} == {0} and {r.set_size for r in got} == {50} and all(r.mutual for r in got)


def test_typical_members_are_the_most_persistent(spark):
    x = np.array([[0.0, 0], [0.1, 0], [0.2, 0], [0.9, 0]])
    got = {r.id: r for r in clusters.similarity_sets(frame(spark, x), 2, 1.0, min_samples=1, min_size=2).collect()}
    assert got[3].typical == 4 and got[3].level < got[0].level


def test_hierarchy_of_one_component():
    x = np.r_[np.arange(5) * 0.1, 0.8 + np.arange(5) * 0.1]
    edges = [(i, i + 1, float(x[i + 1] - x[i])) for i in range(9)]
    label, level, prob = clusters.hierarchy(list(range(10)), edges, 3, 1.0)
    assert set(label) == {0} and min(level) > 1 and max(prob) <= 1  # merged up to the component
    label, _, _ = clusters.hierarchy(list(range(10)), edges, 3, 0.0)
    assert len(set(label)) == 2  # by stability alone: the two groups
    assert T.find([0, 0, 1], 2) == 0


def test_sets_of_a_chained_component_are_its_stable_clusters(spark):
    """Two dense groups and a single record between them, nearer to the first; the second has copies."""
    line = [0.0, 0.1, 0.2, 0.3, 1.2, 2.15, 2.25, 2.35, 2.45, 2.45]
    x = np.array([[v, 0.0] for v in line])
    ids = np.array([5, 1, 2, 3, 0, 7, 8, 9, 10, 11])
    got = clusters.similarity_sets(frame(spark, x, ids), 2, 1.0, min_samples=1).collect()
    sets = {}
    for r in got:
        sets.setdefault(r.first_id, set()).add(r.id)
    assert sets == {0: {0, 1, 2, 3, 5}, 7: {7, 8, 9, 10, 11}}
    assert not any(r.mutual for r in got) and all(r.set_size == len(sets[r.first_id]) for r in got)


def test_hierarchy_keeps_copies_and_a_lone_component():
    edges = [(0, 1, 0.1), (1, 2, 0.1), (2, 3, 0.9), (3, 4, 0.5)]
    label, _, _ = clusters.hierarchy(list(range(5)), edges, 3, 0.0, [1, 1, 1, 2, 1])
    assert label[0] == label[1] == label[2] >= 0 and label[3] == label[4] >= 0 and label[0] != label[3]
    label, _, _ = clusters.hierarchy(list(range(5)), [(i, i + 1, 0.5 + i / 10) for i in range(4)], 3, 0.0, [1] * 5)
    assert label == [0] * 5


def test_close_pairs_exact():
    x = np.random.default_rng(0).normal(size=(200, 3)) + 1e4
    label = np.arange(200) % 2
    i, j, d = clusters.close_pairs(x, label, 0.5, rows=16)
    full = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {(a, b) for a, b in zip(*np.nonzero((full <= 0.5) & (label[:, None] == label))) if a < b}
    assert set(zip(i.tolist(), j.tolist())) == want
    np.testing.assert_allclose(d, full[i, j])


def test_knn_without_structure(spark, monkeypatch):
    """Every vector has many blocks to visit: they go to groups of blocks, some to one block only."""
    monkeypatch.setattr(neighbours, "WIDE", 2)
    monkeypatch.setattr(neighbours, "_GROUP", 150)
    monkeypatch.setattr(neighbours, "_GROUP_QUERIES", 100)
    x = np.random.default_rng(9).uniform(size=(400, 8))
    x[300:340] = x[:40]
    ids = np.arange(400)
    got = neighbours.knn(frame(spark, x, ids), 8, 5, centroids=12).collect()
    assert {(r.id, r.nbr) for r in got} == brute(x, ids, 5) and len(got) == 2000
