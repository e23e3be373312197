import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moraine.functions import scalar
from moraine.functions.metrics import NAMES, Metric, valid_metric_ids
from moraine.operators import blocks as B
from moraine.operators import neighbors as N
from moraine.operators import spanning as S
from moraine.operators.forest import boruvka, connected_components
from moraine.operators.within_labels import label_gaps, reduce_pairs
from moraine.plans import density, exports, flat, predict, validity
from moraine.plans.branches import BranchDetector
from moraine.plans.density import DensityClusterer, NotFitted, density_cluster, fit_tree
from moraine.plans.robust import RobustLinkage, robust_single_linkage
from moraine.sources import points as P
from moraine.sources.store import fit_cached, load_model, save_model


@pytest.fixture(scope="session")
def uniform(spark):
    np.random.seed(0)
    return P.from_arrays(spark, np.random.rand(150, 2))


@pytest.fixture(scope="session")
def three(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.3, (50, 2)) for c in ((0, 0), (4, 4), (0, 5))] + [rng.uniform(-2, 6, (15, 2))])
    return P.from_arrays(spark, x), x


@pytest.fixture(scope="session")
def fitted(three):
    return DensityClusterer(min_cluster_size=10).fit(three[0]).model


def labels_of(df):
    return df.toPandas().sort_values("id").label.to_numpy()


# -- the three known results --------------------------------------------------------------


def test_known_noise(uniform):
    got = labels_of(density_cluster(uniform, min_cluster_size=5, allow_single_cluster=True))
    assert (got == -1).sum() == 46 and len(set(got)) == 2


def test_known_epsilon(uniform):
    got = labels_of(density_cluster(uniform, min_cluster_size=5, allow_single_cluster=True, cluster_selection_epsilon=0.2))
    assert (got == -1).sum() == 2


def test_known_persistence(uniform):
    assert len(set(labels_of(density_cluster(uniform, min_cluster_size=5, cluster_selection_persistence=0.5)))) == 7


# -- metrics ----------------------------------------------------------------------------------

ARGS = {"seuclidean": {"V": [1.0, 2.0, 0.5]}, "minkowski": {"p": 3}, "p": {"p": 1.5}, "wminkowski": {"p": 3, "w": [1, 2, 0.5]}, "mahalanobis": {"VI": [[2, 0.1, 0], [0.1, 1, 0], [0, 0, 1]]}, "pyfunc": {"func": lambda a, b: float(abs(a - b).sum())}}


@pytest.mark.parametrize("name", sorted(NAMES))
@pytest.mark.parametrize("unrolled", [True, False])
def test_metric_forms_agree(spark, name, unrolled):
    rng = np.random.default_rng(2)
    d = 2 if name == "haversine" else 3
    x = rng.normal(size=(6, d)).round(1)
    x[rng.random(x.shape) < 0.3] = 0
    if name in ("cosine", "arccos"):
        x[:, 0] = 1
    m = Metric(name, **ARGS.get(name, {}))
    df = spark.createDataFrame([(i, j, x[i].tolist(), x[j].tolist()) for i in range(6) for j in range(6)], "i int, j int, a array<double>, b array<double>")
    got = df.select("i", "j", m.column(F.col("a"), F.col("b"), d if unrolled else None).alias("d")).toPandas()
    want = m.pairwise(x)
    np.testing.assert_allclose(got.d, want[got.i, got.j], atol=1e-7)
    if name != "pyfunc" and unrolled:
        r = df.select(m.to_distance(m.reduced(F.col("a"), F.col("b"), d)).alias("d")).toPandas().d
        np.testing.assert_allclose(r, got.d, atol=1e-9)
    assert m.dist(x[0], x[1]) == pytest.approx(want[0, 1])


def test_metric_errors():
    for bad in (lambda: Metric("nonsense"), lambda: Metric("minkowski", p=0.5), lambda: Metric("seuclidean"), lambda: Metric("wminkowski", p=2), lambda: Metric("mahalanobis"), lambda: Metric("pyfunc")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        Metric(lambda a, b: "x").dist([1], [2])
    with pytest.raises(ValueError):
        Metric("haversine").dist([1, 2, 3], [1, 2, 3])
    assert valid_metric_ids(["euclidean"]) == ["euclidean", "l2"]
    assert Metric("l2").to_reduced(3.0) == 9.0 and Metric("minkowski", p=math.inf).name == "chebyshev"


def test_scalar_functions(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 2.0, 0.0), (2, -1.0, 1.0)], "k int, a double, b double")
    got = df.select(scalar.inverse(F.col("a")).alias("i"), scalar.safe_divide(F.col("b"), F.col("a")).alias("s"), scalar.softmax(F.col("a"), ["k"]).alias("m"), scalar.normalise(F.col("b"), ["k"]).alias("n"), F.col("a")).toPandas().sort_values("a")
    assert got.i.tolist() == [math.inf, math.inf, 0.5]
    assert got.s.tolist() == [1e8, 2e8, 0.0]
    assert got.m.sum() == pytest.approx(2) and got.n.tolist() == [1.0, 1.0, 0.0]
    v = spark.createDataFrame([([1.0, 2.0],), ([1.0, None],), ([1.0, float("nan")],), ([math.inf, 1.0],), (None,), ([1.0],)], "v array<double>")
    assert [r[0] for r in v.select(scalar.is_finite("v", 2)).collect()] == [True, False, False, False, False, False]


# -- neighbours and trees -------------------------------------------------------------------------


def rows(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos long, x array<double>")


@pytest.mark.parametrize("name", ["euclidean", "canberra"])
@pytest.mark.parametrize("block", [64, 4096])
def test_knn_and_tree_exact(spark, name, block):
    x = np.random.default_rng(4).normal(size=(400, 3)).round(1)
    m = Metric(name)
    df = rows(spark, x)
    near = N.knn(df, 5, m, block=block)
    got = near.toPandas().sort_values(["pos", "rank"])
    d = m.pairwise(x)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    np.testing.assert_array_equal(got.nbr.to_numpy().reshape(-1, 5), want)
    core = N.core_distances(near, 5)
    c = core.toPandas().sort_values("pos").core.to_numpy()
    np.testing.assert_allclose(c, np.sort(d, 1)[:, 4])
    e = S.spanning_tree(df, core, m, block=block).toPandas()
    a, b, w = S.prim(x, c, np.arange(len(x)), m)
    key = lambda a, b, w: sorted(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), w.tolist()))
    assert key(e.a.to_numpy(), e.b.to_numpy(), e.w.to_numpy()) == key(a, b, w)


@pytest.mark.parametrize("light", [0, 150])
def test_repeated_points_count_once(spark, monkeypatch, light):
    """Points that many rows share go into the search and the tree once; core distances and tree stay those of all rows."""
    rng = np.random.default_rng(8)
    x = np.vstack([np.repeat(rng.normal(size=(90, 2)).round(1), 9, axis=0), np.repeat(rng.normal(size=(light, 2)).round(1), 2, axis=0)])
    x = x[rng.permutation(len(x))]
    m, n, seen = Metric(), len(x), []
    real = S.spanning_tree
    monkeypatch.setattr(S, "spanning_tree", lambda points, *a, **k: seen.append(points.count()) or real(points, *a, **k))
    core, tree = fit_tree(rows(spark, x), n, 4, m, 1.0, 64)
    c = N.top_k(m, x, np.arange(n), x, np.arange(n), 4, False)[1][:, 3]
    np.testing.assert_array_equal(core.toPandas().sort_values("pos").core.to_numpy(), c)
    e, (a, b, w) = tree.toPandas(), S.prim(x, c, np.arange(n), m)
    key = lambda a, b, w: sorted(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), w.tolist()))
    assert key(e.a.to_numpy(), e.b.to_numpy(), e.w.to_numpy()) == key(a, b, w)
    assert seen[0] <= 90 + 2 * light


def test_large_forest_isnt_made_with_every_batch(monkeypatch):
    """A forest of more edges than are gathered is reduced a few times, not once a batch."""
    monkeypatch.setattr(S, "GATHER", 100)
    calls, real = [], S.kruskal
    monkeypatch.setattr(S, "kruskal", lambda *e: calls.append(1) or real(*e))
    path = np.arange(2_001)
    edges = [pa.RecordBatch.from_pydict({"a": path[i : i + 10], "b": path[i + 1 : i + 11], "w": np.ones(10)}) for i in range(0, 2_000, 10)]
    edges.append(pa.RecordBatch.from_pydict({"a": [0, 5], "b": [2_000, 9], "w": [2.0, 0.5]}))
    got = pa.Table.from_batches(S._reduce(iter(edges))).to_pydict()
    assert sorted(zip(got["a"], got["b"])) == sorted([(i, i + 1) for i in range(2_000) if i != 8] + [(5, 9)])
    assert len(calls) <= 8


def test_hierarchy_in_parts(three, fitted, monkeypatch):
    """A large tree's tables are made in two parts, which are those of one run."""
    monkeypatch.setattr(density, "APART", 10)
    model = DensityClusterer(min_cluster_size=10).fit(three[0]).model
    for name in ("minimum_spanning_tree", "single_linkage_tree", "condensed_tree", "clusters", "result"):
        key = lambda m: sorted(map(tuple, getattr(m, name).collect()))  # noqa: E731, B023
        assert key(model) == key(fitted)
    assert len(model._parts) == 2


def test_prim_is_unique_minimum(spark):
    x = np.random.default_rng(5).integers(0, 4, size=(40, 2)).astype(float)  # ties and equal points
    m, c = Metric(), np.zeros(40)
    i, j = np.triu_indices(40, 1)
    d = m.pairwise(x)[i, j]
    keep = S.kruskal(i, j, d)
    a, b, w = S.prim(x, c, np.arange(40), m)
    assert sorted(zip(i[keep], j[keep])) == sorted(zip(np.minimum(a, b), np.maximum(a, b)))
    forest, _ = boruvka(spark.createDataFrame(pd.DataFrame({"a": i, "b": j, "w": d})))
    assert sorted((r.a, r.b) for r in forest.collect()) == sorted(zip(i[keep].tolist(), j[keep].tolist()))


def test_knn_edges(spark):
    empty = rows(spark, np.empty((0, 2)))
    assert N.knn(empty, 3, Metric()).count() == 0 and N.within(empty, 1.0, Metric()).count() == 0
    two = rows(spark, np.array([[0.0, 0.0], [0.0, 0.0]]))
    assert [tuple(r) for r in N.knn(two, 3, Metric()).orderBy("pos").collect()] == [(0, 1, 0.0, 1), (1, 0, 0.0, 1)]
    own = N.knn(two, 2, Metric(), itself=True).orderBy("pos", "rank").collect()
    assert [(r.pos, r.nbr) for r in own] == [(0, 0), (0, 1), (1, 1), (1, 0)]
    assert N.core_distances(N.knn(two, 3, Metric()), 3).first()["core"] == math.inf


def test_radius_blocks_agree(spark):
    x = np.random.default_rng(6).normal(size=(300, 2))
    d = Metric().pairwise(x)
    for block in (50, 4096):
        got = {(r.pos, r.nbr) for r in N.within(rows(spark, x), 0.4, Metric(), block=block).collect()}
        assert got == {(i, j) for i, j in zip(*np.nonzero(d <= 0.4)) if i != j}


def test_splitter_handles_equal_points():
    s = B.Splitter.fit(np.zeros((1000, 2)), 1000, 10)
    assert s.blocks == 1 and (s.assign(np.zeros((5, 2))) == 0).all()
    x = np.random.default_rng(0).normal(size=(1000, 2))
    s = B.Splitter.fit(x, 1000, 100)
    n = np.bincount(s.assign(x), minlength=s.blocks)
    assert s.blocks >= 10 and n.max() <= 130


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 4)], "a long, b long")
    assert {r.node: r.part for r in connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}


def test_sparse_reachability(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 2.0), (2, 1, 2.0)], "i long, j long, d double")
    core = N.core_of_edges(e, 2)
    assert {r.pos: r.core for r in core.collect()} == {0: math.inf, 1: 2.0, 2: math.inf}
    assert S.edge_reachability(e, core).count() == 0
    assert {r.w for r in S.edge_reachability(e, core, max_dist=9.0).collect()} == {9.0}


# -- estimator ----------------------------------------------------------------------------------------


def test_missing_rows_change_nothing_else(spark, three):
    _, x = three
    base = labels_of(density_cluster(P.from_arrays(spark, x), min_cluster_size=10))
    y = np.vstack([[np.nan, 0.0], x[:70], [np.inf, np.nan], x[70:]])
    model = DensityClusterer(min_cluster_size=10).fit(P.from_arrays(spark, y)).model
    got = labels_of(model.result)
    assert got[0] == got[71] == -1
    np.testing.assert_array_equal(np.delete(got, [0, 71]), base)
    n = len(y)
    assert model.single_linkage_tree.count() == n - 1 and model.single_linkage_tree.agg(F.max("size")).first()[0] == n
    c = model.condensed_tree.toPandas()
    assert sorted(c.child[c.child_size == 1]) == list(range(n)) and c.parent.min() == n
    assert set(c.child[c.lambda_val == 0]) >= {0, 71}


def test_block_engine_gives_the_same(three):
    pts, _ = three
    one = DensityClusterer(min_cluster_size=10).fit(pts).model
    many = DensityClusterer(min_cluster_size=10, block=32).fit(pts).model
    key = lambda m: sorted(map(tuple, m.minimum_spanning_tree.collect()))
    assert key(one) == key(many)
    assert sorted(map(tuple, one.result.collect())) == sorted(map(tuple, many.result.collect()))


def test_precomputed(spark, three):
    pts, x = three
    d = Metric().pairwise(x)
    i, j = np.triu_indices(len(x), 1)
    edges = spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "d": d[i, j]}))
    assert (labels_of(DensityClusterer(min_cluster_size=10, metric="precomputed").fit_predict(edges)) == labels_of(density_cluster(pts, min_cluster_size=10))).all()
    far = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0)], "i long, j long, d double")
    with pytest.raises(ValueError, match="component"):
        DensityClusterer(metric="precomputed", min_cluster_size=2).fit(far)
    with pytest.warns(UserWarning, match="infinite"):
        joined = DensityClusterer(metric="precomputed", min_cluster_size=2, min_samples=1, missing="inf").fit(far).model
    assert joined.minimum_spanning_tree.count() == 3 and len(set(labels_of(joined.result)) - {-1}) == 2
    given = DensityClusterer(metric="precomputed", min_cluster_size=2, min_samples=1, max_dist=9.0)
    with pytest.raises(ValueError, match="component"):
        given.fit(far)  # there is no edge at all between the parts
    square = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(d[:5, :5])], "id long, features array<double>")
    assert P.matrix_edges(square).count() == 20
    with pytest.raises(ValueError, match="square"):
        P.matrix_edges(square.where("id < 4"))
    with pytest.raises(ValueError, match="symmetric"):
        P.check_symmetric(spark.createDataFrame([(0, 1, 1.0), (1, 0, 2.0)], "i long, j long, d double"))


@pytest.mark.parametrize("params", [{"min_cluster_size": 1}, {"min_cluster_size": 2.5}, {"min_cluster_size": "fail"}, {"min_samples": 0}, {"min_samples": "x"}, {"cluster_selection_epsilon": -1}, {"cluster_selection_persistence": -0.1}, {"cluster_selection_method": "fail"}, {"alpha": 0}, {"metric": "imperial"}, {"metric": "minkowski", "p": -1}, {"leaf_size": 0}, {"algorithm": "something_else"}, {"metric": None}])
def test_bad_parameters(uniform, params):
    with pytest.raises(ValueError):
        DensityClusterer(**params).fit(uniform)


def test_bad_input(spark):
    with pytest.raises(ValueError):
        P.from_arrays(spark, [["a", "b"]])
    with pytest.raises(ValueError):
        DensityClusterer().fit(spark.createDataFrame([(1, [1.0]), (1, [2.0])], P.POINTS))
    with pytest.raises(ValueError):
        DensityClusterer().fit(spark.createDataFrame([(1, [1.0]), (2, [2.0, 3.0])], P.POINTS))
    with pytest.raises(NotFitted):
        DensityClusterer().condensed_tree
    with pytest.raises(AttributeError):
        RobustLinkage().labels


def test_tiny_inputs(spark):
    assert labels_of(density_cluster(P.from_arrays(spark, [[1, 2], [3, 4]]))).tolist() == [-1, -1]
    assert labels_of(density_cluster(P.from_arrays(spark, [[1, 2]]))).tolist() == [-1]
    empty = DensityClusterer().fit(P.from_arrays(spark, np.empty((0, 2)))).model
    assert empty.result.count() == 0 and empty.condensed_tree.count() == 0 and empty.minimum_spanning_tree.count() == 0
    same = DensityClusterer(min_cluster_size=3).fit(P.from_arrays(spark, [[1, 1]] * 10)).model
    assert same.result.count() == 10 and same.outlier_scores.agg(F.max("score")).first()[0] == 0.0


def test_refit_and_options(fitted):
    for size in (5, 20, 45):
        got = fitted.refit(min_cluster_size=size).result.where("label >= 0").groupBy("label").count().toPandas()
        assert (got["count"] >= size).all()
    assert fitted.refit(max_cluster_size=20).result.where("label >= 0").groupBy("label").count().agg(F.max("count")).first()[0] in (None, *range(21))
    assert 0 <= fitted.persistence.agg(F.min("persistence")).first()[0]
    assert fitted.dbscan(0.3, 5).where("label >= 0").select("label").distinct().count() >= 3
    assert -1 <= fitted.relative_validity() <= 1
    assert 1 <= fitted.outliers_above(0.9).count() <= 17


def test_centroids_and_medoids(fitted):
    want = {(0, 0), (4, 4), (0, 5)}
    centres = {tuple(np.round(r.centroid).astype(int)) for r in fitted.weighted_centroids().collect()}
    middles = {tuple(np.round(r.features).astype(int)) for r in fitted.weighted_medoids().collect()}
    assert centres == middles == want
    for f in (fitted.weighted_centroid, fitted.weighted_medoid):
        assert len(f(0)) == 2
        for bad in (-1, 99):
            with pytest.raises(ValueError):
                f(bad)


# -- new points ------------------------------------------------------------------------------------------


def test_prediction(spark, three, fitted):
    pts, _ = three
    p = predict.Predictor(fitted)
    np.testing.assert_array_equal(labels_of(p.labels(pts)), labels_of(fitted.result))
    own = fitted.outlier_scores.toPandas().sort_values("id").score.to_numpy()
    np.testing.assert_allclose(p.scores(pts).toPandas().sort_values("id").score.to_numpy(), own)
    new = spark.createDataFrame([(0, [0.0, 0.1]), (1, [4.0, 4.0]), (2, [100.0, 100.0])], P.POINTS)
    got = labels_of(p.labels(new))
    assert got[2] == -1 and got[0] >= 0 and got[1] >= 0 and got[0] != got[1]
    with pytest.raises(ValueError):
        p.labels(spark.createDataFrame([(0, [1.0])], P.POINTS))
    m = predict.wide(p.membership(new)).toPandas().sort_values("id").memberships
    assert np.argmax(m.iloc[0]) == got[0] and np.argmax(m.iloc[1]) == got[1]
    every = np.stack(predict.wide(p.all_memberships()).toPandas().sort_values("id").memberships)
    lab = labels_of(fitted.result)
    assert every.max() <= 1 + 1e-9 and (every.argmax(1) == lab)[lab >= 0].mean() > 0.95  # soft and hard may differ for single points


def test_prediction_without_clusters(spark):
    x = np.random.default_rng(0).normal(size=(30, 2))
    model = DensityClusterer(min_cluster_size=25).fit(P.from_arrays(spark, x)).model
    new = P.from_arrays(spark, x[:3])
    with pytest.warns(UserWarning):
        assert labels_of(predict.approximate_predict(model, new)).tolist() == [-1] * 3
    assert predict.approximate_predict_scores(model, new).toPandas().score.tolist() == [1.0] * 3
    assert predict.membership_vector(model, new).count() == 0 and predict.all_points_membership_vectors(model).count() == 0


def test_flat(three, fitted):
    pts, _ = three
    for n in (2, 3):
        assert len(set(labels_of(flat.recut(fitted, n).result)) - {-1}) == n
    with pytest.warns(UserWarning):
        more = flat.recut(fitted.refit(min_cluster_size=5), 99)
    assert more.result.count() == 165
    assert len(set(labels_of(flat.approximate_predict_flat(fitted, pts, 2))) - {-1}) == 2
    with pytest.raises(ValueError):
        flat.select_epsilon(fitted, "other", 2)
    assert flat.all_points_membership_vectors_flat(fitted, 2).select("label").distinct().count() == 2
    assert len(flat.clusters_of(predict.Predictor(fitted))) == 3
    assert labels_of(flat.cluster_flat(pts, epsilon=0.5, min_cluster_size=10).result).max() >= 1


def test_robust(three):
    pts, _ = three
    got, tree = robust_single_linkage(pts, 0.5)
    assert len(set(labels_of(got)) - {-1}) == 3 and tree.count() == 164
    d = tree.orderBy("parent").toPandas().distance
    assert d.is_monotonic_increasing
    for bad in ({"cut": -1.0}, {"k": 0}, {"alpha": 0}, {"gamma": 0}, {"metric": "imperial"}, {"algorithm": "x"}, {"leaf_size": 0}, {"p": -1}):
        with pytest.raises(ValueError):
            RobustLinkage(**bad).fit(pts)


def test_validity(spark, fitted):
    own = fitted.point_rows.select("pos", "x", "label")
    index, per = validity.validity(own)
    assert index > 0.5 and per.count() == 3
    raw, _ = validity.validity(own, raw_distances=True)
    assert raw > 0.5
    core = validity.all_points_core_distances(own.where("label >= 0"), Metric(), 2)
    assert validity.max_ratio(own.where("label >= 0").join(core.select("pos", "core"), "pos"), Metric()) > 1
    one = own.withColumn("label", F.lit(0))
    assert math.isnan(validity.validity(one)[0])
    assert validity.validity(own.withColumn("label", F.lit(-1)))[0] == 0.0


def test_pair_reduction_in_parts(spark):
    x = np.random.default_rng(8).normal(size=(120, 2))
    label = np.arange(120) % 2
    df = spark.createDataFrame([(i, x[i].tolist(), int(label[i]), 1.0, 0.0) for i in range(120)], "pos long, x array<double>, label int, weight double, core double")
    d = Metric().pairwise(x)
    want = (d * (label[:, None] == label)).sum(1)
    for block in (17, 4096):
        got = reduce_pairs(df, Metric(), lambda d, w: np.nansum(d * w[None], axis=1), block).toPandas().sort_values("pos").total
        np.testing.assert_allclose(got, want)
        gap = label_gaps(df, Metric(), block).collect()
        assert [(r.a, r.b) for r in gap] == [(0, 1)] and gap[0].gap == pytest.approx(d[label == 0][:, label == 1].min())


# -- branches ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def arms(spark):
    rng = np.random.default_rng(3)
    t = np.linspace(0.05, 3, 50)
    arm = [np.c_[t * np.cos(a), t * np.sin(a)] + rng.normal(0, 0.05, (50, 2)) for a in (0.3, 2.4, 4.5)]
    x = np.vstack([*arm, rng.normal((8, 8), 0.2, (40, 2))])
    return DensityClusterer(min_cluster_size=5, min_samples=5).fit(P.from_arrays(spark, x)).model.refit(min_cluster_size=30), x


@pytest.mark.parametrize("method", ["full", "core"])
def test_branches(spark, arms, method):
    model, x = arms
    found = BranchDetector(method, min_cluster_size=8).fit(model)
    r = found.result.toPandas().sort_values("id")
    star = r[:150]
    assert star.cluster_label.nunique() == 1 and star.branch_label[star.branch_label >= 0].nunique() >= 3
    assert r[150:].branch_label.unique().tolist() == [0]  # a round cluster has no branches
    tips = [star.iloc[49].branch_label, star.iloc[99].branch_label, star.iloc[149].branch_label]
    assert len(set(tips)) == 3
    p = found.predict(P.from_arrays(spark, x[[49, 149, 160]])).toPandas().sort_values("id")
    assert p.branch_label.tolist()[:2] == [tips[0], tips[2]]
    nodes, edges = exports.approximation_graph(found, "lens", "limb")
    assert "limb_label" in nodes.columns and edges.agg(F.max("weight")).first()[0] <= 1
    assert found.condensed_trees.count() > 0 and found.linkage_trees.count() > 0 and found.exemplars.count() > 0
    first = int(star.label.max())
    assert len(found.weighted_centroid(first)) == len(found.weighted_medoid(first)) == 2
    with pytest.raises(ValueError):
        found.weighted_centroid(-1)


def test_branches_of_given_labels(spark, arms):
    model, x = arms
    # The outer ends of two arms under one label: components come in place of branches.
    ends = F.col("id").between(30, 49) | F.col("id").between(80, 99)
    given = model.result.select("id", F.when(ends, 0).otherwise(-1).alias("label"))
    r = BranchDetector("core", min_cluster_size=8).fit(model, given).result
    assert sorted(x.branch_label for x in r.where("cluster_label = 0").select("branch_label").distinct().collect()) == [0, 1]
    for bad in ({"branch_detection_method": "x"}, {"min_cluster_size": 1}, {"cluster_selection_epsilon": -1}, {"cluster_selection_persistence": -1}, {"cluster_selection_method": "x"}):
        with pytest.raises(ValueError):
            BranchDetector(**bad).fit(model)
    with pytest.raises(AttributeError):
        BranchDetector().fit(DensityClusterer())


# -- sources, store, exports, streams -----------------------------------------------------------------------------


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3, "x"), (2, None, 4, "y")], "k long, a double, b int, features string")
    got = P.to_points(df, "k", ["a", "b"])
    assert [r.features for r in got.orderBy("id").collect()] == [[2.0, 3.0], [None, 4.0]]
    df.write.option("header", True).csv(str(tmp_path / "c"))
    assert P.read_points(spark, str(tmp_path / "c"), "k", ["a", "b"], "csv", header=True).count() == 2
    stored = spark.createDataFrame([(1, 0, 5.0), (1, 2, 7.0), (2, 1, 1.0)], "id long, dim int, value double")
    assert {r.id: r.features for r in P.from_sparse(stored, 3).collect()} == {1: [5.0, 0.0, 7.0], 2: [0.0, 1.0, 0.0]}
    maps = spark.createDataFrame([(1, {0: 5.0})], "id long, features map<int,double>")
    assert P.from_maps(maps, 2).first().features == [5.0, 0.0]
    assert P.from_arrays(spark, pd.DataFrame({"a": [1, 2], "b": [3, 4]})).count() == 2
    many = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"))
    assert [r.raw for r in P.positions(many).orderBy("id").collect()] == list(range(1000))


def test_store(spark, three, fitted, tmp_path):
    save_model(fitted, str(tmp_path / "m"))
    back = load_model(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.result.collect())) == sorted(map(tuple, fitted.result.collect()))
    pts, _ = three
    one = fit_cached(pts, str(tmp_path / "cache"), "three", min_cluster_size=10, min_samples=5)
    two = fit_cached(pts, str(tmp_path / "cache"), "three", min_cluster_size=20, min_samples=5)
    assert one.result.count() == two.result.count() and two.params["min_cluster_size"] == 20
    assert len(list((tmp_path / "cache").iterdir())) == 1


def test_exports(fitted):
    nodes, edges = exports.condensed_graph(fitted)
    assert nodes.count() == edges.count() + 1
    nodes, edges = exports.linkage_graph(fitted)
    assert edges.count() == 2 * 164 and nodes.count() == 165 + 164
    nodes, edges = exports.spanning_graph(fitted)
    assert nodes.count() == 165 and edges.count() == 164
    bars, lines, bounds = exports.plot_data(fitted)
    assert bars.count() > 0 and lines.count() == fitted.condensed_tree.where("child_size > 1").count()
    assert bounds.where("left >= right OR bottom > top").count() == 0
    assert exports.plot_data(fitted, log_size=True)[0].count() > 0
    assert exports.to_numpy(fitted.condensed_tree).dtype.names == ("parent", "child", "lambda_val", "child_size")
    assert exports.selected_clusters(fitted).count() == 3 and fitted.exemplars.count() > 0


def test_stream(spark, three, fitted, tmp_path):
    from moraine.streaming.scoring import score_stream

    pts, _ = three
    pts.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    score_stream(stream, predict.Predictor(fitted), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    np.testing.assert_array_equal(labels_of(got), labels_of(fitted.result))


def test_all_ways_to_a_distance_agree_to_the_bit():
    m, rng = Metric(), np.random.default_rng(0)
    for d in (2, 5, 24, 200):
        for n in (1, 7, 500):
            x = rng.normal(size=(n, d)) * 100
            want = m.pairwise(x[:1], x)[0]
            columns = np.ascontiguousarray(np.vstack([x, x]).T)
            assert (m.from_one(x[0], columns[:, :n]) == want).all() and (m.paired(np.repeat(x[:1], n, 0), x) == want).all()
            rough, error = m.rough(x, x)
            assert (np.abs(rough - m.pairwise(x)) <= error + 1e-300).all()
            i, j, r = m.near_pairs(x, x, float(np.median(want)))
            assert set(zip(i, j)) == set(zip(*np.nonzero(m.pairwise(x) <= np.median(want)))) and (r == m.pairwise(x)[i, j]).all()


def test_blocks_agree_in_many_dimensions(spark):
    x = np.random.default_rng(7).normal(size=(300, 12)).round(1)
    pts = P.from_arrays(spark, np.vstack([x, x[:20]]))
    one = DensityClusterer(min_cluster_size=5).fit(pts).model
    many = DensityClusterer(min_cluster_size=5, block=40).fit(pts).model
    key = lambda m: sorted(map(tuple, m.minimum_spanning_tree.collect()))
    assert key(one) == key(many)
