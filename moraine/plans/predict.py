"""New points against a frozen model: labels, scores, soft memberships."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.functions.metrics import Metric
from moraine.functions.scalar import inverse, is_finite
from moraine.operators import neighbors as N
from moraine.operators.arrow import batch, matrix
from moraine.plans.density import DensityModel
from moraine.session import materialize

#: The tables of clusters and exemplars are sent to executors up to so many rows.
MODEL_ROWS = 2_000_000
_BIG = float(np.finfo(float).max)


@dataclass
class ClusterTree:
    """The hierarchy's clusters as arrays, root first; at most one row per two points of it."""

    root: int
    up: np.ndarray
    birth: np.ndarray
    death: np.ndarray
    subtree: np.ndarray
    label: np.ndarray  # of the nearest selected cluster at or above, -1 for none
    top: np.ndarray  # death of that cluster
    selected: np.ndarray  # cluster index of each label

    def height(self, cluster: np.ndarray, lam: np.ndarray, target: int) -> np.ndarray:
        """Lambda at which points of ``cluster`` join the cluster ``target``; the point's own if one holds the other."""
        line, path = {}, []
        t, last = target, -1
        while t >= 0:
            line[t] = last
            last, t = t, self.up[t]
        out = lam.copy()
        for c in np.unique(cluster):
            x, step = int(c), -1
            while x not in line:
                step, x = x, int(self.up[x])
            path = line[x]
            if step >= 0 and path >= 0:  # they part at x
                out[cluster == c] = self.birth[step]
        return out


def cluster_tree(model: DensityModel) -> ClusterTree:
    rows = model.clusters.orderBy("cluster").limit(MODEL_ROWS + 1).toPandas()
    if len(rows) > MODEL_ROWS:
        raise ValueError("the model has too many clusters to be sent to the executors; raise min_cluster_size")
    root = int(rows.cluster.iloc[0]) if len(rows) else model.total
    up = np.where(rows.parent < 0, -1, rows.parent - root).astype(int)
    label, top, own = np.full(len(rows), -1), np.zeros(len(rows)), rows.label.to_numpy()
    for c in range(len(rows)):  # parents come first
        if own[c] >= 0:
            label[c], top[c] = own[c], rows.death[c]
        elif up[c] >= 0:
            label[c], top[c] = label[up[c]], top[up[c]]
    selected = np.flatnonzero(own >= 0)[np.argsort(own[own >= 0])]
    return ClusterTree(root, up, rows.birth.to_numpy(), rows.death.to_numpy(), rows.subtree_death.to_numpy(), label, top, selected)


class Predictor:
    """What is needed to place new points; made once, used for any number of batches.

    Core distances count the point itself here, so they are those of ``min_samples - 1``.
    """

    def __init__(self, model: DensityModel):
        if model.points is None or model.metric is None:
            raise AttributeError("prediction needs a model of points; distances alone don't place new ones")
        self.model, self.metric, self.k = model, model.metric, model.params["min_samples"]
        finite = model.points.where("pos IS NOT NULL").select("pos", "x")
        core = N.nearest_core(finite, min(self.k, model.n), self.metric, itself=True, block=model.params["block"])
        rows = model.point_rows.where("pos IS NOT NULL").select("pos", "id", "parent", "lambda_val")
        self.reference = materialize(finite.join(core, "pos").join(rows, "pos").select("pos", "x", "id", "core", "parent", "lambda_val"), "reference")
        self.tree = cluster_tree(model)

    def _query(self, points: DataFrame) -> DataFrame:
        dim = self.model.dim
        if not points.where(is_finite("features", dim) == F.lit(False)).isEmpty():
            raise ValueError(f"new points must have {dim} finite features, as those of the model")
        return points.select(F.col("id").cast("long").alias("pos"), F.col("features").alias("x"))

    def neighbours(self, points: DataFrame, query: DataFrame | None = None) -> DataFrame:
        """``pos, nbr, id, lam, exact, parent, nbr_lambda``: the reference point that each new point joins first."""
        query = self._query(points) if query is None else query
        k = min(2 * self.k, self.model.n)
        near = N.knn(self.reference.select("pos", "x"), k, self.metric, queries=query.select("pos", "x"), itself=None, block=self.model.params["block"])
        near = materialize(near, "near")
        own = near.where(F.col("rank") == min(self.k + 1, k)).select("pos", F.col("dist").alias("own"))
        info = self.reference.select(F.col("pos").alias("nbr"), "id", "core", "parent", F.col("lambda_val").alias("nbr_lambda"))
        rows = near.join(own, "pos").join(info, "nbr")
        mr = F.greatest("core", "own", "dist")
        best = rows.groupBy("pos").agg(F.min("dist").alias("least"), F.min(F.struct(mr.alias("mr"), "rank", "nbr", "id", "parent", "nbr_lambda")).alias("m"))
        lam = F.when(F.col("m.mr") > 0, inverse(F.col("m.mr"))).otherwise(F.lit(_BIG))
        return best.select("pos", "m.nbr", "m.id", lam.alias("lam"), (F.col("least") == 0).alias("exact"), "m.parent", "m.nbr_lambda")

    def labels(self, points: DataFrame) -> DataFrame:
        """``id, label, probability, neighbor``."""
        if not len(self.tree.selected):
            warnings.warn("the model has no clusters: everything is noise", UserWarning, stacklevel=2)
            return points.select("id", F.lit(-1).alias("label"), F.lit(0.0).alias("probability"), F.lit(None).cast("long").alias("neighbor"))
        tree = self.tree

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                c, lam, at = b.column("parent").to_numpy() - tree.root, b.column("lam").to_numpy(), b.column("nbr_lambda").to_numpy()
                c = c.copy()
                live = np.flatnonzero(at > lam)
                while len(live):
                    live = live[(tree.up[c[live]] >= 0) & (tree.birth[c[live]] >= lam[live])]
                    c[live] = tree.up[c[live]]
                label, top = tree.label[c], tree.top[c]
                prob = np.where(label < 0, 0.0, np.where(top > 0, np.minimum(top, lam) / np.where(top > 0, top, 1), 1.0))
                prob = np.where((label >= 0) & np.isinf(top), np.where(lam >= _BIG, 1.0, 0.0), prob)
                yield batch([("id", pa.int64()), ("label", pa.int32()), ("probability", pa.float64()), ("neighbor", pa.int64())], [b.column("pos"), label, prob, b.column("id")])

        return self.neighbours(points).mapInArrow(place, "id long, label int, probability double, neighbor long")

    def scores(self, points: DataFrame) -> DataFrame:
        """``id, score``: outlier scores of new points; one for all where the model has no clusters.

        Exact copies of a reference point take its lambda; other scores may be negative.
        """
        if len(self.tree.up) < 2:
            return points.select("id", F.lit(1.0).alias("score"))
        death = self.model.clusters.select(F.col("cluster").alias("parent"), "subtree_death")
        lam = F.when(F.col("exact"), F.col("nbr_lambda")).otherwise(F.col("lam"))
        inf = F.lit(float("inf"))
        value = F.when((F.col("subtree_death") == 0) | (lam == inf), F.lit(0.0)).otherwise((F.col("subtree_death") - lam) / F.when(F.col("subtree_death") != 0, F.col("subtree_death")))
        return self.neighbours(points).join(death, "parent").select(F.col("pos").alias("id"), value.alias("score"))

    # -- soft clustering -----------------------------------------------------------------

    def exemplar_distances(self, points: DataFrame) -> DataFrame:
        """``id, label, distance``: least distance to an exemplar of each cluster; points ``pos, x``."""
        ex = self.model.exemplars.select(F.col("label"), F.col("features").alias("e"))
        t = ex.limit(MODEL_ROWS + 1).toArrow()
        if t.num_rows > MODEL_ROWS:
            d = self.metric.column(F.col("x"), F.col("e"), self.model.dim)
            return points.join(ex, F.lit(True)).groupBy(F.col("pos").alias("id"), "label").agg(F.min(d).alias("distance"))
        metric, label, e = self.metric, t.column("label").to_numpy(), matrix(t.column("e"))
        order = np.argsort(label, kind="stable")
        label, e = label[order], e[order]
        starts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]]) if len(label) else np.empty(0, int)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, pos = matrix(b.column("x")), b.column("pos").to_numpy()
                step = max(1, 4_000_000 // max(len(e), 1))
                for s in range(0, len(x) if len(starts) else 0, step):
                    d = np.minimum.reduceat(metric.pairwise(x[s : s + step], e), starts, axis=1)
                    yield batch([("id", pa.int64()), ("label", pa.int32()), ("distance", pa.float64())], [np.repeat(pos[s : s + step], len(starts)), np.tile(label[starts].astype(np.int32), len(d)), d.reshape(-1)])

        return points.select("pos", "x").mapInArrow(run, "id long, label int, distance double")

    def _memberships(self, rows: DataFrame, points: DataFrame, train: bool, softmax: bool = False) -> DataFrame:
        """``id, label, membership`` of rows ``pos, parent, lam`` (and ``biggest`` for the training points)."""
        tree, labels = self.tree, np.arange(len(self.tree.selected), dtype=np.int32)
        far = self.exemplar_distances(points).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("label", "distance"))).alias("s"))
        far = far.select(F.col("id").alias("pos"), F.transform("s", lambda e: e["distance"]).alias("d"))
        top = rows.join(far, "pos")

        def heights(b: pa.RecordBatch) -> np.ndarray:
            c, lam = b.column("parent").to_numpy() - tree.root, b.column("lam").to_numpy()
            return np.stack([tree.height(c, lam, int(t)) for t in tree.selected], 1)

        def near(b: pa.RecordBatch) -> np.ndarray:
            d = matrix(b.column("d"))
            v = np.where(d > 0, 1 / np.where(d > 0, d, 1), _BIG / d.shape[1])
            if softmax:
                v = np.exp(v - v.max(1, keepdims=True))
            return v / v.sum(1, keepdims=True)

        def norm(v: np.ndarray) -> np.ndarray:
            s = v.sum(1, keepdims=True)
            return np.where(s > 0, v / np.where(s > 0, s, 1), 0.0)

        def bulk(b: pa.RecordBatch) -> np.ndarray:
            """exp(-(deepest + 1e-8) / height), before the softmax."""
            c = b.column("parent").to_numpy() - tree.root
            return np.exp(-(tree.death[c][:, None] + 1e-8) / np.maximum(heights(b), 1e-300))

        most = 0.0
        if train:

            def peak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        yield batch([("m", pa.float64())], [[float(np.nanmax(bulk(b)))]])

            most = top.mapInArrow(peak, "m double").agg(F.max("m")).first()[0] or 0.0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                c, lam, h = b.column("parent").to_numpy() - tree.root, b.column("lam").to_numpy(), heights(b)
                deepest = tree.death[c]
                best = h.argmax(1)
                ahead = tree.death[tree.selected[best]]
                with np.errstate(invalid="ignore", over="ignore"):
                    if train:
                        out = norm(np.exp(bulk(b) - most))
                        some = h.max(1) / np.maximum(lam, ahead)
                        v = norm(near(b) * out)
                    else:
                        rest = deepest[:, None] - h
                        s = deepest[:, None] / np.where(rest <= 0, 1e-8, rest)
                        out = norm(np.exp(s - s.max(1, keepdims=True)))
                        some = h.max(1) / (np.maximum(lam, ahead) + 1e-8)
                        v = norm(near(b) ** 0.5 * out**2)
                v = np.nan_to_num(v * np.nan_to_num(some, nan=1.0)[:, None])
                yield batch([("id", pa.int64()), ("label", pa.int32()), ("membership", pa.float64())], [np.repeat(b.column("pos").to_numpy(), len(labels)), np.tile(labels, len(v)), v.reshape(-1)])

        return top.mapInArrow(run, "id long, label int, membership double")

    def membership(self, points: DataFrame, softmax: bool = False) -> DataFrame:
        """``id, label, membership`` of new points: the chance to belong to each cluster.

        Nearness to exemplars (to the power 1/2) times outlierness (squared), normalised,
        times the chance to be in any cluster. No rows where the model has no clusters.
        """
        if not len(self.tree.selected):
            return points.sparkSession.createDataFrame([], "id long, label int, membership double")
        query = materialize(self._query(points), "query")
        rows = self.neighbours(points, query).select("pos", "parent", F.least("lam", "nbr_lambda").alias("lam"))
        return self._memberships(rows, query, train=False, softmax=softmax)

    def all_memberships(self) -> DataFrame:
        """``id, label, membership`` of the model's own points; both parts to the power 1."""
        if not len(self.tree.selected):
            return self.reference.sparkSession.createDataFrame([], "id long, label int, membership double")
        rows = self.reference.select("pos", "parent", F.col("lambda_val").alias("lam"))
        got = self._memberships(rows, self.reference.select("pos", "x"), train=True)
        ids = self.reference.select(F.col("pos"), F.col("id").alias("own"))
        return got.join(ids, F.col("id") == F.col("pos")).select(F.col("own").alias("id"), "label", "membership")


def approximate_predict(model: DensityModel, points: DataFrame) -> DataFrame:
    """``id, label, probability, neighbor`` of new points ``id, features``."""
    return Predictor(model).labels(points)


def approximate_predict_scores(model: DensityModel, points: DataFrame) -> DataFrame:
    return Predictor(model).scores(points)


def membership_vector(model: DensityModel, points: DataFrame) -> DataFrame:
    return Predictor(model).membership(points)


def all_points_membership_vectors(model: DensityModel) -> DataFrame:
    return Predictor(model).all_memberships()


def wide(memberships: DataFrame) -> DataFrame:
    """One row per id, ``memberships`` as an array by label."""
    rows = memberships.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("label", "membership"))).alias("s"))
    return rows.select("id", F.transform("s", lambda e: e["membership"]).alias("memberships"))


