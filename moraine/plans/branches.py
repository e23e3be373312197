"""Branches inside clusters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions.scalar import weighted_average
from moraine.operators import neighbors as N
from moraine.operators import tree as T
from moraine.operators.arrow import batch, groups, matrix
from moraine.operators.forest import boruvka
from moraine.plans.density import _TREE_PARAMS, ARTEFACT, CLUSTER, CONDENSED, LINKAGE, MST, POINT, DensityModel, NotFitted, _number, _whole, rows_of
from moraine.plans.predict import Predictor
from moraine.session import materialize

#: Clusters of up to so many points find their graph in one task; larger ones block by block.
ONE_TASK = 16_384
_GRAPH = "cluster int, a long, b long, lens double, mr double"


def branch_data(model: DensityModel) -> DataFrame:
    """``pos, nbr, dist, rank, core`` of the points that aren't noise: ``min_samples`` neighbours with the point itself."""
    k = min(model.params["min_samples"], model.n)
    finite = model.points.where("pos IS NOT NULL").select("pos", "x")
    near = materialize(N.knn(finite, k, model.metric, itself=True, block=model.params["block"]), "neighbours")
    core = N.core_distances(near, k)
    members = model.point_rows.where("label >= 0").select("pos")
    return near.join(members, "pos", "left_semi").join(core, "pos")


def _full_graph(metric):
    """The radius graph of each cluster that fits a task: all edges no longer than its longest tree edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, t in groups(batches, "cluster"):
            pos, x, core, lens = t.column("pos").to_numpy(), matrix(t.column("x")), t.column("core").to_numpy(), t.column("lens").to_numpy()
            radius = float(t.column("radius")[0].as_py() or 0.0)
            order = np.argsort(pos)
            pos, x, core, lens = pos[order], x[order], core[order], lens[order]
            step = max(1, 2_000_000 // len(pos))
            for s in range(0, len(pos), step):
                d = metric.pairwise(x[s : s + step], x[s:])
                i, j = np.nonzero(d <= radius)
                keep = j > i
                i, j = i[keep], j[keep]
                d, i, j = d[i, j], i + s, j + s
                w = np.maximum(np.maximum(core[i], core[j]), d)
                yield batch([("cluster", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("lens", pa.float64()), ("mr", pa.float64())], [np.full(len(i), c), pos[i], pos[j], np.maximum(lens[i], lens[j]), w])

    return run


def _segment(params: dict, overridden: bool):
    """Per cluster: spanning tree by lens, hierarchy and selection; artefact rows with the cluster in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from moraine.plans.density import _ARTEFACT

        schema = [("cluster", pa.int32()), *_ARTEFACT]
        for c, t in groups(batches, "cluster"):
            kind = t.column("kind").to_numpy()
            a, b, w = (t.column(k).to_numpy() for k in ("a", "b", "w"))
            nodes, e = np.sort(a[kind == 0]), np.flatnonzero(kind == 1)
            i, j, w = np.searchsorted(nodes, a[e]), np.searchsorted(nodes, b[e]), w[e]
            order = np.lexsort((np.maximum(i, j), np.minimum(i, j), w))
            i, j, w = i[order], j[order], w[order]
            keep = T.spanning_forest(len(nodes), i, j, w)
            if len(keep) < len(nodes) - 1:
                part = T.components(len(nodes), i[keep], j[keep])
                roots = np.unique(part)
                n = len(nodes)
                zero, one = np.zeros(n), np.ones(n)
                points = [np.full(n, c), np.full(n, POINT), nodes, np.searchsorted(roots, part), np.zeros(n, int), np.zeros(n, int), one, zero, zero, zero]
                yield batch(schema, points)
                k = len(roots)  # parent -2 marks components in place of a tree
                yield batch(schema, [np.full(k, c), np.full(k, CLUSTER), np.arange(k), np.arange(k), np.full(k, -2), np.zeros(k, int), np.zeros(k), np.zeros(k), np.zeros(k), np.zeros(k)])
                continue
            cols = rows_of(len(nodes), i[keep], j[keep], w[keep], params)
            kinds, first, second = cols[:3]
            single = params["allow_single_cluster"] and len({x for k, x in zip(cols[0], cols[2]) if k == CLUSTER and x >= 0}) == 1
            if single:  # the one branch holds all points, or all up to epsilon
                eps = params["cluster_selection_epsilon"]
                lam = cols[7]
                inside = ~((lam < 1 / eps) if eps > 0 else np.zeros(len(lam), bool))
                at = kinds == POINT
                second[at] = np.where(inside[at], 0, -1)
                cols[5] = np.where(at, np.where(inside, 1.0, 0.0), cols[5])
            is_point = (kinds == POINT) | (kinds == MST)
            first = np.where(is_point, nodes[np.where(is_point, first, 0)], first)
            second = np.where(kinds == MST, nodes[np.where(kinds == MST, second, 0)], second)
            yield batch(schema, [np.full(len(kinds), c), kinds, first, second, *cols[3:]])

    return run


class BranchDetector:
    """Finds branches: the modes of eccentricity within each cluster of a fitted model.

    "full": clusters' graphs hold all edges up to their longest tree edge; "core": the tree's
    edges and each point's nearest neighbours. Missing parameters are those of the model.
    """

    def __init__(self, branch_detection_method: str = "full", label_sides_as_branches: bool = False, min_cluster_size: int | None = None, max_cluster_size: int | None = None, allow_single_cluster: bool | None = None, cluster_selection_method: str | None = None, cluster_selection_epsilon: float = 0.0, cluster_selection_persistence: float = 0.0):
        self.method, self.sides = branch_detection_method, label_sides_as_branches
        self.own = {"min_cluster_size": min_cluster_size, "max_cluster_size": max_cluster_size, "allow_single_cluster": allow_single_cluster, "cluster_selection_method": cluster_selection_method}
        self.epsilon, self.persistence = cluster_selection_epsilon, cluster_selection_persistence
        self.model: DensityModel | None = None

    def fit(self, model: DensityModel, labels: DataFrame | None = None) -> BranchDetector:
        """``labels``: ``id, label`` (and ``probability``) in place of the model's own."""
        model = getattr(model, "model", model)
        if model is None:
            raise NotFitted("the clusterer is not fitted yet")
        if model.metric is None:
            raise ValueError("branches need a model of points")
        p = {k: model.params[k] if v is None else v for k, v in self.own.items()}
        p |= {"cluster_selection_epsilon": float(self.epsilon), "cluster_selection_persistence": float(self.persistence), "cluster_selection_epsilon_max": float("inf"), "match_reference_implementation": False}
        _whole("min_cluster_size", p["min_cluster_size"], 2)
        _number("cluster_selection_epsilon", p["cluster_selection_epsilon"])
        _number("cluster_selection_persistence", p["cluster_selection_persistence"])
        if p["cluster_selection_method"] not in ("eom", "leaf"):
            raise ValueError('cluster_selection_method must be "eom" or "leaf"')
        if self.method not in ("core", "full"):
            raise ValueError('branch_detection_method must be "core" or "full"')
        self.model, self.params, self.overridden = model, {k: p[k] for k in _TREE_PARAMS}, labels is not None
        self._members = materialize(self._labelled(labels), "members")
        self._graph = materialize(self._edges(), "branch-graph")
        self._rows = materialize(self._segments(), "branches")
        return self

    def fit_predict(self, model: DensityModel, labels: DataFrame | None = None) -> DataFrame:
        return self.fit(model, labels).result.select("id", "label")

    def _labelled(self, labels: DataFrame | None) -> DataFrame:
        """``pos, id, x, label, probability``: one row per point, noise too."""
        rows = self.model.point_rows.where("pos IS NOT NULL").select("pos", "id", "x", "label", "probability", "lambda_val")
        if labels is not None:
            prob = F.col("probability") if "probability" in labels.columns else F.when(F.col("label") < 0, 0.0).otherwise(1.0)
            given = labels.select(F.col("id"), F.col("label").cast("int").alias("label"), prob.cast("double").alias("probability"))
            return rows.drop("label", "probability").join(given, "id", "left").select("pos", "id", "x", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
        p = self.model.params
        if p["allow_single_cluster"] and self.model.clusters.where("label >= 0").count() == 1:
            eps = p["cluster_selection_epsilon"]
            out = (F.col("lambda_val") < F.lit(1 / eps)) if eps > 0 else F.lit(False)
            rows = rows.withColumn("label", F.when(out, -1).otherwise(0)).withColumn("probability", F.when(out, 0.0).otherwise(1.0))
        return rows.select("pos", "id", "x", "label", "probability")

    @cached_property
    def neighbours(self) -> DataFrame:
        return materialize(branch_data(self.model), "branch-data")

    @cached_property
    def centralities(self) -> DataFrame:
        """``pos, label, lens``: one over the distance to the cluster's weighted centroid (inf at it)."""
        own = self._members.where("label >= 0")
        centre = weighted_average(own, "label", "x", "probability").withColumnRenamed("x", "centre")
        d = self.model.metric.column(F.col("centre"), F.col("x"), self.model.dim)
        return materialize(own.join(centre, "label").select("pos", "label", F.when(d > 0, 1 / d).otherwise(F.lit(float("inf"))).alias("lens")), "lens")

    def _edges(self) -> DataFrame:
        own = self._members.where("label >= 0").select("pos", "x", "label")
        lens = self.centralities.select("pos", "lens")
        core = self.neighbours.select("pos", "core").distinct() if not self.overridden else N.core_distances(N.knn(self._members.select("pos", "x"), min(self.model.params["min_samples"], self.model.n), self.model.metric, itself=True), min(self.model.params["min_samples"], self.model.n))
        info = materialize(own.join(core, "pos").join(lens, "pos"), "cluster-points")
        side = lambda c, n: info.select(F.col("pos").alias(c), F.col("label").alias(f"l{n}"), F.col("core").alias(f"c{n}"), F.col("lens").alias(f"e{n}"))
        tree = self.model._mst.select("a", "b", "w").join(side("a", 1), "a").join(side("b", 2), "b").where("l1 = l2")
        tree = materialize(tree.select(F.col("l1").alias("cluster"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest("e1", "e2").alias("lens"), F.col("w").alias("mr")), "cluster-tree")
        if self.method == "core":
            near = self.neighbours.where("nbr != pos").select(F.least("pos", "nbr").alias("a"), F.greatest("pos", "nbr").alias("b")).distinct()
            near = near.join(side("a", 1), "a").join(side("b", 2), "b").where("l1 = l2")
            near = near.select(F.col("l1").alias("cluster"), "a", "b", F.greatest("e1", "e2").alias("lens"), F.greatest("c1", "c2").alias("mr"))
            return tree.unionByName(near).groupBy("cluster", "a", "b").agg(F.max("lens").alias("lens"), F.min("mr").alias("mr"))
        radius = tree.groupBy("cluster").agg(F.max("mr").alias("radius"))
        size = info.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ONE_TASK).collect()
        big = [r["label"] for r in size]
        rows = info.join(radius, info.label == radius.cluster, "left").select(F.col("label").alias("cluster"), "pos", "x", "core", "lens", "radius")
        small = rows.where(~F.col("cluster").isin(big)) if big else rows
        out = small.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_full_graph(self.model.metric), _GRAPH)
        for c in big:
            own = materialize(rows.where(F.col("cluster") == c), "cluster")
            r = own.first()["radius"]
            pairs = N.within(own.select("pos", "x"), r, self.model.metric).where("pos < nbr")
            pairs = pairs.select(F.col("pos").alias("a"), F.col("nbr").alias("b"), "dist").join(side("a", 1), "a").join(side("b", 2), "b")
            out = out.unionByName(pairs.select(F.lit(c).alias("cluster"), "a", "b", F.greatest("e1", "e2").alias("lens"), F.greatest("c1", "c2", "dist").alias("mr")))
        return out

    def _segments(self) -> DataFrame:
        nodes = self._members.where("label >= 0").select(F.col("label").alias("cluster"), F.lit(0).alias("kind"), F.col("pos").alias("a"), F.col("pos").alias("b"), F.lit(0.0).alias("w"))
        links = self._graph.select("cluster", "a", "b", F.col("lens").alias("w"))
        big = self._members.where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ONE_TASK)
        if not big.isEmpty():  # only the forests of large clusters' graphs go to their tasks
            forest, _ = boruvka(links.join(big.select(F.col("label").alias("cluster")), "cluster", "left_semi").select("a", "b", "w"))
            owner = self._members.select(F.col("pos").alias("a"), F.col("label").alias("cluster"))
            links = links.join(big.select(F.col("label").alias("cluster")), "cluster", "left_anti").unionByName(forest.join(owner, "a").select("cluster", "a", "b", "w"))
        both = nodes.unionByName(links.select("cluster", F.lit(1).alias("kind"), "a", "b", "w"))
        run = _segment(self.params, self.overridden)
        return both.repartition("cluster").sortWithinPartitions("cluster", "kind").mapInArrow(run, "cluster int, " + ARTEFACT)

    def _ready(self) -> None:
        if self.model is None:
            raise NotFitted("not fitted yet")

    @cached_property
    def branch_counts(self) -> DataFrame:
        """``cluster, branches, noise, single, offset``: how each cluster is labelled, and its first label."""
        self._ready()
        c = self._rows.where(F.col("kind") == CLUSTER).groupBy("cluster").agg(F.max(F.col("b") + 1).alias("branches"), F.max((F.col("c") == -2).cast("int")).alias("parts"))
        p = self._rows.where(F.col("kind") == POINT).groupBy("cluster").agg(F.max((F.col("b") < 0).cast("int")).alias("noise"))
        few = 1 if self.sides else 2
        rows = p.join(c, "cluster", "left").select("cluster", F.coalesce("branches", F.lit(0)).alias("branches"), "noise", ((F.coalesce("branches", F.lit(0)) <= few) & (F.coalesce("parts", F.lit(0)) == 0)).alias("single"))
        used = F.when(F.col("single"), 1).otherwise(F.col("branches") + F.col("noise"))
        before = F.sum(used).over(Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1))
        return materialize(rows.withColumn("offset", F.coalesce(before, F.lit(0))), "branch-counts")

    @cached_property
    def result(self) -> DataFrame:
        """``id, label, probability, cluster_label, cluster_probability, branch_label, branch_probability, centrality``."""
        self._ready()
        own = self._rows.where(F.col("kind") == POINT).select(F.col("a").alias("pos"), F.col("b").cast("int").alias("bl"), F.col("x").alias("bp"))
        counts = self.branch_counts.withColumnRenamed("cluster", "label")
        rows = self._members.drop("x").join(own, "pos", "left").join(counts, "label", "left").join(self.centralities.select("pos", "lens"), "pos", "left")
        noise, single = F.col("label") < 0, F.coalesce("single", F.lit(True))
        label = F.when(noise, -1).when(single, F.col("offset")).otherwise(F.col("bl") + F.col("offset") + F.col("noise"))
        out = rows.select(
            "id",
            label.cast("int").alias("label"),
            F.when(noise | single, F.col("probability")).otherwise((F.col("probability") + F.col("bp")) / 2).alias("probability"),
            F.col("label").alias("cluster_label"),
            F.col("probability").alias("cluster_probability"),
            F.when(noise | single, F.lit(0)).otherwise(F.col("bl")).cast("int").alias("branch_label"),
            F.when(noise | single, F.lit(1.0)).otherwise(F.col("bp")).alias("branch_probability"),
            F.coalesce("lens", F.lit(0.0)).alias("centrality"),
        )
        rest = self.model.points.where("pos IS NULL").select("id", F.lit(-1).alias("label"), F.lit(0.0).alias("probability"), F.lit(-1).alias("cluster_label"), F.lit(0.0).alias("cluster_probability"), F.lit(0).alias("branch_label"), F.lit(1.0).alias("branch_probability"), F.lit(0.0).alias("centrality"))
        return materialize(out.unionByName(rest), "branch-result")

    @property
    def condensed_trees(self) -> DataFrame:
        """``cluster, parent, child, lambda_val, child_size`` over the points' order within the cluster."""
        self._ready()
        return self._rows.where(F.col("kind") == CONDENSED).select("cluster", F.col("a").alias("parent"), F.col("b").alias("child"), F.col("x").alias("lambda_val"), F.col("n").alias("child_size"))

    @property
    def linkage_trees(self) -> DataFrame:
        self._ready()
        return self._rows.where(F.col("kind") == LINKAGE).select("cluster", F.col("a").alias("parent"), F.col("b").alias("left_child"), F.col("c").alias("right_child"), F.col("x").alias("distance"), F.col("n").alias("size"))

    @property
    def approximation_graph(self) -> DataFrame:
        """``cluster, a, b, lens, mr`` in positions."""
        self._ready()
        return self._graph

    @cached_property
    def exemplars(self) -> DataFrame:
        """``cluster, branch, id``: the points that stay longest in the selected branches."""
        self._ready()
        p = self._rows.where(F.col("kind") == POINT).where("b >= 0").select("cluster", F.col("a").alias("pos"), F.col("b").cast("int").alias("branch"), F.col("z").alias("lam"))
        most = p.groupBy("cluster", "branch").agg(F.max("lam").alias("lam"))
        return p.join(most, ["cluster", "branch", "lam"]).join(self._members.select("pos", "id"), "pos").select("cluster", "branch", "id")

    def weighted_centroid(self, label: int) -> list[float]:
        if label < 0:
            raise ValueError("noise has no centroid")
        rows = self.result.where(F.col("label") == label).join(self._members.select("id", "x"), "id")
        row = weighted_average(rows, "label", "x", "probability").first()
        if row is None:
            raise ValueError(f"no branch {label}")
        return row["x"]

    def weighted_medoid(self, label: int) -> list[float]:
        if label < 0:
            raise ValueError("noise has no medoid")
        from moraine.operators.within_labels import reduce_pairs

        rows = self.result.where(F.col("label") == label).select("id", "probability").join(self._members.select("id", "pos", "x"), "id")
        rows = materialize(rows.select("pos", "x", F.lit(int(label)).alias("label"), F.col("probability").alias("weight")), "branch-points")
        cost = reduce_pairs(rows, self.model.metric, lambda d, w: np.nansum(d * w[None], axis=1))
        best = cost.orderBy("total", "pos").first()
        if best is None:
            raise ValueError(f"no branch {label}")
        return rows.where(F.col("pos") == best["pos"]).first()["x"]

    def predict(self, points: DataFrame) -> DataFrame:
        """``id, label, probability, cluster_label, cluster_probability, branch_label, branch_probability``
        of new points, from the branch of the point that each joins first."""
        self._ready()
        placed = Predictor(self.model).labels(points)
        own = self.result.select(F.col("id").alias("neighbor"), F.col("label").alias("nl"), F.col("branch_label").alias("nb"), F.col("branch_probability").alias("np"))
        few = 1 if self.sides else 2
        counts = self.branch_counts.select(F.col("cluster").alias("cl"), (F.col("branches") <= few).alias("plain"))
        rows = placed.join(own, "neighbor", "left").join(counts, F.col("label") == F.col("cl"), "left")
        noise, plain = F.col("label") < 0, F.coalesce("plain", F.lit(True))
        return rows.select(
            "id",
            F.when(noise, -1).when(plain, F.col("label")).otherwise(F.col("nl")).cast("int").alias("label"),
            F.when(noise, F.lit(0.0)).when(plain, F.col("probability")).otherwise((F.col("probability") + F.col("np")) / 2).alias("probability"),
            F.col("label").alias("cluster_label"),
            F.col("probability").alias("cluster_probability"),
            F.when(noise | plain, F.lit(0)).otherwise(F.col("nb")).cast("int").alias("branch_label"),
            F.when(noise | plain, F.lit(1.0)).otherwise(F.col("np")).alias("branch_probability"),
        )
