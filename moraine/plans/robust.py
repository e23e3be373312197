"""Robust single linkage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.functions.metrics import NAMES, fit_metric
from moraine.plans.density import _ALGORITHMS, LINKAGE, DensityClusterer, NotFitted, _number, _whole, cut_labels, fit_tree, hierarchy
from moraine.sources.points import finite_points


class RobustLinkage:
    """Single linkage over max(core_k(a), core_k(b), d / alpha), cut at a distance.

    ``labels``: components of at least ``gamma`` points at the distance ``cut``; others are -1.
    ``k`` doesn't count the point itself. ``algorithm``, ``leaf_size`` and ``core_dist_n_jobs`` change nothing.
    """

    def __init__(self, cut: float = 0.4, k: int = 5, alpha: float = math.sqrt(2), gamma: int = 5, metric="euclidean", algorithm: str = "best", core_dist_n_jobs: int = 4, leaf_size: int = 40, p: float | None = None, block: int = 4096, **kwargs):
        self.cut, self.k, self.alpha, self.gamma, self.metric, self.algorithm, self.leaf_size, self.p, self.block, self.kwargs = cut, k, alpha, gamma, metric, algorithm, leaf_size, p, block, kwargs
        self._points: DataFrame | None = None

    def fit(self, points: DataFrame) -> RobustLinkage:
        """``points``: ``id, features``, where rows that aren't finite are noise; with the metric "precomputed" an edge table ``i, j, d``."""
        _whole("k", self.k, 1)
        _whole("gamma", self.gamma, 1)
        _whole("leaf_size", self.leaf_size, 1)
        _number("alpha", self.alpha, above=True)
        _number("cut", self.cut)
        if self.metric != "precomputed" and not callable(self.metric) and self.metric not in NAMES:
            raise ValueError(f"unknown metric: {self.metric!r}")
        if self.algorithm not in _ALGORITHMS:
            raise ValueError(f"unknown algorithm: {self.algorithm!r}")
        if self.p is not None and self.p < 0:
            raise ValueError("p must not be negative")
        if self.metric == "precomputed":
            model = DensityClusterer(min_samples=self.k, alpha=self.alpha, metric="precomputed", **self.kwargs).fit(points).model
            self._points, self._n, self.core, self._mst = model.points, model.n, model.core, model._mst
            return self
        metric = fit_metric(self.metric, p=self.p, **self.kwargs)
        self._points, self._n, _ = finite_points(points)
        first = self._points.where("pos IS NOT NULL").first()
        self._dim = len(first["x"]) if first else 0
        self.core, self._mst = fit_tree(self._points.where("pos IS NOT NULL").select("pos", "x"), self._n, max(1, min(self._n - 1, self.k)), metric, self.alpha, self.block, self._dim)
        return self

    def _ready(self) -> None:
        if self._points is None:
            raise NotFitted("not fitted yet")

    @property
    def labels(self) -> DataFrame:
        self._ready()
        return self.get_clusters(self.cut, self.gamma)

    def get_clusters(self, cut: float, min_cluster_size: int = 5) -> DataFrame:
        """``id, label`` at another cut of the same hierarchy."""
        self._ready()
        return cut_labels(self._mst, self._points, cut, min_cluster_size)

    @property
    def cluster_hierarchy(self) -> DataFrame:
        """``parent, left_child, right_child, distance, size``, merges in the order of their distance."""
        self._ready()
        m = hierarchy(self._mst, self._n, {}).where(F.col("kind") == LINKAGE)
        return m.select(F.col("a").alias("parent"), F.col("b").alias("left_child"), F.col("c").alias("right_child"), F.col("x").alias("distance"), F.col("n").alias("size"))

    def fit_predict(self, points: DataFrame) -> DataFrame:
        return self.fit(points).labels


def robust_single_linkage(points: DataFrame, cut: float, **params) -> tuple[DataFrame, DataFrame]:
    """(labels ``id, label``, linkage table)."""
    fitted = RobustLinkage(cut=cut, **params).fit(points)
    return fitted.labels, fitted.cluster_hierarchy
