"""Flat clusterings with a wanted number of clusters, from a fitted hierarchy."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame

from moraine.operators import tree as T
from moraine.plans.density import DensityClusterer, DensityModel
from moraine.plans.predict import MODEL_ROWS, Predictor


def _splits(model: DensityModel) -> tuple[T.Condensed, dict]:
    """The hierarchy's clusters without its points, and their stabilities."""
    rows = model.clusters.orderBy("cluster").limit(MODEL_ROWS + 1).collect()
    if len(rows) > MODEL_ROWS:
        raise ValueError("the model has too many clusters to search here; raise min_cluster_size")
    tree = T.Condensed(model.total)
    for r in rows:
        if r["parent"] >= 0:
            tree.add(r["parent"], r["cluster"], r["birth"], r["size"])
    return tree, {r["cluster"]: r["stability"] for r in rows}


def count_clusters(model: DensityModel, method: str, epsilon: float = 0.0) -> int:
    tree, weight = _splits(model)
    return len(T.select(tree, weight, method, False, epsilon))


def select_epsilon(model: DensityModel, method: str, n_clusters: int) -> float:
    """The largest distance below which no cluster is split, that leaves ``n_clusters``.

    "eom": RuntimeError where no distance gives that number; "leaf": a number above the
    possible one is lowered with a warning.
    """
    tree, weight = _splits(model)
    levels = sorted(set(tree.lam))
    if method == "leaf":
        if n_clusters > len(levels) + 1:
            warnings.warn(f"only {len(levels) + 1} clusters are possible", UserWarning, stacklevel=2)
            n_clusters = len(levels) + 1
        return 1 / levels[n_clusters - 2] - 1e-12 if levels else 0.0
    if method != "eom":
        raise ValueError('method must be "eom" or "leaf"')
    if n_clusters > len(T.select(tree, dict(weight), "eom")):
        raise AssertionError("more clusters than stability selects; use leaf")
    for lam in levels:
        epsilon = (1 / lam if lam < math.inf else 0.0) - 1e-12
        if len(T.select(tree, dict(weight), "eom", False, epsilon)) == n_clusters:
            return epsilon
    raise RuntimeError("no distance gives that number of clusters")


def recut(model: DensityModel, n_clusters: int | None = None, epsilon: float = 0.0) -> DensityModel:
    """The model with another selection; neighbours and tree are those it has.

    Size caps, persistence and birth caps of the fit don't hold for the re-cut.
    """
    method = model.params["cluster_selection_method"]
    if n_clusters is not None:
        if method == "eom" and n_clusters > count_clusters(model, "eom"):
            warnings.warn("more clusters than stability selects: changing to leaf", UserWarning, stacklevel=2)
            method = "leaf"
        epsilon = select_epsilon(model, method, n_clusters)
    return model.refit(cluster_selection_method=method, cluster_selection_epsilon=float(max(epsilon, 0.0)), cluster_selection_persistence=0.0, max_cluster_size=0, cluster_selection_epsilon_max=math.inf, match_reference_implementation=False)


def cluster_flat(points: DataFrame, n_clusters: int | None = None, epsilon: float = 0.0, clusterer: DensityClusterer | None = None, **params) -> DensityModel:
    """Fit once (unless ``clusterer`` is fitted) and cut to ``n_clusters`` or at ``epsilon``."""
    if clusterer is None or clusterer.model is None:
        clusterer = (clusterer or DensityClusterer(**params)).fit(points)
    return recut(clusterer.model, n_clusters, epsilon)


def approximate_predict_flat(model: DensityModel, points: DataFrame, n_clusters: int | None = None, epsilon: float = 0.0, predictor: Predictor | None = None) -> DataFrame:
    """``id, label, probability, neighbor`` of new points under a re-cut; ``model`` stays as it is."""
    return (predictor or Predictor(recut(model, n_clusters, epsilon))).labels(points)


def membership_vector_flat(model: DensityModel, points: DataFrame, n_clusters: int | None = None, epsilon: float = 0.0) -> DataFrame:
    return Predictor(recut(model, n_clusters, epsilon)).membership(points)


def all_points_membership_vectors_flat(model: DensityModel, n_clusters: int | None = None, epsilon: float = 0.0) -> DataFrame:
    return Predictor(recut(model, n_clusters, epsilon)).all_memberships()


def clusters_of(predictor: Predictor) -> list[int]:
    """The selected clusters that a predictor places points in."""
    return sorted(int(c) + predictor.tree.root for c in predictor.tree.selected)
