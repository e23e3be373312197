"""Hierarchical density clustering: the estimator and its model."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions.metrics import BOXED, NAMES, Metric, fit_metric
from moraine.functions.scalar import weighted_average
from moraine.operators import neighbors as N
from moraine.operators import spanning as S
from moraine.operators import tree as T
from moraine.operators.arrow import batch
from moraine.operators.blocks import Layout
from moraine.operators.forest import boruvka
from moraine.operators.tree_arrays import artefacts, tables
from moraine.operators.within_labels import reduce_pairs
from moraine.session import materialize
from moraine.sources.points import finite_points

_ALGORITHMS = ("best", "generic", "prims_kdtree", "prims_balltree", "boruvka_kdtree", "boruvka_balltree")
_ARTEFACT = [("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("u", pa.float64())]
ARTEFACT = "kind int, a long, b long, c long, n long, x double, y double, z double, u double"
MST, LINKAGE, CONDENSED, POINT, CLUSTER = range(5)
_KINDS = {"mst": MST, "linkage": LINKAGE, "condensed": CONDENSED, "points": POINT, "clusters": CLUSTER}


class NotFitted(AttributeError):
    pass


def _whole(name: str, value, least: int) -> None:
    if not isinstance(value, (int, np.integer)) or isinstance(value, bool) or value < least:
        raise ValueError(f"{name} must be an integer of at least {least}")


def _number(name: str, value, least: float = 0.0, above: bool = False) -> None:
    if not isinstance(value, (int, float, np.floating, np.integer)) or isinstance(value, bool) or value < least or (above and value == least) or math.isnan(value):
        raise ValueError(f"{name} must be a number {'above' if above else 'of at least'} {least}")


def rows_of(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, p: dict) -> list[np.ndarray]:
    """All artefacts of the spanning tree ``a, b, w`` over 0..n-1 as columns of the artefact table."""
    found = artefacts(n, a, b, w, p)
    size = {name: len(t["a"]) for name, t in found.items()}
    cols = [np.concatenate([np.full(size[name], _KINDS[name], np.int32) for name in found])]
    for name, kind in _ARTEFACT[1:]:
        dtype = np.float64 if kind == pa.float64() else np.int64
        cols.append(np.concatenate([np.asarray(t[name], dtype) if name in t else np.zeros(size[k], dtype) for k, t in found.items()]))
    return cols


def tree_task(n: int, params: dict, kinds: tuple = tuple(range(5))):
    """The whole hierarchy in one task: sequential over the n - 1 edges of the tree. Only rows of ``kinds`` are returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [b for b in batches if b.num_rows]
        if not t and n != 1:
            return
        whole = np.int32 if 2 * n < 1 << 31 else np.int64
        a, b, w = (np.concatenate([x.column(c).to_numpy().astype(dtype) for x in t]) if t else np.empty(0, dtype) for c, dtype in (("a", whole), ("b", whole), ("w", float)))
        del t
        for name, columns in tables(n, a, b, w, params):
            a = b = w = None
            size = len(columns["a"]) if _KINDS[name] in kinds else 0
            for s in range(0, size, 65_536):
                many = min(65_536, size - s)
                yield batch(_ARTEFACT, [np.full(many, _KINDS[name], np.int32), *(pa.array(columns[c][s : s + many]).cast(dtype) if c in columns else pa.array(np.zeros(many), dtype) for c, dtype in _ARTEFACT[1:])])
            del columns

    return run


_TREE_PARAMS = ("min_cluster_size", "cluster_selection_persistence", "cluster_selection_method", "allow_single_cluster", "cluster_selection_epsilon", "max_cluster_size", "cluster_selection_epsilon_max", "match_reference_implementation")


#: Trees of more points are written in two parts, each when it is first asked for.
APART = 1_000_000


def hierarchy(mst: DataFrame, n: int, params: dict, kinds: tuple = tuple(range(5))) -> DataFrame:
    params = {k: params[k] for k in _TREE_PARAMS if k in params}
    return materialize(mst.select("a", "b", "w").repartition(1).mapInArrow(tree_task(n, params, kinds), ARTEFACT), "hierarchy")


class DensityModel:
    """A fitted hierarchy. Every property is a DataFrame, built when first asked for.

    In trees, points are their row numbers 0..n-1 in the order of ``id``, clusters follow
    from n on; points left out for missing values fall out of the root at lambda 0.
    """

    def __init__(self, points: DataFrame | None, n: int, total: int, core: DataFrame, mst: DataFrame, params: dict, metric: Metric | None, dim: int):
        self.points, self.n, self.total, self.core, self._mst, self.params, self.metric, self.dim = points, n, total, core, mst, params, metric, dim
        self.spark = mst.sparkSession
        self._parts: dict = {}

    def refit(self, **params) -> DensityModel:
        """Another selection from the same spanning tree: nothing but the hierarchy task runs again."""
        return DensityModel(self.points, self.n, self.total, self.core, self._mst, self.params | params, self.metric, self.dim)

    def _kind(self, kind: int) -> DataFrame:
        if self.n == 0:
            return self.spark.createDataFrame([], ARTEFACT)
        both = (MST, LINKAGE, CONDENSED), (POINT, CLUSTER)
        part = tuple(range(5)) if self.n <= APART else both[kind in both[1]]
        if part not in self._parts:
            self._parts[part] = hierarchy(self._mst, self.n, self.params, part)
        return self._parts[part].where(F.col("kind") == kind)

    @property
    def _outside(self) -> int:
        return self.total - self.n

    def _raw(self, df: DataFrame, column: str, keep_clusters: bool = True) -> DataFrame:
        """Positions of finite points to row numbers of all points; cluster ids shift up."""
        if not self._outside:
            return df
        raw = self.points.where("pos IS NOT NULL").select(F.col("pos").alias(column), F.col("raw").alias("__raw"))
        return df.join(raw, column, "left").withColumn(column, F.coalesce("__raw", F.col(column) + F.lit(self._outside))).drop("__raw")

    @cached_property
    def minimum_spanning_tree(self) -> DataFrame:
        """``from, to, distance, step`` in ids."""
        ids = self.points.where("pos IS NOT NULL")
        m = self._kind(MST).select("a", "b", F.col("x").alias("distance"), F.col("n").cast("int").alias("step"))
        return m.join(ids.select(F.col("pos").alias("a"), F.col("id").alias("from")), "a").join(ids.select(F.col("pos").alias("b"), F.col("id").alias("to")), "b").select("from", "to", "distance", "step")

    @cached_property
    def single_linkage_tree(self) -> DataFrame:
        """``parent, left_child, right_child, distance, size``; points left out merge last, at inf."""
        m = self._kind(LINKAGE).select(F.col("a").alias("parent"), F.col("b").alias("left_child"), F.col("c").alias("right_child"), F.col("x").alias("distance"), F.col("n").alias("size"))
        if not self._outside:
            return m
        m = self._raw(self._raw(m, "left_child"), "right_child").withColumn("parent", F.col("parent") + F.lit(self._outside))
        number = F.row_number().over(Window.orderBy("raw"))
        last = F.lit(2 * self.n - 2 + self._outside)
        rest = self.points.where("pos IS NULL").select("raw", number.alias("r"))
        rest = rest.select((last + F.col("r")).alias("parent"), (last + F.col("r") - 1).alias("left_child"), F.col("raw").alias("right_child"), F.lit(float("inf")).alias("distance"), (F.lit(self.n) + F.col("r")).cast("long").alias("size"))
        return m.unionByName(rest)

    @cached_property
    def condensed_tree(self) -> DataFrame:
        """``parent, child, lambda_val, child_size``."""
        m = self._kind(CONDENSED).select((F.col("a") + F.lit(self._outside)).alias("parent"), F.col("b").alias("child"), F.col("x").alias("lambda_val"), F.col("n").alias("child_size"))
        if not self._outside:
            return m
        rest = self.points.where("pos IS NULL").select(F.lit(self.total).cast("long").alias("parent"), F.col("raw").alias("child"), F.lit(0.0).alias("lambda_val"), F.lit(1).cast("long").alias("child_size"))
        return self._raw(m, "child").unionByName(rest)

    @cached_property
    def clusters(self) -> DataFrame:
        """``cluster, label, parent, size, birth, death, stability, subtree_death`` of all clusters of the hierarchy."""
        s = F.lit(self._outside)
        return self._kind(CLUSTER).select((F.col("a") + s).alias("cluster"), F.col("b").cast("int").alias("label"), F.when(F.col("c") < 0, F.col("c")).otherwise(F.col("c") + s).alias("parent"), F.col("n").alias("size"), F.col("x").alias("birth"), F.col("y").alias("death"), F.col("z").alias("stability"), F.col("u").alias("subtree_death"))

    @cached_property
    def point_rows(self) -> DataFrame:
        """Per point: ``id, pos, x, label, parent, probability, score, lambda_val`` (``pos`` null: left out)."""
        m = self._kind(POINT).select(F.col("a").alias("pos"), F.col("b").cast("int").alias("label"), (F.col("c") + F.lit(self._outside)).alias("parent"), F.col("x").alias("probability"), F.col("y").alias("score"), F.col("z").alias("lambda_val"))
        joined = self.points.join(m, "pos", "left")
        return joined.select("id", "pos", "x", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("parent", F.lit(self.total)).alias("parent"), F.coalesce("probability", F.lit(0.0)).alias("probability"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("lambda_val", F.lit(0.0)).alias("lambda_val"))

    @cached_property
    def result(self) -> DataFrame:
        """``id, label, probability``; noise is -1."""
        return self.point_rows.select("id", "label", "probability")

    @cached_property
    def outlier_scores(self) -> DataFrame:
        """``id, score``: how much earlier than the densest part of its subtree a point left."""
        return self.point_rows.select("id", "score")

    def outliers_above(self, share: float = 0.9) -> DataFrame:
        """``id, score`` of the points whose outlier score is over the given percentile of all scores."""
        limit = self.outlier_scores.agg(F.percentile("score", F.lit(share)).alias("limit"))
        return self.outlier_scores.crossJoin(F.broadcast(limit)).where("score > limit").select("id", "score")  # one row

    @cached_property
    def persistence(self) -> DataFrame:
        """``label, persistence``."""
        top = self._kind(CONDENSED).agg(F.max("x").alias("top"))
        size = self.result.where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("members"))
        rows = self.clusters.where("label >= 0").join(size, "label", "left").crossJoin(F.broadcast(top))
        inf = F.lit(float("inf"))
        value = F.when((F.col("top") == 0) | (F.col("top") == inf) | F.col("members").isNull(), F.lit(1.0)).otherwise(F.col("stability") / (F.col("members") * F.when(F.col("top") > 0, F.col("top"))))
        return rows.select("label", value.alias("persistence"))

    @cached_property
    def exemplars(self) -> DataFrame:
        """``label, id, features``: the points that stay longest in each leaf cluster below a selected one."""
        leaf = self.clusters.join(self.clusters.select(F.col("parent").alias("cluster")).distinct(), "cluster", "left_anti").select("cluster", "death")
        rows = self.point_rows.where("pos IS NOT NULL").join(leaf, F.col("parent") == F.col("cluster"))
        owner = self.owners.select("cluster", F.col("label").alias("owner"))
        return rows.where("lambda_val = death").drop("cluster").join(owner, F.col("parent") == F.col("cluster")).select(F.col("owner").alias("label"), "id", F.col("x").alias("features"))

    @cached_property
    def owners(self) -> DataFrame:
        """``cluster, label, selected``: every cluster at or below a selected one, with that one.

        Descends level by level; the number of levels is the depth of the cluster tree.
        """
        kids = self.clusters.select(F.col("parent").alias("up"), "cluster")
        level = materialize(self.clusters.where("label >= 0").select("cluster", "label", F.col("cluster").alias("selected")), "owners")
        out = level
        while not level.isEmpty():
            level = materialize(kids.join(level.withColumnRenamed("cluster", "up"), "up").select("cluster", "label", "selected"), "owners")
            out = out.unionByName(level)
        return materialize(out, "owners")

    def dbscan(self, distance: float, min_cluster_size: int = 5) -> DataFrame:
        """``id, label``: components of all tree edges shorter than ``distance``; small ones are noise."""
        return cut_labels(self._mst, self.points, distance, min_cluster_size)

    def weighted_centroids(self) -> DataFrame:
        """``label, centroid``: the average of each cluster's points, weighted by probability."""
        return weighted_average(self.point_rows.where("label >= 0"), "label", "x", "probability").withColumnRenamed("x", "centroid")

    def weighted_centroid(self, label: int) -> list[float]:
        if label < 0:
            raise ValueError("noise has no centroid")
        row = self.weighted_centroids().where(F.col("label") == label).first()
        if row is None:
            raise ValueError(f"no cluster {label}")
        return row["centroid"]

    def weighted_medoids(self) -> DataFrame:
        """``label, id, features``: the point of least weighted distance to its cluster; ties by id."""
        rows = materialize(self.point_rows.where("label >= 0").select("pos", "x", "label", F.col("probability").alias("weight"), "id"), "members")
        cost = reduce_pairs(rows.drop("id"), self.metric, lambda d, w: np.nansum(d * w[None], axis=1))
        best = cost.groupBy("label").agg(F.min(F.struct("total", "pos")).alias("m")).select("label", F.col("m.pos").alias("pos"))
        return best.join(rows.select("pos", "id", F.col("x").alias("features")), "pos").select("label", "id", "features")

    def weighted_medoid(self, label: int) -> list[float]:
        if label < 0:
            raise ValueError("noise has no medoid")
        row = self.weighted_medoids().where(F.col("label") == label).first()
        if row is None:
            raise ValueError(f"no cluster {label}")
        return row["features"]

    def relative_validity(self) -> float:
        """A density-based validity from the spanning tree alone, between -1 and 1."""
        lab = self.point_rows.where("pos IS NOT NULL").select("pos", "label")
        size = {r["label"]: r["n"] for r in lab.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        noise, k = size.pop(-1, 0), len([c for c in size if c >= 0])
        total = noise + sum(size.values())
        e = self._kind(MST).select("a", "b", F.col("x").alias("w"))
        e = e.join(lab.select(F.col("pos").alias("a"), F.col("label").alias("la")), "a").join(lab.select(F.col("pos").alias("b"), F.col("label").alias("lb")), "b")
        far = e.agg(F.max("w")).first()[0] or 0.0
        inside = e.where("la = lb AND la >= 0").groupBy(F.col("la").alias("l")).agg(F.max("w").alias("sparse"))
        ends = e.where("la != lb").select(F.explode(F.array(F.struct(F.col("la").alias("l"), F.col("lb").alias("o")), F.struct(F.col("lb").alias("l"), F.col("la").alias("o")))).alias("s"), "w")
        ends = ends.select("s.l", "s.o", "w").where("l >= 0")
        apart = ends.groupBy("l").agg(F.min(F.when(F.col("o") >= 0, F.col("w"))).alias("other"), F.min(F.when(F.col("o") < 0, F.col("w"))).alias("noise"))
        sparse = {r["l"]: r["sparse"] for r in inside.collect()}
        sep = {r["l"]: r for r in apart.collect()}
        score = 0.0
        for c, n in size.items():
            row = sep.get(c)
            a = row["other"] if row is not None else None
            if a is None:
                a = row["noise"] if row is not None and row["noise"] is not None and k > 1 else None
            a = far * 2 if a is None else a
            b = sparse.get(c, 0.0)
            if max(a, b) > 0:
                score += n / total * (a - b) / max(a, b)
        return float(score)


#: Edges of a tree that one task takes as they are.
ONE_TASK = 5_000_000


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches))
    if t.num_rows:
        nodes, ends = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
        ends = ends.reshape(2, -1)
        part = T.components(len(nodes), ends[0], ends[1])
        yield batch([("node", pa.int64()), ("part", pa.int64())], [nodes, nodes[part]])


def cut_labels(mst: DataFrame, points: DataFrame, distance: float, min_cluster_size: int) -> DataFrame:
    """``id, label`` of the components of edges ``a, b, w`` shorter than ``distance``.

    Labels 0.. in the order of the components' least position; components under
    ``min_cluster_size`` and points left out are -1. A tree that fits a task (``ONE_TASK`` edges)
    is cut there, a larger one by distributed rounds.
    """
    short = mst.where(F.col("w") < distance).select("a", "b", "w")
    if mst.count() <= ONE_TASK:
        parts = short.repartition(1).mapInArrow(_parts, "node long, part long")
    else:
        _, parts = boruvka(short)
    one = points.select("id", "pos").join(parts.select(F.col("node").alias("pos"), "part"), "pos", "left").withColumn("part", F.coalesce("part", "pos"))
    size = one.where("part IS NOT NULL").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("least")).where(F.col("n") >= min_cluster_size)
    label = size.select("part", (F.row_number().over(Window.orderBy("least")) - 1).cast("int").alias("label"))
    return one.join(label, "part", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


class DensityClusterer:
    """Hierarchical density clustering of points, or of a table of distances (metric "precomputed").

    For distances, ``max_dist`` stands for reachabilities that aren't finite, and ``missing="inf"`` joins parts
    without distances between them at infinity, with a warning; without either they are an error.

    Parameters that only tune another engine (``algorithm``, ``leaf_size``,
    ``approx_min_span_tree``, ``core_dist_n_jobs``, ``memory``, ``gen_min_span_tree``) are accepted and change
    nothing: the tree is always exact. ``min_samples`` doesn't count the point itself.
    """

    def __init__(
        self,
        min_cluster_size: int = 5,
        min_samples: int | None = None,
        cluster_selection_epsilon: float = 0.0,
        cluster_selection_persistence: float = 0.0,
        max_cluster_size: int = 0,
        metric="euclidean",
        alpha: float = 1.0,
        p: float | None = None,
        algorithm: str = "best",
        leaf_size: int = 40,
        memory=None,
        approx_min_span_tree: bool = True,
        gen_min_span_tree: bool = False,
        core_dist_n_jobs: int = 4,
        cluster_selection_method: str = "eom",
        allow_single_cluster: bool = False,
        prediction_data: bool = False,
        branch_detection_data: bool = False,
        match_reference_implementation: bool = False,
        cluster_selection_epsilon_max: float = math.inf,
        block: int = 4096,
        **kwargs,
    ):
        self.params = {k: v for k, v in locals().items() if k not in ("self", "kwargs", "__class__")}
        self.metric_kwargs = kwargs
        self.model: DensityModel | None = None

    def _check(self) -> dict:
        p = dict(self.params)
        p["min_samples"] = p["min_cluster_size"] if p["min_samples"] is None else p["min_samples"]
        _whole("min_samples", p["min_samples"], 1)
        _whole("min_cluster_size", p["min_cluster_size"], 2)
        _whole("leaf_size", p["leaf_size"], 1)
        _whole("max_cluster_size", p["max_cluster_size"], 0)
        _number("cluster_selection_epsilon", p["cluster_selection_epsilon"])
        _number("cluster_selection_persistence", p["cluster_selection_persistence"])
        _number("cluster_selection_epsilon_max", p["cluster_selection_epsilon_max"])
        _number("alpha", p["alpha"], above=True)
        if p["cluster_selection_method"] not in ("eom", "leaf"):
            raise ValueError('cluster_selection_method must be "eom" or "leaf"')
        if p["algorithm"] not in _ALGORITHMS:
            raise ValueError(f"unknown algorithm: {p['algorithm']!r}")
        if p["metric"] != "precomputed" and not callable(p["metric"]) and p["metric"] not in NAMES:
            raise ValueError(f"unknown metric: {p['metric']!r}")
        if p["metric"] in ("minkowski", "p") and p["p"] is None:
            p["p"] = 2
        if p["p"] is not None and p["p"] < 0:
            raise ValueError("p must not be negative")
        if p["match_reference_implementation"]:
            p["min_samples"] -= 1
            p["min_cluster_size"] += 1
        return p

    def fit(self, points: DataFrame) -> DensityClusterer:
        """``points``: ``id, features``; with the metric "precomputed" an edge table ``i, j, d``.

        Rows with null, NaN or infinite elements are noise. An empty table gives empty results.
        """
        p = self._check()
        if p["metric"] == "precomputed":
            self.model = self._fit_edges(points, p)
            return self
        metric = fit_metric(p["metric"], p=p["p"], **self.metric_kwargs)
        rows, n, total = finite_points(points)
        finite = rows.where("pos IS NOT NULL").select("pos", "x")
        dim = len(finite.first()["x"]) if n else 0
        p["min_samples"] = max(1, min(n - 1, p["min_samples"]))
        core, mst = fit_tree(finite, n, p["min_samples"], metric, p["alpha"], p["block"], dim)
        self.model = DensityModel(rows, n, total, core, mst, p, metric, dim)
        return self

    def _fit_edges(self, edges: DataFrame, p: dict) -> DensityModel:
        from moraine.sources.points import positions

        both = edges.select("i", "j", "d").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")).where("i != j")
        both = both.groupBy("i", "j").agg(F.min("d").alias("d")).where("d IS NOT NULL AND NOT isnan(d)").where(F.col("d") < F.lit(float("inf")))
        nodes = positions(edges.select(F.explode(F.array("i", "j")).alias("id")).distinct())
        nodes = materialize(nodes.select("id", "raw", F.col("raw").alias("pos"), F.array().cast("array<double>").alias("x")), "points")
        n = nodes.count()
        near = both.join(nodes.select(F.col("id").alias("i"), F.col("pos").alias("pi")), "i").join(nodes.select(F.col("id").alias("j"), F.col("pos").alias("pj")), "j")
        near = materialize(near.select(F.col("pi").alias("i"), F.col("pj").alias("j"), "d"), "distances")
        p["min_samples"] = max(1, min(n - 1, p["min_samples"]))
        core = materialize(N.core_of_edges(near, p["min_samples"]), "core")
        graph = S.edge_reachability(near, core, p["alpha"], self.metric_kwargs.get("max_dist", 0.0))
        mst, parts = boruvka(graph.select(F.col("i").alias("a"), F.col("j").alias("b"), "w"))
        mst = materialize(mst, "mst")
        missing = max(n - 1, 0) - mst.count()
        if missing and self.metric_kwargs.get("missing") == "inf":
            # Distances left out are infinite: the parts are joined at the least node of all.
            least = nodes.join(parts.withColumnRenamed("node", "pos"), "pos", "left").groupBy(F.coalesce("part", "pos").alias("part")).agg(F.min("pos").alias("b"))
            mst = materialize(mst.unionByName(least.where("b > 0").select(F.lit(0).cast("long").alias("a"), "b", F.lit(float("inf")).alias("w"))), "mst")
            warnings.warn("the spanning tree has infinite edges: distances are missing between parts of the data", UserWarning, stacklevel=3)
        elif missing:
            raise ValueError("the distances don't connect all points: there is more than one component; add distances or give max_dist")
        return DensityModel(nodes, n, n, core, mst, p, None, 0)

    def __getattr__(self, name: str):
        if name.startswith("__") or name in ("model", "params"):
            raise AttributeError(name)
        if self.__dict__.get("model") is None:
            raise NotFitted(f"{name}: not fitted yet")
        return getattr(self.model, name)

    def fit_predict(self, points: DataFrame) -> DataFrame:
        return self.fit(points).model.result

    def get_params(self) -> dict:
        return self.params | self.metric_kwargs

    def set_params(self, **params) -> DensityClusterer:
        """Other parameters for the next fit; a model that is there stays."""
        for k, v in params.items():
            (self.params if k in self.params else self.metric_kwargs)[k] = v
        return self


#: How many blocks of points of up to four dimensions one task takes.
LOW_BLOCKS = 6


def fit_tree(finite: DataFrame, n: int, k: int, metric: Metric, alpha: float, block: int, dim: int = 2) -> tuple[DataFrame, DataFrame]:
    """(core distances ``pos, core``, spanning tree ``a, b, w``) of points ``pos, x``.

    Up to ``block`` points fit one task, which makes both; more are done block by block. In few dimensions, where
    a step of Prim's method costs little more than its call, a task takes ``LOW_BLOCKS`` times as many.
    """
    spark = finite.sparkSession
    if n == 0:
        return spark.createDataFrame([], "pos long, core double"), spark.createDataFrame([], "a long, b long, w double")
    low = dim <= 4 and metric.name in BOXED
    if n <= (block * LOW_BLOCKS if low and block >= 1_024 else block):
        both = materialize(finite.repartition(1).mapInArrow(_small(k, metric, alpha), "kind int, a long, b long, w double"), "tree")
        core = both.where("kind = 0").select(F.col("a").alias("pos"), F.col("w").alias("core"))
        return core, both.where("kind = 1").select("a", "b", "w")
    if low:  # boxes tell much in few dimensions: small blocks, few pairs of them
        block = min(block, N.BLOCK)
    copies = repeated(finite, n, k, block) if metric.name in BOXED else None
    if copies is None:
        layout = Layout.of(finite, n, block)
        core = materialize(N.nearest_core(finite, k, metric, layout=layout), "core")
        return core, materialize(S.spanning_tree(finite, core, metric, alpha, layout=layout), "mst")
    marked = materialize(finite.join(copies, "x", "left").select("pos", "first", F.when(F.col("first").isNull() | (F.col("pos") == F.col("first")), F.col("x")).alias("x")), "marked")
    rest = marked.where("first != pos").select(F.col("first").alias("a"), F.col("pos").alias("b"), F.lit(0.0).alias("w"))
    one = marked.where("x IS NOT NULL")
    heavy, light, few = one.where("first IS NOT NULL").select("pos", "x"), one.where("first IS NULL").select("pos", "x"), one.select("pos", "x")
    layout = Layout.of(few, few.count(), block)
    core = heavy.select("pos", F.lit(0.0).alias("core"))
    if not light.isEmpty():  # the k-th neighbour, or the nearest repeated point, of which there are more than k
        near = N.nearest_core(few, k, metric, layout=layout).join(N.knn(heavy, 1, metric, None, queries=light).select("pos", "dist"), "pos")
        core = core.unionByName(near.select("pos", F.least("core", "dist").alias("core")))
    core = materialize(core, "core")
    tree = materialize(S.spanning_tree(few, core, metric, alpha, layout=layout), "mst")
    return core.unionByName(rest.select(F.col("b").alias("pos"), F.lit(0.0).alias("core"))), tree.unionByName(rest)


def repeated(finite: DataFrame, n: int, k: int, block: int) -> DataFrame | None:
    """``x, first`` of the points that more than ``k`` rows share, with the least of their positions; None if they matter little.

    Their core distance is zero, as is their distance to one another; so in the unique tree the other rows hang on the first one,
    and each edge to another point starts there, as (w, low, high) is least there.
    """
    many = finite.groupBy("x").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > k)
    many = materialize(many, "repeated")
    look = many.agg(F.sum(F.col("rows") - 1).alias("saved"), F.max("rows").alias("most")).first()
    if look["most"] is None or (look["saved"] < n / 8 and look["most"] <= block):
        return None
    return many.select("x", "first")


def _small(k: int, metric: Metric, alpha: float):
    schema = [("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from moraine.operators.arrow import matrix

        t = pa.Table.from_batches(list(batches))
        if not t.num_rows:
            return
        pos, x = t.column("pos").to_numpy(), matrix(t.column("x"))
        order = np.argsort(pos)
        pos, x = pos[order], x[order]
        core = N.core_in_task(metric, x, pos, k) if len(pos) > 1 else np.zeros(1)
        a, b, w = S.prim(x, core, pos, metric, alpha)
        yield batch(schema, [np.r_[np.zeros(len(pos), np.int32), np.ones(len(a), np.int32)], np.r_[pos, a], np.r_[pos, b], np.r_[core, w]])

    return run


def density_cluster(points: DataFrame, **params) -> DataFrame:
    """``id, label, probability`` in one call."""
    return DensityClusterer(**params).fit_predict(points)
