"""Trees and graphs in other forms: arrays, frames, node and edge tables, plot data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.plans.branches import BranchDetector
from moraine.plans.density import DensityModel
from moraine.session import materialize


def to_pandas(df: DataFrame, order_by: list[str] | None = None) -> pd.DataFrame:
    """A table at the driver, in a fixed order; for results that fit there."""
    return df.orderBy(*(order_by or df.columns)).toPandas()


def to_numpy(df: DataFrame, order_by: list[str] | None = None) -> np.ndarray:
    """A structured array with the table's columns."""
    return to_pandas(df, order_by).to_records(index=False)


def to_networkx(nodes: DataFrame, edges: DataFrame, source: str, target: str):
    """A graph object, where that library is installed (ImportError otherwise)."""
    import networkx

    graph = networkx.from_pandas_edgelist(edges.toPandas(), source, target, True, networkx.DiGraph())
    key = nodes.columns[0]
    networkx.set_node_attributes(graph, nodes.toPandas().set_index(key).to_dict("index"))
    return graph


def condensed_graph(model: DensityModel) -> tuple[DataFrame, DataFrame]:
    """(nodes ``node, size``, edges ``parent, child, weight``): sizes of children, lambdas as weights."""
    t = model.condensed_tree
    root = t.join(t.select(F.col("child").alias("parent")), "parent", "left_anti").groupBy("parent").agg(F.sum("child_size").alias("size"))
    nodes = t.select(F.col("child").alias("node"), F.col("child_size").alias("size")).unionByName(root.withColumnRenamed("parent", "node"))
    return nodes, t.select("parent", "child", F.col("lambda_val").alias("weight"))


def linkage_graph(model: DensityModel) -> tuple[DataFrame, DataFrame]:
    """(nodes ``node, size``, edges ``parent, child, weight``): two edges per merge."""
    t = model.single_linkage_tree
    nodes = t.select(F.col("parent").alias("node"), "size").unionByName(model.points.select(F.col("raw").alias("node"), F.lit(1).cast("long").alias("size")))
    return nodes, t.select("parent", F.explode(F.array("left_child", "right_child")).alias("child"), F.col("distance").alias("weight"))


def spanning_graph(model: DensityModel) -> tuple[DataFrame, DataFrame]:
    """(nodes ``node, features``, edges ``from, to, weight``) of the spanning tree, in ids."""
    m = model.minimum_spanning_tree
    return model.points.select(F.col("id").alias("node"), F.col("x").alias("features")), m.select("from", "to", F.col("distance").alias("weight"))


def approximation_graph(detector: BranchDetector, lens_name: str = "centrality", sub_cluster_name: str = "branch") -> tuple[DataFrame, DataFrame]:
    """(points, edges) of the graph that branches were found in.

    Points: ``id, label, probability, LENS, cluster_label, cluster_probability, SUB_label,
    SUB_probability``, without noise; edges: ``parent, child, LENS, mutual_reachability, component, weight``
    in ids, weight 1 / (1 + mutual reachability).
    """
    r = detector.result.where("cluster_label >= 0")
    points = r.select("id", "label", "probability", F.col("centrality").alias(lens_name), "cluster_label", "cluster_probability", F.col("branch_label").alias(f"{sub_cluster_name}_label"), F.col("branch_probability").alias(f"{sub_cluster_name}_probability"))
    ids = detector.model.points.where("pos IS NOT NULL")
    e = detector.approximation_graph.join(ids.select(F.col("pos").alias("a"), F.col("id").alias("parent")), "a").join(ids.select(F.col("pos").alias("b"), F.col("id").alias("child")), "b")
    edges = e.select("parent", "child", F.col("lens").alias(lens_name), F.col("mr").alias("mutual_reachability"), F.col("cluster").alias("component"), (1 / (1 + F.col("mr"))).alias("weight"))
    return points, edges


def icicle(rows: pd.DataFrame, spacing: float = 1.0, log_size: bool = False, most_bars: int = 20) -> pd.DataFrame:
    """Plot data of one condensed tree: ``kind, cluster, a, b, c, d``.

    ``rows``: ``parent, child, lambda_val, child_size, points``; with ``points`` a row stands for so
    many points that fall out at once, else for a child cluster.

    bar: centre, bottom, height, width; line: x from, x to, y, y; bound: left, right, bottom,
    top. Clusters stand at the mean of their children, leaves in a row; a bar is drawn
    when a step has taken away enough of the cluster, and at its end.
    """
    scale = np.log if log_size else lambda v: v
    inner = rows[~rows.points]
    kids = {p: g.child.tolist() for p, g in inner.groupby("parent")}
    root = int(rows.parent.min())
    birth = {root: 0.0} | dict(zip(inner.child, inner.lambda_val))
    place: dict = {}
    leaves: list = []
    stack = [root]
    while stack:  # depth first, first child first
        c = stack.pop()
        if c in kids:
            stack += reversed(kids[c])
        else:
            leaves.append(c)
    for i, c in enumerate(leaves):
        place[c] = i * spacing
    for c in sorted(kids, reverse=True):
        place[c] = float(np.mean([place[k] for k in kids[c]]))
    width = scale(float(rows[rows.parent == root].child_size.sum()))
    out = []
    for c, g in rows.groupby("parent"):
        levels = g.groupby("lambda_val").child_size.sum().sort_index()
        lam, lost = levels.index.to_numpy(), levels.to_numpy().astype(float)
        total, x = lost.sum(), place[c] * width
        before = np.r_[total, total - np.cumsum(lost)[:-1]]  # points still there when a level begins
        size = np.where(before > 0.01, scale(np.maximum(before, 0.01)), 0.0) if log_size else before
        step = (scale(total) - scale(lost[-1])) / most_bars
        bottom, shown, last = birth[c], size[0], birth[c]
        for k in range(len(lam)):
            if lam[k] != last and (shown - size[k] > step or k == len(lam) - 1):
                out.append(("bar", c, x, bottom, lam[k] - bottom, shown))
                bottom, shown = last, size[k]
            last = lam[k]
        half = scale(total) / 2
        out.append(("bound", c, x - half, x + half, birth[c], lam[-1]))
    for p, c, lam, n in inner[["parent", "child", "lambda_val", "child_size"]].itertuples(index=False):
        side = np.sign(place[c] - place[p])
        out.append(("line", c, place[p] * width, place[c] * width + side * scale(float(n)) / 2, lam, lam))
    return pd.DataFrame(out, columns=["kind", "cluster", "a", "b", "c", "d"])


def plot_data(model: DensityModel, leaf_separation: float = 1.0, log_size: bool = False, max_rectangles_per_icicle: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars ``cluster, center, bottom, height, width``, lines ``cluster, x0, x1, y``, bounds ``cluster, left, right, bottom, top``).

    One task makes them from sums per cluster and lambda, so that points needn't go there singly.
    """
    t = model.condensed_tree
    points = t.where("child_size = 1").groupBy("parent", "lambda_val").agg(F.count(F.lit(1)).alias("child_size"))
    steps = points.select("parent", F.lit(-1).cast("long").alias("child"), "lambda_val", "child_size", F.lit(True).alias("points"))
    both = steps.unionByName(t.where("child_size > 1").withColumn("points", F.lit(False)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True)
        if len(rows):
            yield icicle(rows.sort_values(["parent", "points", "child", "lambda_val"]), leaf_separation, log_size, max_rectangles_per_icicle)

    got = materialize(both.repartition(1).mapInPandas(run, "kind string, cluster long, a double, b double, c double, d double"), "plot")
    bars = got.where("kind = 'bar'").select("cluster", F.col("a").alias("center"), F.col("b").alias("bottom"), F.col("c").alias("height"), F.col("d").alias("width"))
    lines = got.where("kind = 'line'").select("cluster", F.col("a").alias("x0"), F.col("b").alias("x1"), F.col("c").alias("y"))
    bounds = got.where("kind = 'bound'").select("cluster", F.col("a").alias("left"), F.col("b").alias("right"), F.col("c").alias("bottom"), F.col("d").alias("top"))
    return bars, lines, bounds


def selected_clusters(model: DensityModel) -> DataFrame:
    """``label, cluster`` of the selected clusters."""
    return model.clusters.where("label >= 0").select("label", "cluster")
