"""Density-based validity of any labelling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.functions.metrics import Metric
from moraine.operators import spanning as S
from moraine.operators.arrow import batch, groups, matrix
from moraine.operators.forest import boruvka
from moraine.operators.within_labels import label_gaps, reduce_pairs
from moraine.session import materialize

#: Labels of up to so many points get their tree in one task, larger ones block by block.
ONE_TASK = 16_384


def all_points_core_distances(points: DataFrame, metric: Metric, dim: int) -> DataFrame:
    """``pos, label, core`` of ``pos, x, label``: (mean over the label's others of d ** -dim) ** (-1 / dim).

    Distances of zero are left out; a point with nothing but zeros, or alone, has 0.
    """

    def inverse_power(d: np.ndarray, _: np.ndarray) -> np.ndarray:
        v = np.zeros_like(d)
        ok = d > 0
        v[ok] = (1 / d[ok]) ** dim
        return v.sum(1)

    sums = reduce_pairs(points.withColumn("weight", F.lit(1.0)), metric, inverse_power)
    size = points.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("others"))
    value = F.when((F.col("total") > 0) & (F.col("others") > 0), F.pow(F.col("total") / F.greatest("others", F.lit(1)), F.lit(-1.0 / dim))).otherwise(F.lit(0.0))
    return sums.join(size, "label").select("pos", "label", value.alias("core"))


def max_ratio(points: DataFrame, metric: Metric) -> float:
    """The largest core distance over distance to another point of the label, of ``pos, x, label, core``: a
    diagnostic of how much the core distances outweigh the distances. Equal points don't count; 0 if none is left."""

    def least(d: np.ndarray, _: np.ndarray) -> np.ndarray:
        return np.max(np.where(d > 0, 1 / np.where(d > 0, d, 1), 0.0), axis=1, initial=0.0)

    near = reduce_pairs(points.withColumn("weight", F.lit(1.0)), metric, least, combine="max")
    return float(near.join(points.select("pos", "core"), "pos").agg(F.max(F.col("total") * F.col("core"))).first()[0] or 0.0)


def internal_trees(points: DataFrame, metric: Metric) -> tuple[DataFrame, DataFrame]:
    """Per label, of ``pos, x, label, core``: (edges ``label, a, b, w``, inner nodes ``label, pos``) of its spanning tree.

    Inner nodes have more than one edge; kept are the edges between inner nodes, or all
    edges of a label without such.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, t in groups(batches, "label"):
            if t.num_rows > 1:
                a, b, w = S.prim(matrix(t.column("x")), t.column("core").to_numpy(), t.column("pos").to_numpy(), metric)
                yield batch([("label", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())], [np.full(len(a), label), a, b, w])

    big = [r["label"] for r in points.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ONE_TASK).collect()]
    small = points.where(~F.col("label").isin(big)) if big else points
    edges = small.select("pos", "x", "label", "core").repartition("label").sortWithinPartitions("label").mapInArrow(run, "label int, a long, b long, w double")
    for c in big:
        own = materialize(points.where(F.col("label") == c), "label")
        edges = edges.unionByName(S.spanning_tree(own.select("pos", "x"), own.select("pos", "core"), metric).withColumn("label", F.lit(c)).select("label", "a", "b", "w"))
    edges = materialize(edges, "label-trees")
    return _inner(edges)


def _inner(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of trees ``label, a, b, w``: (the edges between nodes of more than one edge, or all of a label without such; those nodes)."""
    degree = edges.select("label", F.explode(F.array("a", "b")).alias("pos")).groupBy("label", "pos").agg(F.count(F.lit(1)).alias("n"))
    inner = degree.where("n > 1").select("label", "pos")
    kept = edges.join(inner.select("label", F.col("pos").alias("a")), ["label", "a"], "left_semi").join(inner.select("label", F.col("pos").alias("b")), ["label", "b"], "left_semi")
    bare = edges.join(kept.select("label").distinct(), "label", "left_anti")
    return kept.select("label", "a", "b", "w").unionByName(bare.select("label", "a", "b", "w")), inner


def _index(size: DataFrame, edges: DataFrame, gaps: DataFrame, total: int) -> tuple[float, DataFrame]:
    near = gaps.select(F.explode(F.array("a", "b")).alias("label"), "gap").groupBy("label").agg(F.min("gap").alias("separation"))
    sparse = edges.groupBy("label").agg(F.max("w").alias("sparseness"))
    inf = F.lit(float("inf"))
    rows = size.join(sparse, "label", "left").join(near, "label", "left").select("label", "size", F.coalesce("sparseness", F.lit(0.0)).alias("sparseness"), F.coalesce("separation", inf).alias("separation"))
    most = F.greatest("sparseness", "separation")
    value = F.when(F.col("separation") == inf, F.lit(float("nan"))).when(most > 0, (F.col("separation") - F.col("sparseness")) / F.when(most > 0, most)).otherwise(F.lit(0.0))
    rows = materialize(rows.withColumn("validity", value), "validity")
    index = rows.agg(F.sum(F.col("size") / F.lit(float(total)) * F.col("validity"))).first()[0]
    return float(index or 0.0), rows


def validity_of_distances(edges: DataFrame, labels: DataFrame, dim: int, raw_distances: bool = False) -> tuple[float, DataFrame]:
    """:func:`validity` from a table of all distances ``i, j, d`` (one or both directions) and ``id, label``.

    ``dim`` is the dimension of the space, which distances don't tell. Joins and aggregations over the stored
    pairs only: per label the reachability's spanning tree, by distributed rounds, and between labels the least reachability.
    """
    lab = materialize(labels.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label")), "labels")
    total = lab.count()
    own = lab.where("label >= 0")
    pair = edges.where("i != j AND d IS NOT NULL AND NOT isnan(d)").groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.min("d").alias("d"))
    pair = pair.join(own.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(own.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    pair = materialize(pair, "pairs")
    size = own.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    inside = pair.where("la = lb")
    power = F.when(F.col("d") > 0, F.pow(F.lit(1.0) / F.when(F.col("d") > 0, F.col("d")), F.lit(float(dim)))).otherwise(F.lit(0.0))
    sums = inside.select(F.explode(F.array("a", "b")).alias("id"), power.alias("v")).groupBy("id").agg(F.sum("v").alias("v"))
    value = F.when((F.col("v") > 0) & (F.col("size") > 1), F.pow(F.col("v") / F.greatest(F.col("size") - 1, F.lit(1)), F.lit(-1.0 / dim))).otherwise(F.lit(0.0))
    core = own.join(sums, "id", "left").join(size, "label").select("id", "label", (F.lit(0.0) if raw_distances else F.coalesce(value, F.lit(0.0))).alias("core"))
    core = materialize(core, "cores")
    side = lambda c, n: core.select(F.col("id").alias(c), F.col("core").alias(n))
    reach = materialize(pair.join(side("a", "ca"), "a").join(side("b", "cb"), "b").select("a", "b", "la", "lb", F.greatest("d", "ca", "cb").alias("w")), "reach")
    forest, _ = boruvka(reach.where("la = lb").select("a", "b", "w"))
    trees = materialize(forest.join(core.select(F.col("id").alias("a"), "label"), "a").select("label", "a", "b", "w"), "label-trees")
    kept, inner = _inner(trees)
    inner = materialize(inner.select("pos"), "inner")
    gaps = reach.where("la != lb").join(inner.withColumnRenamed("pos", "a"), "a", "left_semi").join(inner.withColumnRenamed("pos", "b"), "b", "left_semi")
    gaps = gaps.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.min("w").alias("gap"))
    return _index(size, kept, gaps, total)


def validity(points: DataFrame, metric: Metric | str = "euclidean", raw_distances: bool = False) -> tuple[float, DataFrame]:
    """Validity of a labelling of ``pos, x, label`` (label -1: noise): (index, ``label, size, sparseness, separation, validity``).

    Per label the heaviest inner edge of its spanning tree (sparseness) against the least
    reachability between its inner nodes and another label's (separation). The index
    weighs labels by size, where noise counts in the total only. With a single label the
    separation is infinite and the validity NaN. ``raw_distances``: without core distances.
    """
    metric = Metric(metric) if isinstance(metric, str) else metric
    total = points.count()
    own = materialize(points.where("label >= 0").select("pos", "x", F.col("label").cast("int").alias("label")), "labelled")
    first = own.first()
    if first is None:
        return 0.0, points.sparkSession.createDataFrame([], "label int, size long, sparseness double, separation double, validity double")
    core = own.select("pos", "label", F.lit(0.0).alias("core")) if raw_distances else all_points_core_distances(own, metric, len(first["x"]))
    cored = materialize(own.join(core.select("pos", "core"), "pos"), "cored")
    edges, inner = internal_trees(cored, metric)
    gaps = label_gaps(cored.join(inner.select("pos"), "pos", "left_semi"), metric)
    return _index(own.groupBy("label").agg(F.count(F.lit(1)).alias("size")), edges, gaps, total)
