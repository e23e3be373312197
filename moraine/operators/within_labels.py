"""Reductions over all pairs of points of one label, without ever emitting the pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.functions.metrics import Metric
from moraine.operators.arrow import batch, groups, matrix

#: Points of a label's block: a task holds two of them.
BLOCK = 4_096


def label_blocks(points: DataFrame, block: int = BLOCK) -> tuple[DataFrame, dict[int, int]]:
    """``points`` (``pos, x, label, weight``) with the column ``part``, and the number of parts of each label.

    Labels number far fewer than points; a label of any size is cut into parts of
    about ``block`` points by a hash of the position.
    """
    size = {r["label"]: r["n"] for r in points.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {c: -(-n // block) for c, n in size.items()}
    many = {c: n for c, n in parts.items() if n > 1}
    part = F.lit(0)
    for n in sorted(set(many.values())):
        part = F.when(F.col("label").isin([c for c, m in many.items() if m == n]), F.pmod(F.xxhash64("pos"), F.lit(n)).cast("int")).otherwise(part)
    return points.withColumn("part", part), parts


def reduce_pairs(points: DataFrame, metric: Metric, value: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = BLOCK, combine: str = "sum") -> DataFrame:
    """``pos, label, total``: for each point the sum (or "max") over its label's points of ``value(distances, weights)``.

    ``value`` gets the distances of some points to others of the label (nan for the point
    itself) and the others' weights, and returns what to add per row. Tasks are
    pairs of parts; partial sums are added up per point.
    """
    cut, parts = label_blocks(points.select("pos", "x", "label", "weight"), block)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, part = b.column("label").to_numpy(), b.column("part").to_numpy()
            n = np.array([parts[c] for c in label.tolist()], np.int64)
            rows = np.repeat(np.arange(len(label)), n)
            other = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            got = b.take(pa.array(np.r_[rows, rows]))
            own, wide = part[rows].astype(np.int64), n[rows]
            pair = np.r_[own * wide + other, other * wide + own]
            names = ["pos", "x", "label", "weight", "pair", "side"]
            yield pa.RecordBatch.from_arrays([got.column("pos"), got.column("x"), got.column("label"), got.column("weight"), pa.array(pair), pa.array(np.r_[np.zeros(len(rows), np.int32), np.ones(len(rows), np.int32)])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, "task"):
            side, pos, x, w = t.column("side").to_numpy(), t.column("pos").to_numpy(), matrix(t.column("x")), t.column("weight").to_numpy()
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(a) or not len(b):
                continue
            total = np.empty(len(a))
            for s in range(0, len(a), 1024):
                d = metric.pairwise(x[a[s : s + 1024]], x[b])
                d[pos[a[s : s + 1024]][:, None] == pos[b][None]] = np.nan
                total[s : s + 1024] = value(d, w[b])
            yield batch([("pos", None), ("label", pa.int32()), ("part_sum", pa.float64())], [pa.array(pos[a]), t.column("label").to_numpy()[a].astype(np.int32), total])

    sent = cut.mapInArrow(send, "pos long, x array<double>, label int, weight double, pair long, side int")
    task = (F.col("label").cast("long") * F.lit(1 << 32) + F.col("pair")).alias("task")  # a label has fewer than 2 ** 16 parts
    sent = sent.select("pos", "x", "label", "weight", "side", task)
    found = sent.repartition("task").sortWithinPartitions("task").mapInArrow(run, "pos long, label int, part_sum double")
    return found.groupBy("pos", "label").agg({"sum": F.sum, "max": F.max}[combine]("part_sum").alias("total"))


def label_gaps(points: DataFrame, metric: Metric, block: int = BLOCK) -> DataFrame:
    """``a, b, gap`` (a < b): the least max(distance, core, core) between two labels' points ``pos, x, label, core``.

    Points go to blocks whatever their label; tasks are pairs of blocks and give one row
    per pair of labels they hold.
    """
    n = points.count()
    parts = max(1, -(-n // block))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("part").to_numpy().astype(np.int64)
            rows, other = np.repeat(np.arange(len(own)), parts), np.tile(np.arange(parts), len(own))
            lo, hi = np.minimum(own[rows], other), np.maximum(own[rows], other)
            got = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([got.column("x"), got.column("label"), got.column("core"), got.column("part"), pa.array(lo * parts + hi)], names=["x", "label", "core", "part", "task"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, t in groups(batches, "task"):
            part, label, x, core = t.column("part").to_numpy(), t.column("label").to_numpy(), matrix(t.column("x")), t.column("core").to_numpy()
            a, b = np.flatnonzero(part == number // parts), np.flatnonzero(part == number % parts)
            if not len(a) or not len(b):
                continue
            b = b[np.argsort(label[b], kind="stable")]
            starts = np.flatnonzero(np.r_[True, np.diff(label[b]) != 0])
            best: dict = {}
            for s in range(0, len(a), 1024):
                own = a[s : s + 1024]
                d = np.maximum(np.maximum(metric.pairwise(x[own], x[b]), core[own][:, None]), core[b][None])
                least = np.minimum.reduceat(d, starts, axis=1)
                for la in np.unique(label[own]):
                    for lb, v in zip(label[b][starts], least[label[own] == la].min(0)):
                        if la != lb:
                            k = (int(min(la, lb)), int(max(la, lb)))
                            best[k] = min(best.get(k, np.inf), float(v))
            if best:
                yield batch([("a", pa.int32()), ("b", pa.int32()), ("gap", pa.float64())], [[k[0] for k in best], [k[1] for k in best], list(best.values())])

    cut = points.select("x", "label", "core", F.pmod(F.xxhash64("pos"), F.lit(parts)).alias("part"))
    sent = cut.mapInArrow(send, "x array<double>, label int, core double, part long, task long")
    return sent.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a int, b int, gap double").groupBy("a", "b").agg(F.min("gap").alias("gap"))
