"""Points in spatial blocks of bounded size, with the box of each block."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.functions.metrics import Metric
from moraine.operators.arrow import groups, lists, matrix

#: Points a block should hold.
BLOCK = 4_096
#: Points that the cuts between blocks are fitted on, or 32 for each block where that is more; all points are then assigned.
SAMPLE = 65_536


@dataclass
class Splitter:
    """A tree of cuts, each at a sample's median of its widest dimension."""

    dim: list
    at: list
    left: list
    right: list  # children; a negative number -1 - b is block b
    blocks: int

    @staticmethod
    def fit(sample: np.ndarray, total: int, block: int = BLOCK) -> Splitter:
        out = Splitter([], [], [], [], 0)
        share = total / max(len(sample), 1)

        def grow(x: np.ndarray) -> int:
            if len(x) * share > block and len(x) >= 16:
                d = int(np.argmax(x.max(0) - x.min(0)))
                cut = float(np.median(x[:, d]))
                low = x[:, d] < cut
                if not low.any():
                    low = x[:, d] <= cut
                    cut = math.nextafter(cut, math.inf)
                if low.any() and not low.all():
                    i = len(out.dim)
                    for col, v in zip((out.dim, out.at, out.left, out.right), (d, cut, 0, 0)):
                        col.append(v)
                    out.left[i], out.right[i] = grow(x[low]), grow(x[~low])
                    return i
            out.blocks += 1
            return -out.blocks

        grow(sample)
        return out

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The block of each row: all rows go down the cuts together, so the work grows with the depth, not with the blocks."""
        if not self.dim:
            return np.zeros(len(x), np.int64)
        dim, at, child = np.array(self.dim), np.array(self.at), np.array([self.right, self.left])
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            i = node[rows]
            node[rows] = child[(x[rows, dim[i]] < at[i]).astype(int), i]
            rows = rows[node[rows] >= 0]
        return -1 - node


@dataclass
class Boxes:
    """Count and box of each block; empty blocks have count 0 and an empty (inverted) box."""

    count: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def gaps(self, metric: Metric, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Per block the least distance that its points can have to a box; inf for empty blocks."""
        if not len(self.count):
            return np.empty(0)
        lo, hi = np.where(self.count[:, None] > 0, self.low, 0), np.where(self.count[:, None] > 0, self.high, 0)
        return np.where(self.count > 0, metric.box_gap(lo, hi, low[None], high[None]), np.inf)

    def point_gaps(self, metric: Metric, x: np.ndarray, block: int) -> np.ndarray:
        return metric.box_gap(x, x, self.low[block][None], self.high[block][None])


def plan(points: DataFrame, total: int, block: int = BLOCK, sample: int = SAMPLE) -> Splitter:
    """Cuts for points ``pos, x``; for few points there is one block."""
    if total <= block:
        return Splitter([], [], [], [], 1)
    sample = max(sample, 32 * math.ceil(total / block))
    few = points if total <= sample else points.where(F.pmod(F.xxhash64("pos"), F.lit(1 << 40)) < F.lit(int((1 << 40) * sample / total)))
    return Splitter.fit(matrix(few.select("x").toArrow().column("x")), total, block)


def spread(df: DataFrame, groups_: int) -> int:
    """Partitions for so many groups of much work each: a few for each core, so that hashing
    a few groups leaves no core with several of them; never many more than there are groups."""
    if groups_ <= 1:
        return 1
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4 * groups_, 4 * spark.sparkContext.defaultParallelism))


def with_block(points: DataFrame, splitter: Splitter) -> DataFrame:
    """``points`` with the column ``block``."""
    if splitter.blocks == 1:
        return points.withColumn("block", F.lit(0).cast("long"))

    @F.arrow_udf("long")
    def block(x: pa.Array) -> pa.Array:
        return pa.array(splitter.assign(matrix(x)), pa.int64())

    return points.withColumn("block", block("x"))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for b in batches:
        x, block = matrix(b.column("x")), b.column("block").to_numpy()
        for k in np.unique(block).tolist():
            y = x[block == k]
            n, lo, hi = held.get(k, (0, y[0], y[0]))
            held[k] = (n + len(y), np.minimum(lo, y.min(0)), np.maximum(hi, y.max(0)))
    if held:
        n, lo, hi = zip(*held.values())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(n, pa.int64()), lists(np.array(lo)), lists(np.array(hi))], names=["block", "n", "low", "high"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, t in groups(batches, "block"):
        cols = [pa.array([number], pa.int64()), pa.array([sum(t.column("n").to_pylist())], pa.int64()), lists(matrix(t.column("low")).min(0)[None]), lists(matrix(t.column("high")).max(0)[None])]
        yield pa.RecordBatch.from_arrays(cols, names=["block", "n", "low", "high"])


def boxes(blocked: DataFrame, blocks: int) -> Boxes:
    """The boxes of ``block, x``: combined per partition first, one row per block at the driver.

    Their number is that of the splitter's leaves.
    """
    schema = "block long, n long, low array<double>, high array<double>"
    part = blocked.select("block", "x").mapInArrow(_partial, schema)
    if blocks <= 1_024:  # a few rows per partition: one task merges them
        part = part.repartition(1)
    else:
        part = part.repartition("block")
    t = part.sortWithinPartitions("block").mapInArrow(_merge, schema).toArrow()
    low, high, at = matrix(t.column("low")), matrix(t.column("high")), t.column("block").to_numpy()
    d = low.shape[1]
    out = Boxes(np.zeros(blocks, np.int64), np.full((blocks, d), np.inf), np.full((blocks, d), -np.inf))
    out.count[at], out.low[at], out.high[at] = t.column("n").to_numpy(), low, high
    return out


@dataclass
class Layout:
    """The blocks of a table of points, made once for all steps that use them."""

    splitter: Splitter
    boxes: Boxes | None  # None for a single block

    @staticmethod
    def of(points: DataFrame, total: int, block: int = BLOCK) -> Layout:
        splitter = plan(points, total, block)
        return Layout(splitter, boxes(with_block(points.select("pos", "x"), splitter), splitter.blocks) if splitter.blocks > 1 else None)
