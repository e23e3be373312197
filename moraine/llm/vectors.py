"""Vectors in spatial blocks: an inverted multi-index over two halves.

A vector's cell is the pair of the nearest centroids of its two halves. Cells expected to
hold too many vectors are cut further. What bounds a block is not a radius around centroids
but the box of the vectors really in it, so that a search can prove that it is complete.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.operators.arrow import groups, lists, matrix
from moraine.session import materialize

#: Centroids per half: at most CENTROIDS ** 2 cells at any size of the input.
CENTROIDS = 256
#: Vectors that the centroids are fitted on; a bounded sample, fixed by a hash of the id.
SAMPLE = 16_384
#: Vectors that a block should not exceed; cells expected to be larger are cut.
BLOCK = 4_096
#: Centroids that are seeded and moved; the work for more would grow with their square.
SEEDED = 2_048
#: Tables of at most so many (id, number) rows are sent to every executor; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: A block's number is (cell << SUB_BITS) + number of its part.
SUB_BITS = 16


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def finite(vec: str, dim: int) -> Column:
    """Whether a vector has ``dim`` elements, all non-null and finite."""
    inf = F.lit(float("inf"))
    return F.coalesce((F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))


def latest(df: DataFrame, id_col: str, at: str, columns: list[str]) -> DataFrame:
    """The row of each id with the latest ``at``, once; ids that are null have none.

    Ids are counted first, without the wide columns; only those delivered more than once
    are looked at again, so the vectors needn't be shuffled for it.
    """
    when = F.coalesce(F.unix_micros(at), F.lit(-(2**63)))
    rows = df.where(F.col(id_col).isNotNull()).select(id_col, when.alias("__at"), *columns)
    many = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n"), F.max("__at").alias("__last")).where("__n > 1")
    many = materialize(many.select(F.col(id_col).alias("__id"), "__last"), "repeated")
    n = many.count()
    if not n:
        return rows.drop("__at")
    many = maybe_broadcast(many, n)
    once = rows.join(many, F.col(id_col) == F.col("__id"), "left_anti")
    again = rows.join(many, (F.col(id_col) == F.col("__id")) & (F.col("__at") == F.col("__last"))).dropDuplicates([id_col])
    return once.select(id_col, *columns).unionByName(again.select(id_col, *columns))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, by one matrix product."""
    d = a @ b.T
    d *= -2
    d += (a * a).sum(1)[:, None]
    d += (b * b).sum(1)
    return np.maximum(d, 0, out=d)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``a`` to the same rows of ``b``, from their differences."""
    return np.sqrt(((a - b) ** 2).sum(-1))


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Centroids: k-means++ seeding (greedy for far groups), then a few Lloyd rounds; beyond ``SEEDED`` a draw of the vectors."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    if k > SEEDED:
        return x[np.sort(rng.choice(len(x), k, replace=False))]
    picked = [int(rng.integers(len(x)))]
    near = squared(x, x[picked])[:, 0]
    while len(picked) < k:
        total = near.sum()
        if total <= 0:
            break
        picked.append(int(np.searchsorted(np.cumsum(near), rng.random() * total).clip(0, len(x) - 1)))
        near = np.minimum(near, squared(x, x[picked[-1:]])[:, 0])
    centre = x[picked].copy()
    for _ in range(rounds):
        own = squared(x, centre).argmin(1)
        n = np.bincount(own, minlength=len(centre))
        sums = np.stack([np.bincount(own, x[:, j], len(centre)) for j in range(x.shape[1])], 1)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
    return centre


@dataclass
class Codebook:
    """Centroids of the two halves, and of the parts of cells expected to be large."""

    first: np.ndarray
    second: np.ndarray
    parts: dict = field(default_factory=dict)  # cell to the centroids of its parts

    @property
    def dim(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The block of each row."""
        if not len(x):
            return np.empty(0, np.int64)
        h = self.first.shape[1]
        out = np.empty(len(x), np.int64)
        for s in range(0, len(x), 16_384):  # pieces keep the distances in cache
            y = x[s : s + 16_384]
            out[s : s + 16_384] = squared(y[:, :h], self.first).argmin(1) * len(self.second) + squared(y[:, h:], self.second).argmin(1)
        cell, block = out, out << SUB_BITS
        if self.parts:
            for c in np.intersect1d(np.unique(cell), np.fromiter(self.parts, np.int64)):
                here = np.flatnonzero(cell == c)
                block[here] += squared(x[here], self.parts[int(c)]).argmin(1)
        return block


def fit(vectors: DataFrame, dim: int, centroids: int = CENTROIDS, sample: int = SAMPLE, block: int = BLOCK, seed: int = 1) -> tuple[Codebook, int]:
    """A codebook for ``id, vec`` and the number of vectors.

    Fitted on about ``sample`` vectors whose ids hash lowest, or 8 for each block where that is more (a share
    of 8 / ``block`` of the vectors); all vectors are then assigned. Parts of large cells: as many as the sample
    lets expect, at most one for each 8 sample vectors of the cell, so blocks grow in number, not in size.
    """
    total = vectors.count()
    sample = max(sample, 8 * math.ceil(total / block))
    if not total:
        return Codebook(np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2))), 0
    few = vectors if total <= sample else vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * sample / total)))
    x = matrix(few.select("vec").toArrow().column("vec"), dim)
    if not len(x):
        x = matrix(vectors.limit(1).select("vec").toArrow().column("vec"), dim)
    h = dim // 2
    book = Codebook(kmeans(x[:, :h], centroids, seed), kmeans(x[:, h:], centroids, seed + 1))
    cell = book.assign(x) >> SUB_BITS
    for c, n in zip(*np.unique(cell, return_counts=True)):
        parts = min(math.ceil(n * total / len(x) / block), n // 8, (1 << SUB_BITS) - 1)
        if parts > 1:
            book.parts[int(c)] = kmeans(x[cell == c], int(parts), seed + 2)
    return book, total


def with_block(vectors: DataFrame, book: Codebook) -> DataFrame:
    """``vectors`` with the column ``block``; the vectors stay in the JVM."""

    @F.arrow_udf("long")
    def block(vec: pa.Array) -> pa.Array:
        return pa.array(book.assign(matrix(vec)), pa.int64())

    return vectors.withColumn("block", block("vec"))


@dataclass
class Blocks:
    """The occupied blocks, ascending: number of vectors and box of each. At most one row
    per cell and part, whatever the number of vectors."""

    number: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def index(self, number: int) -> int:
        return int(np.searchsorted(self.number, number))

    def of_cell(self, cell: int) -> range:
        return range(*np.searchsorted(self.number, [cell << SUB_BITS, (cell + 1) << SUB_BITS]))

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """The occupied cells, ascending, and the number of vectors in each."""
        cell, first = np.unique(self.number >> SUB_BITS, return_index=True)
        return cell, np.add.reduceat(self.count, first)

    def box_gap(self, low: np.ndarray, high: np.ndarray, within: float) -> np.ndarray:
        """Indices of the blocks whose box may be within a distance of the given box."""
        left, limit = np.arange(len(self.number)), within * within * (1 + 1e-9) + 1e-12
        gap = np.zeros(len(left))
        for s in range(0, self.low.shape[1], 4):  # a few dimensions leave few blocks
            d = np.maximum(np.maximum(self.low[left, s : s + 4] - high[s : s + 4], low[s : s + 4] - self.high[left, s : s + 4]), 0)
            gap = gap + (d * d).sum(1)
            keep = gap <= limit
            left, gap = left[keep], gap[keep]
        return left

    def gap(self, x: np.ndarray, i: int) -> np.ndarray:
        """Distance of the points to a block's box; no vector in it is nearer."""
        d = np.maximum(np.maximum(self.low[i] - x, x - self.high[i]), 0)
        return np.sqrt((d * d).sum(1))

    def far(self, x: np.ndarray, i: int) -> np.ndarray:
        """Distance of the points to the farthest corner of a block's box."""
        d = np.maximum(np.abs(x - self.low[i]), np.abs(x - self.high[i]))
        return np.sqrt((d * d).sum(1))


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of the partition: count and box."""
    held: dict = {}
    for batch in batches:
        x, block, n = matrix(batch.column("vec")), batch.column("block").to_numpy(), batch.column("n").to_numpy()
        if not len(x):
            continue
        order = np.argsort(block, kind="stable")
        x, block, n = x[order], block[order], n[order]
        at = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1])
        low, high, count = np.minimum.reduceat(x, at), np.maximum.reduceat(x, at), np.add.reduceat(n, at)
        for i, b in enumerate(block[at].tolist()):
            if b in held:
                c, lo, hi = held[b]
                held[b] = (c + count[i], np.minimum(lo, low[i]), np.maximum(hi, high[i]))
            else:
                held[b] = (count[i], low[i], high[i])
    if held:
        c, lo, hi = zip(*held.values())
        cols = [pa.array(list(held), pa.int64()), pa.array(np.array(c, np.int64)), lists(np.array(lo)), lists(np.array(hi))]
        yield pa.RecordBatch.from_arrays(cols, names=["block", "n", "low", "high"])


def _merge_boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, t in groups(batches, "block"):
        cols = [pa.array([number], pa.int64()), pa.array([sum(t.column("n").to_pylist())], pa.int64()), lists(matrix(t.column("low")).min(0)[None]), lists(matrix(t.column("high")).max(0)[None])]
        yield pa.RecordBatch.from_arrays(cols, names=["block", "n", "low", "high"])


def blocks(blocked: DataFrame, dim: int) -> Blocks:
    """The blocks of a table ``vec, block, n``; boxes are combined within partitions first."""
    schema = "block long, n long, low array<double>, high array<double>"
    part = blocked.select("vec", "block", F.col("n").cast("long").alias("n")).mapInArrow(_boxes, schema)
    t = part.repartition("block").sortWithinPartitions("block").mapInArrow(_merge_boxes, schema).toArrow()
    number = t.column("block").to_numpy()
    order = np.argsort(number)
    return Blocks(number[order], t.column("n").to_numpy()[order], matrix(t.column("low"), dim)[order], matrix(t.column("high"), dim)[order])


def copies(vectors: DataFrame, per: list[str]) -> tuple[DataFrame | None, int]:
    """Records whose vector (and columns ``per``) occurs more than once: ``id, rep, n``; and their number.

    ``rep`` is the least id of the copies and ``n`` how many there are. Only ids and 96 bits
    of hash per record travel; counts are combined map-side, so one group of copies may
    hold most records. (None, 0) if all vectors differ.
    """
    keyed = vectors.select("id", F.xxhash64("vec", *per).alias("h1"), F.hash("vec", *per).alias("h2"))
    many = keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).where("n > 1")
    many = materialize(many, "copies")
    n = many.count()
    if not n:
        return None, 0
    members = keyed.join(maybe_broadcast(many, n), ["h1", "h2"]).select("id", "rep", "n")
    members = materialize(members, "members")
    return members, members.count()
