"""Minimum spanning trees of mutual reachability, from points or from a table of distances."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.functions.metrics import BOXED, Metric
from moraine.functions.scalar import mutual_reachability
from moraine.operators import blocks as B
from moraine.operators.arrow import batch, groups, lists, matrix
from moraine.session import materialize

_EDGE = [("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())]


def reachability(points: DataFrame, core: DataFrame, metric: Metric, dim: int, alpha: float = 1.0) -> DataFrame:
    """All pairs ``i < j`` with their mutual reachability ``w``: plain SQL, for n * n rows."""
    rows = points.join(core, "pos").select("pos", "x", "core")
    a = rows.select(F.col("pos").alias("i"), F.col("x").alias("xa"), F.col("core").alias("ca"))
    b = rows.select(F.col("pos").alias("j"), F.col("x").alias("xb"), F.col("core").alias("cb"))
    d = metric.column(F.col("xa"), F.col("xb"), dim)
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", mutual_reachability(F.col("ca"), F.col("cb"), d, alpha).alias("w"))


def edge_reachability(edges: DataFrame, core: DataFrame, alpha: float = 1.0, max_dist: float = 0.0) -> DataFrame:
    """Mutual reachability of stored distances only: ``i, j, w`` with i < j.

    Edges ``i, j, d`` in either or both directions; of several for a pair the least counts. A
    weight that isn't finite becomes ``max_dist`` if that is positive, else the edge goes.
    """
    low, high = F.least("i", "j"), F.greatest("i", "j")
    one = edges.where("i != j AND d IS NOT NULL AND NOT isnan(d)").groupBy(low.alias("i"), high.alias("j")).agg(F.min("d").alias("d"))
    ca, cb = core.select(F.col("pos").alias("i"), F.col("core").alias("ca")), core.select(F.col("pos").alias("j"), F.col("core").alias("cb"))
    w = mutual_reachability(F.col("ca"), F.col("cb"), F.col("d"), alpha)
    out = one.join(ca, "i").join(cb, "j").select("i", "j", w.alias("w"))
    finite = F.col("w") < F.lit(float("inf"))
    return out.withColumn("w", F.when(finite, F.col("w")).otherwise(F.lit(float(max_dist)))) if max_dist > 0 else out.where(finite)


def prim(x: np.ndarray, core: np.ndarray, pos: np.ndarray, metric: Metric, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, w) of the minimum spanning tree of mutual reachability, unique under (w, low, high).

    Distances are made row by row as they are needed; memory is linear in the points.
    """
    n = len(x)
    order = np.argsort(pos, kind="stable")
    pos = pos[order]
    # The points not yet in the tree are the first ``m`` columns; one that leaves is replaced by the last.
    cols, c, rest = np.ascontiguousarray(x[order].T), core[order].copy(), np.arange(n)
    best, near = np.full(n, np.inf), np.full(n, -1, np.int64)
    a, b, w = np.empty(n - 1, np.int64), np.empty(n - 1, np.int64), np.empty(n - 1)
    at, m = 0, n
    for step in range(n - 1):
        now, point, own = int(rest[at]), cols[:, at].copy(), c[at]
        m -= 1
        cols[:, at], c[at], rest[at], best[at], near[at] = cols[:, m], c[m], rest[m], best[m], near[m]
        d = metric.from_one(point, cols[:, :m])
        if alpha != 1.0:
            d = d / alpha
        np.maximum(d, c[:m], out=d)
        np.maximum(d, own, out=d)
        better = d < best[:m]
        tie = np.flatnonzero(d == best[:m])
        if len(tie):  # the smaller (low, high) of the two edges
            r, o = rest[tie], near[tie]
            lo, hi, lo2, hi2 = np.minimum(r, now), np.maximum(r, now), np.minimum(r, o), np.maximum(r, o)
            better[tie[(o < 0) | (lo < lo2) | ((lo == lo2) & (hi < hi2))]] = True
        np.copyto(best[:m], d, where=better)
        near[:m][better] = now
        at = int(best[:m].argmin())
        least = np.flatnonzero(best[:m] == best[at])
        if len(least) > 1:
            r, o = rest[least], near[least]
            at = int(least[np.lexsort((np.maximum(r, o), np.minimum(r, o)))[0]])
        a[step], b[step], w[step] = pos[near[at]], pos[rest[at]], best[at]
    return a, b, w


def kruskal(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Indices of the minimum spanning forest's edges under the order (w, low, high)."""
    from moraine.operators.tree import spanning_forest

    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low, w))
    low, high = low[order], high[order]
    n = int(high.max()) + 1 if len(w) else 0
    if n > 4 * len(w) or (len(w) and low.min() < 0):  # few of the points: numbered anew
        node, ends = np.unique(np.concatenate([low, high]), return_inverse=True)
        n, (low, high) = len(node), ends.reshape(2, -1)
    return order[spanning_forest(n, low, high)]


_OWN = [("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64()), ("x", None), ("core", pa.float64()), ("block", pa.int64())]


def _own_tree(metric: Metric, alpha: float):
    """Of each block its spanning tree (kind 0), and its points (kind 1) with ``w``: the heaviest edge on the
    tree's path from the point to the block's densest point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t in groups(batches, "block"):
            pos, x, core = t.column("pos").to_numpy(), matrix(t.column("x")), t.column("core").to_numpy()
            n = len(pos)
            a, b, w = prim(x, core, pos, metric, alpha)
            reach = dict(zip(pos.tolist(), _reach(pos, core, a, b, w)))
            edges = pa.array([None] * len(a), pa.list_(pa.float64()))
            yield batch(_OWN, [np.zeros(len(a), np.int32), a, b, w, edges, np.zeros(len(a)), np.full(len(a), block)])
            yield batch(_OWN, [np.ones(n, np.int32), pos, pos, np.array([reach[p] for p in pos.tolist()]), lists(x), core, np.full(n, block)])

    return run


def _reach(pos: np.ndarray, core: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> list[float]:
    """The heaviest edge on each point's way to the densest point (least core, then least position)."""
    near: dict = {p: [] for p in pos.tolist()}
    for u, v, d in zip(a.tolist(), b.tolist(), w.tolist()):
        near[u].append((v, d))
        near[v].append((u, d))
    start = int(pos[np.lexsort((pos, core))[0]])
    out, stack = {start: 0.0}, [start]
    while stack:
        u = stack.pop()
        for v, d in near[u]:
            if v not in out:
                out[v] = max(out[u], d)
                stack.append(v)
    return [out[p] for p in pos.tolist()]


_SENT = [("pos", None), ("x", None), ("core", None), ("reach", None), ("block", None), ("task", pa.int64()), ("bound", pa.float64())]
_SENT_SCHEMA = "pos long, x array<double>, core double, reach double, block long, task long, bound double"


@dataclass
class BlockTree:
    """The occupied blocks and a tree that joins them: memory and size of what tasks get grow with the blocks, not with their pairs."""

    number: np.ndarray
    low: np.ndarray
    high: np.ndarray
    far: np.ndarray  # of each block the heaviest edge on a point's way to its densest point
    least: np.ndarray  # least core distance
    links: list = field(default_factory=list)  # (p, q) by place in ``number``
    weight: list = field(default_factory=list)  # of each link

    def row(self, p: int) -> np.ndarray:
        """The heaviest link on the way from block ``p`` to each block."""
        near: list = [[] for _ in self.number]
        for (u, v), w in zip(self.links, self.weight):
            near[u].append((v, w))
            near[v].append((u, w))
        out, stack = np.full(len(self.number), -1.0), [p]
        out[p] = 0.0
        while stack:
            u = stack.pop()
            for v, w in near[u]:
                if out[v] < 0:
                    out[v] = max(out[u], w)
                    stack.append(v)
        return out

    def join(self, metric: Metric) -> None:
        """Links by Prim's method over the gaps between the boxes, made row by row."""
        n = len(self.number)
        best, near, left, at = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool), 0
        for _ in range(n - 1):
            left[at] = False
            gap = metric.box_gap(self.low[at][None], self.high[at][None], self.low, self.high)
            better = left & ((gap < best) | np.isinf(best))
            best[better], near[better] = gap[better], at
            at = int(np.where(left, best, np.inf).argmin()) if np.isfinite(best[left]).any() else int(np.flatnonzero(left)[0])
            self.links.append((min(at, int(near[at])), max(at, int(near[at]))))


def _by_pair(sent: DataFrame, tasks: int, run, schema: str) -> DataFrame:
    return sent.repartition(B.spread(sent, tasks), "task").sortWithinPartitions("task").mapInArrow(run, schema)


#: Points of a block, of up to four dimensions, that stand for it when a link's weight is bounded.
LINK_POINTS = 64


def _send_links(tree: BlockTree, metric: Metric, alpha: float):
    """Of every block to each link of it the points that may have the lightest way over; where boxes tell little, all points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict = {}
        for t, (p, q) in enumerate(tree.links):
            of.setdefault(p, []).append((t, q))
            of.setdefault(q, []).append((t, p))
        for b in batches:
            block = b.column("block").to_numpy()
            for k in np.unique(block).tolist():
                got = b.take(pa.array(np.flatnonzero(block == k)))
                x, least = matrix(got.column("x")), np.maximum(got.column("core").to_numpy(), got.column("reach").to_numpy())
                for t, q in of.get(int(np.searchsorted(tree.number, k)), []):
                    some = got
                    if metric.name in BOXED and x.shape[1] <= 4 and len(x) > LINK_POINTS:
                        way = np.maximum(least, metric.box_gap(x, x, tree.low[q][None], tree.high[q][None]) / alpha)
                        some = got.take(pa.array(np.argpartition(way, LINK_POINTS)[:LINK_POINTS]))
                    yield batch(_SENT, [*some.columns, np.full(some.num_rows, t), np.zeros(some.num_rows)])

    return run


def _send_crossings(tree: BlockTree, metric: Metric, alpha: float):
    """The points of a block to each other block that an edge lighter than the way there is may lead to.

    Task p * blocks + q, p < q, is a pair of blocks; ``bound`` the heaviest link between them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, known = len(tree.number), {}
        for b in batches:
            block = b.column("block").to_numpy()
            for k in np.unique(block).tolist():
                p = int(np.searchsorted(tree.number, k))
                if p not in known:
                    known = {p: None} if len(known) > 8 else known
                    between = tree.row(p)
                    gap = metric.box_gap(tree.low[p][None], tree.high[p][None], tree.low, tree.high) / alpha * (1 - 1e-9)
                    need = np.maximum(gap, np.maximum(tree.least[p], tree.least)) <= np.maximum(between, np.maximum(tree.far[p], tree.far))
                    need[p] = False
                    known[p] = np.flatnonzero(need), between
                at = np.flatnonzero(block == k)
                got = b.take(pa.array(at))
                x, core, reach = matrix(got.column("x")), got.column("core").to_numpy(), got.column("reach").to_numpy()
                others, between = known[p]
                for q in others.tolist():
                    d = metric.box_gap(x, x, tree.low[q][None], tree.high[q][None]) / alpha * (1 - 1e-9)
                    go = np.flatnonzero(np.maximum(d, core) <= np.maximum(np.maximum(reach, tree.far[q]), between[q]))
                    if len(go):
                        yield batch(_SENT, [*got.take(pa.array(go)).columns, np.full(len(go), min(p, q) * n + max(p, q)), np.full(len(go), between[q])])

    return run


def _sides(t: pa.Table, first: int):
    block = t.column("block").to_numpy()
    cols = matrix(t.column("x")), t.column("core").to_numpy(), t.column("reach").to_numpy(), t.column("pos").to_numpy()
    p, q = np.flatnonzero(block == first), np.flatnonzero(block != first)
    return [c[p] for c in cols], [c[q] for c in cols]


def _links(metric: Metric, alpha: float, tree: BlockTree):
    """Per link of blocks the least bottleneck between their densest points over any one edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, t in groups(batches, "task"):
            (x, cx, jx, _), (y, cy, jy, _) = _sides(t, int(tree.number[tree.links[number][0]]))
            best = np.inf
            for s in range(0, len(x), 128):
                d, error = metric.rough(x[s : s + 128], y)
                w = np.maximum((d + error) / alpha, np.maximum(np.maximum(cx[s : s + 128], jx[s : s + 128])[:, None], np.maximum(cy, jy)[None]))
                best = min(best, float(w.min()))  # a bound from above is enough
            yield batch([("task", pa.int64()), ("w", pa.float64())], [[number], [best]])

    return run


def _crossings(metric: Metric, alpha: float, number: np.ndarray):
    """Per pair of blocks the spanning forest of the edges between them that no path so far makes needless."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, t in groups(batches, "task"):
            (x, cx, jx, px), (y, cy, jy, py) = _sides(t, int(number[task // len(number)]))
            bound = float(t.column("bound")[0].as_py())
            a, b, w = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for s in range(0, len(x) if len(y) else 0, 128):
                most = np.maximum(np.maximum(jx[s : s + 128][:, None], jy[None]), bound)
                i, j, d = metric.near_pairs(x[s : s + 128], y, most * alpha * (1 + 1e-12))
                v = np.maximum(d / alpha, np.maximum(cx[s + i], cy[j]))
                ok = v <= most[i, j]
                a, b, w = np.concatenate([a, px[s + i[ok]]]), np.concatenate([b, py[j[ok]]]), np.concatenate([w, v[ok]])
                if len(w) > 1_000_000:
                    keep = kruskal(a, b, w)
                    a, b, w = a[keep], b[keep], w[keep]
            if len(w):
                keep = kruskal(a, b, w)
                yield batch(_EDGE, [a[keep], b[keep], w[keep]])

    return run


#: Edges that are gathered before they are reduced to their forest; twice the forest where that is more, so that a large one isn't made again with every batch.
GATHER = 16_000_000


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, many, limit = [], 0, GATHER

    def forest() -> tuple:
        a, b, w = (np.concatenate(c) for c in zip(*held))
        held.clear()
        keep = kruskal(a, b, w)
        return a[keep], b[keep], w[keep]

    for t in batches:
        ends = [t.column(c).to_numpy() for c in ("a", "b")]
        small = not t.num_rows or max(ends[0].max(), ends[1].max()) < 1 << 31
        held.append((*(e.astype(np.int32 if small else np.int64) for e in ends), t.column("w").to_numpy().copy()))
        many += t.num_rows
        if many > limit:
            held.append(forest())
            many = len(held[0][2])
            limit = max(GATHER, 2 * many)
    if many:
        a, b, w = forest()
        for s in range(0, len(w), 65_536):
            yield batch(_EDGE, [a[s : s + 65_536], b[s : s + 65_536], w[s : s + 65_536]])


def forest_of(edges: DataFrame) -> DataFrame:
    """The spanning forest of edges ``a, b, w`` that stem from few trees: reduced within the
    partitions, then in one task, which at no time holds more than about 2 n edges or ``GATHER``."""
    schema = "a long, b long, w double"
    return edges.mapInArrow(_reduce, schema).repartition(1).mapInArrow(_reduce, schema)


def spanning_tree(points: DataFrame, core: DataFrame, metric: Metric, alpha: float = 1.0, block: int = B.BLOCK, layout: B.Layout | None = None) -> DataFrame:
    """The exact minimum spanning tree of mutual reachability: ``a, b, w``, n - 1 rows.

    Unique under (w, low, high). Each block makes its own tree, which tells for every point
    the heaviest edge on its way to the block's densest point; one edge per pair of blocks
    of a tree of blocks does so between those. An edge between two blocks heavier than the
    way that its ends already have is in no minimum tree, so only lighter ones are looked
    for, among the points near enough to the other block's box. For metrics without box
    bounds all pairs of blocks are compared. The driver holds some numbers per block, and the tasks find
    out for their own blocks which others they must meet, so nothing of the size of all pairs is anywhere.
    """
    total = points.count()
    spark = points.sparkSession
    if total < 2:
        return spark.createDataFrame([], "a long, b long, w double")
    layout = layout or B.Layout.of(points, total, block)
    splitter, box = layout.splitter, layout.boxes
    blocked = B.with_block(points.select("pos", "x"), splitter).join(core, "pos").select("pos", "x", "core", "block")
    own = blocked.repartition(B.spread(blocked, splitter.blocks), "block").sortWithinPartitions("block").mapInArrow(_own_tree(metric, alpha), "kind int, a long, b long, w double, x array<double>, core double, block long")
    if splitter.blocks == 1:
        return own.where("kind = 0").select("a", "b", "w")
    own = materialize(own, "block-trees")
    placed = own.where("kind = 1").select(F.col("a").alias("pos"), "x", "core", F.col("w").alias("reach"), "block")
    full = np.flatnonzero(box.count > 0)
    n = len(full)
    tree = BlockTree(full, box.low[full], box.high[full], np.zeros(n), np.zeros(n))
    for r in placed.groupBy("block").agg(F.max("reach").alias("far"), F.min("core").alias("least")).collect():  # one row per block
        at = int(np.searchsorted(full, r["block"]))
        tree.far[at], tree.least[at] = r["far"], r["least"]
    edges = own.where("kind = 0").select("a", "b", "w")
    if n > 1:
        tree.join(metric)
        found = _by_pair(placed.mapInArrow(_send_links(tree, metric, alpha), _SENT_SCHEMA), n, _links(metric, alpha, tree), "task long, w double").collect()  # one row per link
        tree.weight = [r["w"] for r in sorted(found, key=lambda r: r["task"])]
        sent = placed.mapInArrow(_send_crossings(tree, metric, alpha), _SENT_SCHEMA)
        edges = edges.unionByName(_by_pair(sent, 4 * n, _crossings(metric, alpha, full), "a long, b long, w double"))
    return forest_of(edges)
