"""Nearest neighbours, neighbours within a radius, all pairs, core distances.

Points are ``pos, x``: an integer key and an array of finite doubles of one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions.metrics import BOXED, Metric
from moraine.operators import blocks as B
from moraine.operators.arrow import batch, groups, lists, matrix
from moraine.session import materialize

#: Distances made at a time: few enough to stay in a core's cache.
_PIECE = 250_000
#: Points of a block of a search: the work grows with it, the number of tasks shrinks.
BLOCK = 1_024
_PAIR = [("pos", pa.int64()), ("nbr", pa.int64()), ("dist", pa.float64())]
_SENT = "pos long, x array<double>, reach double, task long, kind int"


def pairwise(points: DataFrame, metric: Metric, dim: int) -> DataFrame:
    """All pairs ``i < j`` with their distance ``d``: plain SQL, for tables small enough for n * n rows."""
    a, b = points.select(F.col("pos").alias("i"), F.col("x").alias("a")), points.select(F.col("pos").alias("j"), F.col("x").alias("b"))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", metric.column(F.col("a"), F.col("b"), dim).alias("d"))


def top_k(metric: Metric, q: np.ndarray, q_pos: np.ndarray, e: np.ndarray, e_pos: np.ndarray, k: int, itself: bool | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of each query's ``k`` nearest entries, ties by position.

    A query that is an entry is its own first neighbour with ``itself``, else it is left out;
    with None, queries are other points whose positions mean nothing here. Missing places: -1 and inf.
    """
    ids, dist = np.full((len(q), k), -1, np.int64), np.full((len(q), k), np.inf)
    if not len(q) or not len(e):
        return ids, dist
    order = np.argsort(e_pos, kind="stable")
    e, e_pos = e[order], e_pos[order]
    step = max(1, _PIECE // len(e))
    for s in range(0, len(q), step):
        d, error = metric.rough(q[s : s + step], e)
        if itself is not None:
            at = np.searchsorted(e_pos, q_pos[s : s + step]).clip(0, len(e) - 1)
            mine = np.flatnonzero(e_pos[at] == q_pos[s : s + step])
            d[mine, at[mine]] = -1.0 if itself else np.inf
        keep = min(k, len(e))
        kth = np.partition(d, keep - 1, axis=1)[:, keep - 1] if keep < len(e) else np.full(len(d), np.inf)
        row, col = np.nonzero((d <= (kth + 2 * error)[:, None]) & (d < np.inf))
        real = d[row, col]
        if error:
            real = np.where(real < 0, -1.0, metric.paired(q[s + row], e[col]))
        o = np.lexsort((col, real, row))
        row, col, real = row[o], col[o], real[o]
        rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(d)))[row]
        take = rank < k
        ids[s + row[take], rank[take]] = e_pos[col[take]]
        dist[s + row[take], rank[take]] = np.maximum(real[take], 0)
    return ids, dist


def core_in_task(metric: Metric, x: np.ndarray, pos: np.ndarray, k: int, block: int = 256) -> np.ndarray:
    """The distance of each point's ``k``-th neighbour, within one task: small boxes keep most of the pairs out."""
    if len(x) <= 4 * block or metric.name not in BOXED:
        return top_k(metric, x, pos, x, pos, k, False)[1][:, k - 1]
    splitter = B.Splitter.fit(x, len(x), block)
    own = splitter.assign(x)
    order = np.argsort(own, kind="stable")
    edges = np.flatnonzero(np.diff(own[order])) + 1
    parts = np.split(order, edges)
    low, high = np.stack([x[p].min(0) for p in parts]), np.stack([x[p].max(0) for p in parts])
    core = np.empty(len(x))
    for b, rows in enumerate(parts):
        here = top_k(metric, x[rows], pos[rows], x[rows], pos[rows], k, False)[1][:, k - 1]
        near = np.flatnonzero(metric.box_gap(low[b][None], high[b][None], low, high) <= here.max() * (1 + 1e-9))
        e = np.concatenate([parts[i] for i in near])
        core[rows] = here if len(near) == 1 else top_k(metric, x[rows], pos[rows], x[e], pos[e], k, False)[1][:, k - 1]
    return core


def _search(metric: Metric, k: int | None, itself: bool | None, radius: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, "task"):
            kind, pos, x = t.column("kind").to_numpy(), t.column("pos").to_numpy(), matrix(t.column("x"))
            e, q, reach = kind != 1, np.flatnonzero(kind != 0), t.column("reach").to_numpy()
            if not e.any():
                continue
            if k is not None:
                for s in range(0, len(q), 65_536):
                    own = q[s : s + 65_536]
                    nbr, dist = top_k(metric, x[own], pos[own], x[e], pos[e], k, itself)
                    ok = (nbr >= 0) & (dist <= reach[own][:, None])
                    yield batch(_PAIR, [np.repeat(pos[own], ok.sum(1)), nbr[ok], dist[ok]])
                continue
            step = max(1, _PIECE // int(e.sum()))
            for s in range(0, len(q), step):
                own = q[s : s + step]
                i, j, d = metric.near_pairs(x[own], x[e], radius)
                keep = pos[own][i] != pos[e][j] if itself is False else np.ones(len(i), bool)
                yield batch(_PAIR, [pos[own][i][keep], pos[e][j][keep], d[keep]])

    return run


def _send(metric: Metric, box: B.Boxes, radius: float):
    """Queries ``pos, x, block`` to every block within the radius, their own included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"))
            gap = box.gaps(metric, x.min(0), x.max(0))
            for k in np.flatnonzero(gap <= radius * (1 + 1e-9)).tolist():
                at = np.flatnonzero(box.point_gaps(metric, x, k) <= radius * (1 + 1e-9))
                if len(at):
                    yield batch([("pos", None), ("x", None), ("reach", pa.float64()), ("task", pa.int64()), ("kind", pa.int32())], [b.column("pos").take(pa.array(at)), lists(x[at]), np.full(len(at), radius), np.full(len(at), k), np.ones(len(at), np.int32)])

    return run


def _entries(blocked: DataFrame, kind: int) -> DataFrame:
    return blocked.select("pos", "x", F.lit(float("inf")).alias("reach"), F.col("block").alias("task"), F.lit(kind).alias("kind"))


def _by_task(df: DataFrame, tasks: int) -> DataFrame:
    """Groups of the column ``task`` side by side."""
    return df.repartition(B.spread(df, tasks), "task").sortWithinPartitions("task")


_HOME = [("pos", pa.int64()), ("nbr", None), ("dist", None), ("reach", pa.float64()), ("routes", None), ("x", None)]
_HOME_SCHEMA = "pos long, nbr array<long>, dist array<double>, reach double, routes array<long>, x array<double>"


def _home(metric: Metric, k: int, itself: bool | None, box: B.Boxes | None):
    """Each query's neighbours within its own block, and the other blocks that may have nearer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t in groups(batches, "task"):
            kind, pos, x = t.column("kind").to_numpy(), t.column("pos").to_numpy(), matrix(t.column("x"))
            e, asked = kind != 1, np.flatnonzero(kind != 0)
            for s in range(0, len(asked), 16_384):
                own = asked[s : s + 16_384]
                nbr, dist = top_k(metric, x[own], pos[own], x[e], pos[e], k, itself)
                reach = dist[:, k - 1]
                routes: list = [[] for _ in own]
                if box is not None:
                    limit = reach.max() * (1 + 1e-9)
                    for other in np.flatnonzero((box.count > 0) & (box.gaps(metric, x[own].min(0), x[own].max(0)) <= limit)).tolist():
                        if other != block:
                            for r in np.flatnonzero(box.point_gaps(metric, x[own], other) <= reach * (1 + 1e-9)):
                                routes[r].append(other)
                far = np.array([bool(r) for r in routes])
                n = (nbr >= 0).sum(1)
                edges = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                ok = nbr >= 0
                sent = pa.array([v if f else None for v, f in zip(x[own], far)], pa.list_(pa.float64())) if far.any() else pa.nulls(len(own), pa.list_(pa.float64()))
                yield batch(_HOME, [pos[own], pa.ListArray.from_arrays(edges, pa.array(nbr[ok])), pa.ListArray.from_arrays(edges, pa.array(dist[ok])), reach, pa.array(routes, pa.list_(pa.int64())), sent])

    return run


def _rounds(points: DataFrame, k: int, metric: Metric, itself: bool | None, queries: DataFrame | None, block: int, layout: B.Layout | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(what each query found at home, what the routed ones found elsewhere: ``pos, nbr, dist``; None if none is)."""
    layout = layout or B.Layout.of(points, points.count(), block)
    splitter, box = layout.splitter, layout.boxes
    entries = B.with_block(points.select("pos", "x"), splitter)
    both = _entries(entries, 2) if queries is None else _entries(entries, 0).unionByName(_entries(B.with_block(queries.select("pos", "x"), splitter), 1))
    home = _by_task(both, splitter.blocks).mapInArrow(_home(metric, k, itself, box), _HOME_SCHEMA)
    if box is None:
        return home, None
    home = materialize(home, "home")
    routed = home.where(F.size("routes") > 0)
    if routed.isEmpty():
        return home, None
    sent = routed.select("pos", "x", "reach", F.explode("routes").alias("task"), F.lit(1).alias("kind"))
    return home, _by_task(_entries(entries, 0).unionByName(sent), splitter.blocks).mapInArrow(_search(metric, k, itself, None), "pos long, nbr long, dist double")


def knn(points: DataFrame, k: int, metric: Metric, itself: bool | None = False, queries: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``pos, nbr, dist, rank``: the ``k`` nearest points of every query (of every point by default).

    Exact, ties by the smaller position. ``itself``: a point counts as its own neighbour
    (None: queries are other points, whatever their positions).
    Points and queries meet block by block: a query first in the block it falls into, then
    in the blocks whose box is no farther than the k-th neighbour it has; only such
    queries are ranked again. For metrics without box bounds that is all blocks. Fewer rows
    if there are fewer points.
    """
    if points.isEmpty():
        return points.sparkSession.createDataFrame([], "pos long, nbr long, dist double, rank int")
    home, more = _rounds(points, k, metric, itself, queries, block)
    pair = F.arrays_zip("nbr", "dist")
    done = (home if more is None else home.where(F.size("routes") == 0)).select("pos", F.posexplode(pair).alias("i", "p"))
    done = done.select("pos", F.col("p.nbr").alias("nbr"), F.col("p.dist").alias("dist"), (F.col("i") + 1).cast("int").alias("rank"))
    if more is None:
        return done
    first = home.where(F.size("routes") > 0).select("pos", F.explode(pair).alias("p")).select("pos", "p.nbr", "p.dist")
    rank = F.row_number().over(Window.partitionBy("pos").orderBy("dist", *([F.col("nbr") != F.col("pos")] if itself else []), "nbr")).cast("int").alias("rank")
    return done.unionByName(first.unionByName(more).select("pos", "nbr", "dist", rank).where(F.col("rank") <= k))


def nearest_core(points: DataFrame, k: int, metric: Metric, itself: bool = False, block: int = BLOCK, layout: B.Layout | None = None) -> DataFrame:
    """``pos, core``: the distance of each point's ``k``-th neighbour (inf if there are fewer), without the neighbours' table."""
    if points.isEmpty():
        return points.sparkSession.createDataFrame([], "pos long, core double")
    home, more = _rounds(points, k, metric, itself, None, block, layout)
    if more is None:
        return home.select("pos", F.col("reach").alias("core"))
    done = home.where(F.size("routes") == 0).select("pos", F.col("reach").alias("core"))
    all_ = home.where(F.size("routes") > 0).select("pos", F.explode_outer("dist").alias("d")).unionByName(more.select("pos", F.col("dist").alias("d")))
    kth = F.try_element_at(F.sort_array(F.collect_list("d")), F.lit(k))
    return done.unionByName(all_.groupBy("pos").agg(F.coalesce(kth, F.lit(float("inf"))).alias("core")))


def within(points: DataFrame, radius: float, metric: Metric, itself: bool = False, queries: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``pos, nbr, dist``: the points at most ``radius`` from every query (every point by default)."""
    total = points.count()
    if not total:
        return points.sparkSession.createDataFrame([], "pos long, nbr long, dist double")
    splitter = B.plan(points, total, block)
    entries = B.with_block(points.select("pos", "x"), splitter)
    asked = entries if queries is None else B.with_block(queries.select("pos", "x"), splitter)
    if splitter.blocks == 1:
        sent = _entries(asked, 1)
    else:
        sent = asked.mapInArrow(_send(metric, B.boxes(entries, splitter.blocks), radius), _SENT)
    return _by_task(_entries(entries, 0).unionByName(sent), splitter.blocks).mapInArrow(_search(metric, None, itself, radius), "pos long, nbr long, dist double")


def core_distances(neighbours: DataFrame, k: int) -> DataFrame:
    """``pos, core``: the distance of the ``k``-th neighbour in a kNN table; inf if there are fewer."""
    core = F.max(F.when(F.col("rank") == k, F.col("dist")))
    return neighbours.groupBy("pos").agg(F.coalesce(core, F.lit(float("inf"))).alias("core"))


def core_of_edges(edges: DataFrame, k: int) -> DataFrame:
    """``pos, core`` of an edge table ``i, j, d`` with both directions: the k-th smallest stored distance.

    Points with fewer stored distances have the core distance inf.
    """
    w = Window.partitionBy("i").orderBy("d", "j")
    ranked = edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return ranked.groupBy(F.col("i").alias("pos")).agg(F.coalesce(F.max(F.when(F.col("r") == k, F.col("d"))), F.lit(float("inf"))).alias("core"))
