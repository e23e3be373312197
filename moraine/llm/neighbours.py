"""The most similar vectors of every vector, by an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm import vectors as V
from moraine.operators.arrow import groups, matrix
from moraine.session import materialize

#: Entries times queries of one distance matrix.
_PIECE = 4_000_000
#: A query that has to visit more further blocks than this is sent to whole groups of blocks instead.
WIDE = 64
#: Entries of a group of blocks, and queries of one of its tasks.
_GROUP, _GROUP_QUERIES = 65_536, 16_384
_HOME = "id long, block long, nbr array<long>, dist array<double>, reach double, routes array<long>, multi boolean, vec array<double>"
_FOUND = "id long, nbr long, dist double"
_ASKED = "id long, vec array<double>, task long, kind int, multi boolean, rest array<long>"
_ROUTED = "id long, vec array<double>, reach double, routes array<long>"
#: Records whose true neighbours tell how far an approximate search must go, and what is added to the recall asked for their being a sample.
_TRIED, _MARGIN = 512, 0.03
#: Vectors that it sees at least.
_SEEN = 64


def nearest(query: np.ndarray, query_id: np.ndarray, entry: np.ndarray, entry_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of each query's ``k`` nearest entries, ties by the smaller id.

    A query is not its own neighbour. Missing places have distance inf and id -1. The
    product form ranks; the ``k`` nearest and all that rounding leaves open are ranked
    again by their differences.
    """
    n, m = len(query), len(entry)
    ids, dist = np.full((n, k), -1, np.int64), np.full((n, k), np.inf)
    if not n or not m:
        return ids, dist
    order = np.argsort(entry_id, kind="stable")
    entry, entry_id = entry[order], entry_id[order]
    mean = entry.mean(0)
    q, e = query - mean, entry - mean
    e2 = (e * e).sum(1)
    step = max(1, _PIECE // m)
    for s in range(0, n, step):
        d = V.squared(q[s : s + step], e)
        own = np.searchsorted(entry_id, query_id[s : s + step]).clip(0, m - 1)
        mine = np.flatnonzero(entry_id[own] == query_id[s : s + step])
        d[mine, own[mine]] = np.inf
        keep = min(m, k)
        kth = np.partition(d, keep - 1, axis=1)[:, keep - 1] if keep < m else np.full(len(d), np.inf)
        slack = 1e-12 * ((q[s : s + step] ** 2).sum(1) + e2.max()) * q.shape[1]
        row, col = np.nonzero((d <= (kth + 2 * slack)[:, None]) & (d < np.inf))
        real = V.exact(query[s + row], entry[col])
        o = np.lexsort((col, real, row))  # entries are in the order of their ids
        row, col, real = row[o], col[o], real[o]
        first = np.searchsorted(row, np.arange(len(d)))
        rank = np.arange(len(row)) - first[row]
        take = rank < k
        ids[s + row[take], rank[take]] = entry_id[col[take]]
        dist[s + row[take], rank[take]] = real[take]
    return ids, dist


class Traversal:
    """The occupied cells of the multi-index in order of their summed distance from a query.

    A row holds the cells of one centroid of the first half. The heap has of each row the nearest cell not
    yet visited, so that every pop is an occupied cell. Within a cell its blocks follow by the
    distance of their own centroids.
    """

    def __init__(self, book: V.Codebook, blocks: V.Blocks):
        self.book, self.blocks = book, blocks
        self.cell, self.first = np.unique(blocks.number >> V.SUB_BITS, return_index=True)
        self.end = np.append(self.first[1:], len(blocks.number))
        self.row, self.row_start = np.unique(self.cell // len(book.second), return_index=True)
        self.row_end = np.append(self.row_start[1:], len(self.cell))
        self.group = (np.cumsum(blocks.count) - blocks.count) // _GROUP

    def reached(self, x: np.ndarray) -> np.ndarray:
        """Summed squared distance of each query's halves to the centroids of each occupied cell."""
        h, m = self.book.first.shape[1], len(self.book.second)
        return V.squared(x[:, :h], self.book.first)[:, self.cell // m] + V.squared(x[:, h:], self.book.second)[:, self.cell % m]

    def inside(self, point: np.ndarray, cell: int) -> np.ndarray:
        """Indices of the blocks of the ``cell``-th occupied cell, the nearest first."""
        at = np.arange(self.first[cell], self.end[cell])
        if len(at) == 1:
            return at
        part = self.book.parts[int(self.cell[cell])][self.blocks.number[at] & ((1 << V.SUB_BITS) - 1)]
        return at[np.argsort(V.squared(point[None], part)[0], kind="stable")]

    def order(self, point: np.ndarray, reached: np.ndarray, own: int, visit: int) -> list[int]:
        """Blocks in the order of traversal, ``own`` first, until ``visit`` vectors are seen."""
        out, seen = [own], int(self.blocks.count[own])
        best = np.minimum.reduceat(reached, self.row_start)
        heap = list(zip(best.tolist(), range(len(best)), [0] * len(best)))
        heapq.heapify(heap)
        sorted_: dict = {}
        while heap and seen < visit:
            _, r, step = heapq.heappop(heap)
            if r not in sorted_:
                cells = np.arange(self.row_start[r], self.row_end[r])
                sorted_[r] = cells[np.argsort(reached[cells], kind="stable")]
            cells = sorted_[r]
            for i in self.inside(point, int(cells[step])).tolist():
                if i != own and seen < visit:
                    out.append(i)
                    seen += int(self.blocks.count[i])
            if step + 1 < len(cells):
                heapq.heappush(heap, (float(reached[cells[step + 1]]), r, step + 1))
        return out

    def visits(self, x: np.ndarray, own: np.ndarray, visit: int) -> dict[int, list[int]]:
        """Row of ``x`` to its blocks, for the queries whose own block (an index) alone holds too few vectors."""
        few = np.flatnonzero(self.blocks.count[own] < visit)
        out, step = {}, max(1, _PIECE // len(self.cell))
        for s in range(0, len(few), step):
            at = few[s : s + step]
            for q, reached in zip(at.tolist(), self.reached(x[at])):
                out[q] = self.order(x[q], reached, int(own[q]), visit)
        return out

    def routes(self, further: list[int], seen: list[int]) -> list[int]:
        """What a query is sent to: the ``further`` blocks by number, or, for many, the groups (negative) that hold
        them and those ``seen``, so that the groups alone answer it."""
        if len(further) <= WIDE:
            return self.blocks.number[further].tolist()
        return (-1 - np.unique(self.group[[*further, *seen]])).tolist()


def _asks(walk: Traversal, visit: int, complete: bool):
    """Every vector to its own block (kind 2: entry and query) and to the further blocks it visits first (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, x = b.column("block").to_numpy(), matrix(b.column("vec"))
            got = walk.visits(x, np.searchsorted(walk.blocks.number, block), visit)
            multi, rest = np.zeros(len(block), bool), [None] * len(block)
            rows, tasks = [np.arange(len(block))], [block]
            for q, way in got.items():
                if len(way) - 1 > WIDE:  # only an approximate search goes that far: the rest, or all by groups, comes in the second round
                    rest[q] = walk.routes(way[1:], way)
                    continue
                multi[q] = len(way) > 1
                rows.append(np.full(len(way) - 1, q))
                tasks.append(walk.blocks.number[way[1:]])
            at = np.concatenate(rows).astype(np.int64)
            kind = np.where(np.arange(len(at)) < len(block), 2, 1).astype(np.int32)
            sent = b.take(pa.array(at)) if len(at) > len(block) else b
            left = pa.array([*rest, *([None] * (len(at) - len(block)))], pa.list_(pa.int64()))
            cols = [sent.column("id"), sent.column("vec"), pa.array(np.concatenate(tasks)), pa.array(kind), pa.array(multi[at]), left]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "vec", "task", "kind", "multi", "rest"])

    return run


def _beyond(walk: Traversal, x: np.ndarray, reach: np.ndarray, seen: list[list[int]]) -> list[list[int]]:
    """For each query the routes to the blocks not ``seen`` whose box is no farther than its k-th neighbour so far."""
    blocks, out = walk.blocks, []
    near = np.arange(len(blocks.number))
    if np.isfinite(reach).all() and len(x):
        near = blocks.box_gap(x.min(0), x.max(0), float(reach.max()))
    if len(near) * len(x) > 4_000_000:  # queries from all over: each by itself
        for q, r, done in zip(x, reach, seen):
            at = blocks.box_gap(q, q, float(r)) if np.isfinite(r) else np.arange(len(blocks.number))
            gap = np.sqrt((np.maximum(np.maximum(blocks.low[at] - q, q - blocks.high[at]), 0) ** 2).sum(1))
            out.append(walk.routes([i for i in at[gap <= r * (1 + 1e-12)].tolist() if i not in done], done))
        return out
    step = max(1, 2_000_000 // (max(len(x), 1) * x.shape[1]))
    go = [np.empty((len(x), 0), bool)]
    for s in range(0, len(near), step):
        lo, hi = blocks.low[near[s : s + step]], blocks.high[near[s : s + step]]
        d = np.maximum(np.maximum(lo[None] - x[:, None], x[:, None] - hi[None]), 0)
        go.append(np.sqrt((d * d).sum(2)) <= (reach * (1 + 1e-12))[:, None])
    for row, done in zip(np.concatenate(go, 1), seen):
        out.append(walk.routes([i for i in near[row].tolist() if i not in done], done))
    return out


def _rank(walk: Traversal, k: int, complete: bool):
    """Each block ranks its visitors. A query of this block alone also learns which further blocks its proof needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, t in groups(batches, "task"):
            x, qid, kind = matrix(t.column("vec")), t.column("id").to_numpy(), t.column("kind").to_numpy()
            e, multi = kind == 2, t.column("multi").to_numpy()
            here = int(np.searchsorted(walk.blocks.number, number))
            entries, entry_id = x[e], qid[e]
            for s in range(0, len(x), 16_384):
                own, part, pid, many = kind[s : s + 16_384] == 2, x[s : s + 16_384], qid[s : s + 16_384], multi[s : s + 16_384]
                ids, dist = nearest(part, pid, entries, entry_id, k)
                reach = dist[:, k - 1].copy()
                routes: list = t.column("rest").slice(s, 16_384).to_pylist() if not complete else [None] * len(part)
                alone = np.flatnonzero(own & ~many)
                if complete:
                    for i, r in zip(alone.tolist(), _beyond(walk, part[alone], reach[alone], [[here]] * len(alone))):
                        routes[i] = r
                routes = [r or [] for r in routes]
                ok = ids >= 0
                edges = np.concatenate([[0], np.cumsum(ok.sum(1))]).astype(np.int32)
                vec = pa.array([v if r or (m and o) else None for v, r, m, o in zip(part, routes, many, own)], pa.list_(pa.float64()))
                if not complete:
                    reach[:] = np.inf
                cols = [pa.array(pid), pa.array(np.full(len(pid), number)), pa.ListArray.from_arrays(edges, pa.array(ids[ok])), pa.ListArray.from_arrays(edges, pa.array(dist[ok])), pa.array(reach), pa.array(routes, pa.list_(pa.int64())), pa.array(many), vec]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "block", "nbr", "dist", "reach", "routes", "multi", "vec"])

    return run


def _prove(walk: Traversal):
    """Queries that visited several blocks, with their k-th distance over all of them: which others may hold nearer vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, reach = matrix(b.column("vec")), b.column("reach").to_numpy()
                seen = [np.searchsorted(walk.blocks.number, v).tolist() for v in b.column("seen").to_pylist()]
                routes = pa.array(_beyond(walk, x, reach, seen), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), b.column("reach"), routes], names=["id", "vec", "reach", "routes"])

    return run


def _measured_visit(blocked: DataFrame, walk: Traversal, k: int, recall: float) -> int:
    """Vectors that a traversal must see to find ``recall`` of the ``k`` nearest.

    A sample of records, fixed by a hash of the id, is compared with all vectors, and counted
    is what each traversal sees before the block of a true neighbour.
    """
    few = blocked.select("id", "vec", "block").orderBy(F.xxhash64("id", F.lit(7)), "id").limit(_TRIED).toArrow()
    x, qid, own = matrix(few.column("vec")), few.column("id").to_numpy(), np.searchsorted(walk.blocks.number, few.column("block").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, block = batch.column("id").to_numpy(), batch.column("block").to_numpy()
            ids, dist = nearest(x, qid, matrix(batch.column("vec")), entry, k)
            order = np.argsort(entry, kind="stable")
            ok = ids >= 0
            cols = [pa.array(np.repeat(np.arange(len(x)), ok.sum(1))), pa.array(block[order[np.searchsorted(entry[order], ids[ok])]]), pa.array(dist[ok]), pa.array(ids[ok])]
            yield pa.RecordBatch.from_arrays(cols, names=["q", "block", "dist", "nbr"])

    near = blocked.select("id", "vec", "block").mapInArrow(run, "q long, block long, dist double, nbr long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("dist", "nbr"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "block").toArrow()
    q, wanted = near.column("q").to_numpy(), np.searchsorted(walk.blocks.number, near.column("block").to_numpy())
    if not len(q):
        return max(_SEEN, k + 1)
    count, before = walk.blocks.count, np.empty(len(q), np.int64)
    for i in np.unique(q).tolist():
        order = np.array(walk.order(x[i], walk.reached(x[i : i + 1])[0], int(own[i]), int(count.sum())))
        seen = np.full(len(count), count.sum())
        seen[order] = np.cumsum(count[order]) - count[order]
        before[q == i] = seen[wanted[q == i]]
    return max(_SEEN, k + 1, int(np.quantile(before, min(recall + _MARGIN, 1.0), method="higher")) + 1)


def _visit(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, "task"):
            kind = t.column("kind").to_numpy()
            x, ids, reach = matrix(t.column("vec")), t.column("id").to_numpy(), t.column("reach").to_numpy()
            e, q = kind == 0, np.flatnonzero(kind == 1)
            if not e.any() or not len(q):
                continue
            nbr, dist = nearest(x[q], ids[q], x[e], ids[e], k)
            ok = np.isfinite(dist) & (dist <= reach[q][:, None] * (1 + 1e-9))
            cols = [pa.array(np.repeat(ids[q], ok.sum(1))), pa.array(nbr[ok]), pa.array(dist[ok])]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "nbr", "dist"])

    return run


def _second_round(routed: DataFrame, blocked: DataFrame, walk: Traversal, k: int) -> DataFrame:
    """What the ``routed`` queries find in further blocks or groups of blocks: ``id, nbr, dist``."""
    sent = routed.select("id", "vec", "reach", F.explode("routes").alias("key"))
    schema = "id long, vec array<double>, reach double, task long, kind int"
    load = {r["key"]: r["n"] for r in sent.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row per block and group
    # A block or group that many queries come to is given to several tasks, each with all its entries.
    split = {b: min(math.ceil(n / (_GROUP_QUERIES if b < 0 else 8 * V.BLOCK)), 4096) for b, n in load.items()}
    wanted, hot = np.array(sorted(split), np.int64), {b: n for b, n in split.items() if n > 1}
    number, group = walk.blocks.number, walk.group

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            keys = [block, -1 - group[np.searchsorted(number, block)]] if len(wanted) and wanted[0] < 0 else [block]
            key, row = np.concatenate(keys), np.tile(np.arange(len(block)), len(keys))
            at = np.searchsorted(wanted, key).clip(0, len(wanted) - 1)
            mine = np.flatnonzero(wanted[at] == key)
            if len(mine):
                times = np.array([hot.get(b, 1) for b in key[mine].tolist()]) if hot else np.ones(len(mine), np.int64)
                part = np.concatenate([np.arange(n) for n in times]) if hot else np.zeros(len(mine), np.int64)
                mine = np.repeat(mine, times)
                got = batch.take(pa.array(row[mine]))
                cols = [got.column("id"), got.column("vec"), pa.array(np.zeros(len(mine))), pa.array(key[mine] * 4096 + part), pa.array(np.zeros(len(mine), np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "vec", "reach", "task", "kind"])

    parts = F.lit(1)
    for n in sorted(set(hot.values())):
        parts = F.when(F.col("key").isin([b for b, m in hot.items() if m == n]), F.lit(n)).otherwise(parts)
    task = F.col("key") * 4096 + F.pmod(F.xxhash64("id"), parts)
    queries = sent.select("id", "vec", "reach", task.alias("task"), F.lit(1).alias("kind"))
    both = blocked.select("id", "vec", "block").mapInArrow(entries, schema).unionByName(queries)
    return both.repartition("task").sortWithinPartitions("task").mapInArrow(_visit(k), _FOUND)


_BY_GROUP = "size(routes) > 0 AND routes[0] < 0"


def knn(vectors: DataFrame, dim: int, k: int = 5, centroids: int = V.CENTROIDS, sample: int = V.SAMPLE, block: int = V.BLOCK, visit: int | None = None, complete: bool = True, recall: float = 0.9) -> DataFrame:
    """The ``k`` nearest other records of every record of ``id, vec``: ``id, nbr, dist, rank``.

    Distance is Euclidean, ties go to the smaller id. ``vec`` has ``dim`` finite elements
    (see :func:`moraine.llm.vectors.finite`), ids are distinct. With fewer than ``k`` other
    records there are fewer rows; an empty table gives none.

    1. Two codebooks, one per half of the vectors, are fitted on a sample; every vector is an entry
       in the cell of its two nearest centroids. Cells expected to be large are cut into blocks.
    2. Every vector traverses the cells from itself: a heap gives the pairs of centroids by
       summed distance, its own first, until ``visit`` vectors are seen (with ``complete`` by default k + 1).
       It is sent to those blocks, which rerank their entries by true distance.
    3. With ``complete`` a check follows: blocks not visited whose box is no farther than the k-th
       neighbour found are visited too, so that the result is exact.
    4. Without, the traversal is all. ``visit`` is by default measured: what a sample of records, compared
       with all vectors, needs for ``recall``, and 64 at least.
    5. A vector with more than ``WIDE`` further blocks to visit is sent to the groups of blocks that hold
       them, of some 65,536 vectors each: fewer rows for the same search.

    Equal vectors are searched once: their first ``k + 1`` ids stand for them, however
    many there are. Vectors move once, plus the few that must visit another block.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("id").cast("long").alias("id"), "vec")
    book, total = V.fit(vectors, dim, centroids, sample, block)
    if total < 2:
        return spark.createDataFrame([], "id long, nbr long, dist double, rank int")
    members, n = V.copies(vectors, [])
    unique = vectors
    if members is not None:
        others = V.maybe_broadcast(members.where("id != rep").select("id"), n)
        unique = vectors.join(others, "id", "left_anti")
    blocked = V.with_block(unique, book)
    walk = Traversal(book, V.blocks(blocked.withColumn("n", F.lit(1)), dim))
    if not visit:
        visit = k + 1 if complete else _measured_visit(blocked, walk, k, recall)
    asked = blocked.select("id", "vec", "block").mapInArrow(_asks(walk, visit, complete), _ASKED)
    home = materialize(asked.repartition("task").sortWithinPartitions("task").mapInArrow(_rank(walk, k, complete), _HOME), "home")
    routed = home.where("size(routes) > 0").select("id", "vec", "reach", "routes")
    if complete:
        kth = F.try_element_at(F.sort_array(F.flatten(F.collect_list("dist"))), F.lit(k))
        several = home.where("multi").groupBy("id").agg(F.first("vec", ignorenulls=True).alias("vec"), F.coalesce(kth, F.lit(float("inf"))).alias("reach"), F.collect_list("block").alias("seen"))
        more = several.select("id", "vec", "reach", "seen").mapInArrow(_prove(walk), _ROUTED).where("size(routes) > 0")
        routed = materialize(routed.unionByName(more), "routed")
    far, one = not routed.isEmpty(), F.arrays_zip("nbr", "dist")
    pick = [F.col("p.nbr").alias("nbr"), F.col("p.dist").alias("dist")]
    # Where a query saw one block and needs no other, its ranks are final; the others' finds are ranked together.
    final = home.where("NOT multi AND size(routes) = 0").select("id", F.posexplode(one).alias("i", "p")).select("id", *pick, (F.col("i") + 1).cast("int").alias("rank"))
    open_ = home.where("multi OR size(routes) > 0")
    found = open_.where(f"NOT ({_BY_GROUP})")
    if far:
        by_group = routed.where(_BY_GROUP).select("id")
        if complete:  # of queries with several blocks the groups are known only now
            found = found.join(by_group, "id", "left_anti")
    found = found.select("id", F.explode(one).alias("p")).select("id", *pick)
    if far:
        found = found.unionByName(_second_round(routed, blocked, walk, k))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "nbr"))
    ranked = final.unionByName(found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "nbr", "dist", "rank"))
    if members is None:
        return ranked
    return _with_copies(ranked, members, n, k)


def _with_copies(ranked: DataFrame, members: DataFrame, n: int, k: int) -> DataFrame:
    """Neighbours of and among equal vectors, from those of the least id of each group."""
    by_id = Window.partitionBy("rep").orderBy("id")
    first = members.withColumn("i", F.row_number().over(by_id)).where(F.col("i") <= k + 1)  # cut map-side, so no group of copies is moved whole
    heads = first.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("n").alias("n"))
    heads = V.maybe_broadcast(heads, n)
    wide = ranked.join(heads.select(F.col("rep").alias("nbr"), "ids"), "nbr", "left")
    wide = wide.select("id", F.explode(F.coalesce("ids", F.array("nbr"))).alias("nbr"), "dist")
    own = members.join(heads.select("rep", "ids"), "rep")
    own = own.select("id", F.explode("ids").alias("nbr"), F.lit(0.0).alias("dist")).where("id != nbr")
    # Groups of more than k copies need nothing from outside; the others hand on what their least id found.
    small = V.maybe_broadcast(members.where(F.col("n") <= k).select(F.col("id").alias("m"), "rep"), n)
    full = V.maybe_broadcast(heads.where(F.col("n") > k).select(F.col("rep").alias("id")), n)
    outside = wide.join(full, "id", "left_anti").join(small, F.col("id") == F.col("rep"), "left")
    outside = outside.select(F.coalesce("m", "id").alias("id"), "nbr", "dist")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "nbr"))
    return outside.unionByName(own).withColumn("rank", rank).where(F.col("rank") <= k).select("id", "nbr", "dist", "rank")


def records(prediction: DataFrame, dim: int = 24, extra: tuple[str, ...] = ()) -> DataFrame:
    """The valid records of a prediction_data table: ``id, vec`` and ``extra`` of the current rows
    whose vector has ``dim`` non-null, finite elements."""
    now = V.latest(prediction, "id", "loaded_at", ["raw_data", *extra])
    return now.where(V.finite("raw_data", dim)).select("id", F.col("raw_data").alias("vec"), *extra)


def neighbour_pairs(prediction: DataFrame, dim: int = 24, k: int = 5, **options) -> DataFrame:
    """Pairs ``id_a < id_b`` of valid records, one of them among the other's ``k`` nearest."""
    found = knn(materialize(records(prediction, dim), "records"), dim, k, **options)
    return found.select(F.least("id", "nbr").alias("id_a"), F.greatest("id", "nbr").alias("id_b")).distinct()
