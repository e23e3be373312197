"""Sets of mutually similar records, by density hierarchy over a neighbour graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm import vectors as V
from moraine.llm.neighbours import records
from moraine.operators import tree as T
from moraine.operators.arrow import groups, matrix
from moraine.operators.forest import boruvka
from moraine.session import materialize

_SENT = "id long, vec array<double>, label int, n long, task long, kind int"
_GRAPH = "kind int, a long, b long, w double, part long, open boolean, degree long, n long, label int, task long"
_SETS = "part long, id long, mutual boolean, n long, label int, set_size long, level double, probability double"


def _send(blocks: V.Blocks, reach: float):
    """Each record to its own block (kind 0) and to every block it may have neighbours for (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict = {}  # the other blocks within reach of each block met so far

        for batch in batches:
            block, x = batch.column("block").to_numpy(), matrix(batch.column("vec"))
            rows, tasks = [np.arange(len(block))], [block]
            for b in np.unique(block).tolist():
                if b not in near:
                    own = blocks.index(b)
                    near[b] = [i for i in blocks.box_gap(blocks.low[own], blocks.high[own], reach).tolist() if i != own]
                for i in near[b]:
                    here = np.flatnonzero(block == b)
                    here = here[blocks.gap(x[here], i) <= reach]
                    rows.append(here)
                    tasks.append(np.full(len(here), blocks.number[i]))
            at, task = np.concatenate(rows), np.concatenate(tasks)
            kind = (np.arange(len(at)) >= len(block)).astype(np.int32)
            got = batch.take(pa.array(at)) if len(at) > len(block) else batch
            cols = [got.column("id"), got.column("vec"), got.column("label"), got.column("n"), pa.array(task), pa.array(kind)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "vec", "label", "n", "task", "kind"])

    return run


def close_pairs(x: np.ndarray, label: np.ndarray, radius: float, rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j of one label at most ``radius`` apart, and their distances from differences."""
    order = np.argsort(label, kind="stable")
    out: list = []
    edges = np.flatnonzero(np.diff(label[order])) + 1
    for own in np.split(order, edges):
        own = np.sort(own)
        y = x[own] - x[own].mean(0)
        slack = 1e-10 * max(1.0, float((y * y).sum(1).max(initial=0.0)))
        for s in range(0, len(own), rows):
            d = V.squared(y[s : s + rows], y[s:])
            i, j = np.nonzero(d <= radius * radius + slack)
            i, j = i[j > i], j[j > i]
            real = V.exact(x[own[s + i]], x[own[s + j]])
            ok = real <= radius
            out.append((own[s + i[ok]], own[s + j[ok]], real[ok]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def _local(radius: float, min_samples: int):
    """The block's share of the graph: its records' nodes and the local spanning forest of their edges.

    An edge that isn't in the local forest is the heaviest of a cycle, so it is in no
    global one either. A component without records of other blocks is closed: final.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, t in groups(batches, "task"):
            order = np.argsort(t.column("id").to_numpy(), kind="stable")
            t = t.take(pa.array(order))
            ids, kind, weight, label = (t.column(c).to_numpy() for c in ("id", "kind", "n", "label"))
            home = kind == 0
            if not home.any():
                continue
            i, j, d = close_pairs(matrix(t.column("vec")), label, radius)
            m = len(ids)
            degree = np.bincount(i, weight[j], m) + np.bincount(j, weight[i], m) + weight - 1
            # The k-th nearest neighbour; copies are neighbours at distance 0.
            core = np.where(weight > min_samples, 0.0, np.inf)
            who, dist, more = np.concatenate([i, j, np.arange(m)]), np.concatenate([d, d, np.zeros(m)]), np.concatenate([weight[j], weight[i], weight - 1])
            o = np.lexsort((dist, who))
            who, dist, more = who[o], dist[o], more[o]
            upto = np.cumsum(more)
            start = np.searchsorted(who, np.arange(m))
            upto = upto - (upto - more)[start[who]]
            ok = np.flatnonzero(upto >= min_samples)
            first = ok[np.unique(who[ok], return_index=True)[1]]
            core[who[first]] = dist[first]
            w = np.maximum(np.maximum(core[i], core[j]), d)
            e = np.flatnonzero((w <= radius) & (home[i] | home[j]))
            i, j, w = i[e], j[e], w[e]
            o = np.lexsort((ids[j], ids[i], w))
            i, j, w = i[o], j[o], w[o]
            keep = T.spanning_forest(m, i, j, w)
            i, j, w = i[keep], j[keep], w[keep]
            part = T.components(m, i, j)
            open_ = np.zeros(m, bool)
            open_[part[~home]] = True
            node = np.flatnonzero(home & (degree > 0))
            k = len(node) + len(i)
            zero = np.zeros(len(i), np.int64)
            cols = [
                pa.array(np.r_[np.zeros(len(node), np.int32), np.ones(len(i), np.int32)]),
                pa.array(np.r_[ids[node], ids[i]]),
                pa.array(np.r_[ids[node], ids[j]]),
                pa.array(np.r_[np.zeros(len(node)), w]),
                pa.array(np.r_[ids[part[node]], ids[part[i]]]),
                pa.array(np.r_[open_[part[node]], open_[part[i]]]),
                pa.array(np.r_[degree[node].astype(np.int64), zero]),
                pa.array(np.r_[weight[node], zero]),
                pa.array(np.r_[label[node], label[i]].astype(np.int32)),
                pa.array(np.full(k, number)),
            ]
            if k:
                yield pa.RecordBatch.from_arrays(cols, names=["kind", "a", "b", "w", "part", "open", "degree", "n", "label", "task"])

    return run


def hierarchy(ids: list, edges: list, min_size: int, epsilon: float, copies: list | None = None) -> tuple[list, list, list]:
    """Of one component: each record's selected cluster (or -1), level at which it leaves, probability.

    ``edges``: (i, j, w) of its spanning tree over positions in ``ids``. Condensed with
    ``min_size``, clusters chosen by stability, those born below ``epsilon`` merged up; the
    component itself may be chosen, and is then kept whole. With ``copies``, the number of records
    of each, a record counts as up to ``min_size`` points, which join it where it first joins another.
    """
    n = len(ids)
    if n == 1:
        return [0], [T.INF], [1.0]
    order, m = T.prim_order(n, edges), n
    if copies:
        low: dict = {}
        for a, b, w in edges:
            low[a], low[b] = min(w, low.get(a, w)), min(w, low.get(b, w))
        more = [k for k, c in enumerate(copies) for _ in range(min(c, min_size) - 1)]
        order, m = [(k, n + i, low[k]) for i, k in enumerate(more)] + order, n + len(more)
    order = sorted(order, key=lambda e: e[2])
    tree = T.condense(m, T.agglomerate(m, order), min_size)
    weight = T.stability(tree)
    chosen = T.select(tree, weight, single=True, epsilon=epsilon)
    got = T.labels(tree, chosen, weight, single=True, epsilon=epsilon or T.INF)
    level = [0.0] * m
    for _, c, lam, s in tree.rows():
        if s == 1:
            level[c] = lam
    return got.label[:n], level[:n], got.probability[:n]


def _trees(min_size: int, epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(8)]

        def flush():
            cols = [pa.array(c, pa.float64() if k > 5 else pa.int32() if k == 4 else pa.bool_() if k == 2 else pa.int64()) for k, c in enumerate(out)]
            return pa.RecordBatch.from_arrays(cols, names=["part", "id", "mutual", "n", "label", "set_size", "level", "probability"])

        for _, t in groups(batches, "part"):
            kind = t.column("kind").to_numpy()
            nodes, edges = t.filter(pa.array(kind == 0)), t.filter(pa.array(kind == 1))
            ids, n = nodes.column("a").to_pylist(), nodes.column("n").to_pylist()
            if sum(n) < min_size:
                continue
            at = {x: k for k, x in enumerate(ids)}
            tree = [(at[a], at[b], w) for a, b, w in zip(*(edges.column(c).to_pylist() for c in ("a", "b", "w")))]
            mutual = all(d == sum(n) - 1 for d in nodes.column("degree").to_pylist())
            label, level, prob = hierarchy(ids, tree, min_size, epsilon) if mutual else hierarchy(ids, tree, min_size, 0.0, n)
            head: dict = {}
            for x, c in zip(ids, label):
                head.setdefault(c, x)
            size: dict = {}
            for c, k in zip(label, n):
                size[c] = size.get(c, 0) + k
            for k, (x, c, lam, p) in enumerate(zip(ids, label, level, prob)):
                if c >= 0 and size[c] >= min_size:
                    row = (head[c], x, mutual, n[k], nodes.column("label")[k].as_py(), size[c], lam, p)
                    for col, v in zip(out, row):
                        col.append(v)
            if len(out[0]) > 8192:
                yield flush()
                for col in out:
                    col.clear()
        if out[0]:
            yield flush()

    return run


def similarity_sets(points: DataFrame, dim: int, radius: float, min_samples: int = 2, min_size: int = 3, centroids: int = V.CENTROIDS, sample: int = V.SAMPLE, block: int = V.BLOCK) -> DataFrame:
    """Sets of similar records of ``id, vec, label``: one row per member.

    ``id, first_id, label, set_size, mutual, level, probability, typical``: ``first_id`` is the set's least
    id and ``set_size`` its size with copies; ``level`` is one over the distance at which the record leaves the set
    (its persistence) and ``typical`` its place among the members: most persistent first, then
    smallest id. ``mutual``: any two members are at most ``radius`` apart and no further record of
    the label is within ``radius`` of any of them.

    Method: records go to spatial blocks, and to every other block whose box is within
    two radii, so that each block knows all neighbours of its records. Core distance is the
    distance to the ``min_samples``-th nearest other record of the label, edges up to
    ``radius`` weigh max(core, core, distance). Each block keeps the spanning forest of its
    edges; components that reach over blocks are finished by distributed Borůvka rounds;
    each component's tree is condensed (``min_size``) and clusters are selected by
    stability. Only a component that is a mutual set is merged up to ``radius``, so it stays whole; of
    the others, records outside of the selected clusters are in no set. Equal vectors of a
    label are one node that counts as many records. Records in no set, with a null label or
    label below 0 have no row. ``vec`` has ``dim`` finite elements, ids are distinct; an empty
    table gives no sets.
    """
    spark = points.sparkSession
    rows = points.where("label >= 0").select(F.col("id").cast("long").alias("id"), "vec", F.col("label").cast("int").alias("label"))
    book, total = V.fit(rows, dim, centroids, sample, block)
    none = spark.createDataFrame([], "id long, first_id long, label int, set_size long, mutual boolean, level double, probability double, typical int")
    if not total:
        return none
    members, count = V.copies(rows, ["label"])
    unique = rows.withColumn("n", F.lit(1).cast("long"))
    if members is not None:
        info = V.maybe_broadcast(members.select(F.col("id").alias("m"), "rep", F.col("n").alias("c")), count)
        joined = rows.join(info, F.col("id") == F.col("m"), "left").where("m IS NULL OR m = rep")
        unique = joined.select("id", "vec", "label", F.coalesce("c", F.lit(1)).cast("long").alias("n"))
    blocked = V.with_block(unique, book)
    table = V.blocks(blocked, dim)
    sent = blocked.select("id", "vec", "label", "n", "block").mapInArrow(_send(table, 2 * radius * (1 + 1e-9)), _SENT)
    graph = sent.repartition("task").sortWithinPartitions("task").mapInArrow(_local(radius, min_samples), _GRAPH)
    graph = materialize(graph, "graph")
    cols = ["kind", "a", "b", "w", "part", "degree", "n", "label"]
    final = graph.where("NOT open").select(*cols)
    over = graph.where("open")
    if not over.isEmpty():
        forest, parts = boruvka(over.where("kind = 1").select("a", "b", "w"))
        nodes = over.where("kind = 0").drop("part", "open", "task").join(parts.withColumnRenamed("node", "a"), "a", "left")
        nodes = nodes.withColumn("part", F.coalesce("part", "a")).select(*cols)
        zero = [F.lit(0).cast("long").alias("degree"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("label")]
        links = forest.join(parts.withColumnRenamed("node", "a"), "a").select(F.lit(1).alias("kind"), "a", "b", "w", "part", *zero)
        final = final.unionByName(nodes).unionByName(links)
    # Too small components never leave their partition; the others are the sets' trees.
    sets = final.repartition("part").sortWithinPartitions("part", "kind", "a", "b").mapInArrow(_trees(min_size, float(np.nextafter(radius, np.inf))), _SETS)
    sets = materialize(sets, "sets")
    whole = sets.groupBy("part").agg(F.min("id").alias("first_id"))
    sets = sets.join(whole, "part")
    if members is not None:
        more = V.maybe_broadcast(members.where("id != rep").select(F.col("id").alias("m"), "rep"), count)
        copied = sets.join(more, F.col("id") == F.col("rep")).withColumn("id", F.col("m")).drop("m", "rep")
        sets = sets.unionByName(copied)
    typical = F.row_number().over(Window.partitionBy("first_id").orderBy(F.desc("level"), "id")).cast("int")
    return sets.select("id", "first_id", "label", "set_size", "mutual", "level", "probability", typical.alias("typical"))


def labelled_records(prediction: DataFrame, cluster_map: DataFrame, dim: int = 24) -> DataFrame:
    """Valid records with the label of their cluster: ``id, vec, label``; noise has no row.

    A cluster with several labels in the map takes the least.
    """
    now = records(prediction, dim, ("cluster_node",))
    labels = cluster_map.where("cluster_node IS NOT NULL AND label IS NOT NULL").groupBy("cluster_node").agg(F.min("label").alias("label"))
    labels = materialize(labels, "labels")
    return now.join(V.maybe_broadcast(labels, labels.count()), "cluster_node").select("id", "vec", "label")
