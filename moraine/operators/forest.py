"""Minimum spanning forests and components of edge tables, round by round on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.session import materialize


def _jump(link: DataFrame) -> DataFrame:
    """Follow ``c -> p`` to the roots (``p = c``) by doubling; returns ``c, p``."""
    while True:
        up = link.select(F.col("c").alias("p"), F.col("p").alias("g"))
        link = materialize(link.join(up, "p").select("c", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved")), "jump")
        if link.where("moved").isEmpty():
            return link.select("c", "p")
        link = link.select("c", "p")


def boruvka(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Minimum spanning forest of ``a, b, w``, unique under the order (w, a, b).

    Returns (forest, parts): ``a, b, w`` with a < b, and ``node, part`` for every node of an
    edge. Each round every component takes its least outgoing edge (combined map-side, so
    a component of any size loads no single task), the components so linked are joined by
    pointer doubling and edges inside one are dropped: at most log2(nodes) rounds. Every round
    is written to the shared folder, so that plans stay short and lost executors are
    survived. Loops and null or NaN weights are ignored; of parallel edges the least counts.
    """
    spark = edges.sparkSession
    low, high = F.least("a", "b"), F.greatest("a", "b")
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b AND w IS NOT NULL AND NOT isnan(w)")
    clean = clean.select(low.alias("a"), high.alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w"))
    live = materialize(clean.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")), "edges")
    parts = live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("part", F.col("node"))
    forest = None
    while not live.isEmpty():
        out = live.select(F.col("ca").alias("c"), F.struct("w", "a", "b", F.col("cb").alias("o")).alias("e"))
        back = live.select(F.col("cb").alias("c"), F.struct("w", "a", "b", F.col("ca").alias("o")).alias("e"))
        best = out.unionByName(back).groupBy("c").agg(F.min("e").alias("e"))
        best = materialize(best.select("c", "e.w", "e.a", "e.b", "e.o"), "best")
        new = best.select("a", "b", "w").distinct()
        forest = new if forest is None else forest.unionByName(new)
        other = best.select(F.col("c").alias("o"), F.col("o").alias("back"))
        # Two components that chose each other: the smaller becomes the root.
        link = best.select("c", "o").join(other, "o")
        root = F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o"))
        link = _jump(materialize(link.select("c", root.alias("p")), "link"))
        parts = parts.join(link, F.col("part") == F.col("c"), "left").select("node", F.coalesce("p", "part").alias("part"))
        live = live.join(link.select(F.col("c").alias("ca"), F.col("p").alias("na")), "ca").join(link.select(F.col("c").alias("cb"), F.col("p").alias("nb")), "cb")
        live = materialize(live.where("na != nb").select("a", "b", "w", F.col("na").alias("ca"), F.col("nb").alias("cb")), "edges")
        parts = materialize(parts, "parts")
    if forest is None:
        forest = spark.createDataFrame([], "a long, b long, w double")
    return forest, parts


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, part`` for every node of ``a, b``: the least node of its component is its part."""
    _, parts = boruvka(edges.select("a", "b", F.lit(0.0).alias("w")))
    least = parts.groupBy("part").agg(F.min("node").alias("least"))
    return parts.join(least, "part").select("node", F.col("least").alias("part"))
