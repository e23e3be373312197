"""Operators on condensed trees kept in a table, as joins and aggregations.

The table is ``parent, child, lambda_val, child_size``; a forest of any size. Clusters are
told from points by ``child_size > 1``. Rows whose lambda is null or NaN count nowhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.operators.skew import current_rows, key_stats, salted_aggregate
from moraine.session import materialize


def current(tree: DataFrame) -> DataFrame:
    """The current rows of a table that also has ``loaded_at``, with a proper lambda."""
    rows = current_rows(tree, ["lambda_val", "child_size"]).select("parent", "child", "lambda_val", "child_size")
    return rows.where("lambda_val IS NOT NULL AND NOT isnan(lambda_val)")


def cluster_rows(rows: DataFrame) -> DataFrame:
    return rows.where("child_size > 1")


def point_rows(rows: DataFrame) -> DataFrame:
    return rows.where("child_size = 1")


def leaves(rows: DataFrame) -> DataFrame:
    """``cluster``: clusters without clusters below."""
    inner = cluster_rows(rows)
    return inner.select(F.col("child").alias("cluster")).distinct().join(inner.select(F.col("parent").alias("cluster")), "cluster", "left_anti")


def births(rows: DataFrame) -> DataFrame:
    """``cluster, birth``: the least lambda of the rows that a cluster is a child in."""
    return cluster_rows(rows).groupBy(F.col("child").alias("cluster")).agg(F.min("lambda_val").alias("birth"))


def stability(rows: DataFrame) -> DataFrame:
    """``cluster, stability``: sum of (lambda - birth) * size over a cluster's rows; a root is born at 0.

    sum(lambda * size) - birth * sum(size), so that one salted aggregation by parent does
    before birth is known; infinite where a lambda is. A null size adds nothing.
    """
    inf = F.lit(float("inf"))
    finite = F.col("lambda_val") < inf
    aggs = {
        "weighted": ("sum", F.when(finite, F.col("lambda_val") * F.col("child_size"))),
        "size": ("sum", F.when(finite, F.col("child_size"))),
        "endless": ("max", (~finite & (F.col("child_size") > 0)).cast("int")),
    }
    sums = salted_aggregate(rows, "parent", aggs, ["child"])
    own = births(rows).withColumnRenamed("cluster", "parent")
    birth = F.coalesce("birth", F.lit(0.0))
    value = F.when((F.col("endless") == 1) & (birth < inf), inf).when(birth == inf, F.lit(0.0)).otherwise(F.coalesce("weighted", F.lit(0.0)) - birth * F.coalesce("size", F.lit(0)))
    return sums.join(own, "parent", "left").select(F.col("parent").alias("cluster"), value.alias("stability"))


def deaths(rows: DataFrame) -> DataFrame:
    """``cluster, death``: the largest lambda among a cluster's rows."""
    return salted_aggregate(rows, "parent", {"death": ("max", F.col("lambda_val"))}, ["child"]).withColumnRenamed("parent", "cluster")


def ancestors(rows: DataFrame) -> DataFrame:
    """``cluster, ancestor, depth``: every cluster with itself (depth 0) and all clusters above it.

    By doubling: each round joins the paths found so far with themselves, so a tree of depth
    d takes log2(d) rounds. A cluster with several parents has the ancestors of all. Rows that
    would lead back to their start are left out.
    """
    up = cluster_rows(rows).where("child != parent").select(F.col("child").alias("cluster"), F.col("parent").alias("ancestor")).distinct()
    nodes = up.select("cluster").unionByName(up.select(F.col("ancestor").alias("cluster"))).distinct()
    paths = materialize(up.withColumn("depth", F.lit(1)), "ancestors")
    while True:
        top = paths.groupBy("cluster").agg(F.max("depth").alias("d")).agg(F.max("d")).first()[0]
        if top is None:
            break
        more = paths.where(F.col("depth") == top)  # the longest paths only need to go on
        step = paths.select(F.col("cluster").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        new = more.join(step, "ancestor").select("cluster", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")).where("cluster != ancestor")
        new = new.groupBy("cluster", "ancestor").agg(F.min("depth").alias("depth"))
        new = materialize(new.join(paths.select("cluster", "ancestor"), ["cluster", "ancestor"], "left_anti"), "ancestors")
        if new.isEmpty():
            break
        paths = materialize(paths.unionByName(new), "ancestors")
    return nodes.select("cluster", F.col("cluster").alias("ancestor"), F.lit(0).alias("depth")).unionByName(paths)


def subtree_deaths(rows: DataFrame) -> DataFrame:
    """``cluster, death``: the largest lambda among the rows of a cluster and all clusters below it."""
    own = deaths(rows)
    below = ancestors(rows).where("depth > 0").join(own, "cluster").select(F.col("ancestor").alias("cluster"), "death")
    return own.unionByName(below).groupBy("cluster").agg(F.max("death").alias("death"))


def outlier_scores(rows: DataFrame) -> DataFrame:
    """``parent, child, score`` of the points: (death - lambda) / death, with the death of the parent's subtree.

    0 where the death is 0 or the lambda infinite; 1 where only the death is infinite. The deaths
    are one row per cluster; the join is even, as heavy parents' rows are spread first.
    """
    death = subtree_deaths(rows)
    points = point_rows(rows)
    heavy = list(key_stats(points, "parent").pieces)
    inf = F.lit(float("inf"))
    value = F.when((F.col("death") == 0) | (F.col("lambda_val") == inf), F.lit(0.0)).when(F.col("death") == inf, F.lit(1.0)).otherwise((F.col("death") - F.col("lambda_val")) / F.when(F.col("death") != 0, F.col("death")))
    pick = lambda df: df.select("parent", "child", value.alias("score"))
    renamed = death.withColumnRenamed("cluster", "parent")
    if not heavy:
        return pick(points.join(renamed, "parent"))
    # Heavy parents are a few a partition: their deaths go to every task.
    few = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in heavy], "parent long"))
    near = renamed.join(few, "parent", "left_semi")
    light = pick(points.join(few, "parent", "left_anti").join(renamed, "parent"))
    return light.unionByName(pick(points.join(F.broadcast(near), "parent")))
