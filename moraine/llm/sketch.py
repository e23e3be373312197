"""Percentiles with a guaranteed relative error, from bucket counts that add up."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.session import materialize

#: Relative error of a value reported by a sketch.
ALPHA = 0.01
#: Below this, doubles lose digits and a reported value has no bounded relative error.
TINY = 1e-300
#: Distance between the indices of the smallest positive and negative values.
_SPAN = 1 << 40
#: Errors that are kept to: finer buckets than these couldn't be told apart in a double's logarithm.
LEAST, MOST = 1e-7, 0.5
#: Cells that a bucket, or a cell of it, is cut into to find an exact value.
CELLS = 4_096


def _gamma(alpha: float) -> float:
    if not LEAST <= alpha <= MOST:
        raise ValueError(f"alpha must be from {LEAST} to {MOST}")
    return (1 + alpha) / (1 - alpha)


def bucket_of(value: Column, alpha: float = ALPHA) -> Column:
    """The signed logarithmic bucket of a finite value: monotone in the value, 0 for zero.

    With gamma = (1 + alpha) / (1 - alpha), bucket i of the positive side holds
    (gamma^(i-1), gamma^i]; indices are shifted so that all of them are positive.
    """
    gamma = _gamma(alpha)
    index = F.ceil(F.log(F.abs(value)) / F.lit(math.log(gamma))) + F.lit(_SPAN)
    return F.when(value == 0, F.lit(0)).when(value > 0, index).otherwise(-index).cast("long")


def bucket_value(bucket: Column, alpha: float = ALPHA) -> Column:
    """The value reported for a bucket: within ``alpha`` of every value in it."""
    gamma = _gamma(alpha)
    size = F.pow(F.lit(gamma), F.abs(bucket) - F.lit(_SPAN)) * F.lit(2 / (1 + gamma))
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * size)


def sketch(df: DataFrame, keys: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """Bucket counts per key: ``keys, bucket, n``.

    Null, NaN and infinite values count nowhere; null keys form a group of their own.
    Counts are combined map-side, so that a group of any size moves no more rows than
    it has buckets. An empty table gives an empty sketch.
    """
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = df.where(finite).select(*keys, bucket_of(v, alpha).alias("bucket"))
    return rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of other days or files, added up per ``keys``; all of one ``alpha``."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: list[str], shares: dict[str, float], alpha: float = ALPHA) -> DataFrame:
    """``keys, n`` and for each name in ``shares`` its percentile, with ``NAME_bucket``.

    The value at rank ceil(share * n), at least 1, counted from the smallest, with a
    relative error of at most ``alpha``. The window runs over the buckets of a group,
    whose number doesn't grow with the rows.
    """
    w = Window.partitionBy(*keys)
    upto = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = merge(sketches, keys).select(*keys, "bucket", F.sum("n").over(w).alias("__all"), F.sum("n").over(upto).alias("__upto"))
    rank = {name: F.greatest(F.ceil(F.col("__all") * F.lit(share)), F.lit(1)) for name, share in shares.items()}
    picks = [F.min(F.when(F.col("__upto") >= r, F.col("bucket"))).alias(f"{name}_bucket") for name, r in rank.items()]
    found = run.groupBy(*keys).agg(F.first("__all").alias("n"), *picks)
    return found.select(*keys, "n", *[bucket_value(F.col(f"{name}_bucket"), alpha).alias(name) for name in shares], *[f"{name}_bucket" for name in shares])


def exact_at(df: DataFrame, sketches: DataFrame, keys: list[str], value: str, found: DataFrame, name: str, share: float, alpha: float = ALPHA) -> DataFrame:
    """The exact value at the percentile ``name`` for the groups in ``found``: ``keys, exact``.

    ``found`` comes from :func:`percentiles` over ``sketches``, those of ``df``. How many values lie below the bucket of
    the rank is known from the sketch; only the rows of that bucket are read. Its range is cut into
    :data:`CELLS` cells, counted map-side, and so is the cell that holds the rank, until it is one value: a few rounds,
    in which no group's values ever meet in one task.
    """
    target = found.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(f"{name}_bucket").alias("__b"), F.greatest(F.ceil(F.col("n") * F.lit(share)), F.lit(1)).alias("__rank"))
    same = lambda: [F.col(f"__{k}").eqNullSafe(F.col(k)) for k in keys]
    own = [F.col(f"__{k}").alias(k) for k in keys]
    total = merge(sketches, keys)
    below = target.join(total, [*same(), F.col("bucket") < F.col("__b")], "left").groupBy(*[f"__{k}" for k in keys], "__b", "__rank").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__below"))
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))).select(*keys, v.alias("__v"), bucket_of(v, alpha).alias("__bucket"))
    rows = materialize(rows.join(below, [*same(), F.col("__bucket") == F.col("__b")]).select(*own, "__v", (F.col("__rank") - F.col("__below")).alias("__rank")), "bucket")
    state = rows.groupBy(*keys).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.first("__rank").alias("rank"))
    state = materialize(state, "cells")
    done = None
    while True:
        final = state.where("lo = hi").select(*keys, F.col("lo").alias("exact"))
        done = final if done is None else done.unionByName(final)
        live = state.where("lo < hi")
        if live.isEmpty():
            return done
        live = live.select(*[F.col(k).alias(f"__{k}") for k in keys], "lo", "hi", "rank")
        inside = rows.join(live, [*same(), F.col("__v").between(F.col("lo"), F.col("hi"))])
        # The ends are values that occur and fall into cells of their own, so every round gets closer.
        cell = F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS)
        cell = F.when(F.col("__v") == F.col("hi"), F.lit(CELLS)).when(F.col("__v") == F.col("lo"), F.lit(-1)).otherwise(F.least(cell, F.lit(CELLS - 1)))
        counts = inside.groupBy(*keys, "rank", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        state = materialize(counts.select(*keys, "lo", "hi", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")), "cells")


def runs(timings: DataFrame) -> DataFrame:
    """One row per ``run_id``, the one loaded last: ``run_id, c0, c1, c2, day``.

    Rows without ``run_id`` can't be told apart from repeats and are left out; ``c2`` that
    is null, not finite, zero or negative is not a time and left out.
    """
    at = F.coalesce(F.unix_micros("loaded_at"), F.lit(-(2**63)))
    rows = timings.where(F.col("run_id").isNotNull()).select("run_id", "c0", "c1", "c2", F.to_date("measured_at").alias("day"), at.alias("__at"))
    one = rows.groupBy("run_id").agg(*[F.max_by(c, "__at").alias(c) for c in ("c0", "c1", "c2", "day")])
    return one.where((F.col("c2") > 0) & (F.col("c2") < F.lit(float("inf"))))


def timing_sketch(timings: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Bucket counts per (``c0``, ``c1``) and day, of the proper runs: ``c0, c1, day, bucket, n``."""
    return sketch(runs(timings), ["c0", "c1", "day"], "c2", alpha)


def write_sketch(timings: DataFrame, path: str, alpha: float = ALPHA) -> None:
    """Store the daily sketches of ``timings`` at ``path``, a folder per day; days stored before are replaced.

    A run belongs to the day it was measured on, however often it is sent, so a day is complete once all of its
    rows are given together. Runs without a day have a folder of their own.
    """
    rows = timing_sketch(timings, alpha).withColumn("alpha", F.lit(float(alpha)))
    rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_sketch(spark: SparkSession, path: str, alpha: float = ALPHA) -> DataFrame:
    """The stored sketches ``c0, c1, day, bucket, n``; all must be of one ``alpha``."""
    rows = spark.read.schema("c0 int, c1 long, bucket long, n long, alpha double, day date").parquet(path)
    if not rows.where(F.col("alpha") != F.lit(float(alpha))).isEmpty():
        raise ValueError("sketches of another alpha can't be merged")
    return rows.select("c0", "c1", "day", "bucket", "n")


def timing_percentiles(timings: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Median, 90th and 99th percentile of ``c2`` per (``c0``, ``c1``), from the daily sketches.

    ``c0, c1, n, p50, p90, p99`` and their buckets; relative error at most ``alpha``.
    """
    return percentiles(timing_sketch(timings, alpha), ["c0", "c1"], {"p50": 0.5, "p90": 0.9, "p99": 0.99}, alpha)


def long_tailed(timings: DataFrame, ratio: float = 3.0, alpha: float = ALPHA) -> DataFrame:
    """Groups (``c0``, ``c1``) whose 90th percentile is at least ``ratio`` times the median.

    Where the error bound leaves the answer open, the two percentiles are made exact
    from the one bucket each of them lies in.
    """
    daily = materialize(timing_sketch(timings, alpha), "sketches")
    found = percentiles(daily, ["c0", "c1"], {"p50": 0.5, "p90": 0.9}, alpha)
    found = materialize(found.withColumn("r", F.when(F.col("p50") > TINY, F.col("p90") / F.col("p50"))), "percentiles")
    slack = ((1 + alpha) / (1 - alpha)) ** 1.05
    sure = found.where(F.col("r") >= ratio * slack).select("c0", "c1")
    open_ = found.where(F.col("r").isNull() | ((F.col("r") < ratio * slack) & (F.col("r") >= ratio / slack)))
    if open_.isEmpty():
        return sure
    # Only rows of open groups are read again; a run's repeats are of the same group, so they are left out there.
    named = open_.select(F.col("c0").alias("__c0"), F.col("c1").alias("__c1"))
    rows = materialize(runs(timings).join(named, F.col("c0").eqNullSafe(F.col("__c0")) & F.col("c1").eqNullSafe(F.col("__c1")), "left_semi"), "open")
    p50 = exact_at(rows, daily, ["c0", "c1"], "c2", open_, "p50", 0.5, alpha).withColumnRenamed("exact", "p50")
    p90 = exact_at(rows, daily, ["c0", "c1"], "c2", open_, "p90", 0.9, alpha).withColumnRenamed("exact", "p90")
    q = p90.withColumnsRenamed({"c0": "d0", "c1": "d1"})
    both = p50.join(q, p50.c0.eqNullSafe(q.d0) & p50.c1.eqNullSafe(q.d1))
    return sure.unionByName(both.where(F.col("p90") >= F.lit(ratio) * F.col("p50")).select("c0", "c1"))
