import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from moraine.operators import skew

T0 = dt.datetime(2024, 1, 1)
TREE = "parent long, child long, lambda_val double, child_size long, loaded_at timestamp, total long, salt int"


def tree(spark, rows):
    return spark.createDataFrame([(*r, None, 7) for r in rows], TREE)


def at(n):
    return T0 + dt.timedelta(hours=n)


def test_key_stats(spark):
    df = spark.createDataFrame([(1,)] * 90 + [(2,)] * 10 + [(None,)] * 50, "k long")
    got = skew.key_stats(df, "k", 4)
    assert (got.total, got.low, got.high) == (100, 1, 2) and got.pieces == {1: 15}
    assert sorted(skew.key_stats(df, "k", 8).pieces) == [1, 2]
    for none in (df.limit(0), df.where("k > 5"), df.where("k IS NULL"), spark.createDataFrame([], "k long")):
        assert skew.key_stats(none, "k").pieces == {}


def test_a_heavy_key_is_one_that_loads_a_partition(spark):
    """2,000 keys of 1/2,000 each: nothing to split on 8 partitions, everything on 4,000."""
    df = spark.range(60_000).select((F.col("id") % 2000).alias("k"), "id")
    assert skew.key_stats(df, "k", 8).pieces == {}
    many = skew.key_stats(df, "k", 4000)
    assert len(many.pieces) == 2000 and set(many.pieces.values()) == {8}
    got = skew.with_salt(df, "k", ["id"], many.pieces).groupBy("k", "salt").count()
    assert got.count() > 10_000 and got.agg(F.max("count")).first()[0] <= 15
    aggs = {"n": ("count", F.lit(1)), "s": ("sum", F.col("id"))}
    total = skew.salted_aggregate(df, "k", aggs, ["id"], pieces=many.pieces)
    assert sorted(map(tuple, total.collect())) == sorted((k, 30, sum(range(k, 60_000, 2000))) for k in range(2000))


def test_salted_equals_plain(spark):
    random.seed(1)
    rows = [(random.choice([1, 1, 1, 1, 2, 3, None]), random.choice([None, *range(50)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, v long, i long")
    aggs = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}
    got = skew.salted_aggregate(df, "k", aggs, ["i"], pieces={1: 5})
    want = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.columns == ["k", "n", "s", "lo", "hi"]
    assert skew.salted_aggregate(df.limit(0), "k", aggs, ["i"]).count() == 0
    with pytest.raises(ValueError):
        skew.salted_aggregate(df, "k", {"m": ("median", F.col("v"))}, ["i"])


def test_heavy_key_is_spread(spark):
    df = spark.range(10_000).select(F.lit(7).cast("long").alias("k"), "id")
    salts = skew.with_salt(df, "k", ["id"], skew.key_stats(df, "k", 8).pieces).groupBy("salt").count().collect()
    assert len(salts) == 32 and max(r["count"] for r in salts) < 500


def test_parent_totals(spark):
    rows = [
        (10, 1, 1.0, 1, at(0)),
        (10, 1, 1.0, 5, at(2)),  # supersedes
        (10, 1, 1.0, 5, at(2)),  # delivered twice
        (10, 2, 1.0, None, at(1)),  # adds nothing
        (10, 11, 1.0, 3, None),  # a null time is the oldest, but the only one
        (11, 3, 1.0, 1, at(0)),
        (11, 4, 1.0, 2, at(0)),
        (12, 5, 1.0, None, at(0)),
        (9, 10, 1.0, 9, at(0)),
        (9, 12, 1.0, 0, at(0)),
        (None, 10, 1.0, 1, at(9)),
        (10, None, 1.0, 100, at(9)),
    ]
    got = {r["parent"]: tuple(r)[1:] for r in skew.parent_totals(tree(spark, rows)).collect()}
    assert got == {10: (3, 8, 9, True), 11: (2, 3, 3, False), 12: (1, 0, 0, False), 9: (2, 9, None, None)}
    assert skew.parent_totals(tree(spark, rows).limit(0)).count() == 0


def test_skew_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 300), (None, 301), (4, 302)], "k long, i long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "k long, v string")
    want = sorted([(1, i, v) for i in range(300) for v in "ab"] + [(2, 300, "c"), (None, 301, "d"), (4, 302, None)], key=str)
    for limit in (10, 0):
        got = skew.skew_join(left, right, "k", ["i"], 5, limit)
        assert got.columns == ["k", "i", "v"] and sorted(map(tuple, got.collect()), key=str) == want


def test_scratch_tables_go_with_their_block(spark):
    import os

    from moraine.session import materialize, scratch_tables

    with scratch_tables(spark):
        inside = materialize(spark.range(3).toDF("id"), "inside").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(inside)
    assert not os.path.exists(inside)
