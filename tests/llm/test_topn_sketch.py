import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.llm import sketch, topn

T0 = dt.datetime(2024, 1, 1)
TREE = "parent long, child long, lambda_val double, child_size long, loaded_at timestamp, salt int, g long, i long, s string"
INF, NAN = math.inf, math.nan


def tree(spark, rows):
    return spark.createDataFrame([(p, c, lam, 1, None if h is None else T0 + dt.timedelta(hours=h), 3, 4, 5, "x") for p, c, lam, h in rows], TREE)


def brute(rows, n):
    now = {}
    for p, c, lam, h in rows:
        if p is not None and c is not None and ((p, c) not in now or (h if h is not None else -1) >= now[p, c][1]):
            now[p, c] = (lam, h if h is not None else -1)
    groups = {}
    for (p, c), (lam, _) in now.items():
        if lam is not None and not math.isnan(lam):
            groups.setdefault(p, []).append((-lam, c))
    return sorted((p, c) for p, v in groups.items() for _, c in sorted(v)[:n])


def test_top_children_cases(spark):
    rows = [(1, 5, 1.0, 0), (1, 4, 1.0, 0), (1, 3, INF, 0), (1, 2, NAN, 0), (1, 9, None, 0), (1, 8, 9.0, 0), (1, 8, 0.1, 1), (1, 8, 0.1, 1), (2, 1, 7.0, None), (2, 1, NAN, 3), (3, 1, -0.0, 0), (3, 2, 0.0, 0), (None, 1, 1.0, 0), (4, None, 1.0, 0)]
    got = sorted((r.parent, r.child) for r in topn.top_children(tree(spark, rows), 3).collect())
    assert got == brute(rows, 3) == [(1, 3), (1, 4), (1, 5), (3, 1), (3, 2)]
    assert topn.top_children(tree(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(tree(spark, rows), "parent", "lambda_val", "child", 0)


def test_top_children_of_hot_parents(spark):
    random.seed(4)
    rows = [(random.choice([1, 1, 1, 1, 1, 2, random.randint(3, 40)]), random.randint(1, 900), random.choice([None, NAN, INF, 1.0, 2.0, random.random()]), h) for h in range(4000)]
    got = sorted((r.parent, r.child) for r in topn.top_children(tree(spark, rows), 5).collect())
    assert got == brute(rows, 5)


def test_top_n_keeps_equal_rows_and_crosses_batches(spark):
    df = spark.range(30_000).select(F.lit(1).alias("k"), (F.col("id") % 3).alias("v"), (F.col("id") * 0 + 2.0).alias("w"), "id")
    got = topn.top_n(df, "k", "w", "v", 4).collect()
    assert [(r.k, r.v, r.w) for r in got] == [(1, 0, 2.0)] * 4
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        many = spark.range(1000).select((F.col("id") % 11).alias("k"), F.col("id").alias("v"), (F.col("id") % 17).alias("w"))
        got = sorted((r.k, r.v) for r in topn.top_n(many, "k", "w", "v", 6).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = sorted((k, v) for k in range(11) for _, v in sorted((-(i % 17), i) for i in range(1000) if i % 11 == k)[:6])
    assert got == want


@pytest.mark.parametrize("alpha", [0.01, 0.05])
def test_sketch_error_and_merge(spark, alpha):
    rng = np.random.default_rng(0)
    v = np.r_[rng.lognormal(0, 3, 3000), -rng.lognormal(0, 3, 2000), np.zeros(50)]
    df = spark.createDataFrame([(int(i % 3), int(i % 7), float(x)) for i, x in enumerate(v)], "k int, day int, v double")
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    daily = sketch.sketch(df, ["k", "day"], "v", alpha)
    got = {r.k: r for r in sketch.percentiles(daily, ["k"], shares, alpha).collect()}
    for k in range(3):
        own = np.sort(v[np.arange(len(v)) % 3 == k])
        assert got[k].n == len(own)
        for name, q in shares.items():
            true = own[max(math.ceil(q * len(own)), 1) - 1]
            assert abs(got[k][name] - true) <= alpha * abs(true) * (1 + 1e-9)
    whole = sketch.sketch(df, ["k"], "v", alpha)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, sketch.merge(daily, ["k"]).collect()))
    found = sketch.percentiles(daily, ["k"], {"p50": 0.5}, alpha)
    exact = {r.k: r.exact for r in sketch.exact_at(df, daily, ["k"], "v", found, "p50", 0.5, alpha).collect()}
    assert exact == {k: float(np.sort(v[np.arange(len(v)) % 3 == k])[math.ceil(0.5 * (np.arange(len(v)) % 3 == k).sum()) - 1]) for k in range(3)}


def test_sketch_dirty(spark):
    df = spark.createDataFrame([(1, NAN), (1, None), (1, INF), (1, -INF), (1, 3.0), (None, 5.0)], "k int, v double")
    got = {r.k: (r.n, r.p) for r in sketch.percentiles(sketch.sketch(df, ["k"], "v"), ["k"], {"p": 0.5}).collect()}
    assert got[1][0] == 1 and got[1][1] == pytest.approx(3, rel=0.01) and got[None][1] == pytest.approx(5, rel=0.01)
    assert sketch.percentiles(sketch.sketch(df.limit(0), ["k"], "v"), ["k"], {"p": 0.5}).count() == 0


def runs(spark, rows):
    return spark.createDataFrame([(r, a, b, v, T0, T0 + dt.timedelta(hours=h), 0) for r, a, b, v, h in rows], "run_id long, c0 int, c1 long, c2 double, measured_at timestamp, loaded_at timestamp, n int")


def test_long_tailed(spark):
    rows, n = [], 0
    for c1, tail in ((1, 2.0), (2, 2.999), (3, 3.0), (4, 3.001), (5, 10.0)):
        for i in range(100):
            rows.append((n := n + 1, 1, c1, 1.0 if i < 80 else tail, 0))
    rows += [(n, 1, 5, 10.0, 3)] * 500  # the same run, sent again and again
    rows += [(10_000 + i, 1, 1, bad, 0) for i, bad in enumerate((None, NAN, INF, 0.0, -5.0) * 30)]
    rows += [(None, 1, 1, 99.0, 0)] * 200
    got = sorted((r.c0, r.c1) for r in sketch.long_tailed(runs(spark, rows), 3.0).collect())
    assert got == [(1, 3), (1, 4), (1, 5)]
    assert sketch.long_tailed(runs(spark, rows).limit(0)).count() == 0
    p = {r.c1: r for r in sketch.timing_percentiles(runs(spark, rows)).collect()}
    assert p[5].n == 100 and p[1].n == 100


def test_long_tails_of_tiny_values(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for c0, unit, tail in ((1, 1e-14, 4.0), (2, 1e-14, 2.0), (3, 1e-200, 3.0), (4, 1e-323, 3.0), (5, 1e-310, 2.0)):
        rows += [(100 * c0 + i, c0, 0, unit if i < 6 else unit * tail, t0, t0) for i in range(10)]
    df = spark.createDataFrame(rows, "run_id long, c0 int, c1 int, c2 double, measured_at timestamp, loaded_at timestamp")
    want = {c for c in range(1, 6) if (v := sorted(r[3] for r in rows if r[1] == c))[8] >= 3 * v[4]}
    assert {r.c0 for r in sketch.long_tailed(df).collect()} == want and {1, 4} <= want
    p50 = {r.c0: r.p50 for r in sketch.timing_percentiles(df).collect()}
    assert abs(p50[1] / 1e-14 - 1) <= 0.0101 and abs(p50[3] / 1e-200 - 1) <= 0.0101


def test_exact_value_within_one_bucket(spark, monkeypatch):
    """Thousands of different values of one bucket, many of them close together: cut by cells until one is left."""
    monkeypatch.setattr(sketch, "CELLS", 4)
    rng = np.random.default_rng(3)
    v = np.r_[1 + rng.random(2000) * 1e-3, 1.0004 + rng.random(1500) * 1e-14, np.full(700, 1.0005), [5e-324, 1e308]]
    df = spark.createDataFrame([(i % 2 if i < 4000 else None, float(x)) for i, x in enumerate(v)], "k int, v double")
    daily = sketch.sketch(df, ["k"], "v")
    for share in (0.0, 0.3, 0.5, 0.93, 1.0):
        found = sketch.percentiles(daily, ["k"], {"p": share})
        got = {r.k: r.exact for r in sketch.exact_at(df, daily, ["k"], "v", found, "p", share).collect()}
        at = np.where(np.arange(len(v)) < 4000, np.arange(len(v)) % 2, 9)
        assert got == {k: float(np.sort(v[at == c])[max(math.ceil(share * (at == c).sum()), 1) - 1]) for k, c in ((0, 0), (1, 1), (None, 9))}


def test_stored_sketches_of_days_add_up(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, 1, int(i % 3), float(rng.lognormal(0, 2)), T0 + dt.timedelta(days=int(i % 4)), T0, 0) for i in range(800)]
    df = spark.createDataFrame(rows, "run_id long, c0 int, c1 long, c2 double, measured_at timestamp, loaded_at timestamp, n int")
    path = f"{tmp_path}/sketch"
    for day in range(4):
        sketch.write_sketch(df.where(F.to_date("measured_at") == F.lit((T0 + dt.timedelta(days=day)).date())), path)
    sketch.write_sketch(df.where(F.to_date("measured_at") == F.lit(T0.date())), path)  # a day given again replaces itself
    shares = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    got = sketch.percentiles(sketch.read_sketch(spark, path), ["c0", "c1"], shares)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sketch.timing_percentiles(df).collect()))
    with pytest.raises(ValueError):
        sketch.read_sketch(spark, path, 0.02)
    for alpha in (0.0, 1e-9, 0.9):
        with pytest.raises(ValueError):
            sketch.sketch(df, ["c0"], "c2", alpha)
