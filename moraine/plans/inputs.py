"""Point sets derived from the tables, for the registered queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.sources.points import finite_points, to_points


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as they are: 64 dimensions, unit length, no cluster structure."""
    return to_points(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def blobs2d(spark: SparkSession, sf_dir: str, amplitude: float = 4.0) -> DataFrame:
    """Two dimensions, moved by label around a circle: ten clusters (overlapping with a small amplitude)."""
    e = table(spark, sf_dir, "embeddings")
    angle = F.lit(2 * math.pi) * F.col("label") / F.lit(10.0)
    v = F.col("embedding").cast("array<double>")
    return e.select(F.col("vec_id").cast("long").alias("id"), F.array(v[0] + F.lit(amplitude) * F.cos(angle), v[1] + F.lit(amplitude) * F.sin(angle)).alias("features"))


def emb_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb64(spark, sf_dir).select("id", F.transform("features", lambda x: F.when(x > 0, 1.0).otherwise(0.0)).alias("features"))


def emb_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb64(spark, sf_dir).select("id", F.array(F.asin(F.col("features")[0]), F.lit(math.pi) * F.col("features")[1]).alias("features"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes and prices: integers and many equal points."""
    return to_points(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"])


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user: their number and mean value."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    return to_points(e, "user_id", ["n", "v"])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price (in thousands) and day of every order: the largest set of distinct points."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice").cast("double") / 1000).alias("price"), F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double").alias("day"))
    return to_points(o, "o_orderkey", ["price", "day"])


def placed(points: DataFrame) -> DataFrame:
    """``id, pos, x`` of the finite points."""
    return finite_points(points)[0].where("pos IS NOT NULL").select("id", "pos", "x")
