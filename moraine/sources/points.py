"""Points and distance tables from what users have."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moraine.functions.scalar import is_finite
from moraine.session import materialize

POINTS = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("features", T.ArrayType(T.DoubleType()), False)])
EDGES = T.StructType([T.StructField("i", T.LongType(), False), T.StructField("j", T.LongType(), False), T.StructField("d", T.DoubleType(), False)])


def read_points(spark: SparkSession, path: str, id_col: str = "id", features: str | list[str] = "features", format: str = "parquet", **options) -> DataFrame:
    """``id, features`` from any Spark source: an array column, or numeric columns put together."""
    return to_points(spark.read.format(format).options(**options).load(path), id_col, features)


def to_points(df: DataFrame, id_col: str = "id", features: str | list[str] = "features") -> DataFrame:
    """``id, features`` of a DataFrame; other columns are dropped, so their names can't clash."""
    value = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    return df.select(F.col(id_col).cast("long").alias("id"), value.alias("features"))


def from_arrays(spark: SparkSession, data) -> DataFrame:
    """``id, features`` of a list of rows, an array, a pandas frame or a sparse matrix with ``toarray``; ids are row numbers."""
    data = data.toarray() if hasattr(data, "toarray") else data
    array = np.asarray(data.values if isinstance(data, pd.DataFrame) else data)
    if array.dtype.kind not in "fiub" or array.ndim != 2:
        try:
            array = array.astype(float)
        except (TypeError, ValueError):
            raise ValueError("points must be numbers") from None
        if array.ndim != 2:
            raise ValueError("points must be a table of numbers, one row each")
    frame = pd.DataFrame({"id": np.arange(len(array)), "features": list(array.astype(float))})
    return spark.createDataFrame(frame, POINTS) if len(frame) else spark.createDataFrame([], POINTS)


def from_sparse(entries: DataFrame, dim: int) -> DataFrame:
    """``id, features`` of stored entries ``id, dim, value``; missing ones are 0, repeated ones add up."""
    one = entries.groupBy("id", "dim").agg(F.sum("value").alias("v")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "v"))).alias("m"))
    return one.select(F.col("id").cast("long").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("features"))


def from_maps(rows: DataFrame, dim: int) -> DataFrame:
    """``id, features`` of rows ``id, features: map<int, double>``."""
    return rows.select(F.col("id").cast("long").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.try_element_at("features", k), F.lit(0.0))).alias("features"))


def matrix_edges(rows: DataFrame, n: int | None = None) -> DataFrame:
    """The edge table ``i, j, d`` of a square distance matrix given as rows ``id, features``.

    Infinite and null entries are missing edges. Raises ValueError unless every row has as
    many entries as there are rows, and the matrix is symmetric.
    """
    n = n or rows.count()
    edges = rows.select(F.col("id").alias("i"), F.posexplode("features").alias("j", "d"))
    if rows.where(F.size("features") != n).limit(1).count():
        raise ValueError("a distance matrix must be square")
    edges = edges.where("i != j AND d IS NOT NULL AND NOT isnan(d)").where(F.col("d") < F.lit(float("inf")))
    return check_symmetric(edges.select("i", F.col("j").cast("long").alias("j"), "d"))


def check_symmetric(edges: DataFrame) -> DataFrame:
    """``edges`` if every (i, j, d) has its (j, i, d); else ValueError."""
    pair = edges.where("i != j").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    bad = pair.agg(F.countDistinct("i", "j").alias("ways"), F.min("d").alias("a"), F.max("d").alias("b"), F.count(F.lit(1)).alias("n"))
    if bad.where("n < 2 OR abs(a - b) > 1e-8 + 1e-5 * abs(b)").limit(1).count():
        raise ValueError("a distance matrix must be symmetric")
    return edges


def positions(df: DataFrame, id_col: str = "id") -> DataFrame:
    """``df`` with dense row numbers ``raw`` 0..n-1 in the order of ``id_col``.

    Range partitions are numbered within themselves and shifted by the sizes of those
    before, so no single task sees all rows.
    """
    placed = materialize(df.repartitionByRange(id_col).withColumn("__part", F.spark_partition_id()), "positions")
    sizes = placed.groupBy("__part").count().orderBy("__part").collect()  # one row per partition
    start, before = 0, {}
    for r in sizes:
        before[r["__part"]] = start
        start += r["count"]
    spark = df.sparkSession
    shift = spark.createDataFrame(list(before.items()), "__part int, __start long")
    number = F.row_number().over(Window.partitionBy("__part").orderBy(id_col)) - 1
    return placed.withColumn("__n", number).join(F.broadcast(shift), "__part").withColumn("raw", (F.col("__n") + F.col("__start")).cast("long")).drop("__part", "__n", "__start")


def finite_points(points: DataFrame) -> tuple[DataFrame, int, int]:
    """(``id, raw, pos, x``, finite rows, all rows): ``raw`` counts all rows, ``pos`` the finite ones (null for others).

    Raises ValueError for null or repeated ids, or vectors of different lengths.
    """
    points = points.select("id", "features", is_finite("features").alias("ok"))
    look = points.agg(F.count(F.lit(1)).alias("all"), F.countDistinct("id").alias("ids"), F.count("id").alias("n"), F.min(F.size("features")).alias("a"), F.max(F.size("features")).alias("b"), F.count(F.when(~F.col("ok"), 1)).alias("bad")).first()
    total, bad = look["all"], look["bad"]
    if look["ids"] != total or look["n"] != total:
        raise ValueError("ids must be non-null and distinct")
    if total and (look["a"] != look["b"] or look["a"] is None or look["a"] < 1):
        raise ValueError("all points must have the same number of features, at least one")
    rows = positions(points.select("id", F.col("features").alias("x"), "ok"))
    if not bad:
        return materialize(rows.select("id", "raw", F.col("raw").alias("pos"), "x"), "points"), total, total
    good = positions(rows.where("ok").select("id", F.col("raw").alias("r"), "x")).select("id", F.col("r").alias("raw"), F.col("raw").alias("pos"), "x")
    rest = rows.where("NOT ok").select("id", "raw", F.lit(None).cast("long").alias("pos"), "x")
    return materialize(good.unionByName(rest), "points"), total - bad, total
