"""Other scalar functions, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def inverse(distance: Column) -> Column:
    """Density level 1/d; +inf at distance zero (never an error)."""
    return F.when(distance > 0, F.lit(1.0) / distance).otherwise(F.lit(INF))


def mutual_reachability(core_a: Column, core_b: Column, distance: Column, alpha: float = 1.0) -> Column:
    return F.greatest(core_a, core_b, distance / F.lit(float(alpha)))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Division in which a denominator that isn't positive counts as 1e-8."""
    return numerator / F.when(denominator <= 0, F.lit(1e-8)).otherwise(denominator)


def softmax(value: Column, per: list[str]) -> Column:
    """exp(x - max) over its sum, per group."""
    w = Window.partitionBy(*per)
    e = F.exp(value - F.max(value).over(w))
    return e / F.sum(e).over(w)


def normalise(value: Column, per: list[str]) -> Column:
    """A group's values over their sum; zero where the sum is."""
    total = F.sum(value).over(Window.partitionBy(*per))
    return F.when(total > 0, value / total).otherwise(F.lit(0.0))


def is_finite(vec: str, dim: int | None = None) -> Column:
    """Whether all elements are non-null and finite (and ``dim`` many); false for null."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF)))
    if dim is not None:
        ok = (F.size(vec) == dim) & ok
    return F.coalesce(ok, F.lit(False))


def log_size(size: Column) -> Column:
    """Sizes on a logarithmic scale, for plots."""
    return F.log(size.cast("double"))


def weighted_average(df: DataFrame, key: str, vec: str, weight: str) -> DataFrame:
    """Per key the average vector, weighted; zero weights give null elements."""
    each = df.select(key, F.posexplode(vec).alias("dim", "x"), F.col(weight).alias("w"))
    one = each.groupBy(key, "dim").agg((F.sum(F.col("x") * F.col("w")) / F.when(F.sum("w") > 0, F.sum("w"))).alias("m"))
    return one.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias(vec))
