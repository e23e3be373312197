"""Registered queries of the skew-proof aggregation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.operators import skew


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/condensed_tree.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents whose total of ``child_size`` isn't the size stated for them."""
    return skew.parent_totals(_tree(spark, sf_dir)).where("differs").select("parent").distinct()


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children, total and stated size of every parent."""
    return skew.parent_totals(_tree(spark, sf_dir))


def skew_tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as delivered, per parent, by the generic salted aggregation."""
    aggs = {"n": ("count", F.lit(1)), "largest": ("max", F.col("child_size")), "smallest": ("min", F.col("child_size")), "total": ("sum", F.col("child_size"))}
    return skew.salted_aggregate(_tree(spark, sf_dir), "parent", aggs, ["child"])


QUERIES = {"p1_found": p1_found, "p1_totals": p1_totals, "skew_tree_stats": skew_tree_stats}

_CURRENT = """
WITH cur AS (
  SELECT parent, child, child_size FROM condensed_tree WHERE parent IS NOT NULL AND child IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY parent, child ORDER BY loaded_at DESC NULLS LAST) = 1),
tot AS (SELECT parent, count(*) AS children, CAST(coalesce(sum(child_size), 0) AS BIGINT) AS total FROM cur GROUP BY parent),
st AS (SELECT child AS parent, child_size AS stated FROM cur WHERE child_size IS NOT NULL)
"""
ORACLES = {
    "p1_found": _CURRENT + "SELECT DISTINCT parent FROM tot JOIN st USING (parent) WHERE stated <> total",
    "p1_totals": _CURRENT + "SELECT DISTINCT parent, children, total, stated, stated <> total AS differs FROM tot LEFT JOIN st USING (parent)",
    "skew_tree_stats": "SELECT parent, count(*) AS n, max(child_size) AS largest, min(child_size) AS smallest, CAST(sum(child_size) AS BIGINT) AS total FROM condensed_tree GROUP BY parent",
}
