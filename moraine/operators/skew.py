"""Aggregation and joins that stay even when a few keys hold most rows."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from moraine.session import shuffle_partitions

#: A key is heavy from this part of one partition's even share of the rows on; so at most 1 / HEAVY_PART keys a partition are.
HEAVY_PART = 0.5
#: The part of a partition's even share that a salted piece of a heavy key holds.
PIECE_PART = 0.25

#: How each aggregate's partial values are merged.
_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_PARTIAL = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


@dataclass
class KeyStats:
    """What one look at a key column tells: rows with a key, its range, and the heavy keys with their pieces."""

    total: int = 0
    low: object = None
    high: object = None
    pieces: dict = field(default_factory=dict)


def key_stats(df: DataFrame, key: str, partitions: int | None = None) -> KeyStats:
    """The heavy values of ``key``: those of more than ``HEAVY_PART`` of an even partition's rows.

    The threshold follows from the number of shuffle partitions, so no unsalted key loads a task by
    more than that at any size. Counts are combined map-side, and one pass gives them, the
    total and the range. The list is at most ``1 / HEAVY_PART`` keys a partition. Null is never a heavy key;
    an empty table has none.
    """
    partitions = partitions or shuffle_partitions(df.sparkSession)
    seen = Observation()
    keys = df.select(F.col(key).alias("k")).where("k IS NOT NULL").observe(seen, F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
    top = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").limit(int(partitions / HEAVY_PART)).collect()
    if not top:
        return KeyStats()
    got = seen.get
    total = got["n"]
    even = total / partitions
    heavy = {r["k"]: math.ceil(r["n"] / (even * PIECE_PART)) for r in top if r["n"] >= max(2, even * HEAVY_PART)}
    return KeyStats(total, got["low"], got["high"], heavy)


def with_salt(df: DataFrame, key: str, by: list[str], pieces: dict, name: str = "salt") -> DataFrame:
    """``df`` with a salt in ``0..pieces-1`` for the heavy keys' rows, 0 for all others.

    The salt is a hash of the columns ``by``: as even as a random number, but the
    same when a lost task runs again, and rows equal in ``by`` stay together. The keys and their
    pieces are a table of a few rows a partition, sent to every task.
    """
    if not pieces:
        return df.withColumn(name, F.lit(0))
    table = df.sparkSession.createDataFrame(list(pieces.items()), f"__k {df.schema[key].dataType.simpleString()}, __n int")
    spread = F.pmod(F.xxhash64(*by), F.col("__n")).cast("int")
    return df.join(F.broadcast(table), F.col(key) == F.col("__k"), "left").withColumn(name, F.coalesce(spread, F.lit(0))).drop("__k", "__n")


#: A table of up to so many rows is sent to every task of a join.
BROADCAST_ROWS = 200_000


def skew_join(left: DataFrame, right: DataFrame, key: str, by: list[str], rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``left`` with the columns of ``right`` (``rows`` rows, one or more for a ``key``), where it has the key; null matches null.

    A small ``right`` is broadcast. A larger one is joined by (key, salt): a heavy key's rows on the left are
    spread by a hash of ``by``, and its rows on the right go to each of those pieces. The key's column of the left stays.
    """
    other = right.withColumnRenamed(key, "__key")
    if rows <= limit:
        return left.join(F.broadcast(other), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    pieces = key_stats(left, key).pieces
    salted = with_salt(left, key, by, pieces, "__salt")
    if pieces:
        table = left.sparkSession.createDataFrame(list(pieces.items()), f"__k {left.schema[key].dataType.simpleString()}, __n int")
        other = other.join(F.broadcast(table), F.col("__key") == F.col("__k"), "left").drop("__k")
        other = other.withColumn("__s", F.explode(F.sequence(F.lit(0), F.coalesce("__n", F.lit(1)) - 1))).drop("__n")
    else:
        other = other.withColumn("__s", F.lit(0))
    return salted.join(other, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__s")), "left").drop("__key", "__salt", "__s")


def salted_aggregate(df: DataFrame, key: str, aggs: dict[str, tuple[str, Column]], by: list[str], pieces: dict | None = None) -> DataFrame:
    """Two-stage aggregation: partial values per (key, salt), merged per key.

    ``aggs`` maps an output name to ("sum" | "count" | "min" | "max", column). One row
    per distinct key, a null key included. Nulls add nothing; a sum over nothing but
    nulls is null, a count of them 0. An empty table gives an empty result. Output
    columns are ``key`` and the names in ``aggs`` only, so columns of ``df`` can't clash.
    """
    unknown = {fn for fn, _ in aggs.values()} - _MERGE.keys()
    if unknown:
        raise ValueError(f"not mergeable: {sorted(unknown)}")
    values = [c.alias(f"__v{i}") for i, (_, c) in enumerate(aggs.values())]
    rows = df.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], *values)
    pieces = key_stats(df, key).pieces if pieces is None else pieces
    rows = with_salt(rows, "__key", [f"__by{i}" for i in range(len(by))], pieces, "__salt")
    partial = rows.groupBy("__key", "__salt").agg(*[_PARTIAL[fn](f"__v{i}").alias(f"__p{i}") for i, (fn, _) in enumerate(aggs.values())])
    merged = partial.groupBy("__key").agg(*[_MERGE[fn](f"__p{i}").alias(name) for i, (name, (fn, _)) in enumerate(aggs.items())])
    return merged.withColumnRenamed("__key", key)


def current_rows(tree: DataFrame, values: list[str], stats: KeyStats | None = None) -> DataFrame:
    """The current row of each (``parent``, ``child``): the one loaded last.

    Returns ``parent, salt, child`` and ``values``. Rows without parent or child are
    left out; a null ``loaded_at`` is older than any other; rows of the same latest
    time count once. The table is partitioned by (parent, salt) after its one shuffle
    and stays so for partial results per salt: a parent of any size is spread evenly.
    """
    when = F.coalesce(F.unix_micros("loaded_at"), F.lit(-(2**63)))
    rows = tree.where(F.col("parent").isNotNull() & F.col("child").isNotNull())
    stats = key_stats(rows, "parent") if stats is None else stats
    rows = with_salt(rows.select("parent", "child", *values, when.alias("__at")), "parent", ["child"], stats.pieces)
    return rows.repartition("parent", "salt").groupBy("parent", "salt", "child").agg(*[F.max_by(v, "__at").alias(v) for v in values])


def parent_totals(tree: DataFrame) -> DataFrame:
    """Per parent of a condensed tree: children, total of ``child_size``, stated size.

    ``parent, children, total, stated, differs``: ``stated`` is the ``child_size`` where
    the parent is itself a ``child`` of a current row (null if it is nowhere), one row
    per distinct stated size; ``differs`` tells whether it isn't the total (null if
    nothing is stated). A null ``child_size`` adds nothing, so that a parent of nothing
    but nulls has the total 0. Two stages: partial sums per (parent, salt), where only
    heavy parents have more than one salt, then one merge per parent.
    """
    stats = key_stats(tree.where("child IS NOT NULL"), "parent")
    current = current_rows(tree, ["child_size"], stats)
    partial = current.groupBy("parent", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("child_size").alias("s"))
    totals = partial.groupBy("parent").agg(F.sum("n").alias("children"), F.coalesce(F.sum("s"), F.lit(0)).alias("total"))
    # Only a child within the range of the parents can be one; in a tree whose clusters are numbered after its points few others are.
    stated = current.where(F.col("child_size").isNotNull() & F.col("child").between(F.lit(stats.low), F.lit(stats.high))).select(F.col("child").alias("parent"), F.col("child_size").alias("stated"))
    joined = totals.join(stated, "parent", "left")
    return joined.select("parent", "children", "total", "stated", (F.col("stated") != F.col("total")).alias("differs")).distinct()
