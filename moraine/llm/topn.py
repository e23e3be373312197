"""The N best items of every group, by secondary sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.operators.skew import current_rows, key_stats, with_salt


def _first_n(n: int, keys: list[str]):
    """A stream function over batches sorted by ``keys``: passes the first ``n`` rows of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0  # the run that the batch before ended in, and its rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.ones(batch.num_rows, bool)
            new[1:] = False
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            goes_on = last is not None and all(c[0] == x for c, x in zip(cols, last))
            starts = np.flatnonzero(new)
            rank = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
            if goes_on:
                rank[: starts[1] if len(starts) > 1 else len(rank)] += seen
            last, seen = [c[-1] for c in cols], int(rank[-1]) + 1
            keep = rank < n
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def top_n(df: DataFrame, group: str, score: str, item: str, n: int, salted: bool = False) -> DataFrame:
    """The ``n`` rows of every ``group`` with the highest ``score``, ties by lowest ``item``.

    Secondary sort: hash-partition by group, sort within the partitions by (group,
    score descending, item), stream the Arrow batches and pass the first ``n`` rows of
    each run of a group; no group is ever held. Groups with a large share of all rows
    are first cut to ``n`` rows per (group, salt), with the salt from the item. With
    ``salted`` the table has a column ``salt`` and is already partitioned by (group,
    salt). Rows whose group or item is null, or whose score is null or NaN, have no
    rank and are left out; +Infinity ranks highest, -0.0 as 0.0. Equal rows count as
    often as they occur. Returns ``group, item, score`` only; ``group`` and ``item`` are
    integers. Fewer than ``n`` rows if there are fewer; an empty table gives none.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    value = F.col(score).cast("double")
    ok = df.where(F.col(group).isNotNull() & F.col(item).isNotNull() & value.isNotNull() & ~F.isnan(value))
    row = [F.col(group).cast("long").alias("g"), F.col(item).cast("long").alias("i"), (value + F.lit(0.0)).alias("s")]
    schema = "g long, i long, s double"
    pieces = {} if salted else key_stats(ok.select(F.col(group).cast("long").alias("g")), "g").pieces
    rows = ok.select(*row, *([F.col("salt").cast("int").alias("t")] if salted else []))
    if pieces:
        rows = with_salt(rows, "g", ["i"], pieces, "t").repartition("g", "t")
    if salted or pieces:
        part = rows.select("g", "i", "s", "t").sortWithinPartitions("g", "t", F.desc("s"), "i")
        rows = part.mapInArrow(_first_n(n, ["g", "t"]), schema + ", t int").select("g", "i", "s")
    best = rows.repartition("g").sortWithinPartitions("g", F.desc("s"), "i").mapInArrow(_first_n(n, ["g"]), schema)
    return best.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score))


def top_children(tree: DataFrame, n: int = 5) -> DataFrame:
    """Per parent of a condensed tree, its ``n`` current child rows of highest ``lambda_val``.

    ``parent, child, lambda_val``. The current row of (parent, child) is found first;
    where its ``lambda_val`` is null or NaN, the pair is left out, also if an older
    version had a value. One shuffle by (parent, salt) serves finding the current rows
    and the first cut; only up to ``n`` rows per (parent, salt) move again.
    """
    return top_n(current_rows(tree, ["lambda_val"]), "parent", "lambda_val", "child", n, salted=True)
