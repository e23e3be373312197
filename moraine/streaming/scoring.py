"""Streams of new points scored against a frozen model.

The model itself can't be updated by a stream: a fit looks at all points at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moraine.plans.predict import Predictor


def score_stream(points: DataFrame, predictor: Predictor, path: str, checkpoint: str, what: str = "labels", **trigger) -> StreamingQuery:
    """Score a stream ``id, features``; results go to Parquet at ``path``, one folder per batch.

    ``what``: "labels", "scores" or "memberships". A batch that is run again after a failure
    overwrites its own folder, so every point is scored exactly once. Rows that aren't finite
    are left out.
    """
    score: Callable[[DataFrame], DataFrame] = {"labels": predictor.labels, "scores": predictor.scores, "memberships": predictor.membership}[what]
    dim = predictor.model.dim

    def run(batch: DataFrame, number: int) -> None:
        from moraine.functions.scalar import is_finite

        rows = batch.select("id", "features").where(is_finite("features", dim))
        if not rows.isEmpty():
            score(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = points.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(points: DataFrame, when: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: rows and mean value per ``key`` and window, with a watermark for late rows.

    Works on a stream and on a table alike. ``points``: ``when, key, value``.
    """
    w = F.window(F.col(when), window)
    return points.withWatermark(when, late).groupBy(w.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")
