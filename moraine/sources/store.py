"""Models on disk, and the cache of what re-clustering can reuse."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, SparkSession

from moraine.functions.metrics import Metric
from moraine.plans.density import DensityClusterer, DensityModel

_SCHEMAS = {
    "points": "id long, raw long, pos long, x array<double>",
    "core": "pos long, core double",
    "mst": "a long, b long, w double",
}


def save_model(model: DensityModel, path: str) -> None:
    """Write a model as Parquet tables below ``path``, with its parameters as JSON.

    What is stored is what costs: points, core distances, spanning tree. Hierarchy and
    labels are made again in one task. Models of callable metrics can't be stored.
    """
    if model.metric is not None and model.metric.name == "pyfunc":
        raise ValueError("a model with a callable metric can't be stored")
    model.points.select("id", "raw", "pos", "x").write.mode("overwrite").parquet(f"{path}/points")
    model.core.select("pos", "core").write.mode("overwrite").parquet(f"{path}/core")
    model._mst.select("a", "b", "w").write.mode("overwrite").parquet(f"{path}/mst")
    keep = {k: v for k, v in model.params.items() if isinstance(v, (int, float, str, bool, type(None)))}
    keep = {k: ("inf" if isinstance(v, float) and math.isinf(v) else v) for k, v in keep.items()}
    metric = None
    if model.metric is not None:
        m = model.metric
        metric = {"name": m.asked, "p": m.p, "V": None if m.v is None else list(map(float, m.v)) if getattr(m.v, "ndim", 1) == 1 else m.v.tolist(), "VI": None if m.vi is None else m.vi.tolist(), "w": None if m.w is None else list(map(float, m.w))}
    meta = json.dumps({"n": model.n, "total": model.total, "dim": model.dim, "params": keep, "metric": metric})
    model.spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> DensityModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    params = {k: (math.inf if v == "inf" else v) for k, v in meta["params"].items()}
    m = meta["metric"]
    metric = None if m is None else Metric(m.pop("name"), **{k: v for k, v in m.items() if v is not None})
    t = {k: spark.read.schema(s).parquet(f"{path}/{k}") for k, s in _SCHEMAS.items()}
    return DensityModel(t["points"], meta["n"], meta["total"], t["core"], t["mst"], params, metric, meta["dim"])


def fit_cached(points: DataFrame, folder: str, key: str, **params) -> DensityModel:
    """Fit, or take the spanning tree of an earlier fit with the same ``key`` of the data, metric, alpha and ``min_samples``.

    Other parameters only select from the tree, so they may differ between calls.
    """
    spark = points.sparkSession
    wanted = DensityClusterer(**params)
    p = wanted._check()
    name = hashlib.sha256(json.dumps([key, str(p["metric"]), p["p"], p["alpha"], p["min_samples"], sorted(map(str, wanted.metric_kwargs.items()))]).encode()).hexdigest()[:24]
    path = f"{folder}/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        model = load_model(spark, path)
        return model.refit(**{k: v for k, v in p.items() if k != "min_samples" and isinstance(v, (int, float, str, bool, type(None)))})
    model = wanted.fit(points).model
    save_model(model, path)
    return model
