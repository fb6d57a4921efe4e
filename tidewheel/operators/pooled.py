"""One model for a whole panel with ``pyspark.ml``: trained on all series' rows at once and
rolled forward a step at a time over every series together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.lagfeatures import add_lags, normal_lags


def estimator(kind: str, **params):
    """linear, ridge, lasso, elastic_net, forest or boosting by name."""
    from pyspark.ml import regression as R

    penalties = {"linear": {}, "ridge": {"elasticNetParam": 0.0, "regParam": 0.1}, "lasso": {"elasticNetParam": 1.0, "regParam": 0.1}, "elastic_net": {"elasticNetParam": 0.5, "regParam": 0.1}}
    if kind in penalties:
        return R.LinearRegression(**(penalties[kind] | params))
    return {"forest": R.RandomForestRegressor, "boosting": R.GBTRegressor, "tree": R.DecisionTreeRegressor}[kind](**params)


def fit(panel: DataFrame, lags: int | Sequence[int], kind: str = "linear", exog: Sequence[str] = (), keys: Sequence[str] = ("series_id",), **params) -> PipelineModel:
    lags = normal_lags(lags)
    names = [*exog, *[f"y_lag_{k}" for k in lags]]
    rows = add_lags(panel, lags, keys=keys).dropna(subset=[*names, "y"])
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", F.col("y").alias("label"))
    return PipelineModel([VectorAssembler(inputCols=names, outputCol="features"), estimator(kind, **params).fit(assembled)])


def forecast(model: PipelineModel, panel: DataFrame, lags: int | Sequence[int], horizon: int, future: DataFrame | None = None, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """(keys, h, yhat): each step scores all series in one projection; the newest-first
    history travels in an array, so no step shuffles."""
    lags = normal_lags(lags)
    recent = panel.groupBy(*keys).agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("t", "y")), asc=False), 1, max(lags)), lambda s: s["y"]).alias("past"))
    if future is not None:
        ahead = [c for c in future.columns if c not in (*keys, "h")]
        recent = recent.join(future.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("h", *ahead))).alias("ahead")), list(keys))
    state = recent.withColumn("out", F.array().cast("array<double>"))
    for h in range(horizon):
        step = state.withColumns({f"y_lag_{k}": F.col("past")[k - 1] for k in lags})
        if future is not None:
            step = step.withColumns({c: F.col("ahead")[h][c] for c in ahead})
        scored = model.transform(step)
        kept = [*keys, *(["ahead"] if future is not None else [])]
        state = scored.select(*kept, F.concat(F.array("prediction"), "past").alias("past"), F.concat("out", F.array("prediction")).alias("out"))
    return state.select(*keys, F.posexplode("out").alias("p", "yhat")).select(*keys, (F.col("p") + 1).alias("h"), "yhat")
