"""Accuracy metrics as aggregate Columns over (y, yhat), some scaled by the training series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_E = lambda y, p: F.col(y) - F.col(p)


def _mape(y, p, s):
    return F.avg(F.abs(F.try_divide(_E(y, p), F.col(y))))


def _mse(y, p, s):
    return F.avg(_E(y, p) * _E(y, p))


def _mae(y, p, s):
    return F.avg(F.abs(_E(y, p)))


def _smape(y, p, s):
    return F.avg(F.try_divide(2.0 * F.abs(_E(y, p)), F.abs(F.col(y)) + F.abs(F.col(p)))) * 100.0


#: name -> (aggregate builder, needs the training series).  Zero denominators give NULL.
METRICS = {
    "MAPE": (_mape, False),
    "MAE": (_mae, False),
    "MSE": (_mse, False),
    "RMSE": (lambda y, p, s: F.sqrt(_mse(y, p, s)), False),
    "SMAPE": (_smape, False),
    "CFE": (lambda y, p, s: F.sum(_E(y, p)), False),
    "CFE_ABS": (lambda y, p, s: F.abs(F.sum(_E(y, p))), False),
    "WMAPE": (lambda y, p, s: F.try_divide(F.sum(F.abs(_E(y, p))), F.sum(F.col(y))), False),
    "SMAE": (lambda y, p, s: F.try_divide(_mae(y, p, s), F.first(s["mean"])) * 100.0, True),
    "SRMSE": (lambda y, p, s: F.try_divide(F.sqrt(_mse(y, p, s)), F.first(s["mean"])), True),
    "RMSSE": (lambda y, p, s: F.sqrt(F.try_divide(_mse(y, p, s), F.first(s["sq"]))), True),
    "MASE": (lambda y, p, s: F.try_divide(_mae(y, p, s), F.first(s["abs"])), True),
    "MedianASE": (lambda y, p, s: F.try_divide(F.median(F.abs(_E(y, p))), F.first(s["med"])), True),
}
SCALE = {"mean": "train_mean", "abs": "train_abs_diff", "sq": "train_sq_diff", "med": "train_med_diff"}


def metric(name: str, y: str = "y", yhat: str = "yhat", decimals: int | None = None) -> Column:
    """The aggregate Column; ``decimals`` rounds half to even, as the two-place MAPE does."""
    value = METRICS[name][0](y, yhat, SCALE)
    return value if decimals is None else F.bround(value, decimals)


def train_scale(train: DataFrame, keys: Sequence[str] = ("series_id",), y: str = "y") -> DataFrame:
    """Per key: mean, and mean / mean-square / median of first differences of the training series."""
    d = F.col(y) - F.lag(y, 1).over(W.partitionBy(*keys).orderBy("t"))
    return train.withColumn("_d", d).groupBy(*keys).agg(F.avg(y).alias(SCALE["mean"]), F.avg(F.abs("_d")).alias(SCALE["abs"]), F.avg(F.col("_d") * F.col("_d")).alias(SCALE["sq"]), F.median(F.abs("_d")).alias(SCALE["med"]))


def evaluate(scored: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("series_id",), split: int | None = None, h: str = "h") -> DataFrame:
    """(by, y, yhat[, train scale]) -> one row per key and metric: eval_metric, score and, with
    ``split``, score_before_k (h <= k) and score_after_k."""
    parts = [("score", scored)]
    if split is not None:
        parts += [(f"score_before_{split}", scored.where(F.col(h) <= split)), (f"score_after_{split}", scored.where(F.col(h) > split))]
    out = None
    for name, rows in parts:
        wide = rows.groupBy(*by).agg(*[metric(m).alias(m) for m in metrics])
        long = wide.unpivot(list(by), list(metrics), "eval_metric", name)
        out = long if out is None else out.join(long, [*by, "eval_metric"], "left")
    return out
