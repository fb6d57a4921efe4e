"""AR forecasting entirely inside Catalyst: fit by aggregates, recurse by array fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.lagfeatures import add_lags, normal_lags
from tidewheel.operators.trend import fit_design

KEYS = ("series_id",)


def fit_ar1(panel: DataFrame, y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """slope, intercept, last value, n and residual sum of squares per series."""
    lagged = add_lags(panel, 1, y, keys=keys)
    x = F.col(f"{y}_lag_1")
    fit = lagged.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.max_by(y, "t").alias("last"), F.regr_count(y, x).alias("n"),
        (F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), 2) / F.regr_sxx(y, x)).alias("rss"),
    )
    return fit


def fit_ar(panel: DataFrame, lags: int | Sequence[int], y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """Any lags: coef (intercept first), n, rss and the history the recursion starts from."""
    lags = normal_lags(lags)
    model = fit_design(add_lags(panel, lags, y, keys=keys), [F.col(f"{y}_lag_{k}") for k in lags], y, keys)
    recent = panel.groupBy(*keys).agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("t", F.col(y).alias("v"))), asc=False), 1, max(lags)), lambda s: s["v"]).alias("recent"))
    return model.join(recent, list(keys))


def recurse_ar1(model: DataFrame, horizon: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, h, yhat) by folding over the horizon."""
    step = lambda acc, _: F.concat(acc, F.array(F.col("intercept") + F.col("slope") * F.element_at(acc, -1)))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.array("last"), step)
    return model.select(*keys, F.posexplode(path).alias("h", "yhat")).where("h > 0")


def recurse_ar(model: DataFrame, lags: int | Sequence[int], horizon: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """As above for any lags; the state is the newest-first history."""
    lags = normal_lags(lags)

    def step(acc: Column, _: Column) -> Column:
        value = F.col("coef")[0]
        for k, lag in enumerate(lags):
            value = value + F.col("coef")[k + 1] * acc[lag - 1]
        return F.concat(F.array(value), acc)

    path = F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("recent"), step), 1, horizon)
    return model.select(*keys, F.posexplode(F.reverse(path)).alias("p", "yhat")).select(*keys, (F.col("p") + 1).alias("h"), "yhat")


def information_criteria(model: DataFrame, parameters: int) -> DataFrame:
    """aic, aicc, bic, hqc from n and rss; linear models count two more than their features."""
    k, n = float(parameters), F.col("n").cast("double")
    base = n * F.ln(F.col("rss") / n)
    return model.withColumns({
        "aic": base + 2 * k, "aicc": base + 2 * k + 2 * k * (k + 1) / (n - k - 1), "bic": base + k * F.ln(n), "hqc": base + 2 * k * F.ln(F.ln(n)),
    })


def naive(panel: DataFrame, horizon: int, season: int = 1, y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """Last value or last season repeated; NULL where the series is shorter than a season."""
    last = panel.groupBy(*keys).agg(F.max("t").alias("n"))
    steps = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("t", F.col("n") - season + 1 + F.pmod(F.col("h") - 1, F.lit(season)))
    return steps.join(panel.select(*keys, "t", F.col(y).alias("yhat")), [*keys, "t"], "left").select(*keys, "h", "yhat")
