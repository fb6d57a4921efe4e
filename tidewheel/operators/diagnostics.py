"""Time-series diagnostics: correlations as window sums, the rest per packed series."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions.numeric import NORMAL, adf, kpss, partial_autocorrelation, stl
from tidewheel.plans.forecasting import pack

KEYS = ("series_id",)


def z_value(alpha: float) -> float:
    return NORMAL.inv_cdf(1.0 - alpha / 2.0)


def cross_correlation(panel: DataFrame, lags: int, x: str = "x", y: str = "y", adjusted: bool = True, alpha: float | None = None, bartlett: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, lag, ccf[, lower, upper]): sum over t of (y_t - mean)(x_{t+k} - mean) / sqrt(Sxx Syy),
    times n / (n - k) if adjusted."""
    part, w = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("t")
    centred = panel.withColumn("_x", F.col(x) - F.avg(x).over(part)).withColumn("_y", F.col(y) - F.avg(y).over(part))
    ahead = centred.withColumns({f"_p{k}": F.col("_y") * F.lead("_x", k).over(w) for k in range(lags + 1)})
    sums = ahead.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.sum(F.col("_x") * F.col("_x")) * F.sum(F.col("_y") * F.col("_y"))).alias("s"), *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"p{k}") for k in range(lags + 1)])
    n = F.col("n").cast("double")
    scale = lambda k: n / (n - k) if adjusted and k else F.lit(1.0)
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), (F.try_divide(F.col(f"p{k}"), F.col("s")) * scale(k)).alias("ccf")) for k in range(lags + 1)])
    out = sums.select(*keys, "n", F.explode(rows).alias("r")).select(*keys, "n", "r.lag", "r.ccf")
    if alpha is not None:
        squares = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("ccf") * F.col("ccf"))).over(W.partitionBy(*keys).orderBy("lag").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        se = F.when(F.col("lag") == 0, 0.0).otherwise(F.sqrt((1.0 + 2.0 * squares) / F.col("n"))) if bartlett else 1.0 / F.sqrt("n")
        out = out.withColumn("lower", F.col("ccf") - z_value(alpha) * se).withColumn("upper", F.col("ccf") + z_value(alpha) * se)
    return out.drop("n")


def autocorrelation(panel: DataFrame, lags: int, y: str = "y", keys: Sequence[str] = KEYS, **how) -> DataFrame:
    return cross_correlation(panel, lags, y, y, keys=keys, **how).withColumnRenamed("ccf", "acf")


def _exceedance(value, bound):
    """How far a correlation reaches beyond its bound, in bounds; 0 within."""
    return F.when(value > bound, (value - bound) / bound).when(value < -bound, (value + bound) / bound).otherwise(0.0)


def ccf_strength(panel: DataFrame, lags: int = 5, x: str = "x", y: str = "y", adjusted: bool = True, alpha: float = 0.05, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, lags, corr_score, ccf_value, z_bound, abs_corr_score) of significant lags beyond 0, strongest first."""
    n = panel.groupBy(*keys).agg(F.count("*").alias("n"))
    out = cross_correlation(panel, lags, x, y, adjusted, keys=keys).where("lag > 0").join(n, list(keys))
    out = out.withColumn("z_bound", z_value(alpha) / F.sqrt(F.col("n") - F.col("lag"))).withColumn("corr_score", _exceedance(F.col("ccf"), F.col("z_bound")))
    out = out.select(*keys, F.col("lag").alias("lags"), "corr_score", F.col("ccf").alias("ccf_value"), "z_bound", F.abs("corr_score").alias("abs_corr_score"))
    return out.where("abs_corr_score > 0").orderBy(*keys, F.desc("abs_corr_score"))


def _each(panel: DataFrame, y: str, keys: Sequence[str], body, schema: str) -> DataFrame:
    types = dict(panel.dtypes)
    names = [*keys, *[c.split()[0] for c in schema.split(", ")]]

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                x = np.array([np.nan if v is None else v for v in row.y], float)
                rows = [(*(getattr(row, k) for k in keys), *r) for r in body(x[~np.isnan(x)])]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return pack(panel, (y,), keys=keys).mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + schema)


def pacf(panel: DataFrame, lags: int, y: str = "y", adjusted: bool = True, alpha: float = 0.05, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, lag, pacf, bound)."""
    z = z_value(alpha)

    def body(x):
        k = min(lags, len(x) - 2)
        return [(i, float(v), z / math.sqrt(len(x))) for i, v in enumerate(partial_autocorrelation(x, k, adjusted))] if k > 0 and x.var() > 0 else []

    return _each(panel, y, keys, body, "lag int, pacf double, bound double")


def pacf_strength(panel: DataFrame, lags: int = 5, y: str = "y", adjusted: bool = True, alpha: float = 0.05, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, lags, pacf_score, pacf_value, z_bound, abs_pacf_score), strongest first, lag 0 left out."""
    n = panel.groupBy(*keys).agg(F.count("y").alias("n"))
    bound = z_value(alpha) / F.sqrt(F.col("n") - lags) if adjusted else z_value(alpha) / F.sqrt("n")
    out = pacf(panel, lags, y, adjusted, alpha, keys).drop("bound").where("lag > 0").join(n, list(keys)).withColumn("z_bound", bound)
    out = out.withColumn("pacf_score", _exceedance(F.col("pacf"), F.col("z_bound")))
    out = out.select(*keys, F.col("lag").alias("lags"), "pacf_score", F.col("pacf").alias("pacf_value"), "z_bound", F.abs("pacf_score").alias("abs_pacf_score"))
    return out.where("abs_pacf_score > 0").orderBy(*keys, F.desc("abs_pacf_score"))


def unit_root(panel: DataFrame, method: str = "ADF", lags: int | None = None, y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, method, statistic, p_value, used_lags, stationary) at the 5 % level."""
    test = {"ADF": adf, "KPSS": kpss}[method]

    def body(x):
        if len(x) < 10 or x.var() == 0:
            return []
        stat, p, k = test(x, lags)
        return [(method, float(stat), float(p), int(k), bool(p < 0.05) if method == "ADF" else bool(p >= 0.05))]

    return _each(panel, y, keys, body, "method string, statistic double, p_value double, used_lags int, stationary boolean")


def differences_needed(panel: DataFrame, method: str = "KPSS", most: int = 2, y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, ndiffs): differencing until the unit-root test is satisfied."""
    test = {"ADF": adf, "KPSS": kpss}[method]

    def body(x):
        d = 0
        while d < most and len(x) >= 12 and x.var() > 0 and (test(x)[1] < 0.05) != (method == "ADF"):
            x, d = np.diff(x), d + 1
        return [(d,)]

    return _each(panel, y, keys, body, "ndiffs int")


def strengths(panel: DataFrame, period: int, y: str = "y", keys: Sequence[str] = KEYS, **how) -> DataFrame:
    """(keys, trend_strength, seasonality_strength) from an STL decomposition, clamped at 0."""

    def body(x):
        if len(x) < 2 * period:
            return []
        level, season, rest = stl(x, period, **how)
        part = lambda c: max(0.0, 1.0 - rest.var() / max((rest + c).var(), 1e-300))
        return [(part(level), part(season))]

    return _each(panel, y, keys, body, "trend_strength double, seasonality_strength double")


def seasonal_differences_needed(panel: DataFrame, period: int, threshold: float = 0.64, y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, nsdiffs): 1 where the seasonal strength is above the threshold."""
    return strengths(panel, period, y, keys).select(*keys, F.when(F.col("seasonality_strength") > threshold, 1).otherwise(0).alias("nsdiffs"))


def decompose(panel: DataFrame, period: int, y: str = "y", keys: Sequence[str] = KEYS, **how) -> DataFrame:
    """(keys, t, trend, seasonal, remainder)."""

    def body(x):
        return [(i, *map(float, p)) for i, p in enumerate(zip(*stl(x, period, **how)))] if len(x) >= 2 * period else []

    return _each(panel, y, keys, body, "t int, trend double, seasonal double, remainder double")
