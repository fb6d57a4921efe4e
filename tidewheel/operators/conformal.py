"""Prediction intervals, quantiles and samples from backtest residuals.

Calibration residuals are rows (keys, fold, h, resid); everything here is order statistics
and sampling over them, grouped by key and step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.order_statistics import at_levels

KEYS = ("series_id",)
#: The least value of a sampled forecast.
SAMPLE_FLOOR = 0.1


def conformal_level(delta: float, n: int) -> float:
    """ceil(delta (n + 1)) / n with the requested number of windows; above 1 it is an error."""
    level = math.ceil(round(delta * (n + 1), 9)) / n
    if level > 1.0:
        raise ValueError(f"{n} calibration windows are too few for level {delta}")
    return level


def calibrate(residuals: DataFrame, deltas: Sequence[float] | float, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, h, level, q): the half-width per step and coverage."""
    deltas = [deltas] if isinstance(deltas, float) else list(deltas)
    levels = {f"q{k}": (conformal_level(d, n), "lower") for k, d in enumerate(deltas)}
    scores = at_levels(residuals.withColumn("_e", F.abs("resid")), "_e", levels, [*keys, "h"])
    return scores.select(*keys, "h", F.explode(F.array(*[F.struct(F.lit(d).alias("level"), F.col(f"q{k}").alias("q")) for k, d in enumerate(deltas)])).alias("l")).select(*keys, "h", "l.level", "l.q")


def intervals(point: DataFrame, calibration: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, h, level, lower, yhat, upper)."""
    out = point.join(calibration, [*keys, "h"])
    return out.select(*keys, "h", "level", (F.col("yhat") - F.col("q")).alias("lower"), "yhat", (F.col("yhat") + F.col("q")).alias("upper"))


def wide_intervals(long: DataFrame, levels: Sequence[float], keys: Sequence[str] = KEYS) -> DataFrame:
    """point_forecast, lower_XX, upper_XX with XX the truncated percentage."""
    ends = [F.max(F.when(F.col("level") == v, F.col(e))).alias(f"{e}_{int(v * 100)}") for v in levels for e in ("lower", "upper")]
    return long.groupBy(*keys, "h").agg(F.first("yhat").alias("point_forecast"), *ends)


def conformal_quantiles(point: DataFrame, residuals: DataFrame, quantiles: Sequence[float] | float, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, h, quantile, value): symmetric around the forecast; a single quantile takes the
    higher order statistic, a list the lower."""
    method = "higher" if isinstance(quantiles, float) else "lower"
    quantiles = [quantiles] if isinstance(quantiles, float) else list(quantiles)
    sided = {q: conformal_level(abs(1.0 - 2.0 * q), n) for q in quantiles if q != 0.5}
    levels = {f"q{k}": (v, method) for k, v in enumerate(sided.values())} or {"q0": (0.0, method)}
    scores = at_levels(residuals.withColumn("_e", F.abs("resid")), "_e", levels, [*keys, "h"])
    at = {q: (-1.0 if q < 0.5 else 1.0) * F.col(f"q{k}") for k, q in enumerate(sided)}
    rows = F.array(*[F.struct(F.lit(q).alias("quantile"), (F.col("yhat") + at.get(q, F.lit(0.0))).alias("value")) for q in quantiles])
    return point.join(scores, [*keys, "h"]).select(*keys, "h", F.explode(rows).alias("r")).select(*keys, "h", "r.quantile", "r.value")


def residual_distribution(point: DataFrame, residuals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, h, fold, value): the forecast plus every calibration residual, floored."""
    return point.join(residuals.select(*keys, "h", "fold", "resid"), [*keys, "h"]).select(*keys, "h", "fold", F.greatest(F.lit(SAMPLE_FLOOR), F.col("yhat") + F.col("resid")).alias("value"))


def hashed(seed: int, *parts: Column | str) -> Column:
    """md5 of the seed and ``parts``, 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def uniform(digest: Column, at: int) -> Column:
    """Between 0 and 1: eight hex digits from place ``at``."""
    return (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(seed: int, *parts: Column | str) -> Column:
    """A standard normal number that depends on nothing but the seed and ``parts``, by Box and Muller's formula."""
    digest = hashed(seed, *parts)
    return F.sqrt(-2.0 * F.ln(uniform(digest, 1))) * F.cos(2.0 * F.pi() * uniform(digest, 9))


def bootstrap(point: DataFrame, residuals: DataFrame, samples: int = 1000, kind: str = "empirical", seed: int = 42, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, h, sample_id, value): residuals drawn with replacement, for ``kde`` smoothed by a
    normal of Scott's bandwidth.  Draws are hashed from seed, key, step and sample, so any
    partitioning gives the same samples."""
    if kind not in ("empirical", "kde"):
        raise ValueError(f"unknown bootstrap: {kind}")
    held = residuals.groupBy(*keys, "h").agg(F.array_sort(F.collect_list("resid")).alias("r"), F.stddev_samp("resid").alias("sd"))
    drawn = point.join(held, [*keys, "h"]).withColumn("sample_id", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    pick = uniform(hashed(seed, F.lit("pick"), *keys, "h", "sample_id"), 1)
    value = F.col("yhat") + F.element_at("r", (F.floor(pick * F.size("r")) + 1).cast("int"))
    if kind == "kde":
        noise = normal(seed, F.lit("noise"), *keys, "h", "sample_id")
        value = value + noise * F.coalesce("sd", F.lit(0.0)) * F.pow(F.size("r").cast("double"), -0.2)
    return drawn.select(*keys, "h", "sample_id", F.greatest(F.lit(SAMPLE_FLOOR), value).alias("value"))


def cholesky(a: Column, size: int) -> Column:
    """Columns of the lower triangular root of a flat covariance matrix; a step that is a combination of the
    earlier ones has a column of zeros."""
    numbers = F.sequence(F.lit(0), F.lit(size - 1))

    def step(s: Column, k: Column) -> Column:
        pivot = F.get(s["a"], k * size + k)
        column = F.transform(numbers, lambda i: F.when((i < k) | (pivot <= 1e-10 * F.get(s["own"], k)), 0.0).otherwise(F.get(s["a"], i * size + k) / F.sqrt(pivot)))
        # the column is worked out once, then taken off what is left
        rest = lambda c: F.transform(s["a"], lambda x, at: x - F.get(c, F.floor(at / size).cast("int")) * F.get(c, F.pmod(at, F.lit(size))))
        return F.transform(F.array(column), lambda c: F.struct(rest(c).alias("a"), s["own"].alias("own"), F.concat(s["l"], F.array(c)).alias("l")))[0]

    own = F.transform(numbers, lambda k: F.get(a, k * size + k))
    start = F.struct(a.alias("a"), own.alias("own"), F.array().cast("array<array<double>>").alias("l"))
    return F.aggregate(numbers, start, step, lambda s: s["l"])


def correlated_paths(point: DataFrame, residuals: DataFrame, samples: int = 1000, seed: int = 42, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, sample_id, h, value): normal paths with the residuals' mean and covariance across steps (1 to the
    longest forecast; folds that lack a step are left out).

    Covariances are one aggregation, their root a fold over an array, and every normal number is
    hashed from seed, key, sample and step: any partitioning gives the same paths."""
    size = point.agg(F.max("h")).first()[0]
    if size is None:
        return point.select(*keys, F.lit(0).alias("sample_id"), "h", F.col("yhat").alias("value"))
    steps = range(size)
    folds = residuals.groupBy(*keys, "fold").agg(*[F.max(F.when(F.col("h") == k + 1, F.col("resid"))).alias(f"_e{k}") for k in steps]).dropna(subset=[f"_e{k}" for k in steps])
    pairs = {(i, j): F.coalesce(F.covar_samp(f"_e{i}", f"_e{j}"), F.lit(0.0)) for i in steps for j in range(i, size)}
    moments = folds.groupBy(*keys).agg(F.array(*[F.avg(f"_e{k}") for k in steps]).alias("_mean"), F.array(*[pairs[min(i, j), max(i, j)] for i in steps for j in steps]).alias("_cov"))
    rooted = moments.withColumn("_root", cholesky(F.col("_cov"), size)).drop("_cov")
    drawn = rooted.withColumn("sample_id", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("_z", F.array(*[normal(seed, *keys, "sample_id", F.lit(k + 1)) for k in steps]))
    moved = F.zip_with("_root", "_z", lambda column, z: F.transform(column, lambda v: v * z))
    shift = F.aggregate(moved, F.col("_mean"), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    paths = drawn.select(*keys, "sample_id", F.posexplode(shift).alias("_p", "_e"))
    ahead = point.select(*keys, (F.col("h") - 1).alias("_p"), "h", "yhat")
    return paths.join(ahead, [*keys, "_p"]).select(*keys, "sample_id", F.col("h").cast("int").alias("h"), (F.col("yhat") + F.col("_e")).alias("value"))


def sample_quantiles(drawn: DataFrame, quantiles: Sequence[float] | float, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, h, quantile, value) of samples at level ceil(q (n + 1)) / n."""
    method = "higher" if isinstance(quantiles, float) else "lower"
    quantiles = [quantiles] if isinstance(quantiles, float) else list(quantiles)
    wide = at_levels(drawn, "value", {f"q{k}": (conformal_level(q, n), method) for k, q in enumerate(quantiles)}, [*keys, "h"])
    rows = F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(f"q{k}").alias("value")) for k, q in enumerate(quantiles)])
    return wide.select(*keys, "h", F.explode(rows).alias("r")).select(*keys, "h", "r.quantile", "r.value")


def sample_frame(drawn: DataFrame, horizon: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Wide samples: one row per sample, columns h_1 .. h_H."""
    return drawn.groupBy(*keys, "sample_id").agg(*[F.max(F.when(F.col("h") == k, F.col("value"))).alias(f"h_{k}") for k in range(1, horizon + 1)])


def aggregate_series(rows: DataFrame, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Sum forecasts, actuals or residuals over the members of a group of series."""
    return rows.groupBy(*by).agg(*[F.sum(v).alias(v) for v in values])


def aggregate_conformal(backtest: DataFrame, point: DataFrame, deltas: Sequence[float], n: int, metric: str = "mae", by: Sequence[str] = (), group: Column | None = None) -> DataFrame:
    """Intervals of summed forecasts: series are summed first, then scored.

    ``metric``: mae gives yhat -+ q, mape yhat / (1 +- q), smape yhat (2 -+ q) / (2 +- q)."""
    group = F.lit("all") if group is None else group
    base = backtest.withColumn("_g", group).groupBy("_g", *by, "fold", "h").agg(F.sum("y").alias("y"), F.sum("yhat").alias("yhat"))
    error = F.abs(F.col("y") - F.col("yhat"))
    score = {"mae": error, "mape": F.try_divide(error, F.abs("y")), "smape": F.try_divide(2.0 * error, F.abs("y") + F.abs("yhat"))}[metric]
    total = point.withColumn("_g", group).groupBy("_g", *by, "h").agg(F.sum("yhat").alias("yhat"))
    q = calibrate(base.withColumn("resid", score), list(deltas), n, ["_g", *by])
    y, w = F.col("yhat"), F.col("q")
    low, high = {
        "mae": (y - w, y + w),
        "mape": (F.try_divide(y, 1.0 + w), F.when(w < 1.0, y / (1.0 - w))),
        "smape": (y * (2.0 - w) / (2.0 + w), F.when(w < 2.0, y * (2.0 + w) / (2.0 - w))),
    }[metric]
    return total.join(q, ["_g", *by, "h"]).select(F.col("_g").alias("group"), *by, "h", "level", low.alias("lower"), "yhat", high.alias("upper"))
