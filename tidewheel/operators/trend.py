"""Trend fits as aggregates: closed form for a line, normal equations for any design."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("series_id",)


def trend_columns(t: str | Column = "t", degree: int | Sequence[int] = 1, breaks: Sequence[float] | None = None) -> list[Column]:
    t = (F.col(t) if isinstance(t, str) else t).cast("double")
    if breaks is not None:
        return [t, *(F.greatest(F.lit(0.0), t - float(b)) for b in breaks)]
    return [F.pow(t, float(p)) for p in (range(1, degree + 1) if isinstance(degree, int) else degree)]


def fit_line(panel: DataFrame, y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    t = F.col("t").cast("double")
    return panel.groupBy(*keys).agg(F.regr_slope(y, t).alias("slope"), F.regr_intercept(y, t).alias("intercept"), F.max("t").alias("last_t"))


def fit_design(df: DataFrame, columns: Sequence[Column], y: str | Column = "y", keys: Sequence[str] = KEYS, ridge: float = 0.0) -> DataFrame:
    """Least squares with intercept of any per-row design: one pass sums the Gram matrix
    (numbers bounded by the design's width), a grouped function solves it.  Output: keys,
    coef (intercept first), n, rss."""
    p = len(columns) + 1
    target = (F.col(y) if isinstance(y, str) else y).cast("double")
    terms = [F.lit(1.0), *[c.cast("double") for c in columns], target]
    base = df.select(*keys, *[c.alias(f"_x{k}") for k, c in enumerate(terms)]).dropna(subset=[f"_x{k}" for k in range(p + 1)])
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = base.groupBy(*keys).agg(F.array(*[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i, j in pairs]).alias("g"))

    @F.pandas_udf("coef array<double>, n long, rss double")
    def solve(grams: pd.Series) -> pd.DataFrame:
        rows = []
        for g in grams:
            full = np.zeros((p + 1, p + 1))
            for (i, j), v in zip(pairs, g):
                full[i, j] = full[j, i] = v
            scale = np.sqrt(np.maximum(np.diag(full)[:p], 1e-300))
            a = full[:p, :p] / np.outer(scale, scale) + ridge * np.eye(p)
            coef = np.linalg.lstsq(a, full[:p, p] / scale, rcond=1e-13)[0] / scale
            rows.append((coef.tolist(), int(full[0, 0]), float(full[p, p] - 2 * coef @ full[:p, p] + coef @ full[:p, :p] @ coef)))
        return pd.DataFrame(rows, columns=["coef", "n", "rss"])

    return sums.select(*keys, solve("g").alias("m")).select(*keys, "m.*")


def fit_trend(panel: DataFrame, degree: int | Sequence[int] = 1, breaks: Sequence[float] | None = None, y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    last = panel.groupBy(*keys).agg(F.max("t").alias("last_t"))
    return fit_design(panel, trend_columns("t", degree, breaks), y, keys).join(last, list(keys))


def trend_value(t: str | Column = "t", degree: int | Sequence[int] = 1, breaks: Sequence[float] | None = None, coef: str = "coef") -> Column:
    out = F.col(coef)[0]
    for k, c in enumerate(trend_columns(t, degree, breaks)):
        out = out + F.col(coef)[k + 1] * c
    return out


def forecast_trend(model: DataFrame, horizon: int, degree: int | Sequence[int] = 1, breaks: Sequence[float] | None = None) -> DataFrame:
    """(keys, h, t, trend) for the steps after each series."""
    out = model.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("t", F.col("last_t") + F.col("h"))
    return out.withColumn("trend", trend_value("t", degree, breaks)).drop("coef", "n", "rss", "last_t")


def detrend(panel: DataFrame, model: DataFrame, degree: int | Sequence[int] = 1, breaks: Sequence[float] | None = None, y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    out = panel.join(model.select(*keys, "coef"), list(keys))
    return out.withColumn("trend", trend_value("t", degree, breaks)).withColumn(y, F.col(y) - F.col("trend")).drop("coef")


def exponential_smoothing(panel: DataFrame, alpha: float, y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """Simple smoothing with a fixed factor, level by level, as one array fold per series."""
    packed = panel.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", F.col(y).alias("y")))).alias("s"))
    first = F.struct(F.col("s")[0]["y"].alias("level"), F.array(F.col("s")[0]["y"]).alias("out"))
    step = lambda acc, v: F.struct((acc["level"] + alpha * (v["y"] - acc["level"])).alias("level"), F.concat(acc["out"], F.array(acc["level"] + alpha * (v["y"] - acc["level"]))).alias("out"))
    rest = F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0)))
    folded = packed.select(*keys, F.aggregate(rest, first, step)["out"].alias("levels"))
    return folded.select(*keys, F.posexplode("levels").alias("t", "level"))
