"""Local regression and seasonal-trend decomposition as weighted frames.

On equally spaced steps the tricube weights around a step, and with them the local line's value there,
depend on nothing but the step's distance to the ends.  So a smoothed value is a fixed combination of its
neighbours: every value is spread to the steps it counts for, times a coefficient, and summed there.
Inside a series one set of coefficients serves all steps; the ends have a small table of their own.
A series lies in as many tasks as the sums' keys are dealt to.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.sources.shared import cut

KEYS = ("series_id",)


def coefficients(p: int, n: int, span: int) -> tuple[int, np.ndarray]:
    """(first step, coefficients) of the local line's value at step ``p`` of 0 .. n - 1 (or beyond)."""
    q = min(span, n)
    begin = int(min(max(0, math.ceil(p - q / 2)), n - q))
    x = np.arange(begin, begin + q, dtype=float) - p
    reach = max(np.abs(x).max(), 1e-12) * (1.0 if span <= n else span / n) * 1.0000001
    w = (1.0 - (np.abs(x) / reach) ** 3) ** 3
    mean = (w @ x) / w.sum()
    spread = w @ (x - mean) ** 2
    return begin, w / w.sum() - (mean * w * (x - mean) / spread if spread > 1e-12 else 0.0)


def loess(df: DataFrame, span: int, y: str = "y", name: str = "smooth", keys: Sequence[str] = KEYS, t: str = "t", extend: int = 0) -> DataFrame:
    """(keys, t, name): smoothed values of dense steps ``t`` from 0, and of ``extend`` steps before and after."""
    spark = df.sparkSession
    base = df.select(*keys, F.col(t).cast("long").alias("_j"), F.col(y).cast("double").alias("_y"), F.count("*").over(W.partitionBy(*keys)).alias("_n"))
    far = 4 * span + 2 * extend  # an inner step of a series so long has neither end in reach
    begin, inner = coefficients(far // 2, far, span)
    left = [p for p in range(-extend, span) if math.ceil(p - span / 2) < 0]
    right = [r for r in range(-extend, span) if math.ceil(far - 1 - r - span / 2) > far - span]
    long_ = base.where(F.col("_n") >= span)
    moves = ", ".join(f"named_struct('d', {far // 2 - begin - k}L, 'c', {float(c)!r}D)" for k, c in enumerate(inner))
    spread = long_.withColumn("_m", F.expr(f"explode(array({moves}))")).withColumn("_p", F.col("_j") + F.col("_m.d"))
    inside = spread.where((F.col("_p") > (max(left) if left else -1)) & (F.col("_p") < F.col("_n") - 1 - (max(right) if right else -1)))
    parts = [inside.select(*keys, "_p", (F.col("_m.c") * F.col("_y")).alias("_v"))]
    rows = [(0, b + k, p, float(c)) for p in left for b, cs in [coefficients(p, far, span)] for k, c in enumerate(cs)]
    rows += [(1, far - 1 - b - k, r, float(c)) for r in right for b, cs in [coefficients(far - 1 - r, far, span)] for k, c in enumerate(cs)]
    if rows:
        ends = F.broadcast(spark.createDataFrame(rows, "_side int, _k long, _e long, _c double"))  # at most span * span rows a side
        near = long_.withColumn("_s", F.explode(F.array(F.struct(F.lit(0).alias("_side"), F.col("_j").alias("_k")), F.struct(F.lit(1).alias("_side"), (F.col("_n") - 1 - F.col("_j")).alias("_k"))))).where(F.col("_s._k") < span)
        met = near.select(*keys, "_n", "_y", "_s.*").join(ends, ["_side", "_k"])
        parts.append(met.select(*keys, F.when(F.col("_side") == 0, F.col("_e")).otherwise(F.col("_n") - 1 - F.col("_e")).alias("_p"), (F.col("_c") * F.col("_y")).alias("_v")))
    short = [r["_n"] for r in base.where(F.col("_n") < span).select("_n").distinct().collect()]  # fewer than span lengths
    if short:
        rows = [(n, b + k, p, float(c)) for n in short for p in range(-extend, n + extend) for b, cs in [coefficients(p, n, span)] for k, c in enumerate(cs)]
        table = spark.createDataFrame(rows, "_n long, _j long, _p long, _c double")
        parts.append(base.where(F.col("_n") < span).join(table, ["_n", "_j"]).select(*keys, "_p", (F.col("_c") * F.col("_y")).alias("_v")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*keys, F.col("_p").alias(t)).agg(F.sum("_v").alias(name))


def decompose(panel: DataFrame, period: int, seasonal: int = 7, trend: int | None = None, inner: int = 2, y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t, y, trend, seasonal, remainder) of every series of at least two periods and no missing value, on
    dense steps: cycles of each phase smoothed, their slow part taken out again, the rest smoothed for the trend."""
    width = trend or int(math.ceil(1.5 * period / (1.0 - 1.5 / seasonal)))
    width += 1 - width % 2
    low = period + 1 - period % 2
    whole = W.partitionBy(*keys)
    rows = panel.select(*keys, F.col("t").cast("long").alias("t"), F.col(y).cast("double").alias("y"))
    rows = rows.withColumns({"_n": F.count("*").over(whole), "_k": F.count("y").over(whole)}).where((F.col("_n") >= 2 * period) & (F.col("_n") == F.col("_k"))).drop("_n", "_k")
    rows = cut(rows.withColumn("level", F.lit(0.0)))
    for _ in range(inner):
        phases = rows.select(*keys, F.pmod("t", F.lit(period)).alias("phase"), F.floor(F.col("t") / period).alias("t"), (F.col("y") - F.col("level")).alias("v"))
        cycle = loess(phases, seasonal, "v", "c", [*keys, "phase"], "t", 1)
        cycle = cut(cycle.select(*keys, (F.col("phase") + (F.col("t") + 1) * period).alias("t"), "c"))
        flat = cycle
        for w in (period, period, 3):  # means of full frames only
            frame = W.partitionBy(*keys).orderBy("t").rowsBetween(0, w - 1)
            flat = flat.withColumns({"c": F.avg("c").over(frame), "_f": F.count("*").over(frame)}).where(F.col("_f") == w).drop("_f")
        low_pass = loess(flat, low, "c", "flat", keys)
        season = cycle.select(*keys, (F.col("t") - period).alias("t"), "c").join(low_pass, [*keys, "t"]).select(*keys, "t", (F.col("c") - F.col("flat")).alias("season"))
        held = cut(rows.drop("level", "season").join(season, [*keys, "t"]))
        level = loess(held.withColumn("v", F.col("y") - F.col("season")), width, "v", "level", keys)
        rows = cut(held.join(level, [*keys, "t"]))
    return rows.select(*keys, F.col("t").cast("int").alias("t"), "y", F.col("level").alias("trend"), F.col("season").alias("seasonal"), (F.col("y") - F.col("season") - F.col("level")).alias("remainder"))


def strengths(panel: DataFrame, period: int, keys: Sequence[str] = KEYS, **how) -> DataFrame:
    """(keys, trend_strength, seasonality_strength), clamped at 0."""
    rows = decompose(panel, period, keys=keys, **how)
    part = lambda c: F.greatest(F.lit(0.0), 1.0 - F.var_pop("remainder") / F.greatest(F.var_pop(F.col("remainder") + F.col(c)), F.lit(1e-300)))
    return rows.groupBy(*keys).agg(part("trend").alias("trend_strength"), part("seasonal").alias("seasonality_strength"))
