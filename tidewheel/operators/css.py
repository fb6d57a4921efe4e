"""ARMA orders by conditional sums of squares: a grid of parameters folded over every series.

A candidate is a row of parameters beside a series' array of (differenced, centred) values.  Its errors are
one fold over the steps whose state is the last few errors and the sum of their squares, so all orders,
parameters and series of a round are one job; the next round looks around the best
parameters of each series and order with a grid as fine as the steps of the one before.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.transforms import diff, seasonal_diff
from tidewheel.sources.shared import cut

KEYS = ("series_id",)
#: Parameters stay inside (-REACH, REACH).
REACH = 0.95


def product(first: Sequence[Column], season: Sequence[Column], m: int, sign: float) -> list[Column]:
    """Coefficients 1, 2, ... of (1 + sign * sum first_i B^i)(1 + sign * sum season_i B^(m i))."""
    left = [F.lit(1.0), *[sign * c for c in first]]
    right = {0: F.lit(1.0)} | {m * (k + 1): sign * c for k, c in enumerate(season)}
    out = []
    for k in range(1, len(first) + m * len(season) + 1):
        value = F.lit(0.0)
        for i, c in enumerate(left):
            if k - i in right:
                value = value + c * right[k - i]
        out.append(value)
    return out


def sum_of_squares(w: Column, ar: Column, ma: Column) -> Column:
    """Sum of squared errors of values ``w`` from the first step that has all its lags; ``ar`` and ``ma`` are the coefficients
    of the expanded polynomials, errors before the first step are 0."""
    p, q = F.size(ar), F.size(ma)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    def step(s: Column, t: Column) -> Column:
        past = F.reverse(F.slice(w, t - p + 1, p))
        e = F.get(w, t) + dot(ar, past) - dot(ma, s["e"])
        return F.transform(F.array(e), lambda v: F.struct(F.slice(F.concat(F.array(v), s["e"]), 1, q).alias("e"), (s["s"] + v * v).alias("s")))[0]

    start = F.struct(F.transform(ma, lambda _: F.lit(0.0)).alias("e"), F.lit(0.0).alias("s"))
    steps = F.filter(F.sequence(p, F.greatest(p, F.size(w) - 1)), lambda t: t < F.size(w))
    return F.aggregate(steps, start, step, lambda s: s["s"])


def values(panel: DataFrame, d: int = 0, D: int = 0, season: int = 1, y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, w): differenced values in order, less their mean where nothing was differenced.  A series with missing
    values is left out."""
    rows = panel.withColumn("_w", F.col(y).cast("double"))
    if d:
        rows = rows.withColumn("_w", diff("_w", d, keys))
    for _ in range(D):
        rows = rows.withColumn("_w", seasonal_diff("_w", season, keys))
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", F.col("_w").alias("v")))).alias("s"), F.count(F.when(F.col(y).isNull(), 1)).alias("_gaps"), F.avg("_w").alias("_mean"))
    centre = F.col("_mean") if not (d or D) else F.lit(0.0)
    known = F.filter(F.transform("s", lambda r: r["v"]), lambda v: v.isNotNull())
    return packed.where("_gaps = 0").select(*keys, F.transform(known, lambda v: v - centre).alias("w"))


def search_orders(panel: DataFrame, p: int, d: int, q: int, P: int, D: int, Q: int, season: int, steps: int = 7, rounds: int = 4, y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, order, aic, parameters): the best AIC found for all orders up to the given ones.  A round tries
    ``steps`` values of each parameter: from -REACH to REACH, then within a step around the best."""
    held = cut(values(panel, d, D, season, y, keys))
    orders = list(itertools.product(range(p + 1), range(q + 1), range(P + 1), range(Q + 1)))
    centred = 0 if d or D else 1
    grid = [-REACH + 2.0 * REACH * k / (steps - 1) for k in range(steps)]
    best, width = None, 2.0 * REACH / (steps - 1)
    for turn in range(rounds):
        parts = []
        for number, (a, b, c, e) in enumerate(orders):
            many = a + b + c + e
            if turn == 0:
                tried = [[F.lit(v) for v in point] for point in itertools.product(grid, repeat=many)]
                source = held.withColumn("_v", F.explode(F.array(*[F.array(*v) if v else F.array().cast("array<double>") for v in tried])))
            else:
                moves = [width * (2.0 * k / (steps - 1) - 1.0) for k in range(steps)]
                near = held.join(best.where(F.col("_order") == number).select(*keys, "_v"), list(keys)).withColumnRenamed("_v", "_b")
                points = F.lit([0.0]) if not many else F.array(*[F.array(*[F.lit(v) for v in point]) for point in itertools.product(moves, repeat=many)])
                shifted = near.withColumn("_m", F.explode(points)) if many else near.withColumn("_m", F.array().cast("array<double>"))
                inside = lambda x, m: F.greatest(F.lit(-REACH), F.least(F.lit(REACH), x + m))
                source = shifted.withColumn("_v", F.zip_with("_b", "_m", inside)).drop("_b", "_m")
            v = [F.get("_v", F.lit(k)) for k in range(many)]
            ar, ma = product(v[:a], v[a + b : a + b + c], season, -1.0), product(v[a : a + b], v[a + b + c :], season, 1.0)
            arrays = [F.array(*x) if x else F.array().cast("array<double>") for x in (ar, ma)]
            parts.append(source.withColumns({"_ar": arrays[0], "_ma": arrays[1], "_order": F.lit(number), "_many": F.lit(many)}))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        n = (F.size("w") - F.size("_ar")).cast("double")
        fits = rows.where(n > F.col("_many") + 2).withColumn("_s", sum_of_squares(F.col("w"), F.col("_ar"), F.col("_ma")))
        aic = n * (F.ln(2.0 * math.pi * F.greatest(F.col("_s") / n, F.lit(1e-300))) + 1.0) + 2.0 * (F.col("_many") + centred + 1)
        least = F.min(F.struct(aic.alias("aic"), F.col("_v"))).alias("b")
        best = cut(fits.groupBy(*keys, "_order").agg(least).select(*keys, "_order", "b.aic", "b._v"))
        width = width if turn == 0 else 2.0 * width / (steps - 1)  # the step of the round before
    names = F.array(*[F.lit(f"({a}, {b})x({c}, {e})") for a, b, c, e in orders])
    return best.select(*keys, F.get(names, F.col("_order")).alias("order"), "aic", F.col("_v").alias("parameters"))
