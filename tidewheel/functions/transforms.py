"""Order-dependent and element-wise transforms as Column expressions and their inverses."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.sources.panel import by_time

KEYS = ("series_id",)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def box_cox(y: str | Column, lmda: float | Column, shift: bool | Column = False) -> Column:
    """(x^lambda - 1) / lambda, ln x at 0; ``shift`` adds one first."""
    lam = lmda if isinstance(lmda, Column) else F.lit(float(lmda))
    x = _c(y) + F.when(shift if isinstance(shift, Column) else F.lit(shift), 1.0).otherwise(0.0)
    return F.when(lam == 0, F.ln(x)).otherwise((F.pow(x, lam) - 1.0) / lam)


def inverse_box_cox(z: str | Column, lmda: float | Column, shift: bool | Column = False, variance: Column | None = None) -> Column:
    """Inverse; with ``variance`` the bias-adjusted mean instead of the median."""
    lam = lmda if isinstance(lmda, Column) else F.lit(float(lmda))
    z = _c(z)
    base = lam * z + 1.0
    flat, bent = F.exp(z), F.pow(base, 1.0 / lam)
    if variance is not None:
        flat = flat * (1.0 + variance / 2.0)
        bent = bent * (1.0 + (1.0 - lam) * variance / (2.0 * F.pow(base, 2)))
    return F.when(lam == 0, flat).otherwise(bent) - F.when(shift if isinstance(shift, Column) else F.lit(shift), 1.0).otherwise(0.0)


def needs_shift(y: str = "y", keys: Sequence[str] = KEYS) -> Column:
    """Any value below one in the series."""
    return F.min(_c(y)).over(W.partitionBy(*keys)) < 1.0


def box_cox_profile(panel: DataFrame, lambdas: Sequence[float], y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """Profile log-likelihood of each lambda and series, in one aggregation pass."""
    shifted = panel.withColumn("_x", _c(y) + F.when(needs_shift(y, keys), 1.0).otherwise(0.0))
    aggs = [F.struct(F.lit(float(v)).alias("lmda"), (-F.count("_x") / 2.0 * F.ln(F.var_pop(box_cox("_x", v))) + (v - 1.0) * F.sum(F.ln("_x"))).alias("llf")).alias(f"l{k}") for k, v in enumerate(lambdas)]
    return shifted.groupBy(*keys).agg(*aggs).select(*keys, F.explode(F.array(*[f"l{k}" for k in range(len(lambdas))])).alias("p")).select(*keys, "p.lmda", "p.llf")


def box_cox_lambda(panel: DataFrame, y: str = "y", keys: Sequence[str] = KEYS, low: float = -2.0, high: float = 2.0, rounds: int = 3, steps: int = 20) -> DataFrame:
    """Maximum-likelihood lambda by grid refinement: each round one pass over the panel."""
    grid = [low + (high - low) * k / steps for k in range(steps + 1)]
    best = box_cox_profile(panel, grid, y, keys).groupBy(*keys).agg(F.max_by("lmda", "llf").alias("lmda"))
    width = (high - low) / steps
    shifted = panel.withColumn("_x", _c(y) + F.when(needs_shift(y, keys), 1.0).otherwise(0.0)).select(*keys, "_x")
    for _ in range(rounds - 1):
        offsets = [width * (2.0 * k / steps - 1.0) for k in range(steps + 1)]
        joined = shifted.join(best, list(keys))
        aggs = []
        for k, off in enumerate(offsets):
            lam = F.first("lmda") + off
            var = F.var_pop(box_cox("_x", F.col("lmda") + off))
            aggs.append(F.struct(lam.alias("lmda"), (-F.count("_x") / 2.0 * F.ln(var) + (lam - 1.0) * F.sum(F.ln("_x"))).alias("llf")).alias(f"l{k}"))
        best = joined.groupBy(*keys).agg(*aggs).select(*keys, F.array_max(F.array(*[F.struct(F.col(f"l{k}.llf").alias("llf"), F.col(f"l{k}.lmda").alias("lmda")) for k in range(steps + 1)])).alias("b")).select(*keys, F.col("b.lmda").alias("lmda"))
        width = 2.0 * width / steps
    return best


def diff(y: str | Column, order: int = 1, keys: Sequence[str] = KEYS) -> Column:
    """Differencing of any order as binomial lags: one window, no nesting."""
    from math import comb

    w, out = by_time(keys), None
    for k in range(order + 1):
        term = (-1) ** k * comb(order, k) * (F.lag(_c(y), k).over(w) if k else _c(y))
        out = term if out is None else out + term
    return out


def seasonal_diff(y: str | Column, season: int, keys: Sequence[str] = KEYS) -> Column:
    return _c(y) - F.lag(_c(y), season).over(by_time(keys))


def undiff(forecast: DataFrame, history: DataFrame, order: int = 1, d: str = "yhat", y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, h, d) with the history it continues -> the same with d undifferenced ``order`` times."""
    ends = history
    for k in range(1, order):
        ends = ends.withColumn(f"_d{k}", diff(y, k, keys))
    last = ends.groupBy(*keys).agg(*[F.max_by(f"_d{k}" if k else y, "t").alias(f"_l{k}") for k in range(order)])
    out = forecast.join(last, list(keys))
    running = by_time(keys, "h").rowsBetween(W.unboundedPreceding, 0)
    for k in range(order - 1, -1, -1):
        out = out.withColumn(d, F.col(f"_l{k}") + F.sum(d).over(running))
    return out.drop(*[f"_l{k}" for k in range(order)])


def invert_seasonal_diff(forecast: DataFrame, history: DataFrame, season: int, d: str = "yhat", y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """Closed form: the last season's value of the step's phase plus the running sum of its phase."""
    n = W.partitionBy(*keys)
    seed = history.withColumn("_n", F.max("t").over(n)).where(F.col("t") > F.col("_n") - season)
    seed = seed.select(*keys, (F.col("t") - F.col("_n") + season - 1).alias("_p"), F.col(y).alias("_s"))
    out = forecast.withColumn("_p", F.pmod(F.col("h") - 1, F.lit(season))).join(seed, [*keys, "_p"], "left")
    running = W.partitionBy(*keys, "_p").orderBy("h").rowsBetween(W.unboundedPreceding, 0)
    return out.withColumn(d, F.col("_s") + F.sum(d).over(running)).drop("_p", "_s")


def zero_run_length(y: str | Column = "y", lag: int = 0, keys: Sequence[str] = KEYS, threshold: float = 0.5) -> Callable:
    """DataFrame -> DataFrame adding ``zero_run``: consecutive zeros up to and with this step."""

    def add(df: DataFrame, name: str = "zero_run") -> DataFrame:
        w = by_time(keys)
        value = F.lag(_c(y), lag).over(w) if lag else _c(y)
        marked = df.withColumn("_v", value).withColumn("_g", F.sum(F.when(F.col("_v") >= threshold, 1).otherwise(0)).over(w))
        island = W.partitionBy(*keys, "_g").orderBy("t")
        run = F.when(F.col("_v").isNotNull(), F.count(F.when(F.col("_v") < threshold, 1)).over(island))
        return marked.withColumn(name, run).drop("_v", "_g")

    return add


def nonzero_interval(y: str | Column = "y", lag: int = 0, keys: Sequence[str] = KEYS, threshold: float = 0.5) -> Callable:
    """DataFrame -> DataFrame adding ``nz_interval``: steps between the last two non-zero demands, 1 before the second."""

    def add(df: DataFrame, name: str = "nz_interval") -> DataFrame:
        w = by_time(keys)
        hit = df.withColumn("_at", F.when(_c(y) > threshold, F.col("t")))
        before = F.last("_at", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
        gap = hit.withColumn("_gap", F.when(F.col("_at").isNotNull(), F.col("_at") - before))
        out = gap.withColumn("_i", F.coalesce(F.last("_gap", ignorenulls=True).over(w), F.lit(1)))
        return out.withColumn(name, F.lag("_i", lag).over(w) if lag else F.col("_i")).drop("_at", "_gap", "_i")

    return add


def fourier_columns(t: str | Column, period: float, terms: int) -> dict[str, Column]:
    """All sines, then all cosines."""
    angle = lambda k: F.lit(2.0 * k) * F.pi() * _c(t) / F.lit(float(period))
    name = f"{period:g}"
    return {f"sin_{k}_{name}": F.sin(angle(k)) for k in range(1, terms + 1)} | {f"cos_{k}_{name}": F.cos(angle(k)) for k in range(1, terms + 1)}


def fourier_terms(spark: SparkSession, start, end, period: float, terms: int) -> DataFrame:
    """A calendar of steps (integers) or days (dates), both ends included, with Fourier terms."""
    from tidewheel.sources.panel import calendar

    base = spark.range(int(start), int(end) + 1).select((F.col("id") - int(start)).cast("int").alias("t")) if isinstance(start, int) else calendar(spark, start, end)
    return base.withColumns(fourier_columns("t", period, terms))


def nonnegative(y: str | Column) -> Column:
    """Clamp after undifferencing and before the inverse Box-Cox."""
    return F.greatest(F.lit(0.0), _c(y))
