"""Distributed fitting, forecasting and backtesting of per-series models.

A series is packed into one row of arrays (its length bounds the row), and folds and
candidates become further rows, so every (series, fold, candidate) is one unit of parallel
work, dealt round-robin: no shuffle on a hot key and no driver loop.  Models that must
follow one another from fold to fold are evaluated fold after fold within a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.operators.estimators import TooShort
from tidewheel.operators.folds import cutoff_list

KEYS = ("series_id",)
#: What a single series may fail with; anything else fails the job.
UNFIT = (TooShort, np.linalg.LinAlgError)


def _checked(models, horizon: int) -> Mapping[int, object]:
    """Candidates by number; those that can say so refuse a horizon here, before any job."""
    models = models if isinstance(models, Mapping) else {0: models}
    for model in models.values():
        if hasattr(model, "check"):
            model.check(horizon)
    return models


def pack(panel: DataFrame, targets: Sequence[str] = ("y",), exog: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per series: arrays ``t``, ``y`` (targets side by side) and ``x`` in time order."""
    fields = [F.col("t").alias("t"), F.array(*[F.col(c).cast("double") for c in targets]).alias("y"), F.array(*[F.col(c).cast("double") for c in exog]).cast("array<double>").alias("x")]
    packed = panel.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("s"))
    return packed.select(*keys, F.flatten(F.transform("s", lambda r: r["y"])).alias("y"), F.flatten(F.transform("s", lambda r: r["x"])).alias("x"), F.size("s").alias("n"))


def _matrix(values, width: int) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values], float).reshape(-1, width)


def _map(packed: DataFrame, body, schema: str) -> DataFrame:
    """Run ``body(row)`` -> list of output tuples for every packed row."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                out = body(row)
                if out:
                    yield pd.DataFrame(out, columns=names)

    return packed.mapInPandas(run, schema)


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in keys)


def forecast(panel: DataFrame, models: Mapping[int, object] | object, horizon: int, targets: Sequence[str] = ("y",), exog: Sequence[str] = (), future: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, candidate, target, h, yhat).  ``future`` holds exogenous columns per key and ``h``.
    A series too short for a candidate yields no rows for it; ``fit_reports(..., "failures")``
    names it with the reason."""
    models = _checked(models, horizon)
    packed = pack(panel, targets, exog, keys)
    if future is not None:
        fx = future.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("h", F.array(*[F.col(c).cast("double") for c in exog]).alias("x")))).alias("f"))
        packed = packed.join(fx.select(*keys, F.flatten(F.transform("f", lambda r: r["x"])).alias("fx")), list(keys))
    else:
        packed = packed.withColumn("fx", F.array().cast("array<double>"))
    dealt = packed.withColumn("candidate", F.explode(F.array(*[F.lit(c) for c in models]))).repartition(_width(panel))

    def body(row) -> list[tuple]:
        y, x = _matrix(row.y, len(targets)), _matrix(row.x, len(exog)) if exog else None
        fx = _matrix(row.fx, len(exog)) if exog else None
        try:
            yhat = models[row.candidate].fit(y, x).forecast(horizon, fx)
        except UNFIT:
            return []
        at = [getattr(row, k) for k in keys]
        return [(*at, row.candidate, targets[j], h + 1, _none(yhat[h, j])) for h in range(horizon) for j in range(len(targets))]

    return _map(dealt, body, f"{_key_schema(panel, keys)}, candidate int, target string, h int, yhat double")


def _none(v: float) -> float | None:
    return None if v != v else float(v)


def _width(panel: DataFrame) -> int:
    return max(8, int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def backtest(panel: DataFrame, models: Mapping[int, object] | object, n_splits: int, horizon: int, step: int | None = None, targets: Sequence[str] = ("y",), exog: Sequence[str] = (), keys: Sequence[str] = KEYS, warm_rounds: int | None = None) -> DataFrame:
    """(keys, fold, candidate, target, h, y, yhat, resid and the training scales of the metrics).

    ``warm_rounds``: Markov-switching candidates start each fold from the one before and
    run that many rounds; their folds follow one another within a row."""
    models = _checked(models, horizon)
    packed = pack(panel, targets, exog, keys).withColumn("candidate", F.explode(F.array(*[F.lit(c) for c in models])))
    if warm_rounds is None:
        back = F.sequence(F.lit(0), F.lit(n_splits - 1))
        packed = packed.withColumn("turn", F.explode(back))
    else:
        packed = packed.withColumn("turn", F.lit(-1))
    dealt = packed.repartition(_width(panel))

    def one(model, row, y, x, fold, cut) -> tuple[list[tuple], object]:
        try:
            fitted = model.fit(y[:cut], x[:cut] if x is not None else None)
            yhat = fitted.forecast(horizon, x[cut : cut + horizon] if x is not None else None)
        except UNFIT:
            return [], None
        at, out = [getattr(row, k) for k in keys], []
        for j in range(len(targets)):
            past = y[:cut, j]
            d = np.diff(past)
            scale = [_none(float(v)) for v in ((past.mean() if cut else np.nan), *((np.abs(d).mean(), (d * d).mean(), np.median(np.abs(d))) if len(d) else (np.nan,) * 3))]
            for h in range(horizon):
                actual, got = y[cut + h, j], yhat[h, j]
                out.append((*at, fold, row.candidate, targets[j], h + 1, _none(actual), _none(got), _none(actual - got), *scale))
        return out, fitted

    def body(row) -> list[tuple]:
        y, x = _matrix(row.y, len(targets)), _matrix(row.x, len(exog)) if exog else None
        cuts = cutoff_list(len(y), n_splits, horizon, step)
        if row.turn >= 0:
            return one(models[row.candidate], row, y, x, row.turn + 1, cuts[row.turn])[0] if row.turn < len(cuts) else []
        model, out = models[row.candidate], []
        for k, cut in enumerate(cuts):
            rows, fitted = one(model, row, y, x, k + 1, cut)
            out += rows
            if fitted is not None:
                model = model.warm_started(fitted, warm_rounds)
        return out

    scales = "train_mean double, train_abs_diff double, train_sq_diff double, train_med_diff double"
    return _map(dealt, body, f"{_key_schema(panel, keys)}, fold int, candidate int, target string, h int, y double, yhat double, resid double, {scales}")


def cross_validate(panel: DataFrame, models, n_splits: int, horizon: int, metrics: Sequence[str], step: int | None = 1, split: int | None = None, targets: Sequence[str] = ("y",), exog: Sequence[str] = (), keys: Sequence[str] = KEYS, warm_rounds: int | None = None, last_steps: int | None = None) -> DataFrame:
    """(keys, candidate, target, eval_metric, score[, score_before_k, score_after_k]): the mean over
    folds of each fold's metric.  ``last_steps`` scores only the end of the horizon."""
    from tidewheel.functions.metrics import evaluate

    rows = backtest(panel, models, n_splits, horizon, step, targets, exog, keys, warm_rounds)
    if last_steps is not None:
        rows = rows.where(F.col("h") > horizon - last_steps)
    per_fold = evaluate(rows, metrics, [*keys, "candidate", "target", "fold"], split)
    scores = [c for c in per_fold.columns if c.startswith("score")]
    return per_fold.groupBy(*keys, "candidate", "target", "eval_metric").agg(*[F.avg(c).alias(c) for c in scores])


def fit_reports(panel: DataFrame, models, report: str, targets: Sequence[str] = ("y",), exog: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """What fitted models say of themselves, long: ``criteria`` (name, value), ``states``
    (t, state, probability), ``failures`` (reason: of series that cannot be fitted), ``parameters`` (variable, equation, regime, coef, ...), ``regimes``
    and ``covariance`` of Markov-switching models, ``fitted`` (t, value: an exponential
    smoothing's one-step values, usable as a feature) or ``importances``."""
    models = models if isinstance(models, Mapping) else {0: models}
    shapes = {
        "criteria": "name string, value double",
        "failures": "reason string",
        "states": "t int, state int, probability double",
        "regimes": "state int, probability double, log_likelihood double",
        "covariance": "regime int, a int, b int, value double",
        "fitted": "t int, value double",
        "importances": "target int, feature string, share double",
        "parameters": "variable string, equation int, regime int, coef double, std_err double, t_stat double, p_value double, r2 double",
    }
    dealt = pack(panel, targets, exog, keys).withColumn("candidate", F.explode(F.array(*[F.lit(c) for c in models]))).repartition(_width(panel))

    def body(row) -> list[tuple]:
        y, x = _matrix(row.y, len(targets)), _matrix(row.x, len(exog)) if exog else None
        try:
            m = models[row.candidate].fit(y, x)
        except UNFIT as reason:
            return [(*(getattr(row, k) for k in keys), row.candidate, str(reason))] if report == "failures" else []
        if report == "failures":
            return []
        at = [*(getattr(row, k) for k in keys), row.candidate]
        if report == "criteria":
            return [(*at, k, _none(v)) for k, v in m.criteria().items()]
        if report == "fitted":
            return [(*at, t, float(v)) for t, v in enumerate(m.fitted)]
        if report == "importances":
            return [(*at, *r) for r in m.importances()]
        if report == "parameters":
            return [(*at, *(_none(v) if isinstance(v, float) else v for v in p.values())) for p in m.parameters()]
        if report == "regimes":
            share = np.bincount(m.states(), minlength=len(m.pi)) / len(m.z)
            return [(*at, s, float(p), float(m.log_likelihood)) for s, p in enumerate(share)]
        if report == "covariance":
            return [(*at, s, a, b, float(c[a, b])) for s, c in enumerate(m.cov) for a in range(len(c)) for b in range(len(c))]
        states, skip = m.states(), len(y) - len(m.z)
        return [(*at, skip + i, int(s), float(m.gamma[s, i])) for i, s in enumerate(states)]

    return _map(dealt, body, f"{_key_schema(panel, keys)}, candidate int, {shapes[report]}")


def expanding_ets(panel: DataFrame, transform, y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """``panel`` with the column of an ``ExpandingEts`` by its name: the fitted values of a smoothing of all known
    values but the last ``shift`` steps', each that many steps later; NULL elsewhere and where a series is too short."""
    last = panel.groupBy(*keys).agg(F.max("t").alias("_last"))
    known = panel.join(last, list(keys)).where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")) & (F.col("t") <= F.col("_last") - transform.shift))
    known = known.select(*keys, F.col(y).alias("y"), F.col("t").alias("_t"), (F.row_number().over(W.partitionBy(*keys).orderBy("t")) - 1).cast("int").alias("t"))
    fitted = fit_reports(known, transform.ets, "fitted", keys=keys).select(*keys, "t", F.col("value").alias(transform.name))
    column = known.join(fitted, [*keys, "t"]).select(*keys, (F.col("_t") + transform.shift).cast("int").alias("t"), f"`{transform.name}`")
    return panel.join(column, [*keys, "t"], "left")
