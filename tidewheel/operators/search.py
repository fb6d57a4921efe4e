"""Feature selection and hyper-parameter search over distributed backtests.

A round of a search is one job: its candidates are a key column of the backtest.  Only the
rounds (whose choice depends on the last) are a loop on the driver, which sees one row per
candidate and metric.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.lagfeatures import normal_lags
from tidewheel.operators.estimators import Ets, Sarima
from tidewheel.plans.forecasting import cross_validate, fit_reports, forecast

#: Loss of a candidate that cannot be fitted, such as one without any feature.
FAILED = 1e6


@dataclass(frozen=True)
class Features:
    lags: tuple[int, ...] = ()
    exog: tuple[str, ...] = ()
    transforms: tuple = ()


def _scores(panel, models, metrics, n_splits, horizon, step, targets, exog, **how) -> dict[int, list[float]]:
    """Mean over series of each metric, by candidate.  Candidates with different exogenous
    columns are separate backtests."""
    out: dict[int, list[float]] = {}
    for names in sorted(set(exog.values())):
        part = {c: m for c, m in models.items() if exog[c] == names}
        rows = cross_validate(panel, part, n_splits, horizon, metrics, step, None, targets, names, **how)
        found = rows.groupBy("candidate", "eval_metric").agg(F.avg("score").alias("s")).collect()
        for c in part:
            by = {r["eval_metric"]: r["s"] for r in found if r["candidate"] == c}
            out[c] = [FAILED if by.get(m) is None or not math.isfinite(by[m]) else by[m] for m in metrics]
    return out


def _criteria(panel, models, names, targets, exog) -> dict[int, list[float]]:
    out: dict[int, list[float]] = {}
    for columns in sorted(set(exog.values())):
        part = {c: m for c, m in models.items() if exog[c] == columns}
        found = fit_reports(panel, part, "criteria", targets, columns).groupBy("candidate", "name").agg(F.avg("value").alias("v")).collect()
        for c in part:
            by = {r["name"]: r["v"] for r in found if r["candidate"] == c}
            out[c] = [by.get(n, FAILED) for n in names]
    return out


def _better(new: list[float], old: list[float], accept: str) -> bool:
    """``all``: every metric improves; ``lexicographic``: list order."""
    return all(a < b for a, b in zip(new, old)) if accept == "all" else new < old


def _best_of(found: dict[int, list[float]], score: list[float], accept: str) -> int | None:
    """The candidate that is left when each in turn replaces the best so far if it is better."""
    pick = None
    for k in sorted(found):
        if _better(found[k], score, accept):
            pick, score = k, found[k]
    return pick


def per_target(lags: Sequence[tuple[int, int]], targets: int) -> dict[int, list[int]]:
    """(target number, lag) choices as the lags of each target, the form ``Lagged`` takes: candidates
    of this form select the lags of every target of a multivariate model on their own."""
    return {j: [lag for of, lag in lags if of == j] for j in range(targets)}


def _judge(panel, build, options, metrics, n_splits, horizon, step, targets, validation, **how):
    models = {k: build(f) for k, f in enumerate(options)}
    exog = {k: f.exog for k, f in enumerate(options)}
    if validation == "cv":
        return _scores(panel, models, metrics, n_splits, horizon, step, targets, exog, **how)
    return _criteria(panel, models, [v.lower() for v in validation.split("_")], targets, exog)


def forward_selection(panel: DataFrame, build: Callable[[Features], object], metrics: Sequence[str], n_splits: int, horizon: int, lags: Sequence[int] = (), exog: Sequence[str] = (), transforms: Sequence = (), start: Features = Features(), step: int | None = 1, targets: Sequence[str] = ("y",), accept: str = "all", validation: str = "cv", **how) -> tuple[Features, list[float]]:
    """Greedily add the lag, column or transform that improves most; stop when none does.
    ``build`` turns a choice into a model; ``validation``: cv, AIC, BIC or AIC_BIC."""
    best, score = start, [math.inf] * (len(metrics) if validation == "cv" else len(validation.split("_")))
    if start.lags or start.exog or start.transforms:
        score = _judge(panel, build, [start], metrics, n_splits, horizon, step, targets, validation, **how)[0]
    while True:
        options = [replace(best, lags=tuple(sorted({*best.lags, k}))) for k in lags if k not in best.lags]
        options += [replace(best, exog=(*best.exog, c)) for c in exog if c not in best.exog]
        options += [replace(best, transforms=(*best.transforms, t)) for t in transforms if t not in best.transforms]
        if not options:
            return best, score
        found = _judge(panel, build, options, metrics, n_splits, horizon, step, targets, validation, **how)
        pick = _best_of(found, score, accept)
        if pick is None or found[pick][0] >= FAILED:
            return best, score
        best, score = options[pick], found[pick]


def backward_selection(panel: DataFrame, build: Callable[[Features], object], metrics: Sequence[str], n_splits: int, horizon: int, start: Features, step: int | None = 1, targets: Sequence[str] = ("y",), accept: str = "lexicographic", validation: str = "cv", **how) -> tuple[Features, list[float]]:
    """Greedily remove what is missed least."""
    best = start
    score = _judge(panel, build, [best], metrics, n_splits, horizon, step, targets, validation, **how)[0]
    while True:
        options = [replace(best, lags=tuple(k for k in best.lags if k != d)) for d in best.lags]
        options += [replace(best, exog=tuple(c for c in best.exog if c != d)) for d in best.exog]
        options += [replace(best, transforms=tuple(t for t in best.transforms if t != d)) for d in best.transforms]
        options = [o for o in options if o.lags or o.exog or o.transforms]
        if not options:
            return best, score
        found = _judge(panel, build, options, metrics, n_splits, horizon, step, targets, validation, **how)
        pick = _best_of(found, score, accept)
        if pick is None:
            return best, score
        best, score = options[pick], found[pick]


@dataclass(frozen=True)
class Choice:
    values: tuple

    def draw(self, rng):
        return self.values[int(rng.integers(len(self.values)))]


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float
    step: float | None = None  # quantised
    log: bool = False

    def draw(self, rng):
        v = float(np.exp(rng.uniform(np.log(self.low), np.log(self.high)))) if self.log else float(rng.uniform(self.low, self.high))
        return v if self.step is None else type(self.step)(round(v / self.step) * self.step)


def _propose(space: Mapping[str, object], history: list[tuple[dict, float]], count: int, rng) -> list[dict]:
    """Tree-structured Parzen style: draws near good trials that bad trials do not explain."""
    if len(history) < 8:
        return [{k: s.draw(rng) for k, s in space.items()} for _ in range(count)]
    ordered = sorted(history, key=lambda h: h[1])
    good, bad = ordered[: max(2, len(ordered) // 4)], ordered[max(2, len(ordered) // 4) :]

    def density(s, v, rows, k):
        if isinstance(s, Choice):
            return (1.0 + sum(r[0][k] == v for r in rows)) / (len(s.values) + len(rows))
        at = (lambda x: math.log(x)) if s.log else float
        width = (at(s.high) - at(s.low)) / max(2.0, math.sqrt(len(rows))) + 1e-12
        return 1e-3 + sum(math.exp(-0.5 * ((at(r[0][k]) - at(v)) / width) ** 2) for r in rows) / len(rows)

    out = []
    for _ in range(count):
        draws = []
        for _ in range(24):
            parent = good[int(rng.integers(len(good)))][0]
            draws.append({k: parent[k] if rng.random() < 0.5 else s.draw(rng) for k, s in space.items()})
        out.append(max(draws, key=lambda d: sum(math.log(density(s, d[k], good, k)) - math.log(density(s, d[k], bad, k)) for k, s in space.items())))
    return out


def tune(panel: DataFrame, build: Callable[[dict], object], space: Mapping[str, object], metric: str, n_splits: int, horizon: int, trials: int = 100, batch: int = 8, step: int | None = None, targets: Sequence[str] = ("y",), target: str | None = None, exog: Sequence[str] = (), seed: int = 0, last_steps: int | None = None, warm_rounds: int | None = None) -> tuple[dict, list[tuple[dict, float]]]:
    """(best parameters, every trial with its loss).  Trials run in batches, a job each; a
    candidate that ``build`` refuses (None) or that cannot be fitted loses."""
    rng, history = np.random.default_rng(seed), []
    while len(history) < trials:
        drawn = _propose(space, history, min(batch, trials - len(history)), rng)
        models = {k: m for k, m in ((k, build(d)) for k, d in enumerate(drawn)) if m is not None}
        found: dict[int, float] = {}
        if models:
            rows = cross_validate(panel, models, n_splits, horizon, [metric], step, None, targets, exog, last_steps=last_steps, warm_rounds=warm_rounds)
            rows = rows if target is None else rows.where(F.col("target") == target)
            found = {r["candidate"]: r["s"] for r in rows.groupBy("candidate").agg(F.avg("score").alias("s")).collect()}
        history += [(d, found[k] if found.get(k) is not None and math.isfinite(found[k]) else FAILED) for k, d in enumerate(drawn)]
    return min(history, key=lambda h: h[1])[0], history


def tune_lags(panel: DataFrame, build: Callable[[tuple[int, ...]], object], lag_space: Sequence[int], metric: str, n_splits: int, horizon: int, **how) -> tuple[tuple[int, ...], list]:
    """Binary inclusion of every lag; the empty set loses."""
    chosen = lambda d: tuple(k for k in normal_lags(list(lag_space)) if d[f"lag_{k}"])
    best, history = tune(panel, lambda d: build(chosen(d)) if chosen(d) else None, {f"lag_{k}": Choice((False, True)) for k in lag_space}, metric, n_splits, horizon, **how)
    return chosen(best), history


def tune_ets(panel: DataFrame, season: int, metric: str, n_splits: int, horizon: int, trials: int = 100, space: Mapping[str, object] | None = None, **how):
    """``space`` replaces the draws of any parameter of ``Ets``."""
    every = {"trend": Choice((None, "add", "mul")), "damped": Choice((False, True)), "seasonal": Choice((None, "add", "mul")), "alpha": Uniform(0.01, 0.99), "beta": Uniform(0.01, 0.5), "gamma": Uniform(0.01, 0.5), "phi": Uniform(0.8, 0.98)}
    space = every | dict(space or {})
    build = lambda d: Ets(season=season if d["seasonal"] else 0, **d)
    best, history = tune(panel, build, space, metric, n_splits, horizon, trials, **how)
    return build(best), history


def sarima_grid(p: int, d: int, q: int, P: int, D: int, Q: int, season: int) -> dict[int, Sarima]:
    """Every combination of orders up to the given ones."""
    orders = itertools.product(range(p + 1), range(q + 1), range(P + 1), range(Q + 1))
    return {k: Sarima(a, d, b, c, D, e, season) for k, (a, b, c, e) in enumerate(orders)}


def tune_sarima(panel: DataFrame, p: int, d: int, q: int, P: int, D: int, Q: int, season: int, exog: Sequence[str] = ()) -> DataFrame:
    """(series_id, order, aic), ascending; orders that cannot be fitted are left out."""
    grid = sarima_grid(p, d, q, P, D, Q, season)
    names = F.create_map(*[F.lit(v) for k, m in grid.items() for v in (k, f"({m.p}, {m.q})x({m.P}, {m.Q})")])
    aic = {k: _Aic(m) for k, m in grid.items()}
    rows = fit_reports(panel, aic, "criteria", exog=exog)
    return rows.select("series_id", names[F.col("candidate")].alias("order"), F.col("value").alias("aic")).orderBy("series_id", "aic")


@dataclass(frozen=True)
class _Aic:
    model: Sarima

    def fit(self, y, x=None):
        fitted = self.model.fit(y, x)
        return type("Report", (), {"criteria": lambda self: {"aic": fitted.aic}})()


def candidate_forecasts(panel: DataFrame, models: Mapping[int, object], horizon: int, **how) -> DataFrame:
    """(series_id, candidate, horizon_1..H): tuned candidates as a predictive distribution."""
    rows = forecast(panel, models, horizon, **how)
    return rows.groupBy("series_id", "candidate").agg(*[F.max(F.when(F.col("h") == h, F.col("yhat"))).alias(f"horizon_{h}") for h in range(1, horizon + 1)])
