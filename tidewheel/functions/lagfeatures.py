"""Lag features and lag transforms: objects that become Columns over one window spec, so
that any number of them is planned behind a single exchange and sort."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.sources.panel import by_time


@dataclass(frozen=True)
class LagTransform:
    """A statistic of the series shifted by ``shift``.  ``column`` is the batch form over a
    window, ``step`` the same for the next step of a growing history."""

    shift: int = 1

    def _frame(self, w):
        return w.rowsBetween(W.unboundedPreceding, -self.shift)

    def column(self, y: str, keys: Sequence[str]) -> Column:
        return self.statistic(F.col(y), self._frame(by_time(keys)))

    def seen(self, history: np.ndarray) -> np.ndarray:
        return history[: max(0, len(history) - self.shift + 1)]

    def step(self, history: np.ndarray) -> float:
        """Value of the feature at the step after ``history``."""
        seen = self.seen(history)
        seen = seen[~np.isnan(seen)]
        return self.reduce(seen) if len(seen) else np.nan

    def trace(self, z: np.ndarray) -> np.ndarray:
        """Values of the feature at every step of a series."""
        return np.array([self.step(z[:i]) if i >= self.shift else np.nan for i in range(len(z))])

    def _sums(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, sum and sum of squares (of values less their mean) seen before every step: one pass."""
        good = ~np.isnan(z)
        x = np.where(good, z - (z[good].mean() if good.any() else 0.0), 0.0)
        late = lambda v: np.concatenate((np.zeros(self.shift), np.cumsum(v)))[: len(z)]
        return late(good.astype(float)), late(x), late(x * x)


@dataclass(frozen=True)
class ExpandingMean(LagTransform):
    def trace(self, z: np.ndarray) -> np.ndarray:
        n, s, _ = self._sums(z)
        centre = np.nanmean(z) if (~np.isnan(z)).any() else 0.0
        return np.where(n > 0, s / np.maximum(n, 1) + centre, np.nan)

    @property
    def name(self) -> str:
        return f"expanding_mean_shift_{self.shift}"

    def statistic(self, y: Column, frame) -> Column:
        return F.avg(y).over(frame)

    def reduce(self, x: np.ndarray) -> float:
        return float(x.mean())


@dataclass(frozen=True)
class ExpandingStd(LagTransform):
    def trace(self, z: np.ndarray) -> np.ndarray:
        n, s, q = self._sums(z)
        return np.where(n > 1, np.sqrt(np.maximum(q - s * s / np.maximum(n, 1), 0.0) / np.maximum(n - 1, 1)), np.nan)

    @property
    def name(self) -> str:
        return f"expanding_std_shift_{self.shift}"

    def statistic(self, y: Column, frame) -> Column:
        return F.stddev_samp(y).over(frame)

    def reduce(self, x: np.ndarray) -> float:
        return float(x.std(ddof=1)) if len(x) > 1 else np.nan


@dataclass(frozen=True)
class ExpandingQuantile(LagTransform):
    quantile: float = 0.5

    @property
    def name(self) -> str:
        return f"expanding_quantile_shift_{self.shift}_q{self.quantile}"

    def statistic(self, y: Column, frame) -> Column:
        return F.percentile(y, F.lit(self.quantile)).over(frame)

    def reduce(self, x: np.ndarray) -> float:
        return float(np.quantile(x, self.quantile))


@dataclass(frozen=True)
class _Rolling(LagTransform):
    window: int = 2
    min_samples: int = 1

    def _frame(self, w):
        return w.rowsBetween(-(self.shift + self.window - 1), -self.shift)

    def seen(self, history: np.ndarray) -> np.ndarray:
        end = len(history) - self.shift + 1
        return history[max(0, end - self.window) : max(0, end)]

    def column(self, y: str, keys: Sequence[str]) -> Column:
        frame = self._frame(by_time(keys))
        return F.when(F.count(F.col(y)).over(frame) >= self.min_samples, self.statistic(F.col(y), frame))

    def step(self, history: np.ndarray) -> float:
        seen = self.seen(history)
        seen = seen[~np.isnan(seen)]
        return self.reduce(seen) if len(seen) >= max(1, self.min_samples) else np.nan


@dataclass(frozen=True)
class RollingMean(_Rolling):
    @property
    def name(self) -> str:
        return f"rolling_mean_{self.window}_shift_{self.shift}"

    def statistic(self, y: Column, frame) -> Column:
        return F.avg(y).over(frame)

    def reduce(self, x: np.ndarray) -> float:
        return float(x.mean())


@dataclass(frozen=True)
class RollingStd(_Rolling):
    @property
    def name(self) -> str:
        return f"rolling_std_{self.window}_shift_{self.shift}"

    def statistic(self, y: Column, frame) -> Column:
        return F.stddev_samp(y).over(frame)

    def reduce(self, x: np.ndarray) -> float:
        return float(x.std(ddof=1)) if len(x) > 1 else np.nan


@dataclass(frozen=True)
class RollingQuantile(_Rolling):
    quantile: float = 0.5

    @property
    def name(self) -> str:
        return f"rolling_quantile_{self.window}_shift_{self.shift}_q{self.quantile}"

    def statistic(self, y: Column, frame) -> Column:
        return F.percentile(y, F.lit(self.quantile)).over(frame)

    def reduce(self, x: np.ndarray) -> float:
        return float(np.quantile(x, self.quantile))


@dataclass(frozen=True)
class ExpandingSes(LagTransform):
    """Level of simple exponential smoothing with a fixed factor over the shifted series."""

    alpha: float = 0.5

    def trace(self, z: np.ndarray) -> np.ndarray:
        out, level = np.full(len(z), np.nan), np.nan
        for i in range(self.shift, len(z)):
            v = z[i - self.shift]
            if v == v:
                level = v if level != level else level + self.alpha * (v - level)
            out[i] = level
        return out

    @property
    def name(self) -> str:
        return f"expanding_ses_shift_{self.shift}_a{self.alpha}"

    def statistic(self, y: Column, frame) -> Column:
        seen = F.collect_list(y).over(frame)
        rest = F.slice(seen, 2, F.greatest(F.size(seen) - 1, F.lit(0)))
        return F.when(F.size(seen) > 0, F.aggregate(rest, F.element_at(seen, 1), lambda s, x: s + self.alpha * (x - s)))

    def reduce(self, x: np.ndarray) -> float:
        level = x[0]
        for v in x[1:]:
            level += self.alpha * (v - level)
        return float(level)


@dataclass(frozen=True)
class ExpandingEts(LagTransform):
    """Fitted values of exponential smoothing over the shifted series: ``ets`` is any ``Ets`` with
    trend, season, damping and factors, those that are None estimated.  A feature of estimators;
    a panel gets its column from ``plans.forecasting.expanding_ets``."""

    ets: object = None

    @property
    def name(self) -> str:
        return f"expanding_ets_{self.shift}"

    def statistic(self, y: Column, frame) -> Column:
        raise TypeError("a smoothing with estimated parameters is no window; use plans.forecasting.expanding_ets")

    def trace(self, z: np.ndarray) -> np.ndarray:
        out, good = np.full(len(z), np.nan), ~np.isnan(z[: max(0, len(z) - self.shift)])
        at = np.flatnonzero(good)
        if len(at):
            out[at + self.shift] = self.ets.fit(z[at][:, None]).fitted
        return out

    def step(self, history: np.ndarray) -> float:
        seen = self.seen(history)
        seen = seen[~np.isnan(seen)]
        return float(self.ets.fit(seen[:, None]).fitted[-1]) if len(seen) else np.nan


def normal_lags(lags: int | Sequence[int] | None) -> list[int]:
    """An int means 1..k."""
    if lags is None:
        return []
    if isinstance(lags, bool) or not isinstance(lags, (int, list, tuple)):
        raise TypeError("lags must be an int or a list of ints")
    return list(range(1, lags + 1)) if isinstance(lags, int) else list(lags)


def add_lags(df: DataFrame, lags: int | Sequence[int], y: str = "y", transforms: Sequence[LagTransform] = (), keys: Sequence[str] = ("series_id",), prefix: str = "") -> DataFrame:
    """All lags ``{y}_lag_{k}`` and transforms in one projection over one window."""
    w = by_time(keys)
    new = {f"{y}_lag_{k}": F.lag(y, k).over(w) for k in normal_lags(lags)}
    return df.withColumns(new | {prefix + tr.name: tr.column(y, keys) for tr in transforms})
