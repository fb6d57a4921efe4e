"""Predictive distributions of any forecaster: calibrate once by a rolling-origin backtest,
then ask for intervals, quantiles or samples.  Everything stays a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators import conformal as C
from tidewheel.plans import forecasting as P


class Probabilistic:
    """``model`` is any estimator (or a mapping of candidates); one target of it is judged.

    ``n_calibration`` windows of ``horizon`` steps slide by ``sliding``.  Residuals and the
    final forecast are computed once and cached by Spark; ``release`` lets them go."""

    def __init__(self, panel: DataFrame, model, n_calibration: int, horizon: int, sliding: int = 1, targets: Sequence[str] = ("y",), target: str | None = None, exog: Sequence[str] = (), future: DataFrame | None = None, warm_rounds: int | None = None, keys: Sequence[str] = P.KEYS):
        self.panel, self.model, self.n, self.horizon, self.sliding = panel, model, n_calibration, horizon, sliding
        self.targets, self.target, self.exog, self.future = targets, target or targets[0], exog, future
        self.warm_rounds, self.base_keys = warm_rounds, tuple(keys)
        self.keys = (*self.base_keys, "candidate")

    @cached_property
    def residuals(self) -> DataFrame:
        """(keys, candidate, fold, h, y, yhat, resid)."""
        rows = P.backtest(self.panel, self.model, self.n, self.horizon, self.sliding, self.targets, self.exog, self.base_keys, self.warm_rounds)
        return rows.where(F.col("target") == self.target).select(*self.keys, "fold", "h", "y", "yhat", "resid").cache()

    @cached_property
    def point(self) -> DataFrame:
        """The forecast refitted on all data."""
        rows = P.forecast(self.panel, self.model, self.horizon, self.targets, self.exog, self.future, self.base_keys)
        return rows.where(F.col("target") == self.target).select(*self.keys, "h", "yhat").cache()

    def calibrate(self, delta: float | Sequence[float] = 0.5) -> DataFrame:
        return C.calibrate(self.residuals, delta, self.n, self.keys)

    def intervals(self, delta: float | Sequence[float] = 0.5, wide: bool = False) -> DataFrame:
        levels = [delta] if isinstance(delta, float) else list(delta)
        long = C.intervals(self.point, self.calibrate(levels), self.keys)
        return C.wide_intervals(long, levels, self.keys) if wide else long

    def distribution(self) -> DataFrame:
        return C.residual_distribution(self.point, self.residuals, self.keys)

    def quantiles(self, quantiles: float | Sequence[float]) -> DataFrame:
        return C.conformal_quantiles(self.point, self.residuals, quantiles, self.n, self.keys)

    def bootstrap(self, samples: int = 1000, kind: str = "kde", seed: int = 42) -> DataFrame:
        return C.bootstrap(self.point, self.residuals, samples, kind, seed, self.keys)

    def correlated(self, samples: int = 1000, seed: int = 42) -> DataFrame:
        return C.correlated_paths(self.point, self.residuals, samples, seed, self.keys)

    def bootstrap_quantiles(self, quantiles: float | Sequence[float], method: str = "bootstrap", samples: int = 1000, **how) -> DataFrame:
        drawn = self.correlated(samples, **how) if method == "correlated" else self.bootstrap(samples, **how)
        return C.sample_quantiles(drawn, quantiles, self.n, self.keys)  # the level counts calibration windows, not draws

    def aggregate(self, delta: Sequence[float], metric: str = "mae", group=None) -> DataFrame:
        """Intervals of the sum over series (all, or those of a group)."""
        return C.aggregate_conformal(self.residuals, self.point, delta, self.n, metric, ["candidate"], group)

    def release(self) -> None:
        for name in ("residuals", "point"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()
