"""Per-series forecasters: frozen configurations whose ``fit`` gives a model that forecasts.

They run inside grouped functions (one call per series, fold and candidate), where the
recursion is inherently sequential.  ``y`` is (T, K) for K targets, ``x`` optional
exogenous columns (T, p); a forecast is (H, K).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from tidewheel.functions.lagfeatures import LagTransform, normal_lags
from tidewheel.functions.numeric import golden_section, nelder_mead
from tidewheel.functions.regressors import Linear


class TooShort(ValueError):
    """A series has too few values for a configuration; others of the panel are unaffected."""


class Gaps(TooShort):
    """A series has missing values that a model cannot bridge; others are unaffected."""


def trend_design(t: np.ndarray, degree: int | Sequence[int] = 1, breaks: Sequence[float] | None = None) -> np.ndarray:
    """Columns of a trend at positions ``t``: powers (a list names exponents), or t and its
    hinges (degree is then 1)."""
    t = np.asarray(t, float)
    if breaks is not None:
        return np.column_stack([t, *(np.maximum(0.0, t - b) for b in breaks)])
    powers = range(1, degree + 1) if isinstance(degree, int) else degree
    return np.column_stack([t**p for p in powers])


def fit_trend(y: np.ndarray, degree: int | Sequence[int] = 1, breaks: Sequence[float] | None = None):
    """(fitted trend, model) from the known values; ``forecast_trend`` evaluates the model further on."""
    design, known = trend_design(np.arange(len(y)), degree, breaks), ~np.isnan(y)
    if not known.any():
        raise TooShort("no values to fit a trend to")
    model = Linear().fit(design[known], y[known])
    return model.predict(design), model


def forecast_trend(model, h: int, start: int, degree: int | Sequence[int] = 1, breaks: Sequence[float] | None = None) -> np.ndarray:
    return model.predict(trend_design(np.arange(start, start + h), degree, breaks))


def box_cox_array(x: np.ndarray, lmda: float) -> np.ndarray:
    return np.log(x) if lmda == 0 else (x**lmda - 1.0) / lmda


def box_cox_mle(x: np.ndarray) -> float:
    logs = np.log(x).sum()
    return golden_section(lambda v: len(x) / 2.0 * math.log(max(np.var(box_cox_array(x, v)), 1e-300)) - (v - 1.0) * logs, -2.0, 3.0)


def inverse_box_cox_array(z: np.ndarray, lmda: float, biased: bool = False) -> np.ndarray:
    """``biased`` adjusts by the variance across the horizon."""
    var = float(np.var(z)) if biased else 0.0
    if lmda == 0:
        return np.exp(z) * (1.0 + var / 2.0)
    base = np.maximum(lmda * z + 1.0, 1e-12)
    return base ** (1.0 / lmda) * (1.0 + (1.0 - lmda) * var / (2.0 * base**2))


@dataclass(frozen=True)
class Prepare:
    """Box-Cox, detrending, differencing and seasonal differencing of one target, and back."""

    box_cox: bool = False
    lmda: float | None = None
    bias_adjust: bool = False
    trend: str | None = None  # linear | ets: subtracted; feature_lr | feature_ets: a feature
    degree: int | Sequence[int] = 1
    breaks: Sequence[float] | None = None
    difference: int = 0
    season: int = 0
    nonnegative: bool = True
    ets: "Ets | None" = None

    def __post_init__(self):
        if self.trend not in (None, "linear", "ets", "feature_lr", "feature_ets"):
            raise ValueError(f"unknown trend: {self.trend}")

    def forward(self, y: np.ndarray) -> "Prepared":
        state, z = Prepared(self), y.astype(float)
        if not (~np.isnan(z)).any():
            raise TooShort("the series has no values")
        if len(z) < max(self.season, self.difference):
            raise TooShort("the series is shorter than its differences reach back")
        if self.box_cox:
            state.shift = bool(np.nanmin(z) < 1.0)
            z = z + state.shift
            state.lmda = box_cox_mle(z[~np.isnan(z)]) if self.lmda is None else self.lmda
            z = box_cox_array(z, state.lmda)
        state.n = len(z)
        if self.trend in ("linear", "feature_lr"):
            state.fitted, state.model = fit_trend(z, self.degree, self.breaks)
        elif self.trend in ("ets", "feature_ets"):
            state.model = (self.ets or Ets(trend="add")).fit(z[:, None])
            state.fitted = state.model.fitted
        if self.trend in ("linear", "ets"):
            z = z - state.fitted
        state.origins = []
        for _ in range(self.difference):
            state.origins.append(z[-1])
            z = np.concatenate(([np.nan], np.diff(z)))
        if self.season:
            state.seed = z[-self.season :]
            z = np.concatenate((np.full(self.season, np.nan), z[self.season :] - z[: -self.season]))
        state.z = z
        return state


class Prepared:
    shift, lmda, fitted, model, n = False, None, None, None, 0

    def __init__(self, how: Prepare):
        self.how = how

    def ahead(self, h: int) -> np.ndarray | None:
        if self.model is None:
            return None
        if self.how.trend in ("ets", "feature_ets"):
            return self.model.forecast(h)[:, 0]
        return forecast_trend(self.model, h, self.n, self.how.degree, self.how.breaks)

    def back(self, z: np.ndarray) -> np.ndarray:
        how, out = self.how, z.astype(float).copy()
        if how.season:
            for k in range(len(out)):
                out[k] += self.seed[k] if k < how.season else out[k - how.season]
        for origin in reversed(self.origins):
            out = origin + np.cumsum(out)
        if how.trend in ("linear", "ets"):
            out = out + self.ahead(len(out))
        if how.nonnegative:
            out = np.maximum(0.0, out)
        if how.box_cox:
            out = inverse_box_cox_array(out, self.lmda, how.bias_adjust) - self.shift
        return out


@dataclass(frozen=True)
class Lagged:
    """Recursive regression on lags and lag transforms of one or several targets.

    One target with any regressor is the machine-learning forecaster, two targets the
    bidirectional one, several with least squares a VAR.  ``lags``, ``transforms`` and
    ``prepare`` take one value for all targets or one per target."""

    lags: object = 1
    transforms: Sequence = ()
    regressor: object = Linear()
    prepare: Prepare | Sequence[Prepare] = Prepare()
    history: str = "full"  # "trimmed": expanding statistics forget the warm-up rows on forecasting

    def _per(self, value, k: int, nested: bool) -> list:
        if isinstance(value, dict):
            return [value[i] if i in value else list(value.values())[i] for i in range(k)]
        return list(value) if nested and len(value) == k else [value] * k

    def _setup(self, k: int):
        lags = [normal_lags(v) for v in self._per(self.lags, k, isinstance(self.lags, (list, tuple)) and bool(self.lags) and isinstance(self.lags[0], (list, tuple)))]
        trans = self._per(self.transforms, k, bool(self.transforms) and isinstance(self.transforms[0], (list, tuple)))
        return lags, trans, self._per(self.prepare, k, isinstance(self.prepare, (list, tuple)))

    def design(self, y: np.ndarray, x: np.ndarray | None):
        """(design, responses, names, prepared targets, rows kept)."""
        k, n = y.shape[1], len(y)
        lags, trans, prep = self._setup(k)
        done = [p.forward(y[:, j]) for j, p in enumerate(prep)]
        columns, names = ([x[:, j] for j in range(x.shape[1])], [f"x{j}" for j in range(x.shape[1])]) if x is not None else ([], [])
        for j in range(k):
            for lag in lags[j]:
                columns.append(np.concatenate((np.full(min(lag, n), np.nan), done[j].z[: max(0, n - lag)])))
                names.append(f"y{j}_lag_{lag}")
        for j in range(k):
            for tr in trans[j]:
                columns.append(tr.trace(done[j].z))
                names.append((f"trg{j}_" if k > 1 else "") + tr.name)
        for j in range(k):
            if prep[j].trend in ("feature_lr", "feature_ets"):
                columns.append(done[j].fitted)
                names.append(f"trend_{j}")
        z = np.column_stack([d.z for d in done])
        design = np.column_stack(columns) if columns else np.zeros((n, 0))
        rows = ~(np.isnan(design).any(axis=1) | np.isnan(z).any(axis=1))
        return design[rows], z[rows], names, done, rows

    def fit(self, y: np.ndarray, x: np.ndarray | None = None) -> "FittedLagged":
        design, z, names, done, rows = self.design(y, x)
        if not len(z):
            raise TooShort("no complete rows: the series is shorter than its features need")
        regressors = self.regressor if isinstance(self.regressor, (list, tuple)) else [self.regressor] * z.shape[1]
        models = [r.fit(design, z[:, j]) for j, r in enumerate(regressors)]
        fitted = np.column_stack([m.predict(design) for m in models])
        return FittedLagged(self, models, names, done, z, fitted, rows, design)


@dataclass
class FittedLagged:
    config: Lagged
    models: list
    names: list
    done: list
    z: np.ndarray
    fitted: np.ndarray
    rows: np.ndarray
    inputs: np.ndarray

    def forecast(self, h: int, x: np.ndarray | None = None) -> np.ndarray:
        k = self.z.shape[1]
        lags, trans, prep = self.config._setup(k)
        start = [self.z[:, j] if self.config.history == "trimmed" else d.z for j, d in enumerate(self.done)]
        n = len(start[0])
        past = np.full((n + h, k), np.nan)
        past[:n] = np.column_stack(start)
        trends = [d.ahead(h) if prep[j].trend in ("feature_lr", "feature_ets") else None for j, d in enumerate(self.done)]
        for step in range(h):
            at = n + step
            row = list(x[step]) if x is not None else []
            row += [past[at - lag, j] for j in range(k) for lag in lags[j]]
            row += [tr.step(past[:at, j]) for j in range(k) for tr in trans[j]]
            row += [tr[step] for tr in trends if tr is not None]
            one = np.array(row)[None, :]
            past[at] = [m.predict(one)[0] for m in self.models]
        return np.column_stack([d.back(past[n:, j]) for j, d in enumerate(self.done)])

    def importances(self, seed: int = 0) -> list[tuple[int, str, float]]:
        """(target, feature, share): the loss of fit when a feature's training values are shuffled."""
        rng, out = np.random.default_rng(seed), []
        for j, m in enumerate(self.models):
            base, lost = float(((self.z[:, j] - self.fitted[:, j]) ** 2).mean()), []
            for c in range(self.inputs.shape[1]):
                mixed = self.inputs.copy()
                mixed[:, c] = rng.permutation(mixed[:, c])
                lost.append(max(0.0, float(((self.z[:, j] - m.predict(mixed)) ** 2).mean()) - base))
            total = sum(lost) or 1.0
            out += [(j, name, v / total) for name, v in zip(self.names, lost)]
        return out

    def criteria(self) -> dict[str, float]:
        """Per-n for several targets; k counts the intercept, and the variance for linear models."""
        n, p, k = len(self.z), len(self.names), self.z.shape[1]
        rest = self.z - self.fitted
        if k == 1:
            q = p + 2 if getattr(self.config.regressor, "linear", False) else p + 1
            base = n * math.log(max(float((rest**2).sum()) / n, 1e-300))
            small = 2.0 * q * (q + 1) / (n - q - 1) if n > q + 1 else math.inf
            return {"aic": base + 2 * q, "aicc": base + 2 * q + small, "bic": base + q * math.log(n), "hqc": base + 2 * q * math.log(math.log(n))}
        q = k * (p + 1)
        base = np.linalg.slogdet(np.cov(rest.T, ddof=0))[1]
        small = 2.0 * q * (q + 1) / (n - q - 1) / n if n > q + 1 else math.inf
        return {"aic": base + 2 * q / n, "aicc": base + 2 * q / n + small, "bic": base + q * math.log(n) / n, "hqc": base + 2 * q * math.log(math.log(n)) / n}


@dataclass(frozen=True)
class Direct:
    """One model per step ahead, all predicting from the last row.  ``aligned`` lets lag 1 be
    the last value seen (the correct alignment); else features hold strictly older values."""

    lags: object = 1
    transforms: Sequence = ()
    regressor: object = Linear()
    prepare: Prepare = Prepare()
    horizon: int = 1
    aligned: bool = True

    def check(self, horizon: int) -> None:
        if horizon > self.horizon:
            raise ValueError("a direct forecaster reaches no further than its horizon")

    def fit(self, y: np.ndarray, x: np.ndarray | None = None) -> "FittedDirect":
        done = self.prepare.forward(y[:, 0])
        z, late = done.z, int(self.aligned)
        lags = normal_lags(self.lags)
        n = len(z)
        # what is known once the step (or, unaligned, the step before) has been seen
        past = np.concatenate((np.full(max([*lags, 1]), np.nan), z))
        columns = [past[len(past) - n - lag + late : len(past) - lag + late] for lag in lags]
        columns += [tr.trace(np.append(z, np.nan))[late : n + late] for tr in self.transforms]
        rows, models = np.column_stack(columns), []
        for h in range(1, self.horizon + 1):
            lead = h if self.aligned else h - 1
            design, target = rows[: n - lead], z[lead:]
            if x is not None:
                design = np.column_stack([design, x[lead:]])
            good = ~(np.isnan(design).any(axis=1) | np.isnan(target))
            if not good.any():
                raise TooShort(f"no complete rows for {h} steps ahead: the series is shorter than its features need")
            models.append(self.regressor.fit(design[good], target[good]))
        last = rows[-1] if self.aligned else np.array([past[len(past) - lag] for lag in lags] + [tr.step(z) for tr in self.transforms])
        return FittedDirect(models, last, done)


@dataclass
class FittedDirect:
    models: list
    last: np.ndarray
    done: Prepared

    def forecast(self, h: int, x: np.ndarray | None = None) -> np.ndarray:
        if h > len(self.models):
            raise ValueError("a direct forecaster reaches no further than its horizon")
        rows = [self.last if x is None else np.concatenate((self.last, x[k])) for k in range(h)]
        z = np.array([m.predict(r[None, :])[0] for m, r in zip(self.models, rows)])
        return self.done.back(z)[:, None]


@dataclass(frozen=True)
class Naive:
    """The last value, or the last season repeated (NaN when the series is shorter)."""

    season: int = 1

    def fit(self, y: np.ndarray, x: np.ndarray | None = None):
        self_, seed = self, y[-self.season :] if len(y) >= self.season else np.full((self.season, y.shape[1]), np.nan)

        class Model:
            def forecast(self, h: int, x=None):
                return seed[np.arange(h) % self_.season]

        return Model()


@dataclass(frozen=True)
class Ets:
    """Exponential smoothing: additive or multiplicative trend and season, optional damping.
    Parameters that are None are estimated by least squares.  Over a missing value the states go on
    as if it had been forecast exactly."""

    trend: str | None = None
    seasonal: str | None = None
    season: int = 0
    damped: bool = False
    alpha: float | None = None
    beta: float | None = None
    gamma: float | None = None
    phi: float | None = None

    def _initial(self, y: np.ndarray):
        m = self.season
        if self.seasonal and len(y) >= 2 * m:
            once, twice = y[:m], y[m : 2 * m]
            if np.isnan(once).all() or np.isnan(twice).all():
                raise Gaps("no values within a season to start from")
            level, later = float(np.nanmean(once)), float(np.nanmean(twice))
            slope = (later - level) / m
            season = once - level if self.seasonal == "add" else once / (level or 1.0)
            season = np.where(np.isnan(season), 0.0 if self.seasonal == "add" else 1.0, season)
            if self.trend == "mul":
                slope = (later / (level or 1.0)) ** (1.0 / m)
            return level, slope, season
        at = np.flatnonzero(~np.isnan(y))[:2]
        level, steps = float(y[at[0]]), float(at[-1] - at[0])
        slope = (1.0 if self.trend == "mul" else 0.0) if len(y) > 1 else 0.0
        if len(at) > 1:
            slope = (y[at[1]] / (y[at[0]] or 1.0)) ** (1.0 / steps) if self.trend == "mul" else (y[at[1]] - y[at[0]]) / steps
        return level, slope, np.full(max(m, 1), 1.0 if self.seasonal == "mul" else 0.0)

    def _run(self, y: np.ndarray, a: float, b: float, g: float, phi: float):
        level, slope, season = self._initial(y)
        if not self.trend:
            slope = 0.0
        season, m, fitted = list(season), self.season, np.empty(len(y))
        for i, v in enumerate(y):
            base = level * slope**phi if self.trend == "mul" else level + phi * slope
            s = season[i % m] if self.seasonal else 0.0
            fitted[i] = base * s if self.seasonal == "mul" else base + s
            if v != v:
                v = fitted[i]
            plain = (v / (s or 1e-12)) if self.seasonal == "mul" else v - s
            before, level = level, a * plain + (1 - a) * base
            if self.trend == "mul":
                slope = b * level / (before or 1e-12) + (1 - b) * slope**phi
            elif self.trend:
                slope = b * (level - before) + (1 - b) * phi * slope
            if self.seasonal:
                season[i % m] = g * (v / (base or 1e-12)) + (1 - g) * s if self.seasonal == "mul" else g * (v - base) + (1 - g) * s
        return fitted, level, slope, season

    def fit(self, y: np.ndarray, x: np.ndarray | None = None) -> "FittedEts":
        y = y[:, 0] if y.ndim == 2 else y
        known = ~np.isnan(y)
        if not known.any():
            raise TooShort("the series has no values")
        if self.seasonal and len(y) < 2 * self.season:
            raise TooShort("two seasons are needed")
        given = {"a": self.alpha, "b": self.beta if self.trend else 0.0, "g": self.gamma if self.seasonal else 0.0, "phi": self.phi if self.damped else 1.0}
        free = [k for k, v in given.items() if v is None]
        limits = {"a": (1e-4, 0.9999), "b": (1e-4, 0.9999), "g": (1e-4, 0.9999), "phi": (0.8, 0.98)}

        def full(p):
            return given | {k: lo + (hi - lo) / (1.0 + math.exp(-max(-40.0, min(40.0, v)))) for k, v in zip(free, p) for lo, hi in [limits[k]]}

        def loss(p):
            with np.errstate(all="ignore"):
                e = ((y - self._run(y, **full(p))[0])[known] ** 2).sum()
            return float(e) if np.isfinite(e) else 1e300

        used = full(nelder_mead(loss, np.array([-0.5, -2.0, -2.0, 0.0][: len(free)]), 1.0, rounds=120)) if free else given
        fitted, level, slope, season = self._run(y, **used)
        return FittedEts(self, fitted, level, slope, season, used, len(y), float(((y - fitted)[known] ** 2).sum()))


@dataclass
class FittedEts:
    how: Ets
    fitted: np.ndarray
    level: float
    slope: float
    season: list
    params: dict
    n: int
    sse: float

    def forecast(self, h: int, x: np.ndarray | None = None) -> np.ndarray:
        out, phi, reach = np.empty(h), self.params["phi"], 0.0
        for k in range(h):
            reach += phi ** (k + 1)
            base = self.level * self.slope**reach if self.how.trend == "mul" else self.level + reach * self.slope
            if self.how.seasonal:
                s = self.season[(self.n + k) % self.how.season]
                base = base * s if self.how.seasonal == "mul" else base + s
            out[k] = base
        return out[:, None]


@dataclass(frozen=True)
class Sarima:
    """Seasonal ARIMA by conditional sum of squares, with optional regressors."""

    p: int = 0
    d: int = 0
    q: int = 0
    P: int = 0
    D: int = 0
    Q: int = 0
    season: int = 1
    constant: bool = True

    def fit(self, y: np.ndarray, x: np.ndarray | None = None) -> "FittedSarima":
        y, m = (y[:, 0] if y.ndim == 2 else y).astype(float), self.season
        if np.isnan(y).any():
            raise Gaps("missing values; fill them first")
        if len(y) < self.d + m * self.D + 1:
            raise TooShort("series too short for the orders")
        beta = Linear().fit(x, y).coef if x is not None else None
        w = y - x @ beta if x is not None else y.copy()
        origins = []
        for lag in [1] * self.d + [m] * self.D:
            origins.append((lag, w[-lag:].copy()))
            w = w[lag:] - w[:-lag]
        if len(w) < 3 + self.p + self.q + m * (self.P + self.Q):
            raise TooShort("series too short for the orders")
        centre = self.constant and self.d + self.D == 0
        sizes = (self.p, self.q, self.P, self.Q)

        def unpack(v):
            at, out = 0, []
            for s in sizes:
                out.append(v[at : at + s])
                at += s
            ar = np.convolve(np.concatenate(([1.0], -out[0])), self._seasonal(-out[2], m))
            ma = np.convolve(np.concatenate(([1.0], out[1])), self._seasonal(out[3], m))
            return ar, ma, v[at] if centre else 0.0

        def residuals(v):
            ar, ma, mu = unpack(v)
            x_ = np.convolve(w - mu, ar)[: len(w)]
            e = np.zeros(len(w))
            skip = len(ar) - 1
            for i in range(skip, len(w)):
                back = min(len(ma) - 1, i)
                e[i] = x_[i] - ma[1 : back + 1] @ e[i - back : i][::-1] if back else x_[i]
            return e, skip

        def loss(v):
            with np.errstate(all="ignore"):
                e, skip = residuals(v)
                s = float((e[skip:] ** 2).sum())
            return s if np.isfinite(s) and np.abs(v[: sum(sizes)]).max(initial=0.0) < 1.5 else 1e300

        start = np.concatenate((np.full(sum(sizes), 0.1), [w.mean()] if centre else []))
        v = nelder_mead(loss, start, 0.2, rounds=300) if len(start) else start
        e, skip = residuals(v)
        n, used = len(w) - skip, len(start) + 1
        sigma2 = max(float((e[skip:] ** 2).sum()) / max(n, 1), 1e-300)
        aic = n * (math.log(2 * math.pi * sigma2) + 1) + 2 * used
        return FittedSarima(*unpack(v), w, e, origins, beta, sigma2, aic, v)

    @staticmethod
    def _seasonal(c: np.ndarray, m: int) -> np.ndarray:
        out = np.zeros(len(c) * m + 1)
        out[0] = 1.0
        out[m::m] = c
        return out


@dataclass
class FittedSarima:
    ar: np.ndarray
    ma: np.ndarray
    mu: float
    w: np.ndarray
    e: np.ndarray
    origins: list
    beta: np.ndarray | None
    sigma2: float
    aic: float
    params: np.ndarray = field(repr=False, default=None)

    def forecast(self, h: int, x: np.ndarray | None = None) -> np.ndarray:
        w, e = list(self.w - self.mu), list(self.e)
        for _ in range(h):
            now = -sum(c * w[-k] for k, c in enumerate(self.ar[1:], 1) if k <= len(w)) + sum(c * e[-k] for k, c in enumerate(self.ma[1:], 1) if k <= len(e))
            w.append(now)
            e.append(0.0)
        out = np.array(w[-h:]) + self.mu
        for lag, seed in reversed(self.origins):
            full = list(seed)
            for v in out:
                full.append(v + full[-lag])
            out = np.array(full[lag:])
        if x is not None and self.beta is not None:
            out = out + x[:h] @ self.beta
        return out[:, None]
