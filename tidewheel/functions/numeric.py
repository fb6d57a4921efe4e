"""Small numerical tools for per-series estimators: distributions, optimisers, loess."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return (np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True) + 1e-300) + top).squeeze(axis)


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t)) if df > 0 and np.isfinite(t) else float("nan")


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.1, rounds: int = 400, tol: float = 1e-9) -> np.ndarray:
    n = len(start)
    points = np.vstack([start, *(start + step * np.eye(n)[k] for k in range(n))])
    values = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] < tol * (1.0 + abs(values[0])):
            break
        centre = points[:-1].mean(axis=0)
        trial = centre + (centre - points[-1])
        v = f(trial)
        if v < values[0]:
            far = centre + 2.0 * (centre - points[-1])
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (trial, v)
        elif v < values[-2]:
            points[-1], values[-1] = trial, v
        else:
            near = centre + 0.5 * ((trial if v < values[-1] else points[-1]) - centre)
            w = f(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    return points[np.argmin(values)]


def golden_section(f: Callable[[float], float], low: float, high: float, rounds: int = 60) -> float:
    g = (math.sqrt(5.0) - 1.0) / 2.0
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = f(b)
    return (low + high) / 2.0


def autocorrelation(x: np.ndarray, lags: int, adjusted: bool = True) -> np.ndarray:
    d, n = x - x.mean(), len(x)
    c = np.array([d[: n - k] @ d[k:] / (n - k if adjusted else n) for k in range(lags + 1)])
    return c / c[0]


def partial_autocorrelation(x: np.ndarray, lags: int, adjusted: bool = True) -> np.ndarray:
    """Durbin-Levinson on the autocorrelations; lag 0 is 1."""
    r = autocorrelation(x, lags, adjusted)
    out, phi = np.ones(lags + 1), np.zeros(0)
    for k in range(1, lags + 1):
        last = (r[k] - phi @ r[k - 1 : 0 : -1]) / (1.0 - phi @ r[1:k]) if k > 1 else r[1]
        phi = np.concatenate((phi - last * phi[::-1], [last]))
        out[k] = last
    return out


def loess(y: np.ndarray, span: int, weights: np.ndarray | None = None, degree: int = 1, at: np.ndarray | None = None) -> np.ndarray:
    """Tricube local regression at equally spaced points (``at`` may reach outside)."""
    n = len(y)
    x, at = np.arange(n, dtype=float), np.arange(n, dtype=float) if at is None else at
    weights, q, out = np.ones(n) if weights is None else weights, min(span, n), np.empty(len(at))
    for k, p in enumerate(at):
        begin = int(min(max(0, math.ceil(p - q / 2)), n - q))
        d = np.abs(x[begin : begin + q] - p)
        h = max(d.max(), 1e-12) * (1.0 if span <= n else span / n) * 1.0000001
        w = (1.0 - (d / h) ** 3) ** 3 * weights[begin : begin + q]
        xs, ys, total = x[begin : begin + q] - p, y[begin : begin + q], w.sum()
        if total <= 0:
            out[k] = ys.mean()
            continue
        mx, my = (w @ xs) / total, (w @ ys) / total
        sxx = w @ (xs - mx) ** 2
        slope = (w @ ((xs - mx) * (ys - my))) / sxx if degree and sxx > 1e-12 else 0.0
        out[k] = my - slope * mx
    return out


def _moving(x: np.ndarray, w: int) -> np.ndarray:
    return np.convolve(x, np.ones(w) / w, mode="valid")


def stl(y: np.ndarray, period: int, seasonal: int = 7, trend: int | None = None, inner: int = 2, robust: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, remainder) by seasonal-trend decomposition with loess."""
    n = len(y)
    if n < 2 * period:
        raise ValueError("at least two full periods are needed")
    width = trend or int(math.ceil(1.5 * period / (1.0 - 1.5 / seasonal)))
    width += 1 - width % 2
    low = period + 1 - period % 2
    level, weights, season = np.zeros(n), np.ones(n), np.zeros(n)
    for outer in range(6 if robust else 1):
        for _ in range(inner):
            detrended, cycle = y - level, np.empty(n + 2 * period)
            for p in range(period):
                part, w = detrended[p::period], weights[p::period]
                cycle[p::period] = loess(part, seasonal, w, at=np.arange(-1.0, len(part) + 1.0))
            flat = loess(_moving(_moving(_moving(cycle, period), period), 3), low)
            season = cycle[period : n + period] - flat
            level = loess(y - season, width, weights)
        rest = y - season - level
        if robust:
            h = 6.0 * np.median(np.abs(rest)) or 1.0
            weights = (1.0 - np.minimum(np.abs(rest) / h, 1.0) ** 2) ** 2
    return level, season, y - season - level


#: MacKinnon (1994) response surface for the constant-only unit-root regression, and
#: the KPSS (1992) critical values of level stationarity.
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
KPSS_STAT, KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


def adf(x: np.ndarray, lags: int | None = None) -> tuple[float, float, int]:
    """(statistic, p-value, lags) with a constant; lags by AIC up to 12 (n / 100)^(1/4)."""
    n, d = len(x), np.diff(x)
    most = int(math.ceil(12.0 * (n / 100.0) ** 0.25)) if lags is None else lags
    most = min(most, n // 2 - 3)

    def regress(k: int, begin: int) -> tuple[float, float]:
        rows = np.arange(begin, len(d))
        design = np.column_stack([x[rows], np.ones(len(rows)), *(d[rows - j] for j in range(1, k + 1))])
        coef, *_ = np.linalg.lstsq(design, d[rows], rcond=None)
        rss = float(((d[rows] - design @ coef) ** 2).sum())
        free = len(rows) - design.shape[1]
        se = math.sqrt(rss / free * np.linalg.pinv(design.T @ design)[0, 0])
        return coef[0] / se, len(rows) * math.log(rss / len(rows)) + 2 * design.shape[1]

    best = most if lags is not None else min(range(most + 1), key=lambda k: regress(k, most)[1])
    stat = regress(best, best)[0]
    if stat > ADF_MAX or stat < ADF_MIN:
        return stat, float(stat > ADF_MAX), best
    return stat, NORMAL.cdf(float(np.polyval((ADF_SMALL if stat <= ADF_STAR else ADF_LARGE)[::-1], stat))), best


def kpss(x: np.ndarray, lags: int | None = None) -> tuple[float, float, int]:
    """(statistic, p-value by interpolation, clipped to the table; lags) around a level."""
    n, e = len(x), x - x.mean()
    k = int(math.ceil(12.0 * (n / 100.0) ** 0.25)) if lags is None else lags
    s = e @ e / n + 2.0 / n * sum((1.0 - j / (k + 1.0)) * (e[j:] @ e[:-j]) for j in range(1, min(k, n - 1) + 1))
    stat = float((np.cumsum(e) ** 2).sum() / (n * n * s))
    return stat, float(np.interp(stat, KPSS_STAT, KPSS_P)), k
