"""Sweeps, scans with carry-over, order statistics and the Markov-switching scan, against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import lagfeatures as LF
from tidewheel.functions.numeric import adf, stl
from tidewheel.functions.numeric import loess as local_lines
from tidewheel.operators import css, hmm_scan, loess, order_statistics, scan, sweep
from tidewheel.operators.estimators import Lagged
from tidewheel.operators.folds import cutoffs
from tidewheel.operators.hmm import MarkovSwitching


def panel(spark, series):
    rows = [(k, t, None if v is None or np.isnan(v) else float(v)) for k, y in series.items() for t, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, t int, y double")


def noisy(n=120, seed=0):
    rng = np.random.default_rng(seed)
    y = np.zeros(n)
    for t in range(2, n):
        y[t] = 5.0 + 0.5 * y[t - 1] - 0.3 * y[t - 2] + rng.normal()
    return y + 1e4  # far from 0: sums around 0 would lose digits


def lag_matrix(y, lags):
    return np.column_stack([np.ones(len(y) - max(lags)), *[y[max(lags) - k : len(y) - k] for k in lags]]), y[max(lags) :]


# sweeps


def test_every_subset_equals_least_squares(spark):
    y = noisy()
    design, names = sweep.lag_design(panel(spark, {"a": y}), [1, 2, 5])
    fits = {tuple(r["columns"]): r for r in sweep.every_subset(sweep.gram(design, names), 3).collect()}
    assert len(fits) == 8
    x, z = lag_matrix(y, [1, 2, 5])
    for chosen, r in fits.items():
        part = x[:, [0, *[k + 1 for k in chosen]]]
        coef, *_ = np.linalg.lstsq(part, z, rcond=None)
        assert r.rss == pytest.approx(((z - part @ coef) ** 2).sum(), rel=1e-8)
        assert [r.coef[0], *[r.coef[k + 1] for k in chosen]] == pytest.approx(coef, rel=1e-6)
        assert all(r.coef[k + 1] == 0 for k in range(3) if k not in chosen)


def test_criteria_agree_with_the_estimator(spark):
    y = noisy()
    fitted = Lagged([1, 2]).fit(y[:, None]).criteria()
    design, names = sweep.lag_design(panel(spark, {"a": y}), [1, 2])
    whole = [r for r in sweep.every_subset(sweep.gram(design, names), 2).collect() if len(r["columns"]) == 2][0]
    assert {c: whole[c] for c in sweep.CRITERIA} == pytest.approx(fitted, rel=1e-7)


def greedy(scores, p, forward):
    best, score = (frozenset(), np.inf) if forward else (frozenset(range(p)), scores[frozenset(range(p))])
    while True:
        options = [best | {k} for k in range(p) if k not in best] if forward else [best - {k} for k in best if len(best) > 1]
        pick = min(options, key=lambda o: scores[o], default=None)
        if pick is None or scores[pick] >= score:
            return best, score
        best, score = pick, scores[pick]


@pytest.mark.parametrize("method", ["forward", "backward"])
def test_greedy_search_equals_enumeration(spark, method):
    series = {"a": noisy(), "b": noisy(60, 1), "short": noisy(9, 2), "flat": np.full(50, 3.0)}
    lags, df = [1, 2, 3, 7, 12], panel(spark, {"a": noisy(), "b": noisy(60, 1), "short": noisy(9, 2)})
    found = {r.series_id: r for r in sweep.select_features(df, lags, criteria="BIC", method=method).collect()}
    assert set(found) == {"a", "b"}  # a series with fewer rows than a fit of all needs has no row
    for name in ("a", "b"):
        x, z = lag_matrix(series[name], lags)
        scores = {}
        for m in range(1 << len(lags)):
            chosen = frozenset(k for k in range(len(lags)) if m >> k & 1)
            part = x[:, [0, *[k + 1 for k in sorted(chosen)]]]
            rss = ((z - part @ np.linalg.lstsq(part, z, rcond=None)[0]) ** 2).sum()
            scores[chosen] = len(z) * np.log(rss / len(z)) + (len(chosen) + 2) * np.log(len(z))
        best, score = greedy(scores, len(lags), method == "forward")
        assert set(found[name].features) == {f"y_lag_{lags[k]}" for k in best} and found[name].score[0] == pytest.approx(score, rel=1e-7)


def test_search_with_several_criteria_and_folds(spark):
    df = panel(spark, {"a": noisy(), "b": noisy(80, 3)})
    folds = cutoffs(df, 3, 10, 10)
    per_fold = sweep.select_features(df, [1, 2, 3], criteria="AIC_BIC", folds=folds).collect()
    assert {(r.series_id, r.fold) for r in per_fold} == {(s, f) for s in "ab" for f in (1, 2, 3)}
    for r in per_fold:
        cut = {"a": 120, "b": 80}[r.series_id] - 10 * (4 - r.fold)
        alone = sweep.select_features(panel(spark, {"a": {"a": noisy(), "b": noisy(80, 3)}[r.series_id][:cut]}), [1, 2, 3], criteria="AIC_BIC").first()
        assert r.features == alone.features and list(r.score) == pytest.approx(list(alone.score), rel=1e-7)


def test_joint_selection_averages_over_series(spark):
    series = {"a": noisy(), "b": noisy(90, 4)}
    names, score = sweep.select_features_jointly(panel(spark, series), [1, 2, 3], criteria=["bic"])
    subsets = sweep.every_subset(sweep.gram(*[sweep.lag_design(panel(spark, series), [1, 2, 3])[0], ["y_lag_1", "y_lag_2", "y_lag_3"]]), 3)
    means = {tuple(r["columns"]): r.s for r in subsets.groupBy("columns").agg(F.avg("bic").alias("s")).collect()}
    best, wanted = greedy({frozenset(k): v for k, v in means.items()}, 3, True)
    assert set(names) == {f"y_lag_{k + 1}" for k in best} and score[0] == pytest.approx(wanted, rel=1e-9)
    assert set(sweep.select_features_jointly(panel(spark, series), [1, 2, 3], criteria=["bic"], method="backward")[0]) <= {"y_lag_1", "y_lag_2", "y_lag_3"}


def test_dependent_columns_are_left_out(spark):
    df = panel(spark, {"a": noisy()}).withColumns({"one": F.lit(1.0), "twice": F.col("y") * 0 + F.col("t") * 2.0, "again": F.col("t") * 4.0 + 1.0})
    fit = sweep.solve(sweep.gram(df, ["one", "twice", "again"]), 3).first()
    slope = np.polyfit(2.0 * np.arange(120), noisy(), 1)
    assert fit.coef[1] == 0 and fit.coef[3] == 0 and [fit.coef[2], fit.coef[0]] == pytest.approx(slope, rel=1e-6)


def test_var_equals_the_estimator(spark):
    rng = np.random.default_rng(1)
    z = np.zeros((90, 3))
    for t in range(1, 90):
        z[t] = [1.0, 2.0, 3.0] + z[t - 1] @ np.array([[0.5, 0.1, 0], [0.2, 0.3, 0.1], [0, 0, 0.4]]) + rng.normal(size=3)
    df = spark.createDataFrame([("s", t, *map(float, r)) for t, r in enumerate(z)], "series_id string, t int, a double, b double, c double")
    for lags in ([1], [1, 3]):
        fitted = Lagged(lags).fit(z)
        model = sweep.fit_var(df, lags, ["a", "b", "c"])
        rows = {(r.target, r.h): r.yhat for r in sweep.forecast_var(model, lags, ["a", "b", "c"], 5).collect()}
        wanted = fitted.forecast(5)
        assert rows == pytest.approx({(t, h + 1): wanted[h, j] for h in range(5) for j, t in enumerate("abc")}, rel=1e-7)
        assert {c: sweep.var_criteria(model, lags, ["a", "b", "c"]).first()[c] for c in sweep.CRITERIA} == pytest.approx(fitted.criteria(), rel=1e-7)


def test_adf_equals_regressions(spark):
    rng = np.random.default_rng(5)
    series = {"walk": np.cumsum(rng.normal(size=150)), "noise": rng.normal(size=90), "short": rng.normal(size=3)}
    for choose in (True, False):
        found = {r.series_id: r for r in sweep.adf(panel(spark, series), 4, choose=choose).collect()}
        for name in ("walk", "noise"):
            if not choose:
                stat, p, lags = adf(series[name], 4)
            else:
                x, d = series[name], np.diff(series[name])
                rows = lambda k, begin: (np.column_stack([x[begin : len(d)], np.ones(len(d) - begin), *[d[begin - j : len(d) - j] for j in range(1, k + 1)]]), d[begin:])
                rss = [((z - a @ np.linalg.lstsq(a, z, rcond=None)[0]) ** 2).sum() for a, z in (rows(k, 4) for k in range(5))]
                lags = int(np.argmin([len(d[4:]) * np.log(r / len(d[4:])) + 2 * (k + 2) for k, r in enumerate(rss)]))
                stat, p, _ = adf(x, lags)
            r = found[name]
            assert r.used_lags == lags and r.statistic == pytest.approx(stat, rel=1e-8) and r.p_value == pytest.approx(p, abs=1e-6)


# scans


@pytest.mark.parametrize("chunk", [7, 50, 1 << 16])
def test_running_values_carry_over(spark, chunk):
    rng = np.random.default_rng(0)
    series = {"a": np.where(rng.random(160) < 0.3, np.nan, rng.integers(0, 3, 160)), "b": np.full(20, np.nan), "c": np.array([1.0])}
    df = panel(spark, series)
    out = scan.running(df, {"s": ("sum", F.col("y")), "m": ("max", F.col("y")), "l": ("last", F.col("y"))}, chunk=chunk)
    before = scan.running(df, {"s": ("sum", F.col("y")), "l": ("last", F.col("y"))}, chunk=chunk, excluding=True)
    for name, y in series.items():
        s = pd.Series(y)
        got = out.where(F.col("series_id") == name).orderBy("t").toPandas()
        assert got.s.tolist() == s.fillna(0).cumsum().tolist()
        assert got.m.fillna(-1).tolist() == s.cummax().ffill().fillna(-1).tolist() and got.l.fillna(-1).tolist() == s.ffill().fillna(-1).tolist()
        late = before.where(F.col("series_id") == name).orderBy("t").toPandas()
        assert late.s.tolist() == s.fillna(0).cumsum().shift(fill_value=0).tolist() and late.l.fillna(-1).tolist() == s.ffill().shift().fillna(-1).tolist()


@pytest.mark.parametrize("chunk", [11, 1 << 16])
def test_scans_equal_windows(spark, chunk):
    rng = np.random.default_rng(3)
    df = panel(spark, {"a": np.where(rng.random(100) < 0.2, np.nan, rng.normal(50, 3, 100)), "b": rng.normal(size=13)})
    both = lambda a, b: [(tuple(x), tuple(y)) for x, y in zip(a.orderBy("series_id", "t").collect(), b.orderBy("series_id", "t").collect())]
    mean, std = LF.ExpandingMean(3), LF.ExpandingStd(3)
    windows = LF.add_lags(df, None, transforms=[mean, std]).select("series_id", "t", mean.name, std.name)
    for a, b in both(windows, scan.expanding(df, 3, mean="m", std="s", chunk=chunk).select("series_id", "t", "m", "s")):
        assert a[:2] == b[:2] and all((x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9)) for x, y in zip(a[2:], b[2:]))
    rolling = [LF.RollingMean(2, 9, 2), LF.RollingQuantile(1, 5, 1, 0.25)]
    names = [r.name for r in rolling]
    for a, b in both(LF.add_lags(df, None, transforms=rolling).select("series_id", "t", *[f"`{n}`" for n in names]), scan.windowed(df, rolling, chunk=chunk).select("series_id", "t", *[f"`{n}`" for n in names])):
        assert a == pytest.approx(b)
    with pytest.raises(TypeError):
        scan.windowed(df, [mean])


def test_smoothing_scan_skips_gaps(spark):
    y = np.array([np.nan, 4.0, np.nan, 8.0, 2.0, np.nan, 6.0])
    found = [r.level for r in scan.smoothed(panel(spark, {"a": y, "b": [np.nan]}), 0.5, chunk=3).where("series_id = 'a'").orderBy("t").collect()]
    assert found == [None, 4.0, 4.0, 6.0, 4.0, 4.0, 5.0]


def test_numbers_are_dense_whatever_the_ranges(spark):
    rows = [("hot", i % 37, i) for i in range(3000)] + [("b", 1, 1), ("c", 5, 2), ("c", 4, 9)]
    found = scan.numbered(spark.createDataFrame(rows, "series_id string, ts int, id int").repartition(5), order=["ts", "id"]).collect()
    for name in ("hot", "b", "c"):
        own = sorted((r.ts, r.id, r.t) for r in found if r.series_id == name)
        assert [t for *_, t in own] == list(range(len(own)))


@pytest.mark.parametrize("chunk", [13, 1 << 16])
@pytest.mark.parametrize("q,shift", [(0.5, 1), (0.9, 0), (0.0, 2), (1.0, 1)])
def test_expanding_quantile_equals_sorting(spark, q, shift, chunk):
    rng = np.random.default_rng(7)
    series = {"a": np.where(rng.random(90) < 0.2, np.nan, rng.integers(0, 9, 90)), "b": rng.normal(size=20), "none": [np.nan] * 5, "c": [2.0]}  # ties and gaps
    out = order_statistics.expanding_quantile(panel(spark, series), q, shift, chunk=chunk)
    for name, y in series.items():
        got = [r.value for r in out.where(F.col("series_id") == name).orderBy("t").collect()]
        assert len(got) == len(y)
        for t, value in enumerate(got):
            seen = np.array(y[: max(0, t - shift + 1)], float)
            seen = seen[~np.isnan(seen)]
            assert value == (None if not len(seen) else pytest.approx(np.quantile(seen, q)))


def test_expanding_quantile_of_a_long_series(spark):
    n = 30_000
    df = spark.range(n).select(F.lit("a").alias("series_id"), F.col("id").cast("int").alias("t"), F.pmod(F.col("id") * 7919, F.lit(10_007)).cast("double").alias("y"))
    found = {r.t: r.value for r in order_statistics.expanding_quantile(df, 0.5, 1, chunk=4000).where("t in (1, 2, 999, 20000, 29999)").collect()}
    y = (np.arange(n) * 7919) % 10_007
    assert found == {t: float(np.median(y[:t])) for t in found} and len(found) == 5


# Markov switching


def test_switching_scan_equals_the_estimator(spark):
    rng = np.random.default_rng(2)
    y, state = np.zeros(150), 0
    for t in range(1, 150):
        state = state if rng.random() < 0.93 else 1 - state
        y[t] = (2.0, 9.0)[state] + 0.3 * y[t - 1] + rng.normal(0, (0.5, 1.5)[state])
    other = rng.normal(size=40)
    for rounds in (0, 4):
        params, smoothed = hmm_scan.fit(panel(spark, {"a": y, "b": other, "short": other[:3]}), 2, 1, rounds=rounds, chunk=16)
        evidence = {r.series_id: r.log_likelihood for r in hmm_scan.evidence(smoothed).collect()}
        assert set(evidence) == {"a", "b"}
        for name, values in (("a", y), ("b", other)):
            fitted = MarkovSwitching(2, 1, rounds=rounds).fit(values[:, None])
            assert evidence[name] == pytest.approx(fitted.log_likelihood, rel=1e-8)
            rows = smoothed.where(F.col("series_id") == name).orderBy("t").collect()
            assert np.allclose(np.array([r.gamma for r in rows]).T, fitted.gamma, atol=1e-7)
            p = params.where(F.col("series_id") == name).first()
            assert np.allclose(np.array(p.coef), fitted.coef[:, :, 0], rtol=1e-5, atol=1e-6) and np.allclose(np.array(p.sd) ** 2, fitted.cov[:, 0, 0], rtol=1e-6)
            assert np.allclose(np.array(p.move).reshape(2, 2), fitted.move, atol=1e-7) and np.allclose(p.pi, fitted.pi, atol=1e-7)
    states = hmm_scan.states(smoothed).where("series_id = 'a'").orderBy("t").collect()
    assert [r.state for r in states] == list(np.array([r.gamma for r in smoothed.where("series_id = 'a'").orderBy("t").collect()]).argmax(axis=1))
    shares = [r.share for r in hmm_scan.regime_weights(smoothed).where("series_id = 'a'").collect()]
    assert sum(shares) == pytest.approx(1.0)


@pytest.mark.parametrize("regimes", [1, 3])
def test_switching_scan_with_other_numbers_of_regimes(spark, regimes):
    y = np.random.default_rng(4).normal(size=60)
    _, smoothed = hmm_scan.fit(panel(spark, {"a": y}), regimes, [1, 2], rounds=2, chunk=9)
    fitted = MarkovSwitching(regimes, [1, 2], rounds=2).fit(y[:, None])
    assert hmm_scan.evidence(smoothed).first().log_likelihood == pytest.approx(fitted.log_likelihood, rel=1e-8)


# conditional sums of squares


def test_sum_of_squares_equals_the_recursion(spark):
    rng = np.random.default_rng(6)
    w, phi, theta, season_phi, season_theta, m = rng.normal(size=40), [0.4, -0.2], [0.3], [0.5], [-0.4], 4
    ar = -np.convolve([1.0, -phi[0], -phi[1]], [1.0, 0, 0, 0, -season_phi[0]])  # w_t = ar_1 w_(t-1) + ... + e_t + ma_1 e_(t-1) + ...
    ma = np.convolve([1.0, theta[0]], [1.0, 0, 0, 0, season_theta[0]])
    lit = lambda v: [F.lit(x) for x in v]
    frame = spark.createDataFrame([(w.tolist(),)], "w array<double>")
    a, b = F.array(*css.product(lit(phi), lit(season_phi), m, -1.0)), F.array(*css.product(lit(theta), lit(season_theta), m, 1.0))
    found = frame.withColumns({"a": a, "b": b}).select("a", "b", css.sum_of_squares(F.col("w"), F.col("a"), F.col("b")).alias("s")).first()
    e, total = np.zeros(40), 0.0
    for t in range(6, 40):
        e[t] = w[t] - sum(ar[k] * w[t - k] for k in range(1, 7)) - sum(ma[k] * e[t - k] for k in range(1, 6) if t - k >= 6)
        total += e[t] ** 2
    assert found.s == pytest.approx(total)


def test_search_of_orders(spark):
    rng = np.random.default_rng(9)
    y = np.zeros(200)
    for t in range(1, 200):
        y[t] = 0.7 * y[t - 1] + rng.normal()
    df = panel(spark, {"a": y + 20.0, "gap": np.where(np.arange(40) == 7, np.nan, 1.0), "tiny": [1.0, 2.0]})
    found = {(r.series_id, r.order): r for r in css.search_orders(df, 1, 0, 1, 0, 0, 0, 1, steps=5, rounds=4).collect()}
    assert {s for s, _ in found} == {"a"} and len(found) == 4
    assert found["a", "(1, 0)x(0, 0)"].parameters[0] == pytest.approx(0.7, abs=0.12) and found["a", "(1, 0)x(0, 0)"].aic < found["a", "(0, 0)x(0, 0)"].aic - 50
    seasonal = css.search_orders(panel(spark, {"s": 30.0 + 5.0 * np.sin(np.arange(60) * np.pi / 2) + rng.normal(size=60)}), 0, 0, 0, 1, 1, 0, 4, steps=5, rounds=2)
    assert {r.order for r in seasonal.collect()} == {"(0, 0)x(0, 0)", "(0, 0)x(1, 0)"}


# local regression


@pytest.mark.parametrize("span,extend", [(5, 0), (7, 1), (6, 0), (25, 1)])
def test_loess_frames_equal_local_lines(spark, span, extend):
    rng = np.random.default_rng(3)
    series = {"a": rng.normal(size=40), "b": rng.normal(size=span), "c": rng.normal(size=4), "d": rng.normal(size=span + 1)}
    out = loess.loess(panel(spark, series), span, extend=extend).collect()
    for name, y in series.items():
        got = {r.t: r.smooth for r in out if r.series_id == name}
        at = np.arange(-float(extend), len(y) + extend)
        assert got == pytest.approx(dict(zip(at.astype(int).tolist(), local_lines(y, span, at=at))), abs=1e-9)


def test_decomposition_equals_the_packed_one(spark):
    rng = np.random.default_rng(4)
    y = 20.0 + 0.1 * np.arange(75) + 3.0 * np.sin(np.arange(75) * 2 * np.pi / 6) + rng.normal(0, 0.3, 75)
    rows = loess.decompose(panel(spark, {"a": y, "short": y[:11], "gap": np.where(np.arange(40) == 3, np.nan, y[:40])}), 6).orderBy("t").collect()
    assert {r.series_id for r in rows} == {"a"}
    level, season, rest = stl(y, 6)
    assert np.allclose([r.trend for r in rows], level) and np.allclose([r.seasonal for r in rows], season) and np.allclose([r.remainder for r in rows], rest)
    strong = loess.strengths(panel(spark, {"a": y}), 6).first()
    assert strong.seasonality_strength > 0.9 and strong.trend_strength > 0.9
