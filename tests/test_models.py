"""Estimators on planted signals, and their distribution over panels, folds and candidates."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import lagfeatures as LF
from tidewheel.functions import numeric as N
from tidewheel.functions.regressors import REGRESSORS, Linear
from tidewheel.operators import diagnostics as D
from tidewheel.operators.estimators import Direct, Ets, Lagged, Naive, Prepare, Sarima
from tidewheel.operators.hmm import MarkovSwitching
from tidewheel.operators.search import Choice, Features, Uniform, backward_selection, candidate_forecasts, forward_selection, tune, tune_ets, tune_lags, tune_sarima
from tidewheel.plans import catalogue
from tidewheel.plans import forecasting as P

RNG = np.random.default_rng(3)


def seasonal(n=120, m=12):
    t = np.arange(n)
    return 50 + 0.3 * t + 8 * np.sin(2 * np.pi * t / m) + RNG.normal(0, 0.3, n)


def regimes(n=400):
    state, out, states = 0, [], []
    rng = np.random.default_rng(5)
    for _ in range(n):
        state = state if rng.random() < 0.95 else 1 - state
        states.append(state)
        out.append((3.0 if state else -3.0) + rng.normal(0, 0.7))
    return np.array(out), np.array(states)


def panel(spark, **series):
    rows = [(k, t, float(v)) for k, y in series.items() for t, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, t int, y double")


@pytest.mark.parametrize("name", sorted(REGRESSORS))
def test_regressors_fit(name):
    x = RNG.normal(size=(300, 3))
    y = 2 * x[:, 0] - x[:, 1] + RNG.normal(0, 0.1, 300)
    fit = REGRESSORS[name].fit(x, y)
    assert np.var(y - fit.predict(x)) < 0.35 * np.var(y)


@pytest.mark.parametrize("prepare", [
    Prepare(), Prepare(difference=1), Prepare(difference=2, season=0), Prepare(season=12), Prepare(trend="linear"), Prepare(trend="linear", season=12, difference=1),
    Prepare(box_cox=True), Prepare(box_cox=True, bias_adjust=True, difference=1), Prepare(trend="ets"), Prepare(trend="feature_lr"), Prepare(trend="feature_ets"), Prepare(trend="linear", breaks=[30, 60]), Prepare(trend="linear", degree=2),
])
def test_pipeline_forecasts_a_seasonal_series(prepare):
    y = seasonal()
    yhat = Lagged(12, (LF.RollingMean(1, 3), LF.ExpandingMean(1)), Linear(l2=1e-6), prepare).fit(y[:108, None]).forecast(12)[:, 0]
    # a fitted exponential trend follows the season and extrapolates its last slope
    assert np.abs(yhat - y[108:]).mean() < (25.0 if prepare.trend and "ets" in prepare.trend else 3.0)


def test_prepare_inverts():
    y = seasonal()
    for how in (Prepare(difference=2), Prepare(season=12, difference=1), Prepare(box_cox=True, trend="linear", difference=1)):
        done = how.forward(y[:100])
        again = how.forward(y)
        if not how.box_cox and how.trend is None:
            assert done.back(again.z[100:]) == pytest.approx(y[100:])


def test_var_and_criteria():
    a = np.array([[0.5, 0.2], [-0.1, 0.7]])
    y = np.zeros((500, 2))
    rng = np.random.default_rng(0)
    for i in range(1, 500):
        y[i] = 1 + a @ y[i - 1] + rng.normal(0, 0.5, 2)
    m = Lagged(1, prepare=Prepare(nonnegative=False)).fit(y)
    assert np.array([k.coef for k in m.models]) == pytest.approx(a, abs=0.1)
    assert set(m.criteria()) == {"aic", "aicc", "bic", "hqc"} and m.forecast(3).shape == (3, 2)
    m2 = Lagged({"a": [1, 2], "b": 1}, regressor=(REGRESSORS["ridge"], REGRESSORS["tree"])).fit(y)
    assert len(m2.names) == 3


def test_direct_alignment():
    y = np.arange(40.0)
    assert Direct(1, horizon=3).fit(y[:, None]).forecast(3)[:, 0] == pytest.approx([40, 41, 42])
    assert Direct(1, horizon=3, aligned=False).fit(y[:, None]).forecast(3)[:, 0] == pytest.approx([40, 41, 42])


def test_ets_and_sarima():
    y = seasonal()
    for m in (Ets("add", "add", 12), Ets("add", "mul", 12, damped=True), Sarima(1, 1, 0, 0, 1, 1, 12)):
        assert np.abs(m.fit(y[:108, None]).forecast(12)[:, 0] - y[108:]).mean() < 2.5
    level = Ets(alpha=0.3).fit(np.array([1.0, 2.0, 4.0])[:, None])
    assert level.level == pytest.approx(1.3 + 0.3 * (4 - 1.3))
    assert np.isnan(Naive(12).fit(y[:5, None]).forecast(3)).all()


@pytest.mark.parametrize("how", [{}, {"switching_scale": False}, {"covariance": "diag"}, {"method": "viterbi"}, {"restarts": 1}])
def test_markov_switching(how):
    y, states = regimes()
    m = MarkovSwitching(2, 1, **how).fit(y[:, None])
    found = m.states()
    agree = (found == states[1:]).mean()
    assert max(agree, 1 - agree) > 0.9
    assert all(b >= a - 1e-4 for a, b in zip(m.path, m.path[1:]))
    assert np.allclose(m.gamma.sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1)
    assert m.forecast(4).shape == (4, 1) and len(m.parameters()) == 4
    assert all(0 <= p["p_value"] <= 1 for p in m.parameters())


def test_markov_switching_var():
    y, _ = regimes()
    m = MarkovSwitching(2, 1, rounds=30).fit(np.column_stack([y, -y + RNG.normal(0, 0.5, len(y))]))
    assert m.forecast_regimes(3)[1].shape == (3, 2, 2) and m.cov.shape == (2, 2, 2)


def test_numeric_tools():
    assert N.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    walk, noise = np.cumsum(np.random.default_rng(1).normal(size=400)), np.random.default_rng(2).normal(size=400)
    assert N.adf(noise)[1] < 0.01 < 0.05 < N.adf(walk)[1]
    assert N.kpss(noise)[1] >= 0.05 > N.kpss(walk)[1]
    y = seasonal(240, 24)
    level, season, rest = N.stl(y, 24)
    assert level + season + rest == pytest.approx(y) and rest.var() < 0.05 * y.var()
    ar = np.zeros(3000)
    for i in range(2, 3000):
        ar[i] = 0.5 * ar[i - 1] + 0.3 * ar[i - 2] + RNG.normal()
    p = N.partial_autocorrelation(ar, 4)
    assert p[2] == pytest.approx(0.3, abs=0.06) and abs(p[3]) < 0.07


def test_diagnostics(spark):
    y = seasonal()
    both = panel(spark, a=y, b=np.random.default_rng(1).normal(size=120))
    out = {r.series_id: r for r in D.strengths(both, 12).collect()}
    assert out["a"].trend_strength > 0.9 and out["a"].seasonality_strength > 0.9 > out["b"].seasonality_strength
    acf = {r.lag: r.acf for r in D.autocorrelation(both, 3).where("series_id = 'a'").collect()}
    assert [acf[k] for k in range(4)] == pytest.approx(list(N.autocorrelation(y, 3)))
    assert D.pacf_strength(both, 5).where("series_id = 'a' and lags = 1").count() == 1
    assert {r.series_id: r.ndiffs for r in D.differences_needed(both).collect()} == {"a": 1, "b": 0}
    assert D.decompose(both, 12).count() == 240


def test_panel_forecast_equals_single(spark):
    y, z = seasonal(), regimes()[0][:120] + 10
    out = P.forecast(panel(spark, a=y, b=z), {0: Lagged(2), 1: Naive(12)}, 3)
    alone = Lagged(2).fit(y[:, None]).forecast(3)[:, 0]
    assert [r.yhat for r in out.where("series_id = 'a' and candidate = 0").orderBy("h").collect()] == pytest.approx(list(alone))
    assert out.count() == 12


def test_exogenous(spark):
    x = RNG.normal(size=90)
    y = 10 + 3 * x + RNG.normal(0, 0.01, 90)
    df = spark.createDataFrame([("a", t, float(y[t]), float(x[t])) for t in range(80)], "series_id string, t int, y double, x double")
    future = spark.createDataFrame([("a", h, float(x[79 + h])) for h in range(1, 11)], "series_id string, h int, x double")
    out = P.forecast(df, Lagged(1), 10, exog=["x"], future=future).orderBy("h").collect()
    assert [r.yhat for r in out] == pytest.approx(list(y[80:]), abs=0.1)


def test_backtest_and_cross_validation(spark):
    df = panel(spark, a=seasonal(), b=seasonal(40))
    rows = P.backtest(df, {0: Naive(12), 1: Lagged(12)}, 3, 6, 2)
    assert rows.count() == 2 * 3 * 2 * 6
    cv = P.cross_validate(df, Naive(12), 3, 6, ["MAE", "MASE"], 2, split=2)
    assert cv.count() == 4 and {"score", "score_before_2", "score_after_2"} <= set(cv.columns)
    short = P.backtest(panel(spark, a=[1, 2, 3]), Lagged(5), 2, 2)
    assert short.count() == 0
    warm = P.cross_validate(panel(spark, a=regimes()[0][:150]), MarkovSwitching(2, 1, rounds=20), 3, 4, ["MAE"], 1, warm_rounds=2)
    assert warm.count() == 1


def test_search_finds_planted_lag(spark):
    y = [1.0, -1.0, 2.0]
    rng = np.random.default_rng(4)
    for i in range(3, 160):
        y.append(0.9 * y[i - 3] + rng.normal(0, 0.3))
    df = panel(spark, a=np.array(y))
    build = lambda f: Lagged(list(f.lags), f.transforms, prepare=Prepare(nonnegative=False))
    best, score = forward_selection(df, build, ["MAE"], 6, 3, lags=[1, 2, 3])
    assert 3 in best.lags and score[0] < 1
    by_ic, _ = forward_selection(df, build, [], 0, 0, lags=[1, 2, 3], validation="BIC")
    assert by_ic.lags == (3,)
    kept, _ = backward_selection(df, build, ["MAE"], 6, 3, Features((1, 2, 3)))
    assert 3 in kept.lags
    lags, _ = tune_lags(df, lambda k: build(Features(k)), [1, 2, 3], "MAE", 4, 3, trials=8)
    assert 3 in lags
    params, history = tune(df, lambda d: Lagged(3, regressor=Linear(l2=d["l2"])), {"l2": Uniform(0.01, 10, log=True), "z": Choice((1,))}, "MAE", 2, 3, trials=10, batch=5)
    assert len(history) == 10 and 0.01 <= params["l2"] <= 10
    model, _ = tune_ets(df, 12, "MAE", 2, 3, trials=6)
    assert isinstance(model, Ets)
    grid = tune_sarima(df, 1, 0, 1, 0, 0, 0, 1).collect()
    assert [r.aic for r in grid] == sorted(r.aic for r in grid) and len(grid) == 4
    assert candidate_forecasts(df, {0: Lagged(1), 1: Lagged(3)}, 2).columns[-2:] == ["horizon_1", "horizon_2"]


def test_pooled(spark):
    from tidewheel.operators import pooled

    df = panel(spark, a=np.arange(60.0), b=np.arange(5.0, 65.0))
    out = pooled.forecast(pooled.fit(df, 2), df, 2, 3).orderBy("series_id", "h").collect()
    assert [r.yhat for r in out] == pytest.approx([60, 61, 62, 65, 66, 67], abs=0.05)


def test_reports(spark):
    df = panel(spark, a=regimes()[0])
    m = MarkovSwitching(2, 1, rounds=20)
    assert P.fit_reports(df, m, "states").count() == 399
    assert P.fit_reports(df, m, "criteria").count() == 4
    assert P.fit_reports(df, m, "regimes").count() == 2
    assert P.fit_reports(df, m, "covariance").count() == 2


def test_probabilistic(spark):
    from tidewheel.plans.probabilistic import Probabilistic

    p = Probabilistic(panel(spark, a=seasonal(), b=seasonal()), {0: Naive(12), 1: Lagged(12)}, 8, 3)
    out = p.intervals([0.5, 0.8])
    assert out.count() == 2 * 2 * 3 * 2 and out.where("lower > yhat or yhat > upper").count() == 0
    assert p.quantiles([0.3, 0.5, 0.7]).count() == 36 and p.distribution().count() == 2 * 2 * 3 * 8
    assert p.bootstrap(50).count() == 600 and p.bootstrap_quantiles([0.1, 0.8], "correlated", 100).count() == 24
    # the level counts calibration windows, whatever the number of draws: ceil(0.3 * 9) / 8 of 64 draws
    drawn = sorted(r.value for r in p.bootstrap(64, "empirical").where("series_id = 'a' and candidate = 1 and h = 2").collect())
    level = p.bootstrap_quantiles([0.3], samples=64, kind="empirical").where("series_id = 'a' and candidate = 1 and h = 2").first().value
    assert level == drawn[math.floor(3 / 8 * 63)]
    with pytest.raises(ValueError):
        p.bootstrap_quantiles([0.9], "correlated", 100)
    assert p.aggregate([0.5]).count() == 6 and "lower_50" in p.intervals(0.5, wide=True).columns
    p.release()


def test_importances_name_the_signal():
    y = [1.0, 2.0, 3.0]
    for _ in range(200):
        y.append(0.9 * y[-3] + RNG.normal(0, 0.5))
    m = Lagged([1, 2, 3], prepare=Prepare(nonnegative=False)).fit(np.array(y)[:, None])
    assert max(m.importances(), key=lambda r: r[2])[1] == "y0_lag_3"


def test_bartlett_bounds_of_a_cross_correlation(spark):
    rng = np.random.default_rng(3)
    x, y, n = rng.normal(size=40), rng.normal(size=40), 40
    r = [((y[: n - k] - y.mean()) * (x[k:] - x.mean())).sum() / n / (x.std() * y.std()) * n / (n - k) for k in range(6)]
    panel = spark.createDataFrame([("a", t, float(x[t]), float(y[t])) for t in range(n)], "series_id string, t int, x double, y double")
    for row in D.cross_correlation(panel, 5, alpha=0.05, bartlett=True).collect():
        se = math.sqrt((1 + 2 * sum(v * v for v in r[1 : row.lag])) / n) if row.lag else 0.0
        assert (row.ccf, row.lower, row.upper) == pytest.approx((r[row.lag], r[row.lag] - 1.959963984540054 * se, r[row.lag] + 1.959963984540054 * se))


def test_ccf_bartlett_has_bounds_at_every_lag(spark):
    rows = catalogue.QUERIES["ccf_bartlett"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 7 and all(r.lower < r.ccf < r.upper if r.lag else r.lower == r.ccf == r.upper for r in rows)


def test_selection_keeps_the_best_that_improves_all_metrics(spark, monkeypatch):
    from tidewheel.operators import search

    # the lexicographic first is worse in the second metric; a later one improves both
    assert search._best_of({0: [1.0, 9.0], 1: [2.0, 3.0], 2: [1.5, 2.0], 3: [1.4, 2.5]}, [3.0, 4.0], "all") == 2
    assert search._best_of({0: [1.0, 9.0]}, [3.0, 4.0], "all") is None
    # what one starts from is scored first: additions that are worse are refused
    worth = {(1,): [1.0], (1, 2): [2.0], (1, 3): [3.0]}
    monkeypatch.setattr(search, "_judge", lambda panel, build, options, *a, **how: {k: worth[f.lags] for k, f in enumerate(options)})
    assert search.forward_selection(None, None, ["MAE"], 3, 3, lags=[1, 2, 3], start=search.Features(lags=(1,))) == (search.Features(lags=(1,)), [1.0])


def test_lags_are_selected_per_target(spark):
    from tidewheel.operators.search import per_target

    assert per_target([(0, 1), (0, 3), (1, 2)], 3) == {0: [1, 3], 1: [2], 2: []}
    found = {(r.target, r.lag) for r in catalogue.QUERIES["forward_selection_by_target"](spark, "/root/testdata/sf0.001").collect()}
    assert found and found <= {(0, 1), (0, 2), (1, 1), (1, 2)}


def test_wrong_configurations_fail_and_short_series_are_named(spark):
    class Wrong:
        def fit(self, y, x=None):
            raise ValueError("wrong in every series")

    df = panel(spark, a=seasonal(), b=[1.0, 2.0, 3.0])
    with pytest.raises(ValueError, match="unknown trend"):
        Prepare(trend="sideways")
    with pytest.raises(ValueError, match="no further"):
        P.forecast(df, Direct(1, horizon=3), 5)
    with pytest.raises(Exception, match="wrong in every series"):
        P.forecast(df, Wrong(), 2).collect()
    rows = P.fit_reports(df, {0: Lagged(12), 1: Naive(1)}, "failures").collect()
    assert [(r.series_id, r.candidate) for r in rows] == [("b", 0)] and "shorter" in rows[0].reason
    assert {r.series_id for r in P.forecast(df, Lagged(12), 2).collect()} == {"a"}


def test_markov_switching_given_parameters():
    y = regimes()[0][:, None]
    given = dict(initial=[0.5, 0.5], transitions=[[0.95, 0.05], [0.05, 0.95]], coefficients=[[-3.0, 0.0], [3.0, 0.0]], stds=[1.0, 1.0])
    held = MarkovSwitching(2, 1, rounds=0, **given).fit(y)
    # the log likelihood of these parameters, by the plain forward recursion
    x, z = y[:-1, 0], y[1:, 0]
    density = np.exp(-0.5 * np.array([(z + 3.0) ** 2, (z - 3.0) ** 2])) / math.sqrt(2 * math.pi)
    a, total = np.array([0.5, 0.5]) * density[:, 0], 0.0
    for t in range(len(z)):
        if t:
            a = (a @ np.array(given["transitions"])) * density[:, t]
        total, a = total + math.log(a.sum()), a / a.sum()
    assert held.log_likelihood == pytest.approx(total) and len(x) == len(z)
    drawn = MarkovSwitching(2, 1, rounds=5, start_prior=1e3, move_prior=1e5).fit(y)
    assert np.isfinite(drawn.log_likelihood)
    with pytest.raises(ValueError):
        MarkovSwitching(2, 1, stds=[1.0])
    apart = MarkovSwitching(2, 1, constant=False, rounds=0).fit(y)
    assert np.allclose(apart.coef[0], apart.coef[1]) and apart.cov[0] < apart.cov[1]


@pytest.mark.parametrize("tr", [LF.ExpandingMean(1), LF.ExpandingMean(3), LF.ExpandingStd(2), LF.ExpandingSes(2, 0.3), LF.ExpandingQuantile(1, 0.4), LF.RollingMean(1, 4, 2)])
def test_traces_equal_steps(tr):
    z = RNG.normal(size=60) + 100.0
    z[[0, 7, 8, 30]] = np.nan
    steps = np.array([tr.step(z[:i]) if i >= tr.shift else np.nan for i in range(len(z))])
    assert np.allclose(tr.trace(z), steps, equal_nan=True)


def test_expanding_ets_is_the_fit_of_the_shifted_series():
    y = np.asarray(seasonal(), float)
    how = Ets("add", "add", 12, alpha=0.3, beta=0.1, gamma=0.2)
    tr = LF.ExpandingEts(1, how)
    assert np.allclose(tr.trace(y)[1:], how.fit(y[:-1][:, None]).fitted) and np.isnan(tr.trace(y)[0])
    assert tr.step(y) == pytest.approx(how.fit(y[:, None]).fitted[-1])
    assert Lagged([1], (tr,)).fit(y[:, None]).forecast(3).shape == (3, 1)


def test_other_columns_of_a_panel_do_not_depend_on_order(spark):
    from tidewheel.sources.panel import to_panel

    rows = [("a", f"2024-01-01 00:{m:02d}:00", 1.0, c) for m, c in ((30, "late"), (5, None), (10, "b"), (10, "a"))]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k string, at string, y double, c string").withColumn("at", F.to_timestamp("at"))
        assert [(r.y, r.c) for r in to_panel(df, "k", "at", "y", ["c"], unit="hour").collect()] == [(4.0, "a")]


def test_many_categories_as_a_vector(spark):
    from tidewheel.operators.encoders import one_hot_vector

    df = spark.createDataFrame([(f"c{k % 1500}",) for k in range(3000)] + [(None,)], "c string")
    out = one_hot_vector(df, "c")[1].collect()
    assert len(out) == 3001 and {r.c_vector.numNonzeros() for r in out} == {1} and out[0].c_vector.size >= 1500
