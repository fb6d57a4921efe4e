"""One short or gapped series never fails a job: it has no rows, and its reason is told."""

import numpy as np
import pytest

from tidewheel.functions import lagfeatures as LF
from tidewheel.functions.regressors import REGRESSORS
from tidewheel.operators import encoders
from tidewheel.operators.estimators import Direct, Ets, Lagged, Naive, Prepare, Sarima, TooShort
from tidewheel.operators.hmm import MarkovSwitching
from tidewheel.plans import forecasting as P
from tidewheel.streaming import features

MODELS = {
    "lags": Lagged([1, 2]), "season": Lagged(1, prepare=Prepare(season=12)), "differences": Lagged(1, prepare=Prepare(difference=2)), "box_cox": Lagged(1, prepare=Prepare(box_cox=True)),
    "linear": Lagged(1, prepare=Prepare(trend="linear")), "trend_ets": Lagged(1, prepare=Prepare(trend="ets")), "feature": Lagged(1, prepare=Prepare(trend="feature_lr")), "forest": Lagged(2, regressor=REGRESSORS["forest"]),
    "transforms": Lagged(1, (LF.ExpandingMean(1), LF.RollingStd(1, 3), LF.ExpandingEts(1, Ets()))), "trimmed": Lagged(1, (LF.ExpandingMean(5),), history="trimmed"),
    "direct": Direct(2, horizon=2), "late": Direct(2, (LF.RollingMean(1, 2),), horizon=2, aligned=False), "naive": Naive(3), "ets": Ets(), "holt": Ets("add", damped=True), "winters": Ets("add", "mul", 2), "growth": Ets("mul"),
    "sarima": Sarima(1, 1, 1), "seasonal": Sarima(0, 0, 0, 1, 1, 0, 4), "switching": MarkovSwitching(2, 1, rounds=3),
}


@pytest.mark.parametrize("name", sorted(MODELS))
@pytest.mark.parametrize("n", range(7))
def test_every_length(name, n):
    y = np.array([3.0, 5.0, 4.0, 6.0, 5.0, 8.0])[:n, None]
    try:
        out = MODELS[name].fit(y).forecast(2)
    except TooShort:
        return
    assert out.shape == (2, 1) and (name in ("naive", "trimmed") or np.isfinite(out).all())  # a trimmed history may be too short for a feature


def test_jobs_go_on(spark):
    lengths = {f"s{n}": n for n in range(1, 7)} | {"whole": 60}
    rows = [(s, t, 10.0 + (t % 4) + 0.1 * t) for s, n in lengths.items() for t in range(n)] + [("gap", t, None if t in (5, 20) else 10.0 + t % 4) for t in range(50)] + [("null", t, None) for t in range(9)]
    df, models = spark.createDataFrame(rows, "series_id string, t int, y double"), dict(enumerate(MODELS.values()))
    found = P.forecast(df, models, 2).collect()
    assert {r.candidate for r in found if r.series_id == "whole"} == set(models) and not any(r.yhat is None for r in found if r.series_id == "whole")
    failed = {(r.series_id, r.candidate): r.reason for r in P.fit_reports(df, models, "failures").collect()}
    done = {(r.series_id, r.candidate) for r in found}
    assert done.isdisjoint(failed) and done | set(failed) == {(s, k) for s in [*lengths, "gap", "null"] for k in models}
    names = list(MODELS)
    assert "missing values" in failed["gap", names.index("sarima")]
    assert all(r.yhat is not None for r in found if r.series_id == "gap" and names[r.candidate] in ("ets", "holt", "winters", "linear"))
    # folds with no training part, and a series of exactly the horizon
    tested = P.backtest(df, models, 4, 2, 1).collect()
    assert {r.candidate for r in tested if r.series_id == "whole"} == set(models)
    assert P.cross_validate(df, models, 4, 2, ["MAE"], 1).count() > 0


def test_smoothing_goes_on_over_gaps():
    y = 50.0 + np.arange(40) * 0.5
    gapped = y.copy()
    gapped[[7, 8, 21]] = np.nan
    fitted = Ets("add", alpha=0.5, beta=0.2).fit(gapped[:, None])
    assert np.allclose(fitted.fitted[30:], y[30:], atol=1e-3) and np.allclose(fitted.forecast(3)[:, 0], y[-1] + 0.5 * np.arange(1, 4), atol=1e-3)
    trend = Lagged(1, prepare=Prepare(trend="linear", nonnegative=False)).fit(gapped[:, None])
    assert np.allclose(trend.forecast(2)[:, 0], y[-1] + 0.5 * np.arange(1, 3), atol=1e-6)


@pytest.mark.parametrize("shift", [0, 1, 5])
def test_features_read_no_later_values(shift):
    for n in range(7):
        step = LF.ExpandingMean(shift).step(np.arange(1.0, n + 1))
        seen = np.arange(1.0, n + 1)[: max(0, n - shift + 1)]
        assert np.isnan(step) if not len(seen) else step == seen.mean()


@pytest.mark.parametrize("aligned", [True, False])
def test_direct_features_equal_steps(aligned):
    y = np.random.default_rng(0).normal(size=30) + 5.0
    transforms = (LF.RollingMean(1, 4), LF.ExpandingQuantile(2, 0.3), LF.ExpandingSes(1, 0.4))
    model = Direct([1, 3], transforms, horizon=3, aligned=aligned).fit(y[:, None])
    late = int(aligned)
    rows = [[y[i - k + late] if i - k + late >= 0 else np.nan for k in (1, 3)] + [tr.step(y[: i + late]) for tr in transforms] for i in range(30)]
    for h in (1, 2, 3):
        lead = h if aligned else h - 1
        x, z = np.array(rows[: 30 - lead]), y[lead:]
        good = ~np.isnan(x).any(axis=1)
        coef, *_ = np.linalg.lstsq(np.column_stack([np.ones(good.sum()), x[good]]), z[good], rcond=None)
        last = rows[-1] if aligned else [y[-1], y[-3], *[tr.step(y) for tr in transforms]]
        assert model.forecast(3)[h - 1, 0] == pytest.approx(coef[0] + np.dot(coef[1:], last), rel=1e-6)


def test_category_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("c",)], "k string")
    model, out = encoders.index_categories(df.where("k <> 'c'"), "k")
    assert {r.k: r.k_index for r in out.collect()} == {"a": 0.0, "b": 1.0}
    assert {r.k: r.k_index for r in model.transform(df).collect()} == {"a": 0.0, "b": 1.0, "c": 2.0}


def test_running_errors_of_two_streams(spark, tmp_path):
    def source(name, rows, column):
        frame = spark.createDataFrame(rows, f"series_id string, ts timestamp, {column} double")
        frame.write.parquet(str(tmp_path / name / "one"))
        return features.read_stream(spark, str(tmp_path / name / "*"), frame.schema)

    at = lambda h: __import__("datetime").datetime(2024, 1, 1, h)
    actual = source("y", [("a", at(1), 5.0), ("a", at(2), 7.0), ("b", at(1), 1.0)], "y")
    told = source("f", [("a", at(1), 4.0), ("a", at(2), 9.0), ("b", at(3), 2.0)], "yhat")
    features.run_available(features.running_errors(actual, told), "tidewheel_errors", str(tmp_path / "ck"))
    assert sorted((r.series_id, r.ts.hour, r.resid) for r in spark.table("tidewheel_errors").collect()) == [("a", 1, 1.0), ("a", 2, -2.0)]


def test_levels_of_a_stream_with_late_rows(spark, tmp_path):
    """Two batches out of order: rows wait for the watermark, and rows behind it are dropped."""
    from datetime import datetime, timedelta

    from tidewheel.streaming.levels import levels, written

    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    shape = "s string, ts timestamp, id long, y double"
    batches = [[("a", at(30), 3, 9.0), ("a", at(0), 1, 4.0), ("a", at(10), 2, 6.0), ("b", at(5), 9, 1.0), ("a", at(10), 4, None)], [("a", at(200), 5, 8.0), ("a", at(25), 6, 5.0), ("b", at(180), 10, 3.0)], [("a", at(20), 7, 100.0), ("a", at(400), 8, 7.0), ("b", at(400), 11, 2.0)]]
    folder = tmp_path / "in"
    folder.mkdir()
    stream = features.read_stream(spark, str(folder), spark.createDataFrame([], shape).schema, maxFilesPerTrigger=1)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(folder))
        found = written(levels(stream, "s", "ts", "id", "y", 0.5, 1.0, 2, "60 minutes"), folder=f"file://{tmp_path}/out")
    told = {(r.series_id, r.row_id): (r.level, r.resid, r.width) for r in found.collect()}
    # id 6 was in time for the watermark of its batch, id 7 came after minute 140 had been passed
    assert told == {
        ("a", 1): (4.0, None, None), ("a", 2): (5.0, 2.0, 2.0), ("a", 6): (5.0, 0.0, 2.0), ("a", 3): (7.0, 4.0, 4.0), ("a", 5): (7.5, 1.0, 4.0),
        ("b", 9): (1.0, None, None), ("b", 10): (2.0, 2.0, 2.0),
    }


class _Blocks(dict):
    """A map state that tells how many rows were handed over at once."""

    most = 0

    def updateValue(self, key, value):
        self.most = max(self.most, len(value[0]) // 32)
        self[key] = value

    getValue, removeKey = dict.__getitem__, dict.__delitem__


def test_waiting_rows_pass_in_blocks(monkeypatch):
    """Runs of unequal lengths, many equal times, taken in three goes and added to between: all rows in order, no
    block or piece above its size however long the series, and nothing left in state."""
    from tidewheel.streaming import levels as SL

    monkeypatch.setattr(SL, "BLOCK", 8)
    monkeypatch.setattr(SL, "FAN", 3)
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 100, 3000):
        rows = np.stack((rng.integers(-5, 40, n), rng.integers(0, 2, n), rng.integers(0, 9, n), rng.normal(size=n).view(np.int64)), axis=1)
        blocks, out, runs = _Blocks(), [], 0
        waiting = SL.Waiting(blocks, [], 0)
        for part in np.split(rows, np.sort(rng.integers(0, n + 1, 40))):
            waiting.add([SL._sorted(part)])
            waiting = SL.Waiting(blocks, [list(r) for r in waiting.runs], waiting.free)  # as the next batch finds it
            runs = max(runs, len(waiting.runs))
        assert sum(len(v[0]) // 32 for v in blocks.values()) == n
        for end in (10, 11, 60):
            pieces = list(waiting.take(end))
            assert all(len(p) <= 8 * runs for p in pieces)
            out += pieces
            early = SL._sorted(np.concatenate([np.empty((0, 4), np.int64), *out]))
            assert np.array_equal(early, SL._sorted(rows[rows[:, 0] < end])) and np.array_equal(early, np.concatenate([np.empty((0, 4), np.int64), *out]))
            assert waiting.first() == (rows[rows[:, 0] >= end, 0].min() if (rows[:, 0] >= end).any() else None)
        assert blocks.most <= 8 and runs <= 3 * 6 and not blocks and not waiting.runs


class _Handle:
    """State of one series in memory, with the largest value that was stored."""

    def __init__(self):
        self.most, self.timers, self.maps, self.value = 0, [], _Blocks(), None

    def getValueState(self, name, shape):
        return self

    def getMapState(self, name, key, value):
        return self.maps

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.most = value, max(self.most, *(len(v) for v in value if isinstance(v, list)))

    def listTimers(self):
        return self.timers

    def deleteTimer(self, at):
        self.timers = [t for t in self.timers if t != at]

    def registerTimer(self, at):
        self.timers.append(at)


def test_levels_hold_no_series_whole():
    """A series of 150,000 rows out of order: no value of state and no frame grows with it."""
    from types import SimpleNamespace

    import pandas as pd

    from tidewheel.streaming.levels import Levels

    n, now = 150_000, 30_000
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"at": rng.integers(1, 40_000, n) * 1000, "unknown": 0, "row_id": np.arange(n), "y": rng.normal(size=n)})
    handle, levels = _Handle(), Levels(0.5, 0.9, 20)
    levels.init(handle)
    clock = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    assert not [len(f) for f in levels.handleInputRows(("a",), (rows[k : k + 10_000] for k in range(0, n, 10_000)), clock(0)) if len(f)]
    assert handle.timers == [rows["at"].min() // 1000]
    frames = list(levels.handleExpiredTimer(("a",), clock(now), None))
    assert max(len(f) for f in frames) <= 10_000 and handle.most <= 50 and handle.maps.most <= 2048
    out = pd.concat(frames)
    rows = rows.sort_values(["at", "row_id"])
    rows = rows[rows["at"] <= now * 1000]
    assert np.array_equal(out["row_id"], rows["row_id"]) and handle.timers == [now + 1]
    level, errors, wanted = None, [], []
    for y in rows["y"]:
        if level is None:
            level = y
            continue
        errors, level = (errors + [abs(y - level)])[-20:], level + 0.5 * (y - level)
        wanted.append((level, sorted(errors)[int(round(0.9 * (len(errors) - 1), 9))]))
    assert list(zip(out["level"], out["width"]))[1:] == wanted
    assert sum(len(f) for f in levels.handleExpiredTimer(("a",), clock(50_000), None)) == n - len(out) and not handle.maps and not handle.timers


def test_levels_of_rows_without_ids(spark, tmp_path):
    """Large ids stay exact beside null ones, which come last among equal times."""
    from datetime import datetime, timedelta

    from tidewheel.streaming.levels import levels, written

    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [("a", at(0), None, 8.0), ("a", at(0), (1 << 60) + 1, 4.0), ("a", at(0), -3, 2.0), ("a", at(300), 5, 1.0)]
    frame = spark.createDataFrame(rows, "s string, ts timestamp, id long, y double")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = written(levels(features.read_stream(spark, str(tmp_path / "in"), frame.schema), "s", "ts", "id", "y", 0.5), folder=f"file://{tmp_path}/out")
    assert {(r.row_id, r.level) for r in found.collect()} == {(-3, 2.0), ((1 << 60) + 1, 3.0), (None, 5.5)}


def test_expanding_ets_as_a_column(spark):
    y = {"a": [3.0, 5.0, None, 4.0, 6.0, 5.0, 8.0, 7.0], "b": [1.0], "c": [2.0, 2.5, 3.5, 3.0]}
    df = spark.createDataFrame([(s, t, v) for s, values in y.items() for t, v in enumerate(values)], "series_id string, t int, y double")
    tr = LF.ExpandingEts(2, Ets("add", alpha=0.4, beta=0.1))
    found = P.expanding_ets(df, tr).orderBy("series_id", "t").collect()
    for s, values in y.items():
        wanted = tr.trace(np.array([np.nan if v is None else v for v in values])) if len(values) > 2 else np.full(len(values), np.nan)
        got = [np.nan if r[tr.name] is None else r[tr.name] for r in found if r.series_id == s]
        assert np.allclose(got, wanted, equal_nan=True) and len(got) == len(values)
