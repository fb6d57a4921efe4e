"""Hand-computed values and round trips of the feature operators, against pandas where it helps."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import lagfeatures as LF
from tidewheel.functions import transforms as T
from tidewheel.sources import panel as S


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "series_id string, t int, y double")


def column(df, name):
    return [r[0] for r in df.orderBy("t").select(f"`{name}`").collect()]


def close(found, wanted):
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        assert (a is None) == (b is None), (found, wanted)
        assert a is None or math.isclose(a, b, abs_tol=1e-6), (found, wanted)


def test_rolling_and_expanding(spark):
    trs = [LF.RollingMean(1, 2), LF.RollingStd(1, 2), LF.ExpandingMean(1), LF.RollingQuantile(0, 3, 1, 0.3)]
    out = LF.add_lags(series(spark, [1, 2, 4, 7]), None, transforms=trs)
    close(column(out, trs[0].name), [None, 1, 1.5, 3])
    close(column(out, trs[1].name), [None, None, 0.7071068, 1.4142136])
    close(column(out, trs[2].name), [None, 1, 1.5, 2.3333333])
    close(column(out, trs[3].name), [1, 1.3, 1.6, 3.2])


def test_window_columns_share_one_exchange(spark):
    trs = [LF.RollingMean(1, 3), LF.RollingStd(1, 3), LF.ExpandingMean(1), LF.ExpandingQuantile(1, 0.5)]
    plan = LF.add_lags(series(spark, range(9)), [1, 2], transforms=trs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("tr", [LF.RollingMean(2, 5, 3), LF.RollingStd(2, 5, 3), LF.RollingQuantile(2, 5, 3, 0.3), LF.ExpandingMean(2), LF.ExpandingStd(2), LF.ExpandingQuantile(2, 0.7), LF.ExpandingSes(1, 0.4)])
def test_batch_form_equals_step_form(spark, tr):
    rng = np.random.default_rng(0)
    y = rng.normal(size=40)
    found = column(LF.add_lags(series(spark, y), None, transforms=[tr]), tr.name)
    wanted = [tr.step(y[:i]) if i >= tr.shift else math.nan for i in range(40)]
    close(found, [None if w != w else w for w in wanted])


def test_against_pandas_with_gaps(spark):
    y = [3.0, None, 1.0, 4.0, None, 5.0, 9.0, 2.0]
    tr = LF.RollingMean(1, 3, 2)
    wanted = pd.Series(y, dtype=float).shift(1).rolling(3, min_periods=2).mean()
    close(column(LF.add_lags(series(spark, y), None, transforms=[tr]), tr.name), [None if v != v else v for v in wanted])


def test_differences(spark):
    df = series(spark, [1, 2, 4, 7, 11])
    close(column(df.withColumn("d", T.diff("y")), "d"), [None, 1, 2, 3, 4])
    close(column(df.withColumn("d", T.diff("y", 2)), "d"), [None, None, 1, 1, 1])
    close(column(df.withColumn("d", T.seasonal_diff("y", 2)), "d"), [None, None, 3, 5, 7])


def test_undiff_and_seasonal_inverse(spark):
    history = series(spark, [1, 2, 4, 7])
    ahead = spark.createDataFrame([("a", 1, 4.0), ("a", 2, 5.0)], "series_id string, h int, yhat double")
    assert [r.yhat for r in T.undiff(ahead, history).orderBy("h").collect()] == [11, 16]
    ones = spark.createDataFrame([("a", h, 1.0) for h in (1, 2, 3)], "series_id string, h int, yhat double")
    assert [r.yhat for r in T.invert_seasonal_diff(ones, history, 2).orderBy("h").collect()] == [5, 8, 6]


def test_intermittent(spark):
    df = series(spark, [3, 0, 0, 2, 0, 1])
    out = T.nonzero_interval()(T.zero_run_length()(df))
    assert column(out, "zero_run") == [0, 1, 2, 0, 1, 0]
    assert column(out, "nz_interval") == [1, 1, 1, 3, 3, 2]


def test_box_cox(spark):
    df = series(spark, [1, 2, 4])
    close(column(df.withColumn("z", T.box_cox("y", 0.0)), "z"), [0, math.log(2), math.log(4)])
    out = df.withColumn("z", T.box_cox("y", 0.5)).withColumn("b", T.inverse_box_cox("z", 0.5))
    close(column(out, "z"), [0, 0.8284271, 2])
    close(column(out, "b"), [1, 2, 4])


def test_box_cox_lambda_recovers_log(spark):
    rng = np.random.default_rng(1)
    df = series(spark, np.exp(rng.normal(3, 0.5, 400)))
    lam = T.box_cox_lambda(df).first()["lmda"]
    assert abs(lam) < 0.25


def test_fourier_names_and_values(spark):
    out = T.fourier_terms(spark, "2024-01-01", "2024-01-08", 7, 2)
    assert out.columns[-4:] == ["sin_1_7", "sin_2_7", "cos_1_7", "cos_2_7"]
    row = out.where("t = 2").first()
    assert math.isclose(row["sin_1_7"], math.sin(4 * math.pi / 7)) and out.count() == 8


def test_panel_numbers_and_fills_gaps(spark):
    rows = [("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", float("nan")), ("a", "2024-01-01 03:00:00", 2.0), ("b", "2024-01-01 01:00:00", 5.0)]
    df = spark.createDataFrame(rows, "k string, at string, v double").withColumn("at", F.to_timestamp("at"))
    out = S.gap_fill(S.to_panel(df, "k", "at", "v", unit="hour"))
    assert [(r.series_id, r.t, r.y) for r in out.orderBy("series_id", "t").collect()] == [("a", 0, 1.0), ("a", 1, 0.0), ("a", 2, 0.0), ("a", 3, 2.0), ("b", 0, 5.0)]


def test_empty_panel(spark):
    empty = series(spark, [])
    assert LF.add_lags(empty, 3, transforms=[LF.RollingMean(1, 2)]).count() == 0
    assert T.zero_run_length()(empty).count() == 0
