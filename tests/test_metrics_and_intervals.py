import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import metrics as M
from tidewheel.operators import conformal as C
from tidewheel.operators import encoders as E
from tidewheel.operators import folds as V
from tidewheel.operators import linear_recursion as R
from tidewheel.operators import trend as TR
from tidewheel.operators.order_statistics import at_levels


def frame(spark, y, yhat, train):
    scale = M.train_scale(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(train)], "series_id string, t int, y double"))
    rows = spark.createDataFrame([("a", h + 1, float(a), float(b)) for h, (a, b) in enumerate(zip(y, yhat))], "series_id string, h int, y double, yhat double")
    return rows.join(scale, "series_id")


def test_all_metrics(spark):
    wanted = {"MAE": 1, "MSE": 1, "RMSE": 1, "MAPE": 0.375, "SMAPE": 44.444444, "CFE": 0, "CFE_ABS": 0, "WMAPE": 0.3333333, "SMAE": 30, "SRMSE": 0.3, "MASE": 0.4, "RMSSE": 0.3922323}
    out = {r.eval_metric: r.score for r in M.evaluate(frame(spark, [2, 4], [1, 5], [1, 3, 6]), list(wanted)).collect()}
    for k, v in wanted.items():
        assert math.isclose(out[k], v, abs_tol=1e-6), k
    rounded = frame(spark, [2, 4], [1, 5], [1, 3, 6]).agg(M.metric("MAPE", decimals=2).alias("m")).first().m
    assert rounded == 0.38


def test_zero_denominators_are_null(spark):
    out = {r.eval_metric: r.score for r in M.evaluate(frame(spark, [0, 0], [0, 0], [0, 0, 0]), ["MAPE", "SMAPE", "WMAPE", "MASE"]).collect()}
    assert set(out.values()) == {None}


@pytest.mark.parametrize("step,wanted", [(2, [4, 6, 8]), (1, [6, 7, 8])])
def test_cutoffs(spark, step, wanted):
    panel = spark.createDataFrame([("a", i, 1.0) for i in range(10)], "series_id string, t int, y double")
    out = V.cutoffs(panel, 3, 2, step).orderBy("fold").collect()
    assert [r.cutoff for r in out] == wanted == V.cutoff_list(10, 3, 2, step) and [r.fold for r in out] == [1, 2, 3]


def test_fewer_folds_than_asked(spark):
    panel = spark.createDataFrame([("a", i, 1.0) for i in range(5)], "series_id string, t int, y double")
    assert [(r.fold, r.cutoff) for r in V.cutoffs(panel, 9, 2, 2).orderBy("fold").collect()] == [(1, 1), (2, 3)]
    assert V.cutoffs(panel, 3, 6).count() == 0


def test_order_statistics(spark):
    rows = spark.createDataFrame([("a", 1, float(v)) for v in [5, 1, 4, 2, 3, 9, 7, 8, 6, 10]], "series_id string, h int, resid double")
    asked = [(0.5, "lower"), (0.5, "higher"), (0.8, "lower"), (0.8, "higher"), (0.9, "lower")]
    found = at_levels(rows, "resid", {f"q{k}": (C.conformal_level(d, 10), m) for k, (d, m) in enumerate(asked)}, ["series_id", "h"]).first()
    assert [found[f"q{k}"] for k in range(5)] == [6, 7, 9, 10, 10] and found.n == 10
    with pytest.raises(ValueError):
        C.conformal_level(0.95, 10)


def test_intervals_and_samples(spark):
    rng = np.random.default_rng(0)
    resid = spark.createDataFrame([("a", f, h, float(rng.normal())) for f in range(1, 41) for h in (1, 2)], "series_id string, fold int, h int, resid double")
    point = spark.createDataFrame([("a", 1, 50.0), ("a", 2, 60.0)], "series_id string, h int, yhat double")
    out = C.intervals(point, C.calibrate(resid, [0.5, 0.9], 40)).orderBy("h", "level").collect()
    assert [r.level for r in out] == [0.5, 0.9] * 2 and out[0].upper < out[1].upper and out[0].lower > out[1].lower
    wide = C.wide_intervals(C.intervals(point, C.calibrate(resid, [0.5], 40)), [0.5])
    assert {"point_forecast", "lower_50", "upper_50"} <= set(wide.columns)
    for kind in ("empirical", "kde"):
        drawn = C.bootstrap(point, resid, 300, kind)
        assert drawn.count() == 600
        mean = drawn.groupBy("h").agg(F.avg("value").alias("m")).orderBy("h").collect()
        assert abs(mean[0].m - 50) < 0.6 and abs(mean[1].m - 60) < 0.6
    paths = C.correlated_paths(point, resid, 200)
    assert paths.count() == 400
    assert C.sample_frame(paths, 2).columns[-2:] == ["h_1", "h_2"]
    assert C.sample_quantiles(paths, [0.1, 0.9], 200).count() == 4
    first, again = (C.bootstrap(point, resid, 50).orderBy("h", "sample_id").collect() for _ in range(2))
    assert first == again
    one_step = C.correlated_paths(point.where("h = 1"), resid.where("h = 1"), 10)
    assert one_step.count() == 10


@pytest.mark.parametrize("metric", ["mae", "mape", "smape"])
def test_aggregate_conformal(spark, metric):
    back = spark.createDataFrame([(s, f, 1, 10.0 + f, 10.0) for s in "ab" for f in range(1, 11)], "series_id string, fold int, h int, y double, yhat double")
    point = spark.createDataFrame([("a", 1, 10.0), ("b", 1, 20.0)], "series_id string, h int, yhat double")
    row = C.aggregate_conformal(back, point, [0.8], 10, metric).first()
    assert row.yhat == 30 and row.lower < 30 < row.upper
    if metric == "mae":
        assert row.upper - row.yhat == 18  # the ninth of sums 2, 4, ..., 20


def test_encoders(spark):
    df = spark.createDataFrame([(i, c, float(v)) for i, (c, v) in enumerate([("x", 1), ("y", 2), ("x", 3), ("y", 4), ("z", 9)])], "i int, c string, y double")
    values = E.categories(df, "c")
    out = E.one_hot(df, "c", values, drop_first=True)
    assert out.columns == ["i", "y", "c_y", "c_z"]
    unseen = E.one_hot(spark.createDataFrame([("w",)], "c string"), "c", values).first()
    assert list(unseen) == [0.0, 0.0, 0.0]
    enc = {r.i: r.c_target_encoded for r in E.kfold_target_encode(df, "c", "y", F.col("i") % 2).collect()}
    assert enc[4] == pytest.approx(19 / 5)  # alone in its category: the overall mean
    two = spark.createDataFrame([(0, "x", 1.0), (1, "x", 3.0)], "i int, c string, y double")
    assert {r.i: r.c_target_encoded for r in E.kfold_target_encode(two, "c", "y", F.col("i")).collect()} == {0: 3.0, 1: 1.0}
    train = df.withColumn("c_target_encoded", F.col("y"))
    test = E.target_encode_test(train, spark.createDataFrame([("x",), ("new",)], "c string"), "c")
    assert {r.c: r.c_target_encoded for r in test.collect()} == {"x": 2.0, "new": pytest.approx(3.8)}


def test_trends_and_recursion(spark):
    panel = spark.createDataFrame([("a", t, 2.0 + 3.0 * t + (5.0 * (t - 6) if t > 6 else 0.0)) for t in range(12)], "series_id string, t int, y double")
    out = TR.forecast_trend(TR.fit_trend(panel, breaks=[6]), 2, breaks=[6]).orderBy("h").collect()
    assert [r.trend for r in out] == pytest.approx([2 + 36 + 30, 2 + 39 + 35])
    flat = TR.detrend(panel, TR.fit_trend(panel, breaks=[6]), breaks=[6])
    assert max(abs(r.y) for r in flat.collect()) < 1e-6
    ar = [1.0, 1.0]
    for _ in range(40):
        ar.append(0.5 + 0.6 * ar[-1] + 0.2 * ar[-2] + math.sin(len(ar)))
    panel = spark.createDataFrame([("a", t, v) for t, v in enumerate(ar)], "series_id string, t int, y double")
    x = np.column_stack([np.ones(40), ar[1:-1], ar[:-2]])
    b = np.linalg.lstsq(x, np.array(ar[2:]), rcond=None)[0]
    model = R.fit_ar(panel, 2)
    assert model.first().coef == pytest.approx(list(b))
    past = ar[:]
    for _ in range(4):
        past.append(b[0] + b[1] * past[-1] + b[2] * past[-2])
    assert [r.yhat for r in R.recurse_ar(model, 2, 4).orderBy("h").collect()] == pytest.approx(past[-4:])
    assert [r.yhat for r in R.naive(panel, 3, 2).orderBy("h").collect()] == [ar[-2], ar[-1], ar[-2]]
