"""The engine's queries over the TPC-H-like tables and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import lagfeatures as LF
from tidewheel.functions import metrics as M
from tidewheel.functions import transforms as T
from tidewheel.functions.regressors import REGRESSORS, Linear
from tidewheel.operators import conformal as C
from tidewheel.operators import diagnostics as D
from tidewheel.operators import encoders as E
from tidewheel.operators import folds as V
from tidewheel.operators import linear_recursion as R
from tidewheel.operators import trend as TR
from tidewheel.operators.estimators import Direct, Ets, Lagged, Naive, Prepare, Sarima
from tidewheel.operators.hmm import MarkovSwitching
from tidewheel.plans import forecasting as P
from tidewheel.sources import panel as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Two days held out over five folds, and the six-step horizon of the flagship forecast.
FOLDS, TEST, STEP, AHEAD = 5, 24, 24, 6

SERIES = """
raw AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, sum(value) AS y FROM events GROUP BY 1, 2),
bounds AS (SELECT series_id, min(ts) AS a, max(ts) AS b FROM raw GROUP BY 1),
grid AS (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM bounds),
panel AS (
  SELECT g.series_id, g.ts, (row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) - 1)::INT AS t, coalesce(r.y, 0.0) AS y
  FROM grid g LEFT JOIN raw r ON g.series_id = r.series_id AND g.ts = r.ts
)"""
MONTHS = """
panel AS (
  SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate) AS ts, count(*)::DOUBLE AS y,
    (row_number() OVER (PARTITION BY o_orderpriority ORDER BY date_trunc('month', o_orderdate)) - 1)::INT AS t
  FROM orders GROUP BY 1, 2
)"""
SPLITS = f"""
n AS (SELECT series_id, max(t) + 1 AS n FROM panel GROUP BY 1),
starts AS (SELECT series_id, n, unnest(generate_series(0, {FOLDS - 1})) AS k FROM n WHERE n >= {TEST}),
folds AS (
  SELECT series_id, (least({FOLDS}, (n - {TEST}) // {STEP} + 1) - k)::INT AS fold, (n - {TEST} - k * {STEP})::INT AS cutoff
  FROM starts WHERE n - {TEST} - k * {STEP} >= 0
)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c: str, digits: int = 6):
    """Rounded, with no negative zero."""
    return (F.round(F.col(c), digits) + 0.0).alias(c)


def _re(c: str, digits: int = 4):
    """Rounded after a nudge: means of two-decimal values often lie exactly on a half."""
    return (F.round(F.col(c) + 1e-9, digits) + 0.0).alias(c)


W_ = "(PARTITION BY series_id ORDER BY t"


@query(f"WITH {SERIES} SELECT series_id, ts, t, round(y, 6) AS y FROM panel")
def panel_hourly_gapfilled(spark, sf):
    return S.hourly_events(spark, sf).select("series_id", "ts", "t", _r("y"))


@query(f"""WITH {SERIES}, f AS (SELECT series_id, t, y, lag(y, 1) OVER {W_}) AS y_lag_1, lag(y, 2) OVER {W_}) AS y_lag_2,
 lag(y, 24) OVER {W_}) AS y_lag_24 FROM panel)
SELECT series_id, t, round(y, 6) AS y, round(y_lag_1, 6) AS y_lag_1, round(y_lag_2, 6) AS y_lag_2, round(y_lag_24, 6) AS y_lag_24 FROM f WHERE y_lag_24 IS NOT NULL""")
def lag_features(spark, sf):
    rows = LF.add_lags(S.hourly_events(spark, sf), [1, 2, 24])
    names = ["y_lag_1", "y_lag_2", "y_lag_24"]
    return rows.dropna(subset=names).select("series_id", "t", _r("y"), *[_r(c) for c in names])


def _rolling(transform, name):
    def run(spark, sf):
        rows = LF.add_lags(S.hourly_events(spark, sf), None, transforms=[transform])
        return rows.select("series_id", "t", (F.round(F.col(f"`{transform.name}`") + 1e-9, 6) + 0.0).alias("value"))

    run.__name__ = name
    return run


def _frame(call: str, frame: str, least: int = 1) -> str:
    return f"""WITH {SERIES} SELECT series_id, t, CASE WHEN count(y) OVER {W_} {frame}) >= {least} THEN round({call} OVER {W_} {frame}) + 1e-9, 6) END AS value FROM panel"""


for _name, _tr, _call, _rows, _least in (
    ("rolling_mean_24", LF.RollingMean(1, 24, 1), "avg(y)", "ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING", 1),
    ("rolling_std_24", LF.RollingStd(1, 24, 2), "stddev_samp(y)", "ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING", 2),
    ("rolling_quantile_12", LF.RollingQuantile(2, 12, 3, 0.3), "quantile_cont(y, 0.3)", "ROWS BETWEEN 13 PRECEDING AND 2 PRECEDING", 3),
    ("expanding_mean", LF.ExpandingMean(1), "avg(y)", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", 1),
    ("expanding_std", LF.ExpandingStd(1), "stddev_samp(y)", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", 2),
    ("expanding_quantile_window", LF.ExpandingQuantile(1, 0.5), "quantile_cont(y, 0.5)", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", 1),
):
    query(_frame(_call, _rows, _least))(_rolling(_tr, _name))

_D1 = f"y - lag(y) OVER {W_})"


@query(f"""WITH {SERIES}, d AS (SELECT *, {_D1} AS d1, y - lag(y, 24) OVER {W_}) AS s24 FROM panel)
SELECT series_id, t, round(d1, 6) AS diff_1, round(d1 - lag(d1) OVER {W_}), 6) AS diff_2, round(s24, 6) AS seasonal_diff_24 FROM d""")
def differences(spark, sf):
    rows = S.hourly_events(spark, sf).withColumns({"diff_1": T.diff("y"), "diff_2": T.diff("y", 2), "seasonal_diff_24": T.seasonal_diff("y", 24)})
    return rows.select("series_id", "t", _r("diff_1"), _r("diff_2"), _r("seasonal_diff_24"))


@query(f"""WITH {SERIES}, n AS (SELECT series_id, max(t) AS m FROM panel GROUP BY 1)
SELECT p.series_id, (t - m + 12)::INT AS h, round(y, 4) AS yhat FROM panel p JOIN n USING (series_id) WHERE t > m - 12""")
def undiff_roundtrip(spark, sf):
    """The last 12 second differences, undifferenced from the history before them, are the series again."""
    rows = S.hourly_events(spark, sf).withColumn("m", F.max("t").over(S.W.partitionBy("series_id"))).withColumn("d", T.diff("y", 2))
    held = rows.where(F.col("t") > F.col("m") - 12).select("series_id", (F.col("t") - F.col("m") + 12).alias("h"), F.col("d").alias("yhat"))
    return T.undiff(held, rows.where(F.col("t") <= F.col("m") - 12).select("series_id", "t", "y"), 2).select("series_id", "h", _r("yhat", 4))


@query(f"""WITH {SERIES}, n AS (SELECT series_id, max(t) AS m FROM panel GROUP BY 1)
SELECT p.series_id, (t - m + 36)::INT AS h, round(y, 4) AS yhat FROM panel p JOIN n USING (series_id) WHERE t > m - 36""")
def invert_seasonal_diff(spark, sf):
    rows = S.hourly_events(spark, sf).withColumn("m", F.max("t").over(S.W.partitionBy("series_id"))).withColumn("d", T.seasonal_diff("y", 24))
    held = rows.where(F.col("t") > F.col("m") - 36).select("series_id", (F.col("t") - F.col("m") + 36).alias("h"), F.col("d").alias("yhat"))
    return T.invert_seasonal_diff(held, rows.where(F.col("t") <= F.col("m") - 36).select("series_id", "t", "y"), 24).select("series_id", "h", _r("yhat", 4))


@query(f"""WITH {SERIES}, s AS (SELECT *, CASE WHEN min(y) OVER (PARTITION BY series_id) < 1 THEN 1.0 ELSE 0.0 END AS a FROM panel)
SELECT series_id, t, round(ln(y + a), 6) AS z0, round((sqrt(y + a) - 1) / 0.5, 6) AS z5, round(y, 4) AS back FROM s""")
def box_cox_fixed_lambda(spark, sf):
    rows = S.hourly_events(spark, sf).withColumn("shift", T.needs_shift())
    rows = rows.withColumn("z0", T.box_cox("y", 0.0, F.col("shift"))).withColumn("z5", T.box_cox("y", 0.5, F.col("shift")))
    return rows.withColumn("back", T.inverse_box_cox("z5", 0.5, F.col("shift"))).select("series_id", "t", _r("z0"), _r("z5"), _r("back", 4))


@query(f"""WITH {SERIES}, z AS (SELECT series_id, t, (sqrt(y + 1) - 1) / 0.5 AS z FROM panel),
v AS (SELECT *, var_pop(z) OVER (PARTITION BY series_id) AS v FROM z)
SELECT series_id, t, round(pow(0.5 * z + 1, 2) * (1 + 0.5 * v / (2 * pow(0.5 * z + 1, 2))) - 1, 4) AS value FROM v""")
def inverse_box_cox_bias_adjusted(spark, sf):
    rows = S.hourly_events(spark, sf).withColumn("z", T.box_cox("y", 0.5, True))
    v = F.var_pop("z").over(S.W.partitionBy("series_id"))
    return rows.withColumn("v", v).withColumn("value", T.inverse_box_cox("z", 0.5, True, F.col("v"))).select("series_id", "t", _r("value", 4))


def _profile(number: str, source: str, grid: str) -> str:
    """SQL: the lambda of the grid (column l of source) with the largest profile log-likelihood."""
    z = "CASE WHEN l = 0 THEN ln(x) ELSE (pow(x, l) - 1) / l END"
    return f"""{number} AS (SELECT series_id, arg_max(l, llf) AS l FROM (
  SELECT series_id, l, -count(*) / 2.0::DOUBLE * ln(var_pop({z})) + (l - 1) * sum(ln(x)) AS llf FROM (SELECT s.series_id, s.x, {grid} AS l FROM {source}, range(0, 21) r(k)) GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH {MONTHS}, s AS (SELECT series_id, y + CASE WHEN min(y) OVER (PARTITION BY series_id) < 1 THEN 1 ELSE 0 END AS x FROM panel),
{_profile('one', 's', '-2 + 4 * k / 20.0::DOUBLE')}, {_profile('two', 's JOIN one o USING (series_id)', 'o.l + 0.2::DOUBLE * (2.0::DOUBLE * k / 20 - 1)')},
{_profile('three', 's JOIN two o USING (series_id)', 'o.l + 0.02::DOUBLE * (2.0::DOUBLE * k / 20 - 1)')}
SELECT series_id, round(l, 4) + 0.0 AS lmda FROM three""")
def box_cox_mle(spark, sf):
    return T.box_cox_lambda(S.monthly_orders(spark, sf)).select("series_id", _r("lmda", 4))


_ZERO = f"""WITH {SERIES}, m AS (SELECT *, sum(CASE WHEN y >= 0.5 THEN 1 ELSE 0 END) OVER {W_}) AS g,
 CASE WHEN y > 0.5 THEN t END AS hit FROM panel),
k AS (SELECT *, hit - last_value(hit IGNORE NULLS) OVER {W_} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap,
 count(CASE WHEN y < 0.5 THEN 1 END) OVER (PARTITION BY series_id, g ORDER BY t) AS zero_run FROM m)
SELECT series_id, t, zero_run::BIGINT AS zero_run, coalesce(last_value(gap IGNORE NULLS) OVER {W_} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)::INT AS nz_interval FROM k"""


@query(_ZERO)
def intermittent_demand(spark, sf):
    rows = T.nonzero_interval()(T.zero_run_length()(S.hourly_events(spark, sf)))
    return rows.select("series_id", "t", "zero_run", "nz_interval")


@query("""WITH d AS (SELECT date_trunc('day', o_orderdate)::DATE AS ds, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT min(ds) AS a, max(ds) AS z FROM d),
c AS (SELECT (a + i::INT)::DATE AS ds, i FROM b, range(0, date_diff('day', (SELECT a FROM b), (SELECT z FROM b)) + 1) r(i))
SELECT ds, i::INT AS t, coalesce(n, 0)::BIGINT AS orders, round(sin(2.0 * pi() * i / 7), 6) + 0.0 AS sin_1_7, round(sin(4.0 * pi() * i / 7), 6) + 0.0 AS sin_2_7,
 round(cos(2.0 * pi() * i / 7), 6) + 0.0 AS cos_1_7, round(cos(4.0 * pi() * i / 7), 6) + 0.0 AS cos_2_7 FROM c LEFT JOIN d USING (ds)""")
def fourier_terms(spark, sf):
    """Orders a day with the weekly terms of the calendar between the table's first and last day."""
    days = S.read(spark, f"{sf}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("ds")).agg(F.count("*").alias("orders"))
    first, last = days.agg(F.min("ds"), F.max("ds")).first()
    names = ["sin_1_7", "sin_2_7", "cos_1_7", "cos_2_7"]
    terms = T.fourier_terms(spark, str(first), str(last), 7, 2)
    return terms.join(days, "ds", "left").select("ds", "t", F.coalesce("orders", F.lit(0)).alias("orders"), *[_r(c) for c in names])


@query(f"""WITH {MONTHS} SELECT series_id, round(regr_slope(y, t), 6) AS slope, round(regr_intercept(y, t), 6) AS intercept, max(t) AS last_t FROM panel GROUP BY 1""")
def linear_trend_fit(spark, sf):
    return TR.fit_line(S.monthly_orders(spark, sf)).select("series_id", _r("slope"), _r("intercept"), "last_t")


@query(f"""WITH {MONTHS}, m AS (SELECT series_id, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, max(t) AS last_t FROM panel GROUP BY 1)
SELECT series_id, h::INT AS h, (last_t + h)::INT AS t, round(a + b * (last_t + h), 4) AS trend FROM m, range(1, 13) r(h)""")
def linear_trend_forecast(spark, sf):
    return TR.forecast_trend(TR.fit_trend(S.monthly_orders(spark, sf)), 12).select("series_id", "h", "t", _r("trend", 4))


def _three(y: str = "y", by: str = "series_id") -> str:
    """SQL of least squares of y on d's columns x1, x2, x3 with intercept (CTE m: a, b1, b2, b3), by Cramer's rule."""
    c = {f"s{i}{j}": f"covar_pop(x{i}, x{j})" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j} | {f"c{i}": f"covar_pop(x{i}, {y})" for i in (1, 2, 3)}
    det = "s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s23 * s13) + s13 * (s12 * s23 - s22 * s13)"
    b1 = "c1 * (s22 * s33 - s23 * s23) - s12 * (c2 * s33 - s23 * c3) + s13 * (c2 * s23 - s22 * c3)"
    b2 = "s11 * (c2 * s33 - s23 * c3) - c1 * (s12 * s33 - s23 * s13) + s13 * (s12 * c3 - c2 * s13)"
    b3 = "s11 * (s22 * c3 - c2 * s23) - s12 * (s12 * c3 - c2 * s13) + c1 * (s12 * s23 - s22 * s13)"
    sums = ", ".join(f"{v} AS {k}" for k, v in c.items())
    return f"""v AS (SELECT {by}, {sums}, avg({y}) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3 FROM d WHERE x1 + x2 + x3 + {y} IS NOT NULL GROUP BY {by}),
w AS (SELECT *, ({b1}) / ({det}) AS b1, ({b2}) / ({det}) AS b2, ({b3}) / ({det}) AS b3 FROM v),
m AS (SELECT {by}, b1, b2, b3, my - b1 * m1 - b2 * m2 - b3 * m3 AS a FROM w)"""


@query(f"""WITH {MONTHS}, d AS (SELECT series_id, t::DOUBLE AS x1, greatest(0, t - 24)::DOUBLE AS x2, greatest(0, t - 48)::DOUBLE AS x3, y FROM panel), {_three()},
n AS (SELECT series_id, max(t) AS last_t FROM panel GROUP BY 1)
SELECT series_id, h::INT AS h, (last_t + h)::INT AS t, round(a + b1 * (last_t + h) + b2 * greatest(0, last_t + h - 24) + b3 * greatest(0, last_t + h - 48), 4) AS trend
FROM m JOIN n USING (series_id), range(1, 13) r(h)""")
def piecewise_trend(spark, sf):
    return TR.forecast_trend(TR.fit_trend(S.monthly_orders(spark, sf), breaks=[24, 48]), 12, breaks=[24, 48]).select("series_id", "h", "t", _r("trend", 4))


def _two(x1: str, x2: str, y: str) -> str:
    """SQL of least squares of y on two columns with intercept: a, b1, b2 of each series."""
    v1, v2, v12, c1, c2 = f"var_pop({x1})", f"var_pop({x2})", f"covar_pop({x1}, {x2})", f"covar_pop({x1}, {y})", f"covar_pop({x2}, {y})"
    b1, b2 = f"({c1} * {v2} - {c2} * {v12}) / ({v1} * {v2} - {v12} * {v12})", f"({c2} * {v1} - {c1} * {v12}) / ({v1} * {v2} - {v12} * {v12})"
    return f"{b1} AS b1, {b2} AS b2, avg({y}) - {b1} * avg({x1}) - {b2} * avg({x2}) AS a"


@query(f"""WITH {MONTHS}, d AS (SELECT series_id, t, t::DOUBLE AS x1, (t * t)::DOUBLE AS x2, y FROM panel),
m AS (SELECT series_id, max(t) AS last_t, {_two("x1", "x2", "y")} FROM d GROUP BY 1)
SELECT series_id, h::INT AS h, (last_t + h)::INT AS t, round(a + b1 * (last_t + h) + b2 * (last_t + h) * (last_t + h), 3) AS trend FROM m, range(1, 13) r(h)""")
def polynomial_trend(spark, sf):
    return TR.forecast_trend(TR.fit_trend(S.monthly_orders(spark, sf), degree=2), 12, degree=2).select("series_id", "h", "t", _r("trend", 3))


@query(f"""WITH {MONTHS}, d AS (SELECT series_id, t, t::DOUBLE AS x1, greatest(0, t - 40)::DOUBLE AS x2, y FROM panel),
m AS (SELECT series_id, max(t) AS last_t, {_two("x1", "x2", "y")} FROM d GROUP BY 1)
SELECT series_id, h::INT AS h, (last_t + h)::INT AS t, round(a + b1 * (last_t + h) + b2 * greatest(0, last_t + h - 40), 3) AS trend FROM m, range(1, 13) r(h)""")
def hinge_trend(spark, sf):
    return TR.forecast_trend(TR.fit_trend(S.monthly_orders(spark, sf), breaks=[40]), 12, breaks=[40]).select("series_id", "h", "t", _r("trend", 3))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' THEN 1.0 ELSE 0.0 END::DOUBLE AS priority_2, CASE WHEN o_orderpriority = '5-LOW' THEN 1.0 ELSE 0.0 END::DOUBLE AS priority_5,
 (SELECT count(DISTINCT o_orderpriority) FROM orders)::INT AS n_categories FROM orders""")
def one_hot_priority(spark, sf):
    orders = S.read(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority")
    values = E.categories(orders, "o_orderpriority")
    out = E.one_hot(orders, "o_orderpriority", values)
    return out.select("o_orderkey", F.col("`o_orderpriority_2-HIGH`").alias("priority_2"), F.col("`o_orderpriority_5-LOW`").alias("priority_5"), F.lit(len(values)).alias("n_categories"))


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority AS c, o_totalprice AS y, o_orderkey % 5 AS f FROM orders),
g AS (SELECT c, f, sum(y) AS s, count(y) AS n FROM o GROUP BY 1, 2), t AS (SELECT c, sum(s) AS s, sum(n) AS n FROM g GROUP BY 1)
SELECT o_orderkey, round((t.s - g.s) / (t.n - g.n), 4) AS encoded FROM o JOIN g ON o.c = g.c AND o.f = g.f JOIN t ON o.c = t.c""")
def kfold_target_encode(spark, sf):
    orders = S.read(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = E.kfold_target_encode(orders, "o_orderpriority", "o_totalprice", F.pmod("o_orderkey", F.lit(5)))
    return out.select("o_orderkey", F.round("o_orderpriority_target_encoded", 4).alias("encoded"))


@query("""WITH tr AS (SELECT o_orderpriority AS c, avg(o_totalprice) AS m FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1)
SELECT o_orderkey, round(m, 4) AS encoded FROM orders JOIN tr ON o_orderpriority = c WHERE o_orderkey % 4 = 0""")
def target_encode_test(spark, sf):
    orders = S.read(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice")
    train = orders.where("o_orderkey % 4 <> 0").withColumn("o_orderpriority_target_encoded", F.col("o_totalprice"))
    out = E.target_encode_test(train, orders.where("o_orderkey % 4 = 0"), "o_orderpriority")
    return out.select("o_orderkey", F.round("o_orderpriority_target_encoded", 4).alias("encoded"))


@query(f"WITH {SERIES}, {SPLITS} SELECT * FROM folds")
def ts_split_folds(spark, sf):
    return V.cutoffs(S.hourly_events(spark, sf), FOLDS, TEST, STEP)


@query(f"""WITH {SERIES}, n AS (SELECT series_id, max(t) AS m FROM panel GROUP BY 1)
SELECT n.series_id, h::INT AS h, round(p.y, 6) AS naive, round(q.y, 6) AS seasonal FROM n CROSS JOIN range(1, 37) r(h)
JOIN panel p ON p.series_id = n.series_id AND p.t = m JOIN panel q ON q.series_id = n.series_id AND q.t = m - 23 + (h - 1) % 24""")
def naive_forecast(spark, sf):
    panel = S.hourly_events(spark, sf)
    a = R.naive(panel, 36).withColumnRenamed("yhat", "naive")
    return a.join(R.naive(panel, 36, 24).withColumnRenamed("yhat", "seasonal"), ["series_id", "h"]).select("series_id", "h", _r("naive"), _r("seasonal"))


AR1 = f"""
lagged AS (SELECT *, lag(y) OVER {W_}) AS x FROM panel),
model AS (SELECT series_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, arg_max(y, t) AS last, regr_count(y, x) AS n,
  regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x) AS rss FROM lagged GROUP BY 1)"""


@query(f"""WITH RECURSIVE {SERIES}, {AR1},
path AS (SELECT series_id, 0 AS h, last AS yhat, a, b FROM model UNION ALL SELECT series_id, h + 1, a + b * yhat, a, b FROM path WHERE h < {AHEAD})
SELECT series_id, h::INT AS h, round(yhat, 6) AS yhat FROM path WHERE h > 0""")
def ar1_recursive_forecast(spark, sf):
    """Flagship: hourly demand per event type, AR(1) by least squares, six hours ahead."""
    return R.recurse_ar1(R.fit_ar1(S.hourly_events(spark, sf)), AHEAD).select("series_id", "h", _r("yhat"))


@query(f"""WITH {SERIES}, {AR1} SELECT series_id, round(n * ln(rss / n) + 6, 4) AS aic, round(n * ln(rss / n) + 6 + 24.0 / (n - 4), 4) AS aicc,
 round(n * ln(rss / n) + 3 * ln(n), 4) AS bic, round(n * ln(rss / n) + 6 * ln(ln(n)), 4) AS hqc FROM model""")
def ic_ar1(spark, sf):
    out = R.information_criteria(R.fit_ar1(S.hourly_events(spark, sf)), 3)
    return out.select("series_id", *[_r(c, 4) for c in ("aic", "aicc", "bic", "hqc")])


@query(f"""WITH RECURSIVE {SERIES}, d AS (SELECT series_id, t, y, lag(y) OVER {W_}) AS x1, lag(y, 2) OVER {W_}) AS x2, lag(y, 24) OVER {W_}) AS x3 FROM panel), {_three()},
past AS (SELECT series_id, list(y ORDER BY t) AS y FROM panel GROUP BY 1),
path AS (SELECT series_id, 0 AS h, a, b1, b2, b3, y[len(y) - 23:] AS y FROM m JOIN past USING (series_id)
  UNION ALL SELECT series_id, h + 1, a, b1, b2, b3, list_append(y, a + b1 * y[-1] + b2 * y[-2] + b3 * y[-24]) FROM path WHERE h < 24)
SELECT series_id, h::INT AS h, round(y[-1], 4) AS yhat FROM path WHERE h > 0""")
def ar_recursive_forecast(spark, sf):
    lags = [1, 2, 24]
    return R.recurse_ar(R.fit_ar(S.hourly_events(spark, sf), lags), lags, 24).select("series_id", "h", _r("yhat", 4))


@query(f"""WITH RECURSIVE {MONTHS}, level AS (SELECT series_id, t, y AS level FROM panel WHERE t = 0
UNION ALL SELECT p.series_id, p.t, l.level + 0.3 * (p.y - l.level) FROM level l JOIN panel p ON p.series_id = l.series_id AND p.t = l.t + 1)
SELECT series_id, t, round(level, 6) AS level FROM level""")
def ses_fixed_alpha(spark, sf):
    return TR.exponential_smoothing(S.monthly_orders(spark, sf), 0.3).select("series_id", "t", _r("level"))


_NAMES = ["MAPE", "MAE", "MSE", "RMSE", "SMAPE", "CFE", "CFE_ABS", "WMAPE", "SMAE", "SRMSE", "RMSSE", "MASE"]
BACKTEST = f"""
scored AS (
  SELECT f.series_id, f.fold, p.t - f.cutoff + 1 AS h, p.y, q.y AS yhat FROM folds f
  JOIN panel p ON p.series_id = f.series_id AND p.t BETWEEN f.cutoff AND f.cutoff + {TEST - 1}
  JOIN panel q ON q.series_id = f.series_id AND q.t = f.cutoff - 24 + (p.t - f.cutoff) % 24
),
steps AS (SELECT *, y - lag(y) OVER {W_}) AS d FROM panel),
scales AS (
  SELECT f.series_id, f.fold, avg(s.y) AS m, avg(abs(CASE WHEN s.t > 0 THEN s.d END)) AS a, avg(CASE WHEN s.t > 0 THEN s.d * s.d END) AS q
  FROM folds f JOIN steps s ON s.series_id = f.series_id AND s.t < f.cutoff GROUP BY 1, 2
),
wide AS (
  SELECT series_id, fold, avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) AS "MAPE", avg(abs(y - yhat)) AS "MAE", avg((y - yhat) * (y - yhat)) AS "MSE",
    sqrt(avg((y - yhat) * (y - yhat))) AS "RMSE", 100 * avg(CASE WHEN abs(y) + abs(yhat) <> 0 THEN 2 * abs(y - yhat) / (abs(y) + abs(yhat)) END) AS "SMAPE",
    sum(y - yhat) AS "CFE", abs(sum(y - yhat)) AS "CFE_ABS", sum(abs(y - yhat)) / sum(y) AS "WMAPE",
    100 * avg(abs(y - yhat)) / any_value(m) AS "SMAE", sqrt(avg((y - yhat) * (y - yhat))) / any_value(m) AS "SRMSE",
    sqrt(avg((y - yhat) * (y - yhat)) / any_value(q)) AS "RMSSE", avg(abs(y - yhat)) / any_value(a) AS "MASE"
  FROM scored JOIN scales USING (series_id, fold) GROUP BY 1, 2
)"""


def _naive_backtest(panel: DataFrame) -> DataFrame:
    """Seasonal naive over every fold, as joins on equal steps."""
    folds = V.cutoffs(panel, FOLDS, TEST, STEP)
    tests = V.test_rows(panel, folds, TEST).withColumn("src", F.col("cutoff") - 24 + F.pmod(F.col("h") - 1, F.lit(24)))
    source = panel.select("series_id", F.col("t").alias("src"), F.col("y").alias("yhat"))
    scales = M.train_scale(V.train_rows(panel, folds), ["series_id", "fold"])
    return tests.join(source, ["series_id", "src"]).join(scales, ["series_id", "fold"])


for _metric in _NAMES:
    def _one(spark, sf, _m=_metric):
        rows = M.evaluate(_naive_backtest(S.hourly_events(spark, sf)), [_m], ["series_id", "fold"])
        return rows.select("series_id", "fold", _re("score"))

    _one.__name__ = f"metric_{_metric.lower()}"
    query(f"""WITH {SERIES}, {SPLITS}, {BACKTEST} SELECT series_id, fold, round("{_metric}" + 1e-9, 4) AS score FROM wide""")(_one)


@query(f"""WITH {SERIES}, {SPLITS}, {BACKTEST}, long AS (UNPIVOT wide ON {', '.join(f'"{m}"' for m in _NAMES)} INTO NAME eval_metric VALUE score)
SELECT series_id, eval_metric, round(avg(score) + 1e-9, 4) AS score FROM long GROUP BY 1, 2""")
def cv_naive_metrics(spark, sf):
    rows = M.evaluate(_naive_backtest(S.hourly_events(spark, sf)), _NAMES, ["series_id", "fold"])
    return rows.groupBy("series_id", "eval_metric").agg(F.avg("score").alias("score")).select("series_id", "eval_metric", _re("score"))


@query(f"""WITH {SERIES}, {SPLITS}, {BACKTEST}, e AS (SELECT series_id, fold, avg(abs(y - yhat)) AS score,
 avg(CASE WHEN h <= 6 THEN abs(y - yhat) END) AS b, avg(CASE WHEN h > 6 THEN abs(y - yhat) END) AS a FROM scored GROUP BY 1, 2)
SELECT series_id, round(avg(score) + 1e-9, 4) AS score, round(avg(b) + 1e-9, 4) AS score_before_6, round(avg(a) + 1e-9, 4) AS score_after_6 FROM e GROUP BY 1""")
def cv_split_horizon(spark, sf):
    rows = M.evaluate(_naive_backtest(S.hourly_events(spark, sf)), ["MAE"], ["series_id", "fold"], split=6)
    names = ["score", "score_before_6", "score_after_6"]
    return rows.groupBy("series_id").agg(*[F.avg(c).alias(c) for c in names]).select("series_id", *[_re(c) for c in names])


@query(f"""WITH RECURSIVE {SERIES}, {SPLITS},
lagged AS (SELECT *, lag(y) OVER {W_}) AS x FROM panel),
model AS (SELECT f.series_id, f.fold, f.cutoff, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, arg_max(y, t) AS last
  FROM folds f JOIN lagged l ON l.series_id = f.series_id AND l.t < f.cutoff GROUP BY 1, 2, 3),
path AS (SELECT series_id, fold, cutoff, 0 AS h, last AS yhat, a, b FROM model
  UNION ALL SELECT series_id, fold, cutoff, h + 1, a + b * yhat, a, b FROM path WHERE h < {TEST}),
e AS (SELECT p.series_id, p.fold, avg(abs(q.y - greatest(0, p.yhat))) AS mae, sqrt(avg(pow(q.y - greatest(0, p.yhat), 2))) AS rmse
  FROM path p JOIN panel q ON q.series_id = p.series_id AND q.t = p.cutoff + p.h - 1 WHERE p.h > 0 GROUP BY 1, 2),
long AS (SELECT series_id, 'MAE' AS eval_metric, mae AS score FROM e UNION ALL SELECT series_id, 'RMSE', rmse FROM e)
SELECT series_id, eval_metric, round(avg(score) + 1e-9, 4) AS score FROM long GROUP BY 1, 2""")
def cv_ar1_metrics(spark, sf):
    rows = P.cross_validate(S.hourly_events(spark, sf), Lagged(1), FOLDS, TEST, ["MAE", "RMSE"], STEP)
    return rows.select("series_id", "eval_metric", _re("score"))


_WINDOWS, _DELTAS = 10, (0.5, 0.8)
CALIBRATION = f"""
n AS (SELECT series_id, max(t) + 1 AS n FROM panel GROUP BY 1),
folds AS (SELECT series_id, n - {AHEAD} - k AS cutoff FROM n, range(0, {_WINDOWS}) r(k)),
resid AS (SELECT f.series_id, p.t - f.cutoff + 1 AS h, p.y, q.y AS yhat, p.y - q.y AS e FROM folds f
  JOIN panel p ON p.series_id = f.series_id AND p.t BETWEEN f.cutoff AND f.cutoff + {AHEAD - 1}
  JOIN panel q ON q.series_id = f.series_id AND q.t = f.cutoff - 1),
point AS (SELECT n.series_id, h, p.y AS yhat FROM n JOIN panel p ON p.series_id = n.series_id AND p.t = n - 1, range(1, {AHEAD + 1}) s(h))"""


def _naive_calibration(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(residual rows, point forecast) of the naive forecast over sliding windows."""
    folds = V.cutoffs(panel, _WINDOWS, AHEAD, 1)
    tests = V.test_rows(panel, folds, AHEAD).withColumn("src", F.col("cutoff") - 1)
    rows = tests.join(panel.select("series_id", F.col("t").alias("src"), F.col("y").alias("yhat")), ["series_id", "src"])
    return rows.withColumn("resid", F.col("y") - F.col("yhat")), R.naive(panel, AHEAD)


def _order(level: float, method: str = "floor", values: str = "abs(e)") -> str:
    at = f"{method}(round({level} * (count(*) - 1), 9))"
    return f"list_sort(list({values}))[({at} + 1)::INT]"


@query(f"""WITH {SERIES}, {CALIBRATION}, q AS (
  SELECT series_id, h, 0.5 AS level, {_order(C.conformal_level(0.5, _WINDOWS))} AS q FROM resid GROUP BY 1, 2
  UNION ALL SELECT series_id, h, 0.8, {_order(C.conformal_level(0.8, _WINDOWS))} FROM resid GROUP BY 1, 2)
SELECT series_id, h::INT AS h, level::DOUBLE AS level, round(yhat - q, 6) AS lower, round(yhat, 6) AS yhat, round(yhat + q, 6) AS upper FROM point JOIN q USING (series_id, h)""")
def conformal_intervals(spark, sf):
    rows, point = _naive_calibration(S.hourly_events(spark, sf))
    out = C.intervals(point, C.calibrate(rows, list(_DELTAS), _WINDOWS))
    return out.select("series_id", "h", "level", _r("lower"), _r("yhat"), _r("upper"))


@query(f"""WITH {SERIES}, {CALIBRATION}, q AS (SELECT series_id, h, {_order(C.conformal_level(0.6, _WINDOWS))} AS a, {_order(C.conformal_level(0.8, _WINDOWS))} AS b FROM resid GROUP BY 1, 2),
l AS (SELECT series_id, h, 0.2 AS quantile, yhat - a AS value FROM point JOIN q USING (series_id, h) UNION ALL SELECT series_id, h, 0.5, yhat FROM point
  UNION ALL SELECT series_id, h, 0.9, yhat + b FROM point JOIN q USING (series_id, h))
SELECT series_id, h::INT AS h, quantile::DOUBLE AS quantile, round(value, 6) AS value FROM l""")
def conformal_quantiles(spark, sf):
    rows, point = _naive_calibration(S.hourly_events(spark, sf))
    return C.conformal_quantiles(point, rows, [0.2, 0.5, 0.9], _WINDOWS).select("series_id", "h", "quantile", _r("value"))


@query(f"""WITH {SERIES}, {CALIBRATION}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, h ORDER BY e) AS k FROM resid)
SELECT series_id, h::INT AS h, round(greatest(0.1, p.yhat + e), 6) AS value, k AS rank FROM r JOIN point p USING (series_id, h)""")
def residual_distribution(spark, sf):
    rows, point = _naive_calibration(S.hourly_events(spark, sf))
    out = C.residual_distribution(point, rows).join(rows.select("series_id", "h", "fold", "resid"), ["series_id", "h", "fold"])
    rank = F.row_number().over(S.W.partitionBy("series_id", "h").orderBy("resid")).cast("long")
    return out.select("series_id", "h", _r("value"), rank.alias("rank"))


@query(f"""WITH {SERIES}, {CALIBRATION}, f AS (SELECT cutoff_rank, h, sum(y) AS y, sum(yhat) AS yhat FROM
 (SELECT *, dense_rank() OVER (PARTITION BY series_id, h ORDER BY k) AS cutoff_rank FROM (SELECT *, row_number() OVER (PARTITION BY series_id, h ORDER BY t0) AS k FROM
  (SELECT f.series_id, p.t - f.cutoff + 1 AS h, p.y, q.y AS yhat, f.cutoff AS t0 FROM folds f
   JOIN panel p ON p.series_id = f.series_id AND p.t BETWEEN f.cutoff AND f.cutoff + {AHEAD - 1} JOIN panel q ON q.series_id = f.series_id AND q.t = f.cutoff - 1))) GROUP BY 1, 2),
s AS (SELECT h, {_order(C.conformal_level(0.8, _WINDOWS), values='abs(y - yhat)')} AS q FROM f GROUP BY 1), t AS (SELECT h, sum(yhat) AS yhat FROM point GROUP BY 1)
SELECT 'all' AS "group", h::INT AS h, 0.8::DOUBLE AS level, round(yhat - q, 4) AS lower, round(yhat, 4) AS yhat, round(yhat + q, 4) AS upper FROM t JOIN s USING (h)""")
def aggregate_conformal_sum(spark, sf):
    rows, point = _naive_calibration(S.hourly_events(spark, sf))
    return C.aggregate_conformal(rows, point, [0.8], _WINDOWS).select("group", "h", "level", _r("lower", 4), _r("yhat", 4), _r("upper", 4))


def _pairs(spark, sf):
    """Click and purchase demand side by side, aligned on the hour."""
    panel = S.hourly_events(spark, sf).select("ts", "series_id", "y")
    kinds = "series_id in ('click', 'purchase')"
    both = panel.where(kinds).groupBy("ts").pivot("series_id", ["click", "purchase"]).agg(F.first("y")).dropna()
    return S.number(both.select(F.lit("pair").alias("series_id"), "ts", F.col("click").alias("x"), F.col("purchase").alias("y")))


_LAGS = 6
PAIRS = f"""
met AS (SELECT a.ts, a.y AS x, b.y AS y, row_number() OVER (ORDER BY a.ts) - 1 AS t FROM panel a JOIN panel b ON a.ts = b.ts AND a.series_id = 'click' AND b.series_id = 'purchase'),
c AS (SELECT t, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM met),
s AS (SELECT count(*) AS n, sqrt(sum(x * x) * sum(y * y)) AS s FROM c),
k AS (SELECT k, sum(a.y * b.x) AS p FROM range(0, {_LAGS + 1}) r(k) JOIN c a ON true JOIN c b ON b.t = a.t + k GROUP BY k),
ccf AS (SELECT 'pair' AS series_id, k::INT AS lag, p / s * CASE WHEN k > 0 THEN n / (n - k) ELSE 1 END AS ccf, n FROM k, s)"""


@query(f"""WITH {SERIES}, {PAIRS} SELECT series_id, lag, round(ccf, 6) AS ccf, round(ccf - {D.z_value(0.05)!r} * se, 6) AS lower, round(ccf + {D.z_value(0.05)!r} * se, 6) AS upper FROM
 (SELECT *, CASE WHEN lag = 0 THEN 0 ELSE sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN ccf * ccf END) OVER (ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS se FROM ccf)""")
def ccf_bartlett(spark, sf):
    out = D.cross_correlation(_pairs(spark, sf), _LAGS, alpha=0.05, bartlett=True)
    return out.select("series_id", "lag", _r("ccf"), _r("lower"), _r("upper"))


RUNNING = PAIRS.replace("SELECT a.ts, a.y AS x, b.y AS y,", "SELECT a.ts, sum(a.y) OVER (ORDER BY a.ts) AS x, sum(b.y) OVER (ORDER BY a.ts) AS y,")


@query(f"""WITH {SERIES}, {RUNNING}, b AS (SELECT *, {D.z_value(0.05)!r} / sqrt(n - lag) AS z FROM ccf WHERE lag > 0),
g AS (SELECT *, CASE WHEN ccf > z THEN (ccf - z) / z WHEN ccf < -z THEN (ccf + z) / z ELSE 0 END AS s FROM b)
SELECT series_id, lag AS lags, round(s, 6) AS corr_score, round(ccf, 6) AS ccf_value, round(z, 6) AS z_bound, round(abs(s), 6) AS abs_corr_score FROM g WHERE abs(s) > 0""")
def ccf_strength(spark, sf):
    """Of the running sums of clicks and purchases, which go together at every lag."""
    so_far = S.W.partitionBy("series_id").orderBy("t")
    out = D.ccf_strength(_pairs(spark, sf).withColumns({c: F.sum(c).over(so_far) for c in "xy"}), _LAGS)
    return out.select("series_id", "lags", *[_r(c) for c in ("corr_score", "ccf_value", "z_bound", "abs_corr_score")])


@query(f"""WITH {MONTHS}, c AS (SELECT series_id, t, y - avg(y) OVER (PARTITION BY series_id) AS y FROM panel), s AS (SELECT series_id, count(*) AS n, sum(y * y) AS s FROM c GROUP BY 1),
k AS (SELECT a.series_id, k, sum(a.y * b.y) AS p FROM range(0, 13) r(k) JOIN c a ON true JOIN c b ON b.series_id = a.series_id AND b.t = a.t + k GROUP BY 1, 2)
SELECT series_id, k::INT AS lag, round(p / s * n / (n - k), 6) AS acf FROM k JOIN s USING (series_id)""")
def acf(spark, sf):
    return D.autocorrelation(S.monthly_orders(spark, sf), 12).select("series_id", "lag", _r("acf"))


# Queries whose algorithms SQL cannot express: rows only, with their own tests.


_PACF = 24
#: Autocorrelations r[1..], then Durbin and Levinson's recursion on a list of coefficients.
LEVINSON = f"""
c AS (SELECT series_id, t, y - avg(y) OVER (PARTITION BY series_id) AS y FROM panel), s AS (SELECT series_id, count(*) AS n, sum(y * y) AS s FROM c GROUP BY 1),
k AS (SELECT a.series_id, k, sum(a.y * b.y) AS p FROM range(1, {_PACF + 1}) r(k) JOIN c a ON true JOIN c b ON b.series_id = a.series_id AND b.t = a.t + k GROUP BY 1, 2),
acf AS (SELECT series_id, any_value(n) AS n, list(p / s * n / (n - k) ORDER BY k) AS r FROM k JOIN s USING (series_id) GROUP BY 1),
step AS (
  SELECT series_id, n, r, 1 AS k, [r[1]] AS phi FROM acf
  UNION ALL
  SELECT series_id, n, r, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - new * phi[k + 1 - j]), new) FROM (
    SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j]))) AS new
    FROM step WHERE k < {_PACF}))"""


@query(f"""WITH RECURSIVE {SERIES}, {LEVINSON}
SELECT series_id, k::INT AS lag, round(phi[k], 6) AS pacf, round({D.z_value(0.05)!r} / sqrt(n), 6) AS bound FROM step
UNION ALL SELECT series_id, 0, 1.0, round({D.z_value(0.05)!r} / sqrt(n), 6) FROM acf""")
def pacf(spark, sf):
    return D.pacf(S.hourly_events(spark, sf), _PACF).select("series_id", "lag", _r("pacf"), _r("bound"))


@query(f"""WITH RECURSIVE {SERIES}, {LEVINSON}, z AS (SELECT series_id, k, phi[k] AS p, {D.z_value(0.05)!r} / sqrt(n - {_PACF}) AS z FROM step),
g AS (SELECT *, CASE WHEN p > z THEN (p - z) / z WHEN p < -z THEN (p + z) / z ELSE 0 END AS s FROM z)
SELECT series_id, k::INT AS lags, round(s, 6) AS pacf_score, round(p, 6) AS pacf_value, round(z, 6) AS z_bound, round(abs(s), 6) AS abs_pacf_score FROM g WHERE abs(s) > 0""")
def pacf_strength(spark, sf):
    out = D.pacf_strength(S.hourly_events(spark, sf), _PACF)
    return out.select("series_id", "lags", *[_r(c) for c in ("pacf_score", "pacf_value", "z_bound", "abs_pacf_score")])


@query()
def unit_root(spark, sf):
    panel = S.hourly_events(spark, sf)
    return D.unit_root(panel, "ADF").unionByName(D.unit_root(panel, "KPSS"))


@query()
def stl_strength(spark, sf):
    return D.strengths(S.hourly_events(spark, sf), 24)


@query()
def differencing_orders(spark, sf):
    panel = S.monthly_orders(spark, sf)
    return D.differences_needed(panel).join(D.seasonal_differences_needed(panel, 12), "series_id")


_NORMAL = "sqrt(-2 * ln((('0x' || substr(d, 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)) * cos(2 * pi() * (('0x' || substr(d, 9, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)"
_DRAWN = f"""held AS (SELECT series_id, h, list(e ORDER BY e) AS r, stddev_samp(e) AS sd FROM resid GROUP BY 1, 2),
drawn AS (SELECT series_id, h, s, yhat + r[floor((('0x' || substr(md5('42:pick:' || series_id || ':' || h || ':' || s), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 * len(r))::INT + 1] AS base, sd, len(r) AS n,
  md5('42:noise:' || series_id || ':' || h || ':' || s) AS d FROM point JOIN held USING (series_id, h), range(1, 1001) a(s))"""


@query(f"""WITH {SERIES}, {CALIBRATION}, {_DRAWN} SELECT series_id, h::INT AS h, s::INT AS sample_id, round(greatest(0.1, base), 6) AS value FROM drawn""")
def bootstrap_empirical(spark, sf):
    rows, point = _naive_calibration(S.hourly_events(spark, sf))
    return C.bootstrap(point, rows).select("series_id", "h", "sample_id", _r("value"))


@query(f"""WITH {SERIES}, {CALIBRATION}, {_DRAWN}, v AS (SELECT series_id, h, list_sort(list(greatest(0.1, base + {_NORMAL} * coalesce(sd, 0) * pow(n, -0.2)))) AS v FROM drawn GROUP BY 1, 2)
SELECT series_id, h::INT AS h, q::DOUBLE AS quantile, round(v[floor(round(l * (len(v) - 1), 9))::INT + 1], 4) AS value FROM v,
 (VALUES (0.1, {C.conformal_level(0.1, _WINDOWS)!r}), (0.5, {C.conformal_level(0.5, _WINDOWS)!r}), (0.9, {C.conformal_level(0.9, _WINDOWS)!r})) x(q, l)""")
def bootstrap_kde(spark, sf):
    rows, point = _naive_calibration(S.hourly_events(spark, sf))
    return C.sample_quantiles(C.bootstrap(point, rows, kind="kde"), [0.1, 0.5, 0.9], _WINDOWS).select("series_id", "h", "quantile", _r("value", 4))




@query(f"""WITH RECURSIVE {SERIES}, {CALIBRATION.replace("SELECT f.series_id, p.t - f.cutoff + 1 AS h, p.y,", "SELECT f.series_id, f.cutoff, p.t - f.cutoff + 1 AS h, p.y,")},
wide AS (SELECT series_id, cutoff, list(e ORDER BY h) AS e FROM resid GROUP BY 1, 2),
cov AS (SELECT series_id, [{", ".join(f"avg(e[{i}])" for i in range(1, AHEAD + 1))}] AS mean, [{", ".join("[" + ", ".join(f"covar_samp(e[{i}], e[{j}])" for j in range(1, AHEAD + 1)) + "]" for i in range(1, AHEAD + 1))}] AS m FROM wide GROUP BY 1),
root AS (
  SELECT series_id, mean, m, 0 AS k, []::DOUBLE[][] AS l FROM cov
  UNION ALL
  SELECT series_id, mean, list_transform(range(1, {AHEAD + 1}), lambda i: list_transform(range(1, {AHEAD + 1}), lambda j: m[i][j] - c[i] * c[j])), k + 1, list_append(l, c)
  FROM (SELECT *, list_transform(range(1, {AHEAD + 1}), lambda i: CASE WHEN i <= k THEN 0 ELSE m[i][k + 1] / sqrt(m[k + 1][k + 1]) END) AS c FROM root WHERE k < {AHEAD})
),
drawn AS (SELECT series_id, s, list(z ORDER BY k) AS z FROM (SELECT series_id, s, k, {_NORMAL} AS z FROM (
  SELECT series_id, s, k, md5('42:' || series_id || ':' || s || ':' || k) AS d FROM cov, range(1, 1001) a(s), range(1, {AHEAD + 1}) b(k))) GROUP BY 1, 2)
SELECT p.series_id, s::INT AS sample_id, h::INT AS h, round(yhat + mean[h] + list_sum(list_transform(range(1, {AHEAD + 1}), lambda k: l[k][h] * z[k])), 4) AS value
FROM point p JOIN root r ON r.series_id = p.series_id AND r.k = {AHEAD} JOIN drawn d ON d.series_id = p.series_id""")
def correlated_sim(spark, sf):
    """Paths from Cholesky's root of the residuals' covariance and normal numbers hashed from a counter."""
    rows, point = _naive_calibration(S.hourly_events(spark, sf))
    return C.correlated_paths(point, rows).select("series_id", "sample_id", "h", _r("value", 4))


@query()
def ml_forecast(spark, sf):
    models = {k: Lagged([1, 2, 24], (LF.RollingMean(1, 24, 1),), r, Prepare(difference=1)) for k, r in enumerate((REGRESSORS["ridge"], REGRESSORS["boosting"]))}
    return P.forecast(S.hourly_events(spark, sf), models, 24)


@query(f"""WITH {SERIES}, x AS (SELECT series_id, t, y, y AS x1, lag(y) OVER {W_}) AS x2, lag(y, 23) OVER {W_}) AS x3 FROM panel),
d AS (SELECT x.series_id, h, x1, x2, x3, p.y AS z FROM x JOIN range(1, 13) r(h) ON true JOIN panel p ON p.series_id = x.series_id AND p.t = x.t + h), {_three("z", "series_id, h")},
n AS (SELECT series_id, max(t) AS t FROM panel GROUP BY 1)
SELECT series_id, h::INT AS h, round(greatest(0, a + b1 * x1 + b2 * x2 + b3 * x3), 4) AS yhat FROM m JOIN n USING (series_id) JOIN x ON x.series_id = m.series_id AND x.t = n.t""")
def direct_forecast(spark, sf):
    return P.forecast(S.hourly_events(spark, sf), Direct([1, 2, 24], regressor=Linear(), horizon=12), 12).select("series_id", "h", _r("yhat", 4))


@query()
def var_box_cox_forecast(spark, sf):
    return P.forecast(S.monthly_by_status(spark, sf), Lagged([1, 2], prepare=Prepare(box_cox=True)), 12, ["F", "O", "P"])


@query(f"""WITH RECURSIVE p AS (SELECT date_trunc('month', o_orderdate) AS ts, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS f,
  count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS o FROM orders GROUP BY 1),
l AS (SELECT ts, f, o, lag(f) OVER (ORDER BY ts) AS x1, lag(o) OVER (ORDER BY ts) AS x2 FROM p),
m AS (SELECT 1 AS k, {_two("x1", "x2", "f")} FROM l WHERE x1 IS NOT NULL), n AS (SELECT 1 AS k, {_two("x1", "x2", "o")} FROM l WHERE x1 IS NOT NULL),
path AS (SELECT 0 AS h, arg_max(f, ts) AS f, arg_max(o, ts) AS o FROM p
  UNION ALL SELECT h + 1, m.a + m.b1 * f + m.b2 * o, n.a + n.b1 * f + n.b2 * o FROM path JOIN m ON true JOIN n ON true WHERE h < {AHEAD})
SELECT 'F' AS target, h::INT AS h, round(greatest(0, f), 4) AS yhat FROM path WHERE h > 0
UNION ALL SELECT 'O', h::INT, round(greatest(0, o), 4) FROM path WHERE h > 0""")
def var1_forecast(spark, sf):
    return P.forecast(S.monthly_by_status(spark, sf), Lagged(1), AHEAD, ["F", "O"]).select("target", "h", _r("yhat", 4))


@query()
def bidirect_forecast(spark, sf):
    return P.forecast(S.monthly_by_status(spark, sf), Lagged(3, regressor=(REGRESSORS["ridge"], REGRESSORS["forest"])), 6, ["F", "O"])


@query()
def ets_forecast(spark, sf):
    return P.forecast(S.monthly_orders(spark, sf), Ets("add", "add", 12, damped=True), 12)


@query()
def sarima_forecast(spark, sf):
    return P.forecast(S.monthly_orders(spark, sf), Sarima(1, 0, 1, 1, 0, 0, 12), 12)


@query()
def hmm_states(spark, sf):
    return P.fit_reports(S.monthly_orders(spark, sf), MarkovSwitching(2, 1), "states")


@query()
def hmm_parameters(spark, sf):
    return P.fit_reports(S.monthly_orders(spark, sf), MarkovSwitching(2, 1), "parameters")


@query()
def hmm_forecast(spark, sf):
    return P.forecast(S.monthly_orders(spark, sf), MarkovSwitching(2, 2), 6)


@query()
def hmm_var_forecast(spark, sf):
    return P.forecast(S.monthly_by_status(spark, sf), MarkovSwitching(2, 1), 6, ["F", "O", "P"])


@query()
def hmm_cross_validate(spark, sf):
    return P.cross_validate(S.monthly_orders(spark, sf), MarkovSwitching(2, 1), 3, 6, ["MAE", "MASE"], 1, warm_rounds=3)


@query()
def tune_sarima(spark, sf):
    from tidewheel.operators.search import tune_sarima as tune

    return tune(S.monthly_orders(spark, sf), 1, 0, 1, 1, 0, 0, 12)


@query()
def forward_selection(spark, sf):
    from tidewheel.operators.search import forward_selection as select

    best, score = select(S.monthly_orders(spark, sf), lambda f: Lagged(list(f.lags)), ["MAE"], 3, 6, lags=[1, 2, 12])
    return spark.createDataFrame([(list(best.lags), float(score[0]))], "lags array<int>, score double")


@query()
def tune_lags(spark, sf):
    from tidewheel.operators.search import tune_lags as tune

    best, _ = tune(S.monthly_orders(spark, sf), lambda lags: Lagged(list(lags)), [1, 2, 3, 12], "MAE", 3, 6)
    return spark.createDataFrame([(list(best),)], "lags array<int>")


@query()
def pooled_forecast(spark, sf):
    from tidewheel.operators import pooled

    panel = S.hourly_events(spark, sf)
    return pooled.forecast(pooled.fit(panel, [1, 2, 24]), panel, [1, 2, 24], 12)


@query()
def probabilistic_intervals(spark, sf):
    from tidewheel.plans.probabilistic import Probabilistic

    return Probabilistic(S.monthly_orders(spark, sf), {0: Naive(12), 1: Ets("add"), 2: Lagged([1, 12])}, 8, 6).intervals([0.5, 0.8])


@query(f"""WITH RECURSIVE {MONTHS}, s AS (
  SELECT p.series_id, 0 AS t, p.y + (q.y - p.y) AS base, 0.4 * p.y + 0.6 * q.y AS level,
    0.1 * (0.4 * p.y + 0.6 * q.y - p.y) + 0.9 * (q.y - p.y) AS slope FROM panel p JOIN panel q ON q.series_id = p.series_id AND q.t = 1 WHERE p.t = 0
  UNION ALL
  SELECT s.series_id, s.t + 1, s.level + s.slope, 0.4 * p.y + 0.6 * (s.level + s.slope),
    0.1 * (0.4 * p.y + 0.6 * (s.level + s.slope) - s.level) + 0.9 * s.slope FROM s JOIN panel p ON p.series_id = s.series_id AND p.t = s.t + 1)
SELECT series_id, 0 AS candidate, t::INT AS t, round(base, 4) AS value FROM s""")
def ets_fitted(spark, sf):
    """Holt's linear smoothing with fixed factors: one-step fitted values."""
    return P.fit_reports(S.monthly_orders(spark, sf), Ets("add", alpha=0.4, beta=0.1), "fitted").select("series_id", "candidate", "t", _r("value", 4))


@query(f"""WITH RECURSIVE {MONTHS}, o AS (SELECT series_id, list(y ORDER BY t) AS y FROM panel GROUP BY 1),
i AS (SELECT series_id, y, list_avg(y[1:12]) AS level, (list_avg(y[13:24]) - list_avg(y[1:12])) / 12 AS slope FROM o),
s AS (
  SELECT series_id, y, 0 AS t, NULL::DOUBLE AS fitted, level, slope, list_transform(y[1:12], lambda v: v - level) AS season FROM i
  UNION ALL
  SELECT series_id, y, t + 1, level + slope + now, up, 0.1 * (up - level) + 0.9 * slope,
    list_concat(list_concat(season[1:t % 12], [0.2 * (y[t + 1] - level - slope) + 0.8 * now]), season[t % 12 + 2:]) FROM (
    SELECT *, season[t % 12 + 1] AS now, 0.3 * (y[t + 1] - season[t % 12 + 1]) + 0.7 * (level + slope) AS up FROM s WHERE t < len(y)))
SELECT series_id, (t - 1)::INT AS t, round(fitted, 4) AS value FROM s WHERE t > 0""")
def ets_seasonal_fitted(spark, sf):
    """Additive Holt-Winters with fixed factors: one-step fitted values."""
    return P.fit_reports(S.monthly_orders(spark, sf), Ets("add", "add", 12, alpha=0.3, beta=0.1, gamma=0.2), "fitted").select("series_id", "t", _r("value", 4))


@query("""WITH panel AS (SELECT l_returnflag AS series_id, date_trunc('day', l_shipdate) AS ts, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2)
SELECT series_id, ts, round(avg(y) OVER w + 1e-9, 6) AS mean_28, round(quantile_cont(y, 0.5) OVER w + 1e-9, 6) AS median_28 FROM panel
WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)""")
def rolling_shipments(spark, sf):
    """Four weeks of shipments a day, from lineitem."""
    mean, median = LF.RollingMean(1, 28, 1), LF.RollingQuantile(1, 28, 1, 0.5)
    rows = LF.add_lags(S.daily_shipments(spark, sf), None, transforms=[mean, median])
    return rows.select("series_id", "ts", *[(F.round(F.col(f"`{c.name}`") + 1e-9, 6) + 0.0).alias(n) for c, n in ((mean, "mean_28"), (median, "median_28"))])


@query(f"""WITH {SERIES}, {SPLITS}, {BACKTEST}, m AS (SELECT f.series_id, f.fold, median(abs(CASE WHEN s.t > 0 THEN s.d END)) AS m FROM folds f
  JOIN steps s ON s.series_id = f.series_id AND s.t < f.cutoff GROUP BY 1, 2)
SELECT series_id, fold, round(median(abs(y - yhat)) / nullif(any_value(m), 0) + 1e-9, 4) AS score FROM scored JOIN m USING (series_id, fold) GROUP BY 1, 2""")
def metric_medianase(spark, sf):
    return M.evaluate(_naive_backtest(S.hourly_events(spark, sf)), ["MedianASE"], ["series_id", "fold"]).select("series_id", "fold", _re("score"))


@query("""SELECT o_orderkey, (o_orderpriority = '2-HIGH')::INT::DOUBLE AS priority_2, (SELECT count(DISTINCT o_orderpriority) - 1 FROM orders)::INT AS n_columns FROM orders""")
def one_hot_drop_first(spark, sf):
    orders = S.read(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority")
    out = E.one_hot(orders, "o_orderpriority", E.categories(orders, "o_orderpriority"), drop_first=True)
    return out.select("o_orderkey", F.col("`o_orderpriority_2-HIGH`").alias("priority_2"), F.lit(len(out.columns) - 1).alias("n_columns"))


@query("""SELECT user_id, 'only click' AS part FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase')
UNION ALL SELECT user_id, 'either' FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'purchase')
UNION ALL SELECT user_id, 'both' FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')""")
def user_sets(spark, sf):
    """Set operations over users of two event types."""
    events = S.read(spark, f"{sf}/events.parquet").select("user_id", "event_type")
    a, b = (events.where(F.col("event_type") == kind).select("user_id") for kind in ("click", "purchase"))
    parts = {"only click": a.subtract(b), "either": a.union(b).distinct(), "both": a.intersect(b)}
    rows = [part.withColumn("part", F.lit(name)) for name, part in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query()
def backward_selection(spark, sf):
    from tidewheel.operators.search import Features, backward_selection as select

    best, score = select(S.monthly_orders(spark, sf), lambda f: Lagged(list(f.lags)), ["MAE"], 3, 6, Features(lags=(1, 2, 12)))
    return spark.createDataFrame([(list(best.lags), float(score[0]))], "lags array<int>, score double")


@query()
def forward_selection_by_target(spark, sf):
    """The lags of each target of a VAR on their own."""
    from tidewheel.operators.search import forward_selection as select, per_target

    found, _ = select(S.monthly_by_status(spark, sf), lambda f: Lagged(per_target(f.lags, 2)), ["MAE"], 3, 6, lags=[(0, 1), (0, 2), (1, 1), (1, 2)], targets=["F", "O"])
    return spark.createDataFrame([(j, lag) for j, lag in found.lags], "target int, lag int")


@query(f"""WITH {SERIES}, lags AS (SELECT p.series_id, h, p.y AS x, q.y AS z FROM panel p JOIN range(1, {AHEAD + 1}) r(h) ON true
  JOIN panel q ON q.series_id = p.series_id AND q.t = p.t + h),
m AS (SELECT series_id, h, regr_slope(z, x) AS b, regr_intercept(z, x) AS a FROM lags GROUP BY 1, 2),
last AS (SELECT series_id, arg_max(y, t) AS y FROM panel GROUP BY 1)
SELECT series_id, h::INT AS h, round(greatest(0, a + b * y), 4) AS yhat FROM m JOIN last USING (series_id)""")
def direct_ar1_forecast(spark, sf):
    """A model of its own for every step ahead."""
    return P.forecast(S.hourly_events(spark, sf), Direct(1, horizon=AHEAD), AHEAD).select("series_id", "h", _r("yhat", 4))


@query(f"""WITH RECURSIVE {SERIES}, d AS (SELECT series_id, t, y, y - lag(y) OVER {W_}) AS d FROM panel),
e AS (SELECT *, lag(d) OVER {W_}) AS x FROM d),
m AS (SELECT series_id, regr_slope(d, x) AS b, regr_intercept(d, x) AS a, arg_max(d, t) AS d, arg_max(y, t) AS y FROM e GROUP BY 1),
path AS (SELECT series_id, 0 AS h, a, b, d, y FROM m UNION ALL SELECT series_id, h + 1, a, b, a + b * d, y + a + b * d FROM path WHERE h < {AHEAD})
SELECT series_id, h::INT AS h, round(greatest(0, y), 4) AS yhat FROM path WHERE h > 0""")
def ml_differenced_forecast(spark, sf):
    """Recursive regression on differences, undone after the recursion and clamped at 0."""
    return P.forecast(S.hourly_events(spark, sf), Lagged(1, prepare=Prepare(difference=1)), AHEAD).select("series_id", "h", _r("yhat", 4))


_KPSS_LAGS = 4


@query(f"""WITH {MONTHS}, e AS (SELECT series_id, t, y - avg(y) OVER (PARTITION BY series_id) AS e FROM panel),
c AS (SELECT series_id, t, e, sum(e) OVER {W_}) AS c FROM e), n AS (SELECT series_id, count(*) AS n, sum(c * c) AS top, sum(e * e) AS s0 FROM c GROUP BY 1),
k AS (SELECT a.series_id, sum((1 - j / {_KPSS_LAGS + 1}.0::DOUBLE) * a.e * b.e) AS s1 FROM e a JOIN range(1, {_KPSS_LAGS + 1}) r(j) ON true
  JOIN e b ON b.series_id = a.series_id AND b.t = a.t - j GROUP BY 1)
SELECT series_id, round(top / (n * n * (s0 / n + 2.0 / n * s1)), 6) AS statistic FROM n JOIN k USING (series_id)""")
def kpss_statistic(spark, sf):
    return D.unit_root(S.monthly_orders(spark, sf), "KPSS", _KPSS_LAGS).select("series_id", _r("statistic"))


@query(f"""WITH RECURSIVE {SERIES}, m AS (SELECT series_id, t, y, lag(y, 1) OVER {W_}) AS x1, lag(y, 2) OVER {W_}) AS x2 FROM panel),
g AS (SELECT series_id, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1, covar_pop(x2, y) AS s2,
  avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM m WHERE x2 IS NOT NULL GROUP BY 1),
b AS (SELECT *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) AS b1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM g),
z AS (SELECT b.series_id, my - b1 * m1 - b2 * m2 AS a, b1, b2, arg_max(p.y, p.t) AS y1, arg_max(p.y, p.t) FILTER (p.t < n.m) AS y2
  FROM b JOIN panel p ON p.series_id = b.series_id JOIN (SELECT series_id, max(t) AS m FROM panel GROUP BY 1) n ON n.series_id = b.series_id GROUP BY ALL),
path AS (SELECT series_id, 0 AS h, a, b1, b2, y1, y2 FROM z UNION ALL SELECT series_id, h + 1, a, b1, b2, a + b1 * y1 + b2 * y2, y1 FROM path WHERE h < {AHEAD})
SELECT series_id, h::INT AS h, round(y1, 4) AS yhat FROM path WHERE h > 0""")
def ar2_recursive_forecast(spark, sf):
    """Two lags: normal equations by one aggregation, recursion by an array fold."""
    return R.recurse_ar(R.fit_ar(S.hourly_events(spark, sf), 2), 2, AHEAD).select("series_id", "h", _r("yhat", 4))


@query()
def feature_importances(spark, sf):
    return P.fit_reports(S.monthly_orders(spark, sf), Lagged([1, 2, 12], regressor=REGRESSORS["boosting"]), "importances")


@query(f"""WITH n AS (SELECT o_orderpriority AS series_id, count(DISTINCT date_trunc('month', o_orderdate))::INT AS n FROM orders GROUP BY 1),
s AS (SELECT series_id, n - 6 - k * 3 AS cutoff FROM n, range(0, 4) r(k) WHERE n - 6 - k * 3 >= 0)
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY cutoff)::INT AS fold, cutoff::INT AS cutoff,
 round((pow(cutoff, 0.5) - 1) / 0.5, 6) AS z FROM s""")
def sql_functions(spark, sf):
    """The SQL table function of folds and the SQL Box-Cox, per series."""
    from tidewheel.functions.sql import register

    register(spark)
    S.monthly_orders(spark, sf).groupBy("series_id").agg(F.count("*").cast("int").alias("n")).createOrReplaceTempView("tidewheel_lengths")
    return spark.sql("SELECT l.series_id, f.fold, f.cutoff, round(box_cox(f.cutoff, 0.5), 6) AS z FROM tidewheel_lengths l, LATERAL folds(l.n, 4, 6, 3) f")
