"""Queries over the sweep, the scans and the order statistics, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.functions import lagfeatures as LF
from tidewheel.functions import transforms as T
from tidewheel.operators import css as A
from tidewheel.operators import hmm_scan as H
from tidewheel.operators import loess as L
from tidewheel.operators import order_statistics as Q
from tidewheel.operators import scan as C
from tidewheel.operators import sweep as X
from tidewheel.operators.folds import cutoffs
from tidewheel.plans.catalogue import AHEAD, FOLDS, MONTHS, SERIES, SPLITS, STEP, TEST, W_, _r, query
from tidewheel.sources import panel as S

#: Steps of a stretch, so that the hourly series lie in several.
STRETCH = 200


def _matrix(columns: list[str]) -> str:
    """SQL: centred cross products of columns as a list of rows."""
    return "[" + ", ".join("[" + ", ".join(f"covar_pop({a}, {b}) * count(*)" for b in columns) + "]" for a in columns) + "]"


def _eliminated(name: str, source: str, keep: str, size: int, wide: int | None = None) -> str:
    """SQL: Gauss and Jordan's elimination of matrix m by the pivots in list p (from 1), a step a row."""
    wide = wide or size
    row = f"list_transform(range(1, {wide + 1}), lambda j: CASE WHEN i = p[step + 1] THEN m[i][j] / m[i][i] ELSE m[i][j] - m[i][p[step + 1]] * m[p[step + 1]][j] / m[p[step + 1]][p[step + 1]] END)"
    return f"""{name} AS (
  SELECT {keep}, p, m, 0 AS step FROM {source}
  UNION ALL
  SELECT {keep}, p, list_transform(range(1, {size + 1}), lambda i: {row}), step + 1 FROM {name} WHERE step < len(p)
)"""


_NAMES = ["y_lag_1", "y_lag_2", "y_lag_12"]
_SUBSETS = f"""lagged AS (SELECT series_id, y, lag(y, 1) OVER {W_}) AS x1, lag(y, 2) OVER {W_}) AS x2, lag(y, 12) OVER {W_}) AS x3 FROM panel),
gram AS (SELECT series_id, count(*) AS n, {_matrix(['x1', 'x2', 'x3', 'y'])} AS m, [avg(x1), avg(x2), avg(x3), avg(y)] AS mean FROM lagged WHERE x3 IS NOT NULL GROUP BY 1),
sets AS (SELECT series_id, n, m, mean, s, list_filter(range(1, 4), lambda i: (s >> (i - 1)::INT) & 1 = 1) AS p FROM gram, range(0, 8) r(s)),
{_eliminated('pivoted', 'sets', 'series_id, n, mean, s', 4)},
fits AS (
  SELECT series_id, n, s, p, m[4][4] AS rss, list_transform(range(1, 4), lambda i: CASE WHEN list_contains(p, i) THEN m[i][4] ELSE 0 END) AS b, mean,
    n * ln(m[4][4] / n) + 2 * (len(p) + 2) AS aic, n * ln(m[4][4] / n) + ln(n) * (len(p) + 2) AS bic
  FROM pivoted WHERE step = len(p)
)"""


@query(f"""WITH RECURSIVE {MONTHS}, {_SUBSETS}
SELECT series_id, s::INT AS subset, round(rss, 3) AS rss, round(aic, 4) AS aic, round(bic, 4) AS bic,
  round(mean[4] - b[1] * mean[1] - b[2] * mean[2] - b[3] * mean[3], 4) AS intercept, round(b[1], 6) AS b_1, round(b[2], 6) AS b_2, round(b[3], 6) AS b_12 FROM fits""")
def subset_criteria(spark, sf):
    """Coefficients, residuals and criteria of every subset of three lags, from one matrix a series."""
    design, names = X.lag_design(S.monthly_orders(spark, sf), [1, 2, 12])
    fits = X.every_subset(X.gram(design, names), 3)
    subset = F.aggregate("columns", F.lit(0), lambda s, k: s + F.call_function("shiftleft", F.lit(1), k))
    out = fits.select("series_id", subset.alias("subset"), "rss", "aic", "bic", *[F.col("coef")[k].alias(c) for k, c in enumerate(("intercept", "b_1", "b_2", "b_12"))])
    return out.select("series_id", "subset", _r("rss", 3), _r("aic", 4), _r("bic", 4), _r("intercept", 4), *[_r(c) for c in ("b_1", "b_2", "b_12")])


_NAMED = "list_aggregate(list_transform(list_filter(range(1, 4), lambda i: (s >> (i - 1)::INT) & 1 = 1), lambda i: ['y_lag_1', 'y_lag_2', 'y_lag_12'][i]), 'string_agg', ',')"


def _greedy(up: bool, score: str = "aic") -> str:
    """SQL: a greedy search over the subsets of three, a step a row while it improves."""
    begin = f"SELECT series_id, arg_min(s, {score}) AS s, min({score}) AS score FROM fits WHERE len(p) = 1 GROUP BY 1" if up else f"SELECT series_id, s, {score} AS score FROM fits WHERE s = 7"
    size, next_ = ("bit_count(s) + 1", "f.s & w.s = w.s") if up else ("bit_count(s) - 1", "f.s & w.s = f.s")
    size = size.replace("(s)", "(w.s)")
    return f"""walk AS (
  {begin}
  UNION ALL
  SELECT series_id, s, score FROM (SELECT w.series_id, arg_min(f.s, f.{score}) AS s, min(f.{score}) AS score, any_value(w.score) AS before
    FROM walk w JOIN fits f ON f.series_id = w.series_id AND len(f.p) = {size} AND len(f.p) > 0 AND {next_} GROUP BY w.series_id) WHERE score < before
)"""


def _selected(found):
    return found.select("series_id", F.array_join(F.filter(F.array(*[F.lit(c) for c in _NAMES]), lambda c: F.array_contains("features", c)), ",").alias("features"), F.round(F.col("score")[0], 4).alias("score"))


@query(f"""WITH RECURSIVE {MONTHS}, {_SUBSETS}, {_greedy(True)} SELECT series_id, {_NAMED} AS features, round(score, 4) AS score FROM walk QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY score) = 1""")
def forward_selection_by_criteria(spark, sf):
    """Lags added to each series' regression while AIC falls: the whole search is one job."""
    return _selected(X.select_features(S.monthly_orders(spark, sf), [1, 2, 12], criteria="AIC"))


@query(f"""WITH RECURSIVE {MONTHS}, {_SUBSETS}, {_greedy(False, 'bic')} SELECT series_id, {_NAMED} AS features, round(score, 4) AS score FROM walk QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY score) = 1""")
def backward_selection_by_criteria(spark, sf):
    """Lags taken out of each series' regression while BIC falls."""
    return _selected(X.select_features(S.monthly_orders(spark, sf), [1, 2, 12], criteria="BIC", method="backward"))


@query(f"""WITH {SERIES}, {SPLITS}, lagged AS (SELECT series_id, t, y, lag(y, 1) OVER {W_}) AS x1, lag(y, 24) OVER {W_}) AS x2 FROM panel),
g AS (SELECT f.series_id, f.fold, count(*) AS n, covar_pop(x1, x1) * count(*) AS a, covar_pop(x1, x2) * count(*) AS b, covar_pop(x2, x2) * count(*) AS c, covar_pop(x1, y) * count(*) AS u, covar_pop(x2, y) * count(*) AS v,
  avg(x1) AS m1, avg(x2) AS m2, avg(y) AS m FROM folds f JOIN lagged l ON l.series_id = f.series_id AND l.t < f.cutoff AND x2 IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, (u * c - v * b) / (a * c - b * b) AS b1, (v * a - u * b) / (a * c - b * b) AS b2 FROM g)
SELECT series_id, fold, n, round(b1, 6) AS b_1, round(b2, 6) AS b_24, round(m - b1 * m1 - b2 * m2, 4) AS intercept FROM k""")
def fold_regressions(spark, sf):
    """A regression for every fold of a backtest, from one scan: rows are summed between cutoffs."""
    panel = S.hourly_events(spark, sf)
    design, names = X.lag_design(panel, [1, 24])
    fits = X.solve(X.gram(design, names, folds=cutoffs(panel, FOLDS, TEST, STEP)), 2)
    out = fits.select("series_id", "fold", "n", *[F.col("coef")[k].alias(c) for k, c in enumerate(("intercept", "b_1", "b_24"))])
    return out.select("series_id", "fold", "n", _r("b_1"), _r("b_24"), _r("intercept", 4))


_VAR = f"""p AS (SELECT date_trunc('month', o_orderdate) AS ts, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS f, count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS o FROM orders GROUP BY 1),
l AS (SELECT ts, f AS y1, o AS y2, lag(f) OVER w AS x1, lag(f, 2) OVER w AS x2, lag(o) OVER w AS x3, lag(o, 2) OVER w AS x4 FROM p WINDOW w AS (ORDER BY ts)),
g AS (SELECT 'orders' AS series_id, count(*) AS n, [1, 2, 3, 4] AS p, {_matrix(['x1', 'x2', 'x3', 'x4', 'y1', 'y2'])} AS m, [avg(x1), avg(x2), avg(x3), avg(x4), avg(y1), avg(y2)] AS mean FROM l WHERE x2 IS NOT NULL),
{_eliminated('pivoted', 'g', 'series_id, n, mean', 6)},
fit AS (SELECT *, list_transform([5, 6], lambda t: mean[t] - m[1][t] * mean[1] - m[2][t] * mean[2] - m[3][t] * mean[3] - m[4][t] * mean[4]) AS a FROM pivoted WHERE step = 4)"""
_NEXT = lambda t: f"a[{t}] + m[1][{4 + t}] * f1 + m[2][{4 + t}] * f2 + m[3][{4 + t}] * o1 + m[4][{4 + t}] * o2"


@query(f"""WITH RECURSIVE {_VAR}, ends AS (SELECT arg_max(y1, ts) AS f1, arg_max(x1, ts) AS f2, arg_max(y2, ts) AS o1, arg_max(x3, ts) AS o2 FROM l),
path AS (SELECT 0 AS h, f1, f2, o1, o2 FROM ends UNION ALL SELECT h + 1, {_NEXT(1)}, f1, {_NEXT(2)}, o1 FROM path, fit WHERE h < 12)
SELECT series_id, 'F' AS target, h::INT AS h, round(greatest(0, f1), 4) AS yhat FROM path, fit WHERE h > 0 UNION ALL SELECT series_id, 'O', h::INT, round(greatest(0, o1), 4) FROM path, fit WHERE h > 0""")
def var_forecast(spark, sf):
    """Two lags of two targets: block normal equations by one aggregation, matrix times history by a fold."""
    model = X.fit_var(S.monthly_by_status(spark, sf), 2, ["F", "O"])
    return X.forecast_var(model, 2, ["F", "O"], 12).select("series_id", "target", "h", _r("yhat", 4))


@query(f"""WITH RECURSIVE {_VAR}, d AS (SELECT *, ln((m[5][5] * m[6][6] - m[5][6] * m[6][5]) / (n * n)) AS d FROM fit)
SELECT series_id, round(d + 20.0 / n, 6) AS aic, round(d + 20.0 / n + 2.0 * 10 * 11 / (n - 11) / n, 6) AS aicc, round(d + 10 * ln(n) / n, 6) AS bic, round(d + 20 * ln(ln(n)) / n, 6) AS hqc FROM d""")
def var_criteria(spark, sf):
    model = X.fit_var(S.monthly_by_status(spark, sf), 2, ["F", "O"])
    return X.var_criteria(model, 2, ["F", "O"]).select("series_id", *[_r(c) for c in X.CRITERIA])


_ADF = 3
_SMALL, _LARGE = (" + ".join(f"{v!r} * pow(statistic, {k})" for k, v in enumerate(c)) for c in (X.ADF_SMALL, X.ADF_LARGE))
_TAIL = f"(1 / (1 + {X.NORMAL_P} * abs(z)))"
_CDF = "(" + " + ".join(f"{b!r} * pow({_TAIL}, {k + 1})" for k, b in enumerate(X.NORMAL_B)) + ") * exp(-z * z / 2) / sqrt(2 * pi())"
_XS = [f"x{k}" for k in range(_ADF + 1)]


@query(f"""WITH RECURSIVE {MONTHS}, s AS (SELECT series_id, t, y - lag(y) OVER {W_}) AS d, lag(y) OVER {W_}) AS x0 FROM panel),
l AS (SELECT *, {", ".join(f"lag(d, {k}) OVER {W_}) AS x{k}" for k in range(1, _ADF + 1))} FROM s),
common AS (SELECT series_id, count(*) AS n, {list(range(1, _ADF + 2))} AS p, {_matrix([*_XS, 'd'])} AS m FROM l WHERE x{_ADF} IS NOT NULL GROUP BY 1),
{_eliminated('nested', 'common', 'series_id, n', _ADF + 2)},
best AS (SELECT series_id, arg_min(step - 1, n * ln(m[{_ADF + 2}][{_ADF + 2}] / n) + 2 * (step + 1)) AS k FROM nested WHERE step > 0 GROUP BY 1),
own AS (SELECT l.series_id, k, count(*) AS n, range(1, any_value(k) + 2) AS p, {_matrix([*[f"coalesce({x}, 0)" for x in _XS], 'd'])} AS g FROM l JOIN best USING (series_id) WHERE x0 IS NOT NULL AND t > k GROUP BY 1, 2),
wide AS (SELECT series_id, k, n, p, list_transform(range(1, {_ADF + 3}), lambda i: list_append(g[i], CASE WHEN i = 1 THEN 1.0 ELSE 0.0 END)) AS m FROM own),
{_eliminated('solved', 'wide', 'series_id, k, n', _ADF + 2, _ADF + 3)},
stat AS (SELECT series_id, k, m[1][{_ADF + 2}] / sqrt(m[{_ADF + 2}][{_ADF + 2}] / (n - k - 2) * m[1][{_ADF + 3}]) AS statistic FROM solved WHERE step = len(p)),
score AS (SELECT *, CASE WHEN statistic <= {X.ADF_STAR} THEN {_SMALL} ELSE {_LARGE} END AS z FROM stat)
SELECT series_id, k::INT AS used_lags, round(statistic, 6) AS statistic,
  round(CASE WHEN statistic > {X.ADF_MAX} THEN 1 WHEN statistic < {X.ADF_MIN} THEN 0 WHEN z >= 0 THEN 1 - {_CDF} ELSE {_CDF} END, 5) AS p_value FROM score""")
def adf_test(spark, sf):
    """Unit roots with the number of lagged differences by AIC: all nested regressions from one matrix."""
    out = X.adf(S.monthly_orders(spark, sf), _ADF)
    return out.select("series_id", F.col("used_lags").cast("int").alias("used_lags"), _r("statistic"), _r("p_value", 5))


# Scans: the hourly series lie in several stretches.


@query(f"""WITH {SERIES} SELECT series_id, t, round(avg(y) OVER w + 1e-9, 6) AS mean, round(stddev_samp(y) OVER w + 1e-9, 6) AS std FROM panel
WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)""")
def expanding_scan(spark, sf):
    rows = C.expanding(S.hourly_events(spark, sf), 2, mean="mean", std="std", chunk=STRETCH)
    return rows.select("series_id", "t", *[(F.round(F.col(c) + 1e-9, 6) + 0.0).alias(c) for c in ("mean", "std")])


@query(f"""WITH {SERIES} SELECT series_id, t, round(avg(y) OVER w + 1e-9, 6) AS mean, round(quantile_cont(y, 0.5) OVER w + 1e-9, 6) AS median FROM panel
WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)""")
def rolling_week_scan(spark, sf):
    """A week's mean and median: stretches take the week before along."""
    mean, median = LF.RollingMean(1, 168, 1), LF.RollingQuantile(1, 168, 1, 0.5)
    rows = C.windowed(S.hourly_events(spark, sf), [mean, median], chunk=STRETCH)
    return rows.select("series_id", "t", *[(F.round(F.col(f"`{c.name}`") + 1e-9, 6) + 0.0).alias(n) for c, n in ((mean, "mean"), (median, "median"))])


@query(f"""WITH {SERIES}, m AS (SELECT *, sum(CASE WHEN y >= 0.5 THEN 1 ELSE 0 END) OVER {W_}) AS g, CASE WHEN y > 0.5 THEN t END AS hit FROM panel),
k AS (SELECT *, hit - last_value(hit IGNORE NULLS) OVER {W_} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap, count(CASE WHEN y < 0.5 THEN 1 END) OVER (PARTITION BY series_id, g ORDER BY t) AS zero_run FROM m)
SELECT series_id, t, zero_run::BIGINT AS zero_run, coalesce(last_value(gap IGNORE NULLS) OVER {W_} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)::INT AS nz_interval FROM k""")
def intermittent_scan(spark, sf):
    rows = C.nonzero_interval(C.zero_run_length(S.hourly_events(spark, sf), chunk=STRETCH), chunk=STRETCH)
    return rows.select("series_id", "t", F.col("zero_run").cast("long").alias("zero_run"), "nz_interval")


@query(f"""WITH {SERIES}, n AS (SELECT series_id, max(t) AS m FROM panel GROUP BY 1)
SELECT p.series_id, (t - m + 300)::INT AS h, round(y, 3) AS twice, round(y, 4) AS seasonal FROM panel p JOIN n USING (series_id) WHERE t > m - 300""")
def undiff_scan(spark, sf):
    """The last 300 second differences and seasonal differences, undone from the history before them."""
    rows = S.hourly_events(spark, sf).withColumn("m", F.max("t").over(S.W.partitionBy("series_id"))).withColumns({"d1": T.diff("y"), "d2": T.diff("y", 2), "ds": T.seasonal_diff("y", 24)})
    late = rows.where(F.col("t") > F.col("m") - 300).withColumn("h", (F.col("t") - F.col("m") + 300).cast("int"))
    past = rows.where(F.col("t") <= F.col("m") - 300)
    ends = past.groupBy("series_id").agg(F.max_by("y", "t").alias("end_0"), F.max_by("d1", "t").alias("end_1"))
    seeds = past.where(F.col("t") > F.col("m") - 324).select("series_id", (F.col("t") - F.col("m") + 323).alias("phase"), F.col("y").alias("seed"))
    twice = C.undiff(late.select("series_id", "h", F.col("d2").alias("twice")), ends, 2, "twice", chunk=STRETCH)
    seasonal = C.invert_seasonal_diff(late.select("series_id", "h", F.col("ds").alias("seasonal")), seeds, 24, "seasonal", chunk=STRETCH)
    return twice.join(seasonal, ["series_id", "h"]).select("series_id", "h", _r("twice", 3), _r("seasonal", 4))


@query(f"""WITH RECURSIVE {SERIES}, level AS (SELECT series_id, t, y AS level FROM panel WHERE t = 0
UNION ALL SELECT p.series_id, p.t, l.level + 0.3 * (p.y - l.level) FROM level l JOIN panel p ON p.series_id = l.series_id AND p.t = l.t + 1)
SELECT series_id, t, round(level, 6) AS level FROM level""")
def smoothing_scan(spark, sf):
    return C.smoothed(S.hourly_events(spark, sf), 0.3, chunk=STRETCH).select("series_id", "t", _r("level"))


@query("""WITH e AS (SELECT event_type, user_id, ts, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t FROM events)
SELECT event_type, event_id, t::BIGINT AS t, round(sum(value) OVER (PARTITION BY event_type ORDER BY t) + 1e-9, 4) AS total FROM e""")
def numbered_events(spark, sf):
    """Every event's number within its type and the running total, with no type's events in one task."""
    events = S.read(spark, f"{sf}/events.parquet").select("event_type", "ts", "event_id", "value")
    rows = C.numbered(events, ["event_type"], ["ts", "event_id"])
    out = C.running(rows, {"total": ("sum", F.col("value"))}, ["event_type"], "t", chunk=500)
    return out.select("event_type", "event_id", "t", (F.round(F.col("total") + 1e-9, 4) + 0.0).alias("total"))


@query(f"""WITH {SERIES} SELECT series_id, t, CASE WHEN count(y) OVER w >= 1 THEN round(quantile_cont(y, 0.5) OVER w + 1e-9, 6) END AS value FROM panel
WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def expanding_quantile(spark, sf):
    """The median so far by digits of ranks, in near-linear time."""
    rows = Q.expanding_quantile(S.hourly_events(spark, sf), 0.5, 1)
    return rows.select("series_id", "t", (F.round(F.col("value") + 1e-9, 6) + 0.0).alias("value"))


@query(f"""WITH {SERIES} SELECT series_id, t, round(quantile_cont(y, 0.9) OVER w + 1e-9, 6) AS value FROM panel
WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING)""")
def expanding_quantile_scan(spark, sf):
    """The same for another quantile and shift, series lying in several stretches."""
    rows = Q.expanding_quantile(S.hourly_events(spark, sf), 0.9, 3, chunk=STRETCH)
    return rows.select("series_id", "t", (F.round(F.col("value") + 1e-9, 6) + 0.0).alias("value"))


# Markov switching at given parameters.

_PI, _MOVE, _B, _SD = (0.4, 0.6), (0.9, 0.1, 0.2, 0.8), ((20.0, 0.6), (30.0, 0.7)), (12.0, 25.0)
_LOG_B = [f"-0.5 * pow((y - {b[0]} - {b[1]} * x) / {sd}, 2) - ln({sd}) - 0.5 * ln(2 * pi())" for b, sd in zip(_B, _SD)]
_ADD = lambda a, b: f"(greatest({a}, {b}) + ln(1 + exp(-abs({a} - {b}))))"
HMM = f"""lagged AS (SELECT series_id, t, y, lag(y) OVER {W_}) AS x FROM panel),
b AS MATERIALIZED (SELECT series_id, (t - 1)::INT AS t, {_LOG_B[0]} AS b1, {_LOG_B[1]} AS b2, max(t) OVER (PARTITION BY series_id) - 1 AS last FROM lagged WHERE x IS NOT NULL),
forth AS (
  SELECT series_id, t, ln({_PI[0]}) + b1 AS f1, ln({_PI[1]}) + b2 AS f2 FROM b WHERE t = 0
  UNION ALL
  SELECT b.series_id, b.t, b1 + {_ADD(f"(f1 + ln({_MOVE[0]}))", f"(f2 + ln({_MOVE[2]}))")}, b2 + {_ADD(f"(f1 + ln({_MOVE[1]}))", f"(f2 + ln({_MOVE[3]}))")}
  FROM forth f JOIN b ON b.series_id = f.series_id AND b.t = f.t + 1
),
back AS (
  SELECT series_id, t, 0.0::DOUBLE AS g1, 0.0::DOUBLE AS g2 FROM b WHERE t = last
  UNION ALL
  SELECT b.series_id, b.t - 1, {_ADD(f"(ln({_MOVE[0]}) + b1 + g1)", f"(ln({_MOVE[1]}) + b2 + g2)")}, {_ADD(f"(ln({_MOVE[2]}) + b1 + g1)", f"(ln({_MOVE[3]}) + b2 + g2)")}
  FROM back g JOIN b ON b.series_id = g.series_id AND b.t = g.t AND b.t > 0
)"""


def _switching(spark, sf):
    rows = H.design(S.monthly_orders(spark, sf), 1)
    arrays = {"pi": _PI, "move": _MOVE, "sd": _SD}
    given = rows.select("series_id").distinct().withColumns({k: F.array(*[F.lit(float(x)) for x in v]) for k, v in arrays.items()}).withColumn("coef", F.array(*[F.array(*[F.lit(x) for x in b]) for b in _B]))
    return H.smooth(rows, given, 2, chunk=16)


@query(f"""WITH RECURSIVE {MONTHS}, {HMM} SELECT f.series_id, f.t, round(1 / (1 + exp(f2 + g2 - f1 - g1)), 6) AS p_0, round(1 / (1 + exp(f1 + g1 - f2 - g2)), 6) AS p_1 FROM forth f JOIN back g ON g.series_id = f.series_id AND g.t = f.t""")
def hmm_smoothed(spark, sf):
    """Regime probabilities at given parameters, stretch by stretch."""
    out = _switching(spark, sf).select("series_id", "t", *[F.col("gamma")[k].alias(f"p_{k}") for k in (0, 1)])
    return out.select("series_id", "t", _r("p_0"), _r("p_1"))


@query(f"""WITH RECURSIVE {MONTHS}, {HMM} SELECT f.series_id, round({_ADD('f1', 'f2')}, 4) AS log_likelihood, (f.t + 1)::BIGINT AS n FROM forth f JOIN b ON b.series_id = f.series_id AND b.t = f.t WHERE b.t = last""")
def hmm_log_likelihood(spark, sf):
    return H.evidence(_switching(spark, sf)).select("series_id", _r("log_likelihood", 4), "n")


@query(f"""WITH RECURSIVE {MONTHS}, {HMM}, g AS (SELECT f.series_id, f.t, l.y, l.x, 1 / (1 + exp(f2 + g2 - f1 - g1)) AS w FROM forth f JOIN back g ON g.series_id = f.series_id AND g.t = f.t JOIN lagged l ON l.series_id = f.series_id AND l.t = f.t + 1),
r AS (SELECT series_id, x, y, unnest([0, 1]) AS regime, greatest(unnest([w, 1 - w]), {H.FLOOR}) AS w FROM g),
s AS (SELECT series_id, regime, sum(w) + {H.RIDGE} AS a, sum(w * x) AS b, sum(w * x * x) + {H.RIDGE} AS c, sum(w * y) AS u, sum(w * x * y) AS v FROM r GROUP BY 1, 2)
SELECT series_id, regime::INT AS regime, round((u * c - v * b) / (a * c - b * b), 3) AS intercept, round((v * a - u * b) / (a * c - b * b), 5) AS slope FROM s""")
def hmm_maximised(spark, sf):
    """One maximisation: weighted regressions of both regimes from sums by series."""
    found = H.maximise(_switching(spark, sf), 2, 2)
    rows = found.select("series_id", F.posexplode("coef").alias("regime", "b"))
    return rows.select("series_id", "regime", F.round(F.col("b")[0], 3).alias("intercept"), F.round(F.col("b")[1], 5).alias("slope"))


# ARMA orders on a fixed grid.

_GRID = 5


def _css(number: int, source: str) -> str:
    """SQL: errors of an ARMA(1, 1) with parameters f and g (0 where the order lacks them), then the best of each order."""
    return f"""run{number} AS (
  SELECT c.series_id, o, f, g, lag_, c.t, e0 AS e, e0 * e0 AS s FROM (SELECT *, CASE WHEN lag_ = 0 THEN v ELSE v - f * before END AS e0 FROM {source} WHERE t = lag_) c
  UNION ALL
  SELECT r.series_id, r.o, r.f, r.g, r.lag_, w.t, w.v - r.f * w.before - r.g * r.e, r.s + pow(w.v - r.f * w.before - r.g * r.e, 2) FROM run{number} r JOIN w ON w.series_id = r.series_id AND w.t = r.t + 1
),
best{number} AS (SELECT series_id, o, min_by(f, {{'a': aic, 'f': f, 'g': g}}) AS f, min_by(g, {{'a': aic, 'f': f, 'g': g}}) AS g, min(aic) AS aic FROM (
  SELECT r.series_id, o, f, g, (n - lag_) * (ln(2 * pi() * s / (n - lag_)) + 1) + 2 * (o % 2 + o // 2 + 2) AS aic FROM run{number} r JOIN n ON n.series_id = r.series_id AND r.t = n - 1) GROUP BY 1, 2)"""


_ORDERS = "(SELECT o, o // 2 AS lag_ FROM range(0, 4) r(o))"  # o = 2 * p + q
_AT = f"-{A.REACH} + 2 * {A.REACH} * {{}} / {_GRID - 1}.0::DOUBLE"
_NEAR = f"greatest(-{A.REACH}, least({A.REACH}, {{}} + {2 * A.REACH / (_GRID - 1)!r}::DOUBLE * (2.0::DOUBLE * {{}} / {_GRID - 1} - 1)))"


@query(f"""WITH RECURSIVE {MONTHS}, w AS MATERIALIZED (SELECT series_id, t, v, coalesce(lag(v) OVER {W_}), 0) AS before FROM (SELECT series_id, t, y - avg(y) OVER (PARTITION BY series_id) AS v FROM panel)),
n AS (SELECT series_id, count(*)::INT AS n FROM w GROUP BY 1),
c1 AS (SELECT w.*, o, lag_, f, g FROM w, {_ORDERS}, (SELECT {_AT.format('i')} AS f, {_AT.format('j')} AS g FROM range(0, {_GRID}) a(i), range(0, {_GRID}) b(j) UNION SELECT 0, {_AT.format('j')} FROM range(0, {_GRID}) b(j)
  UNION SELECT {_AT.format('i')}, 0 FROM range(0, {_GRID}) a(i) UNION SELECT 0, 0) WHERE t = lag_ AND (o // 2 = 1 OR f = 0) AND (o % 2 = 1 OR g = 0)),
{_css(1, 'c1')},
c2 AS (SELECT DISTINCT w.*, b.o, b.o // 2 AS lag_, CASE WHEN b.o // 2 = 1 THEN {_NEAR.format('b.f', 'i')} ELSE 0 END AS f, CASE WHEN b.o % 2 = 1 THEN {_NEAR.format('b.g', 'j')} ELSE 0 END AS g
  FROM best1 b JOIN w ON w.series_id = b.series_id AND w.t = b.o // 2, range(0, {_GRID}) x(i), range(0, {_GRID}) y(j)),
{_css(2, 'c2')}
SELECT series_id, '(' || o // 2 || ', ' || o % 2 || ')x(0, 0)' AS "order", round(aic, 4) AS aic FROM best2""")
def tune_arma_grid(spark, sf):
    """AIC of ARMA orders up to (1, 1) by conditional sums of squares on a grid, refined once."""
    return A.search_orders(S.monthly_orders(spark, sf), 1, 0, 1, 0, 0, 0, 1, steps=_GRID, rounds=2).select("series_id", "order", _r("aic", 4))


# Local regression.

_PERIOD, _SEASONAL, _WIDTH, _LOW = 24, 7, 47, 25


def _loess(name: str, keys: str, source: str, span: int, extend: int = 0) -> str:
    """SQL: weighted lines around every step of source (keys, i, v), i from 0."""
    on = " AND ".join(f"s.{k} = b.{k}" for k in keys.split(", "))
    own = ", ".join(f"b.{k}" for k in keys.split(", "))
    return f"""{name}_n AS (SELECT {keys}, count(*) AS n, least({span}, count(*)) AS q FROM {source} GROUP BY ALL),
{name}_b AS (SELECT *, greatest(abs(a - p), abs(a + q - 1 - p)) * CASE WHEN {span} <= n THEN 1 ELSE {span}::DOUBLE / n END * 1.0000001::DOUBLE AS h
  FROM (SELECT *, least(greatest(0, ceil(p - q / 2.0)), n - q)::BIGINT AS a FROM (SELECT *, unnest(range(-{extend}, n + {extend})) AS p FROM {name}_n))),
{name}_m AS (SELECT {own}, p, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * v) AS r0, sum(w * x * v) AS r1 FROM (
  SELECT {own}, p, s.i - p AS x, v, pow(1 - pow(abs(s.i - p) / h, 3), 3) AS w FROM {name}_b b JOIN {source} s ON {on} AND s.i BETWEEN a AND a + q - 1) b GROUP BY ALL),
{name} AS (SELECT {keys}, p AS i, r0 / s0 - (r1 - s1 * r0 / s0) / (s2 - s1 * s1 / s0) * s1 / s0 AS v FROM {name}_m)"""


@query(f"""WITH {SERIES}, phases AS (SELECT series_id, t % {_PERIOD} AS phase, t // {_PERIOD} AS i, y AS v FROM panel),
{_loess('cyc', 'series_id, phase', 'phases', _SEASONAL, 1)},
c0 AS (SELECT series_id, phase + (i + 1) * {_PERIOD} AS i, v FROM cyc),
c1 AS (SELECT series_id, i, avg(v) OVER w AS v FROM c0 WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {_PERIOD - 1} FOLLOWING) QUALIFY count(*) OVER w = {_PERIOD}),
c2 AS (SELECT series_id, i, avg(v) OVER w AS v FROM c1 WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {_PERIOD - 1} FOLLOWING) QUALIFY count(*) OVER w = {_PERIOD}),
c3 AS (SELECT series_id, i, avg(v) OVER w AS v FROM c2 WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) QUALIFY count(*) OVER w = 3),
{_loess('flat', 'series_id', 'c3', _LOW)},
season AS (SELECT c.series_id, f.i, c.v - f.v AS s FROM flat f JOIN c0 c ON c.series_id = f.series_id AND c.i = f.i + {_PERIOD}),
rest AS (SELECT p.series_id, s.i, p.y - s AS v FROM season s JOIN panel p ON p.series_id = s.series_id AND p.t = s.i),
{_loess('level', 'series_id', 'rest', _WIDTH)},
parts AS (SELECT p.series_id, l.v AS level, s.s AS season, p.y - s.s - l.v AS r FROM level l JOIN season s ON s.series_id = l.series_id AND s.i = l.i JOIN panel p ON p.series_id = l.series_id AND p.t = l.i)
SELECT series_id, round(greatest(0, 1 - var_pop(r) / var_pop(r + level)), 6) AS trend_strength, round(greatest(0, 1 - var_pop(r) / var_pop(r + season)), 6) AS seasonality_strength FROM parts GROUP BY 1""")
def stl_strength_frames(spark, sf):
    """Strengths of trend and season by one pass of weighted frames."""
    out = L.strengths(S.hourly_events(spark, sf), _PERIOD, inner=1)
    return out.select("series_id", _r("trend_strength"), _r("seasonality_strength"))


# A stream with state, equal to its batch.


@query("""WITH RECURSIVE e AS (SELECT event_type AS series_id, ts, event_id AS row_id, value AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
s AS (
  SELECT series_id, k, y AS level, NULL::DOUBLE AS resid FROM e WHERE k = 1
  UNION ALL
  SELECT e.series_id, e.k, s.level + 0.3 * (e.y - s.level), e.y - s.level FROM s JOIN e ON e.series_id = s.series_id AND e.k = s.k + 1
),
w AS (SELECT series_id, k, level, resid, list(abs(resid)) FILTER (resid IS NOT NULL) OVER (PARTITION BY series_id ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS a FROM s)
SELECT series_id, row_id, round(level, 5) AS level, round(resid, 5) AS resid, round(CASE WHEN resid IS NOT NULL THEN list_sort(a)[floor(round(0.9 * (len(a) - 1), 9))::INT + 1] END, 5) AS width
FROM w JOIN e USING (series_id, k) WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 2 HOURS""")
def streaming_levels(spark, sf):
    """Levels and error quantiles of the events as a stream, up to the watermark."""
    from tidewheel.streaming.features import read_stream
    from tidewheel.streaming.levels import levels, written

    events = S.read(spark, f"{sf}/events.parquet")
    stream = read_stream(spark, f"{sf}/events.parque[t]", events.schema)  # a pattern, as a stream lists a folder
    out = written(levels(stream, "event_type", "ts", "event_id", "value"))
    return out.select("series_id", "row_id", _r("level", 5), _r("resid", 5), _r("width", 5))
