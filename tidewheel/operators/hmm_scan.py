"""Markov-switching regression of long series: the recursions as an associative scan.

Smoothing multiplies, step after step, matrices of log transition plus log emission in the semiring of
(log-sum-exp, +).  The product is associative, so a series is cut into stretches of ``chunk`` steps that
are multiplied out in different tasks; the products, one small matrix a stretch, are passed along
forwards and backwards, and a second look at each stretch gives every step's regime probabilities
and expected transitions.  The maximisation is weighted sums by series and regime and one
sweep per regime.  Everything is array expressions; parameters are a row per series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions.lagfeatures import add_lags, normal_lags
from tidewheel.operators.sweep import swept
from tidewheel.sources.shared import cut

KEYS = ("series_id",)
#: Steps of a stretch: within one, states are kept in an array that grows step by step.
CHUNK = 256
FLOOR, RIDGE, NEVER = 1e-5, 1e-5, -1e300


def _lse(terms: Sequence[Column]) -> Column:
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    total = F.exp(terms[0] - top)
    for t in terms[1:]:
        total = total + F.exp(t - top)
    return top + F.ln(total)


def _held(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def design(panel: DataFrame, lags: int | Sequence[int], exog: Sequence[str] = (), y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t, y, x): rows whose features are all known, x beginning with 1, t dense from 0 again."""
    lags = normal_lags(lags)
    rows = add_lags(panel, lags, y, keys=keys)
    names = [*exog, *[f"{y}_lag_{k}" for k in lags]]
    known = rows.dropna(subset=[y, *names])
    first = known.groupBy(*keys).agg(F.min("t").alias("_first"))
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in names])
    return known.join(first, list(keys)).select(*keys, (F.col("t") - F.col("_first")).cast("int").alias("t"), F.col(y).cast("double").alias("y"), x.alias("x"))


def parameters(design: DataFrame, regimes: int, columns: int, stay: float = 0.9, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, pi, move, coef, sd): a common regression, its intercepts spread over the residual deviation."""
    size = columns + 1
    fields = [*[F.col("x")[k] for k in range(columns)], F.col("y")]
    g = F.array(*[F.sum(fields[i] * fields[j]) for i in range(size) for j in range(size)])
    sums = design.groupBy(*keys).agg(F.count("*").alias("n"), g.alias("g"))
    done = sums.withColumn("a", swept(F.col("g"), F.sequence(F.lit(0), F.lit(columns - 1)), size))
    coef = [F.get("a", F.lit(k * size + columns)) for k in range(columns)]
    sd = F.sqrt(F.greatest(F.get("a", F.lit(size * size - 1)) / (F.col("n") - 1.0), F.lit(0.0)) + FLOOR)
    at = [-1.0 + 2.0 * s / (regimes - 1) if regimes > 1 else 0.0 for s in range(regimes)]
    away = (1.0 - stay) / max(1, regimes - 1)
    return done.where(F.col("n") > columns + regimes).select(
        *keys, F.array(*[F.lit(1.0 / regimes)] * regimes).alias("pi"),
        F.array(*[F.lit((stay if i == j else away) if regimes > 1 else 1.0) for i in range(regimes) for j in range(regimes)]).alias("move"),
        F.array(*[F.array(coef[0] + a * sd, *coef[1:]) for a in at]).alias("coef"), F.array(*[sd] * regimes).alias("sd"),
    )


def smooth(design: DataFrame, params: DataFrame, regimes: int, keys: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """(keys, t, y, x, gamma, xi, log_likelihood): probabilities of each regime at every step, expected moves (row by
    row) into it (NULL at the first), given (keys, pi, move, coef, sd)."""
    n = range(regimes)

    def emission(s: int) -> Column:
        fitted = F.aggregate(F.zip_with("x", F.get("coef", F.lit(s)), lambda a, b: a * b), F.lit(0.0), lambda u, v: u + v)
        sd = F.get("sd", F.lit(s))
        return -0.5 * F.pow((F.col("y") - fitted) / sd, 2) - F.ln(sd) - 0.5 * math.log(2.0 * math.pi)

    logged = lambda c: F.transform(c, lambda v: F.ln(v + 1e-300))
    rows = design.join(params, list(keys)).select(*keys, "t", "y", "x", F.array(*[emission(s) for s in n]).alias("b"), logged("pi").alias("pi"), logged("move").alias("move"))
    rows = rows.withColumn("_chunk", F.floor(F.col("t") / chunk).cast("int"))
    parts = rows.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(F.struct("t", "y", "x", "b"))).alias("s"), F.first("pi").alias("pi"), F.first("move").alias("move"))

    def move(v: Column, i: int, j: int) -> Column:
        """Log weight of going from i to j at a step; the first step comes from nowhere."""
        return F.when(v["t"] == 0, F.get("pi", F.lit(j))).otherwise(F.get("move", F.lit(i * regimes + j))) + F.get(v["b"], F.lit(j))

    unit = F.array(*[F.lit(0.0 if i == j else NEVER) for i in n for j in n])
    product = F.aggregate("s", unit, lambda m, v: F.array(*[_lse([F.get(m, F.lit(i * regimes + k)) + move(v, k, j) for k in n]) for i in n for j in n]))
    parts = cut(parts.withColumn("m", product))

    # what enters each stretch from the left, and what follows it to the right: a row per stretch
    line = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_chunk", "m"))).alias("l"))
    forth = lambda a, p: F.array(*[_lse([F.get(a, F.lit(i)) + F.get(p["m"], F.lit(i * regimes + j)) for i in n]) for j in n])
    back = lambda b, p: F.array(*[_lse([F.get(p["m"], F.lit(i * regimes + j)) + F.get(b, F.lit(j)) for j in n]) for i in n])
    growing = lambda go: lambda s, p: F.struct(F.concat(s["o"], F.array(s["v"])).alias("o"), go(s["v"], p).alias("v"))
    none = F.array().cast("array<array<double>>")
    one_hot, flat = F.array(*[F.lit(0.0 if i == 0 else NEVER) for i in n]), F.array(*[F.lit(0.0)] * regimes)
    left = F.aggregate("l", F.struct(none.alias("o"), one_hot.alias("v")), growing(forth))
    right = F.aggregate(F.reverse("l"), F.struct(none.alias("o"), flat.alias("v")), growing(back), lambda s: F.reverse(s["o"]))
    ends = line.select(*keys, left.alias("left"), right.alias("right"), F.transform("l", lambda p: p["_chunk"]).alias("c"))
    ends = ends.withColumn("log_likelihood", _lse([F.get("left.v", F.lit(j)) for j in n]))
    each = ends.select(*keys, "log_likelihood", F.explode(F.arrays_zip(F.col("c"), F.col("left.o").alias("a"), F.col("right").alias("b"))).alias("e"))
    met = parts.join(each.select(*keys, "log_likelihood", F.col("e.c").alias("_chunk"), F.col("e.a").alias("enter"), F.col("e.b").alias("leave")), [*keys, "_chunk"])

    step = lambda s, v: F.struct(F.concat(s["o"], F.array(s["v"])).alias("o"), F.array(*[_lse([F.get(s["v"], F.lit(i)) + move(v, i, j) for i in n]) for j in n]).alias("v"))
    ahead = F.aggregate("s", F.struct(none.alias("o"), F.col("enter").alias("v")), step, lambda s: F.concat(s["o"], F.array(s["v"])))
    down = lambda s, v: F.struct(F.concat(s["o"], F.array(s["v"])).alias("o"), F.array(*[_lse([move(v, i, j) + F.get(s["v"], F.lit(j)) for j in n]) for i in n]).alias("v"))
    behind = F.aggregate(F.reverse("s"), F.struct(none.alias("o"), F.col("leave").alias("v")), down, lambda s: F.reverse(s["o"]))
    met = met.select(*keys, "log_likelihood", "pi", "move", "s", ahead.alias("alpha"), behind.alias("beta"))
    # alpha has an entry more: what entered, then the value after every step
    zipped = F.arrays_zip(F.col("s").alias("v"), F.slice("alpha", 1, F.size("s")).alias("before"), F.slice("alpha", 2, F.size("s")).alias("now"), F.col("beta").alias("after"))
    out = met.select(*keys, "log_likelihood", "pi", "move", F.explode(zipped).alias("z"))
    joint = F.array(*[F.get("z.now", F.lit(j)) + F.get("z.after", F.lit(j)) for j in n])
    gamma = _held(joint, lambda v: _held(_lse([F.get(v, F.lit(j)) for j in n]), lambda total: F.transform(v, lambda u: F.exp(u - total))))
    xi = F.array(*[F.exp(F.get("z.before", F.lit(i)) + F.get("move", F.lit(i * regimes + j)) + F.get("z.v.b", F.lit(j)) + F.get("z.after", F.lit(j)) - F.col("log_likelihood")) for i in n for j in n])
    return out.select(*keys, F.col("z.v.t").alias("t"), F.col("z.v.y").alias("y"), F.col("z.v.x").alias("x"), gamma.alias("gamma"), F.when(F.col("z.v.t") > 0, xi).alias("xi"), "log_likelihood")


def maximise(smoothed: DataFrame, regimes: int, columns: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, pi, move, coef, sd, log_likelihood) from weighted sums by series and regime."""
    n, size = range(regimes), columns + 1
    w = lambda s: F.greatest(F.get("gamma", F.lit(s)), F.lit(FLOOR))
    fields = [*[F.col("x")[k] for k in range(columns)], F.col("y")]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = smoothed.groupBy(*keys).agg(
        F.first("log_likelihood").alias("log_likelihood"), F.max_by("gamma", -F.col("t")).alias("first"),
        F.array(*[F.sum(F.get("xi", F.lit(k))) for k in range(regimes * regimes)]).alias("moves"),
        *[F.struct(F.sum(w(s)).alias("w"), F.array(*[F.sum(w(s) * fields[i] * fields[j]) for i, j in pairs]).alias("p")).alias(f"r{s}") for s in n],
    )
    at = {p: k for k, p in enumerate(pairs)}
    coefs, sds = [], []
    for s in n:
        own = lambda i, j, s=s: F.col(f"r{s}.p")[at[min(i, j), max(i, j)]]
        full = F.array(*[own(i, j) + (RIDGE if i == j < columns else 0.0) for i in range(size) for j in range(size)])
        sums = sums.withColumn(f"g{s}", full).withColumn(f"a{s}", swept(F.col(f"g{s}"), F.sequence(F.lit(0), F.lit(columns - 1)), size))
        b = [F.get(f"a{s}", F.lit(k * size + columns)) for k in range(columns)]
        rest = own(columns, columns)
        for i in range(columns):
            rest = rest - 2.0 * b[i] * own(i, columns)
            for j in range(columns):
                rest = rest + b[i] * b[j] * own(i, j)
        coefs.append(F.array(*b))
        sds.append(F.sqrt(F.greatest(rest / F.col(f"r{s}.w"), F.lit(FLOOR))))
    total = lambda values: sum(values[1:], values[0])
    start = [F.get("first", F.lit(s)) + FLOOR for s in n]
    go = [[F.get("moves", F.lit(i * regimes + j)) + FLOOR for j in n] for i in n]
    return sums.select(*keys, F.array(*[v / total(start) for v in start]).alias("pi"), F.array(*[v / total(row) for row in go for v in row]).alias("move"), F.array(*coefs).alias("coef"), F.array(*sds).alias("sd"), "log_likelihood")


def fit(panel: DataFrame, regimes: int = 2, lags: int | Sequence[int] = 1, exog: Sequence[str] = (), rounds: int = 10, start: DataFrame | None = None, y: str = "y", keys: Sequence[str] = KEYS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(parameters, smoothed rows) after ``rounds`` of expectation and maximisation, all series side by side."""
    rows = cut(design(panel, lags, exog, y, keys))
    columns = 1 + len(exog) + len(normal_lags(lags))
    params = cut(parameters(rows, regimes, columns, keys=keys)) if start is None else start
    for _ in range(rounds):
        params = cut(maximise(smooth(rows, params, regimes, keys, chunk), regimes, columns, keys))
    return params, smooth(rows, params.drop("log_likelihood"), regimes, keys, chunk)


def states(smoothed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t, state, probability): the likeliest regime of every step."""
    most = F.array_max("gamma")
    return smoothed.select(*keys, "t", (F.array_position("gamma", most) - 1).cast("int").alias("state"), most.alias("probability"))


def evidence(smoothed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, log_likelihood, n)."""
    return smoothed.groupBy(*keys).agg(F.first("log_likelihood").alias("log_likelihood"), F.count("*").alias("n"))


def regime_weights(smoothed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, state, share): mean probability of each regime."""
    rows = smoothed.select(*keys, F.posexplode("gamma").alias("state", "p"))
    return rows.groupBy(*keys, "state").agg(F.avg("p").alias("share")).withColumn("share", F.col("share") / F.sum("share").over(W.partitionBy(*keys)))
