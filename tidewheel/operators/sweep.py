"""Least squares by pivoting: every fit that a set of columns allows comes from one Gram matrix.

One aggregation sums the centred cross products of design and targets, per series and, if asked for,
per fold of a backtest: numbers bounded by the design's width.  The sweep of a pivot brings
a column into the fit or out of it again, on the flat matrix as an array expression, and leaves
coefficients, the inverse of the cross products and the residual cross products where they can be
read off.  Searches over subsets, nested models and several targets are folds of sweeps: one job for all
series and folds, with no further look at the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions.lagfeatures import LagTransform, add_lags, normal_lags

KEYS = ("series_id",)
#: A pivot that has lost this much of its column's own sum of squares is linearly dependent.
SINGULAR = 1e-11
CRITERIA = ("aic", "aicc", "bic", "hqc")


def gram(design: DataFrame, columns: Sequence[str], targets: Sequence[str] = ("y",), keys: Sequence[str] = KEYS, folds: DataFrame | None = None) -> DataFrame:
    """(keys[, fold], n, mean, g): means of columns and targets, and their centred cross products, row by
    row, of the rows in which all are known.  With ``folds`` (keys, fold, cutoff) a matrix for the rows
    before each cutoff: every row is summed once, into the stretch between two cutoffs."""
    names = [*columns, *targets]
    known = design.dropna(subset=names)
    base = known.select(*keys, "t", *[F.col(f"`{c}`").cast("double").alias(f"_x{k}") for k, c in enumerate(names)])
    # sums are taken around each series' means, so that differences of large numbers cancel exactly enough
    centre = [F.avg(f"_x{k}").over(W.partitionBy(*keys)).alias(f"_c{k}") for k in range(len(names))]
    base = base.select(*keys, "t", *[f"_x{k}" for k in range(len(names))], *centre)
    size = len(names)
    d = [F.col(f"_x{k}") - F.col(f"_c{k}") for k in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    at = {p: k for k, p in enumerate(pairs)}
    sums = [F.count("*").alias("n"), F.array(*[F.sum(x) for x in d]).alias("s"), F.array(*[F.sum(d[i] * d[j]) for i, j in pairs]).alias("p"), F.array(*[F.first(f"_c{k}") for k in range(size)]).alias("c")]
    if folds is None:
        total = base.groupBy(*keys).agg(*sums)
        by = list(keys)
    else:
        cuts = folds.groupBy(*keys).agg(F.array_sort(F.collect_list("cutoff")).alias("_cuts"))
        part = F.size(F.filter("_cuts", lambda c: c <= F.col("t")))
        parts = base.join(cuts, list(keys)).withColumn("_part", part).groupBy(*keys, "_part").agg(*sums)
        rank = (F.row_number().over(W.partitionBy(*keys).orderBy("cutoff")) - 1).alias("_fold")
        each = folds.select(*keys, "fold", rank).join(parts, list(keys)).where(F.col("_part") <= F.col("_fold"))
        added = lambda c, m: F.array(*[F.sum(F.col(c)[k]) for k in range(m)]).alias(c)
        total = each.groupBy(*keys, "fold").agg(F.sum("n").alias("n"), added("s", size), added("p", len(pairs)), F.first("c").alias("c"))
        by = [*keys, "fold"]
    n = F.col("n").cast("double")
    mean = F.zip_with("c", "s", lambda c, s: c + s / n)
    full = F.array(*[F.col("p")[at[min(i, j), max(i, j)]] - F.col("s")[i] * F.col("s")[j] / n for i in range(size) for j in range(size)])
    return total.select(*by, "n", mean.alias("mean"), full.alias("g"))


def sweep(a: Column, pivot: Column | int, size: int) -> Column:
    """The flat matrix ``a`` with one pivot swept; a second sweep takes it back.  ``a`` should be a name or a
    lambda's variable, as it is read in every entry."""
    k = F.lit(pivot) if isinstance(pivot, int) else pivot
    d = F.get(a, k * size + k)

    def entry(x: Column, at: Column) -> Column:
        i, j = F.floor(at / size).cast("int"), F.pmod(at, F.lit(size))
        return (
            F.when((i == k) & (j == k), 1.0 / d)
            .when(i == k, x / d)
            .when(j == k, -x / d)
            .otherwise(x - F.get(a, i * size + k) * F.get(a, k * size + j) / d)
        )

    return F.transform(a, entry)


def swept(a: Column, pivots: Column, size: int) -> Column:
    """All of ``pivots`` swept in turn, linearly dependent ones left out (their coefficients are 0)."""
    start = F.struct(a.alias("a"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.get(a, k * size + k)).alias("own"))

    def step(state: Column, k: Column) -> Column:
        sound = F.get(state["a"], k * size + k) > SINGULAR * F.get(state["own"], k)
        return F.struct(F.when(sound, sweep(state["a"], k, size)).otherwise(state["a"]).alias("a"), state["own"].alias("own"))

    return F.aggregate(pivots, start, step, lambda s: s["a"])


def _entry(a: Column, i: int, j: int, size: int) -> Column:
    return F.get(a, F.lit(i * size + j))


def solve(grams: DataFrame, columns: int, targets: int = 1, pivots: Column | None = None) -> DataFrame:
    """``coef`` (per target: intercept, then a number per column, 0 for one not among ``pivots``), ``rss`` (residual
    cross products of the targets, row by row) and ``inverse`` (the diagonal of that of the cross products)."""
    size = columns + targets
    pivots = F.sequence(F.lit(0), F.lit(columns - 1)) if pivots is None else pivots
    done = grams.withColumn("_a", swept(F.col("g"), pivots, size)).withColumn("_in", pivots)
    a, inside = F.col("_a"), lambda k: F.array_contains("_in", F.lit(k))
    rows = []
    for t in range(targets):
        b = [F.when(inside(k), _entry(a, k, columns + t, size)).otherwise(0.0) for k in range(columns)]
        own = F.get("mean", F.lit(columns + t))
        for k, v in enumerate(b):
            own = own - v * F.get("mean", F.lit(k))
        rows.append(F.array(own, *b))
    rss = [_entry(a, columns + i, columns + j, size) for i in range(targets) for j in range(targets)]
    inverse = [F.when(inside(k), _entry(a, k, k, size)) for k in range(columns)]
    return done.withColumns({"coef": rows[0] if targets == 1 else F.array(*rows), "rss": F.array(*rss), "inverse": F.array(*inverse)}).drop("_a", "_in", "g", "mean")


def criterion(name: str, rss: Column, n: Column, features: Column) -> Column:
    """aic, aicc, bic or hqc of a linear model: its features, intercept and variance count."""
    k, n = features.cast("double") + 2.0, n.cast("double")
    base = n * F.ln(F.greatest(rss, F.lit(1e-300)) / n)
    return {
        "aic": lambda: base + 2.0 * k, "aicc": lambda: base + 2.0 * k + F.try_divide(2.0 * k * (k + 1.0), n - k - 1.0),
        "bic": lambda: base + k * F.ln(n), "hqc": lambda: base + 2.0 * k * F.ln(F.ln(n)),
    }[name]()


def every_subset(grams: DataFrame, columns: int) -> DataFrame:
    """``columns`` (the numbers brought in), coef, rss and all criteria of every subset of at most 12 columns."""
    if columns > 12:
        raise ValueError("more than 4096 subsets; search them greedily")
    bits = F.explode(F.sequence(F.lit(0), F.lit((1 << columns) - 1)))
    subset = F.filter(F.sequence(F.lit(0), F.lit(columns - 1)), lambda k: F.col("_m").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) > 0)
    grams = grams.withColumn("_m", bits).withColumn("columns", subset)
    out = solve(grams, columns, 1, F.col("columns")).drop("inverse", "_m").withColumn("rss", F.col("rss")[0])
    return out.withColumns({c: criterion(c, F.col("rss"), F.col("n"), F.size("columns")) for c in CRITERIA})


def _better(new: Column, old: Column, accept: str) -> Column:
    """``all``: every criterion improves; ``lexicographic``: in their order."""
    if accept == "all":
        return F.forall(F.arrays_zip(new.alias("a"), old.alias("b")), lambda p: p["a"] < p["b"])
    return new < old


def _search(grams: DataFrame, columns: int, criteria: Sequence[str], accept: str, forward: bool) -> DataFrame:
    size, y = columns + 1, columns
    numbers = F.sequence(F.lit(0), F.lit(columns - 1))
    n = F.col("n")

    def scores(rss: Column, count: Column) -> Column:
        return F.array(*[criterion(c, rss, n, count) for c in criteria])

    def trial(state: Column, k: Column) -> Column:
        """Residual sum of squares once column k is swept: a step of one entry, not of the matrix."""
        a = state["a"]
        return F.get(a, F.lit(y * size + y)) - F.get(a, F.lit(y * size) + k) * F.get(a, k * size + y) / F.get(a, k * size + k)

    def turn(state: Column, _: Column) -> Column:
        count = F.size(state["chosen"]) + (1 if forward else -1)
        able = (lambda k: ~F.array_contains(state["chosen"], k) & (F.get(state["a"], k * size + k) > SINGULAR * F.get(F.col("g"), k * size + k))) if forward else (lambda k: F.array_contains(state["chosen"], k))
        start = F.struct(F.lit(-1).alias("k"), state["score"].alias("score"))

        def weigh(best: Column, k: Column) -> Column:
            new = scores(trial(state, k), count)
            return F.when(able(k) & _better(new, best["score"], accept), F.struct(k.alias("k"), new.alias("score"))).otherwise(best)

        best = F.aggregate(numbers, start, weigh)
        least = F.lit(True) if forward else count > 0
        # a struct of the choice first, so that it is worked out once
        return F.transform(F.array(best), lambda b: F.when((b["k"] >= 0) & least, F.struct(
            sweep(state["a"], b["k"], size).alias("a"),
            (F.concat(state["chosen"], F.array(b["k"])) if forward else F.array_remove(state["chosen"], b["k"])).alias("chosen"),
            b["score"].alias("score"),
        )).otherwise(state))[0]

    if forward:
        begin = F.struct(F.col("g").alias("a"), F.array().cast("array<int>").alias("chosen"), F.array(*[F.lit(float("inf"))] * len(criteria)).alias("score"))
    else:
        whole = F.col("_whole")
        grams = grams.withColumn("_whole", swept(F.col("g"), numbers, size))
        begin = F.struct(whole.alias("a"), numbers.alias("chosen"), scores(F.get(whole, F.lit(y * size + y)), F.lit(columns)).alias("score"))
    end = F.aggregate(numbers, begin, turn)
    return grams.withColumn("_end", end).withColumns({"columns": F.col("_end.chosen"), "score": F.col("_end.score")}).drop("_end", "_whole")


def forward(grams: DataFrame, columns: int, criteria: Sequence[str] = ("aic",), accept: str = "all") -> DataFrame:
    """Greedy additions while the criteria improve; ``columns`` in the order they came in, and ``score``."""
    return _search(grams, columns, criteria, accept, True)


def backward(grams: DataFrame, columns: int, criteria: Sequence[str] = ("aic",), accept: str = "lexicographic") -> DataFrame:
    """Greedy removals, starting from all columns, while the criteria improve; one column stays."""
    return _search(grams, columns, criteria, accept, False)


def lag_design(panel: DataFrame, lags: int | Sequence[int] = (), exog: Sequence[str] = (), transforms: Sequence[LagTransform] = (), targets: Sequence[str] = ("y",), keys: Sequence[str] = KEYS) -> tuple[DataFrame, list[str]]:
    """(panel with features, their names): lags and lag transforms of every target, and exogenous columns."""
    names = list(exog)
    for y in targets:
        prefix = f"{y}_" if len(targets) > 1 else ""
        panel = add_lags(panel, lags, y, transforms, keys, prefix)
        names += [f"{y}_lag_{k}" for k in normal_lags(lags or None)] + [prefix + t.name for t in transforms]
    return panel, names


def select_features(panel: DataFrame, lags: int | Sequence[int] = (), exog: Sequence[str] = (), transforms: Sequence[LagTransform] = (), criteria: Sequence[str] | str = ("aic",), method: str = "forward", accept: str | None = None, y: str = "y", keys: Sequence[str] = KEYS, folds: DataFrame | None = None) -> DataFrame:
    """(keys[, fold], features, score): the lags, columns and transforms that a greedy search by information
    criteria keeps, for every series (and every fold's training part) in one job.

    All subsets are compared on the same rows, those in which every candidate is known; names
    like ``AIC_BIC`` mean several criteria, all of which have to improve."""
    criteria = criteria.lower().split("_") if isinstance(criteria, str) else [c.lower() for c in criteria]
    design, names = lag_design(panel, lags, exog, transforms, (y,), keys)
    grams = gram(design, names, (y,), keys, folds).where(F.col("n") > len(names) + 2)
    found = forward(grams, len(names), criteria, accept or "all") if method == "forward" else backward(grams, len(names), criteria, accept or "lexicographic")
    told = F.transform("columns", lambda k: F.get(F.array(*[F.lit(c) for c in names]), k))
    return found.select(*keys, *(["fold"] if folds is not None else []), told.alias("features"), "score")


def select_features_jointly(panel: DataFrame, lags: int | Sequence[int] = (), exog: Sequence[str] = (), transforms: Sequence[LagTransform] = (), criteria: Sequence[str] = ("aic",), method: str = "forward", y: str = "y", keys: Sequence[str] = KEYS, held: Callable[[DataFrame], DataFrame] = lambda df: df.cache()) -> tuple[list[str], list[float]]:
    """One choice for all series of a panel, by the criteria's means over them.  A round is a job over the
    matrices (``held`` keeps them), which brings back a row per candidate."""
    design, names = lag_design(panel, lags, exog, transforms, (y,), keys)
    size, at = len(names) + 1, len(names)
    grams = held(gram(design, names, (y,), keys).where(F.col("n") > len(names) + 2))
    chosen = [] if method == "forward" else list(range(len(names)))
    score = [float("inf")] * len(criteria)

    def judged(options: list[list[int]]) -> list[list[float]]:
        rows = grams.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(c) for c in o]).cast("array<int>").alias("c")) for k, o in enumerate(options)])))
        rss = F.get(swept(F.col("g"), F.col("_o.c"), size), F.lit(at * size + at))
        means = [F.avg(criterion(c, rss, F.col("n"), F.size("_o.c"))).alias(f"s{j}") for j, c in enumerate(criteria)]
        found = {r["k"]: [r[f"s{j}"] for j in range(len(criteria))] for r in rows.groupBy(F.col("_o.k").alias("k")).agg(*means).collect()}
        return [found.get(k, [float("inf")] * len(criteria)) for k in range(len(options))]

    if method != "forward":
        score = judged([chosen])[0]
    while True:
        options = [[*chosen, k] for k in range(len(names)) if k not in chosen] if method == "forward" else [[c for c in chosen if c != k] for k in chosen if len(chosen) > 1]
        if not options:
            break
        pick = None
        for option, new in zip(options, judged(options)):
            if all(a < b for a, b in zip(new, score)):
                pick, score = option, new
        if pick is None:
            break
        chosen = pick
    return [names[k] for k in chosen], score


# Vector autoregression.


def fit_var(panel: DataFrame, lags: int | Sequence[int], targets: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, coef (a row per target), rss, n, recent: block normal equations of all targets on the lags of all,
    and the newest-first history that the recursion starts from."""
    lags = normal_lags(lags)
    design, names = lag_design(panel, lags, (), (), targets, keys)
    fitted = solve(gram(design, names, targets, keys).where(F.col("n") > len(names)), len(names), len(targets))
    newest = F.sort_array(F.collect_list(F.struct("t", F.array(*[F.col(y).cast("double") for y in targets]).alias("v"))), asc=False)
    ends = panel.groupBy(*keys).agg(F.max("t").alias("_last")).where(F.col("_last") >= max(lags) - 1)
    recent = panel.join(ends, list(keys)).where(F.col("t") > F.col("_last") - max(lags)).groupBy(*keys).agg(F.transform(newest, lambda s: s["v"]).alias("recent"))
    return fitted.join(recent, list(keys))


def forecast_var(model: DataFrame, lags: int | Sequence[int], targets: Sequence[str], horizon: int, keys: Sequence[str] = KEYS, nonnegative: bool = True) -> DataFrame:
    """(keys, target, h, yhat) by folding matrix times history over the horizon.  Values below 0 are set to 0
    once the recursion is over."""
    lags, many = normal_lags(lags), len(targets)

    def ahead(past: Column, _: Column) -> Column:
        row = [F.get(F.get(past, F.lit(lag - 1)), F.lit(j)) for j in range(many) for lag in lags]
        each = []
        for t in range(many):
            b = F.get(F.col("coef"), F.lit(t))
            value = F.get(b, F.lit(0))
            for k, x in enumerate(row):
                value = value + F.get(b, F.lit(k + 1)) * x
            each.append(value)
        return F.concat(F.array(F.array(*each)), past)

    # a target alone has a flat coef
    model = model.withColumn("coef", F.array("coef")) if many == 1 else model
    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("recent"), ahead)
    steps = model.select(*keys, F.posexplode(F.reverse(F.slice(path, 1, horizon))).alias("p", "v"))
    rows = F.explode(F.array(*[F.struct(F.lit(y).alias("target"), F.get("v", F.lit(j)).alias("yhat")) for j, y in enumerate(targets)]))
    out = steps.select(*keys, (F.col("p") + 1).alias("h"), rows.alias("r")).select(*keys, "r.target", "h", "r.yhat")
    return out.withColumn("yhat", F.greatest(F.lit(0.0), F.col("yhat"))) if nonnegative else out


def log_determinant(a: Column, size: int) -> Column:
    """ln of a positive definite flat matrix's determinant: the product of its pivots as they are swept."""
    start = F.struct(a.alias("a"), F.lit(0.0).alias("d"))
    step = lambda s, k: F.struct(sweep(s["a"], k, size).alias("a"), (s["d"] + F.ln(F.get(s["a"], k * size + k))).alias("d"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), start, step, lambda s: s["d"])


def var_criteria(model: DataFrame, lags: int | Sequence[int], targets: Sequence[str]) -> DataFrame:
    """aic, aicc, bic, hqc per observation from the residual covariance's determinant."""
    many, n = len(targets), F.col("n").cast("double")
    q = float(many * (many * len(normal_lags(lags)) + 1))
    base = model.withColumn("_s", F.transform("rss", lambda v: v / n)).withColumn("_d", log_determinant(F.col("_s"), many))
    small = F.try_divide(F.lit(2.0 * q * (q + 1.0)), n - q - 1.0) / n
    return base.withColumns({
        "aic": F.col("_d") + 2.0 * q / n, "aicc": F.col("_d") + 2.0 * q / n + small,
        "bic": F.col("_d") + q * F.ln(n) / n, "hqc": F.col("_d") + 2.0 * q * F.ln(F.ln(n)) / n,
    }).drop("_s", "_d")


# Unit roots.

#: MacKinnon (1994) response surface for the constant-only unit-root regression.
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
#: Coefficients of the approximation 26.2.17 of the normal distribution in Abramowitz and Stegun.
NORMAL_P, NORMAL_B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(x: Column) -> Column:
    """Within 7.5e-8."""
    k = 1.0 / (1.0 + NORMAL_P * F.abs(x))
    tail = k * 0.0
    for b in reversed(NORMAL_B):
        tail = (tail + b) * k
    tail = tail * F.exp(-x * x / 2.0) / F.sqrt(2.0 * F.pi())
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


def adf_p_value(stat: Column) -> Column:
    def polynomial(c: Sequence[float]) -> Column:
        out = F.lit(0.0)
        for v in reversed(c):
            out = out * stat + v
        return out

    inside = normal_cdf(F.when(stat <= ADF_STAR, polynomial(ADF_SMALL)).otherwise(polynomial(ADF_LARGE)))
    return F.when(stat > ADF_MAX, 1.0).when(stat < ADF_MIN, 0.0).otherwise(inside)


def adf(panel: DataFrame, most: int, y: str = "y", keys: Sequence[str] = KEYS, choose: bool = True) -> DataFrame:
    """(keys, statistic, p_value, used_lags): the augmented Dickey-Fuller test with a constant and up to ``most``
    lagged differences, their number by the smallest AIC on common rows (or given, if not ``choose``).

    The level and the differences are swept in one after another, so one matrix has every nested
    regression.  The statistic comes from the rows that the chosen one needs: matrices of the
    rows from each number of lags on are summed in the same pass, as folds that end at the start."""
    w = W.partitionBy(*keys).orderBy("t")
    rows = panel.select(*keys, "t", F.col(y).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = rows.withColumn("t", F.row_number().over(w) - 1).withColumn("_x0", F.lag("_v").over(w)).withColumn("_d", F.col("_v") - F.col("_x0"))
    rows = rows.withColumns({f"_x{k}": F.lag("_d", k).over(w) for k in range(1, most + 1)})
    size = most + 2
    fields = [F.col("_x0"), *[F.coalesce(f"_x{k}", F.lit(0.0)) for k in range(1, most + 1)], F.col("_d")]
    # row t has its first t - 1 lagged differences: it counts for every number of lags up to t - 1
    base = rows.where("t >= 1").select(*keys, F.least(F.col("t") - 1, F.lit(most)).alias("_upto"), *[f.alias(f"_f{k}") for k, f in enumerate(fields)])
    centre = [F.avg(f"_f{k}").over(W.partitionBy(*keys)).alias(f"_c{k}") for k in range(size)]
    base = base.select(*keys, "_upto", *[F.col(f"_f{k}") for k in range(size)], *centre)
    d = [F.col(f"_f{k}") - F.col(f"_c{k}") for k in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    at = {p: k for k, p in enumerate(pairs)}
    parts = base.groupBy(*keys, "_upto").agg(F.count("*").alias("n"), F.array(*[F.sum(x) for x in d]).alias("s"), F.array(*[F.sum(d[i] * d[j]) for i, j in pairs]).alias("p"))
    # rows known for k lags: those of every stretch from k on
    after = W.partitionBy(*keys).orderBy(F.desc("_upto")).rowsBetween(W.unboundedPreceding, 0)
    summed = lambda c, m: F.array(*[F.sum(F.col(c)[k]).over(after) for k in range(m)]).alias(c)
    sums = parts.select(*keys, F.col("_upto").alias("k"), F.sum("n").over(after).alias("n"), summed("s", size), summed("p", len(pairs)))
    n = F.col("n").cast("double")
    g = F.array(*[F.col("p")[at[min(i, j), max(i, j)]] - F.col("s")[i] * F.col("s")[j] / n for i in range(size) for j in range(size)])
    grams = sums.select(*keys, "k", "n", g.alias("g"))
    y_at = F.lit((size - 1) * size + size - 1)

    def nested(state: Column, k: Column) -> Column:
        a = sweep(state["a"], k, size)
        told = F.transform(F.array(a), lambda m: F.struct(m.alias("a"), F.concat(state["fits"], F.array(F.struct(F.get(m, y_at).alias("rss"), F.get(m, F.lit(size - 1)).alias("b"), F.get(m, F.lit(0)).alias("inverse")))).alias("fits")))
        return told[0]

    empty = F.array().cast("array<struct<rss:double,b:double,inverse:double>>")
    fits = F.aggregate(F.sequence(F.lit(0), F.col("k")), F.struct(F.col("g").alias("a"), empty.alias("fits")), nested, lambda s: s["fits"])
    grams = grams.where(F.col("n") > F.col("k") + 2).withColumn("fits", fits).drop("g")
    if choose:
        widest = F.max_by(F.struct("fits", "n"), "k")
        aic = lambda fit, j: F.struct((F.col("m.n") * F.ln(fit["rss"] / F.col("m.n")) + 2.0 * (j + 2)).alias("aic"), j.alias("k"))
        best = grams.groupBy(*keys).agg(widest.alias("m")).select(*keys, F.array_min(F.transform("m.fits", aic))["k"].alias("k"))
    else:
        best = grams.groupBy(*keys).agg(F.max("k").alias("k"))
    fit = F.element_at("fits", -1)
    used = grams.join(best, [*keys, "k"])
    stat = fit["b"] / F.sqrt(fit["rss"] / (F.col("n") - F.col("k") - 2) * fit["inverse"])
    return used.select(*keys, stat.alias("statistic"), F.col("k").alias("used_lags")).withColumn("p_value", adf_p_value(F.col("statistic"))).select(*keys, "statistic", "p_value", "used_lags")
