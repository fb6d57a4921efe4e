"""Scans over series that are longer than a task: every stretch on its own, then what is carried over.

A series is cut into stretches of ``chunk`` consecutive steps, which are dealt out like series of
their own.  A running value is worked out within each stretch; a summary of a stretch is one row,
summaries are combined in order (a row per stretch and series), and a second step brings what the
stretches before have left to the rows.  Sums, maxima, last known values, steps since an event and
linear recursions go this way; frames that reach back a bounded number of steps take
the end of the stretch before along instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions.lagfeatures import LagTransform, _Rolling
from tidewheel.sources.shared import cut

KEYS = ("series_id",)
#: Steps of a stretch.
CHUNK = 1 << 16


def numbered(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("ts",), name: str = "t") -> DataFrame:
    """Dense numbers from 0 within each key, with no key's rows in one task: rows are dealt by range
    and counted, and each range begins where the ranges before have left its first key."""
    spark = df.sparkSession
    width = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [*keys, *order]
    ranges = cut(df.repartitionByRange(width, *by).withColumn("_range", F.spark_partition_id()))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = ranges.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    begins = counts.withColumn("_begin", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return ranges.join(begins, [*keys, "_range"]).withColumn(name, (F.col("_begin") + within).cast("long")).drop("_range", "_begin")


def stretch(t: str | Column = "t", chunk: int = CHUNK) -> Column:
    return F.floor((F.col(t) if isinstance(t, str) else t) / chunk).cast("long")


_KINDS = {
    "sum": (lambda v, t: F.sum(v), lambda v: F.sum(v), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (lambda v, t: F.max(v), lambda v: F.max(v), F.greatest),
    "last": (lambda v, t: F.max_by(v, F.when(v.isNotNull(), t)), lambda v: F.last(v, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def running(df: DataFrame, values: Mapping[str, tuple[str, Column]], keys: Sequence[str] = KEYS, order: str = "t", chunk: int = CHUNK, after: Sequence[str] = (), excluding: bool = False) -> DataFrame:
    """Columns ``name: (kind, value)`` of running sums, maxima or last known values (kind ``sum``, ``max`` or
    ``last``) up to and with each row, or up to the row before (``excluding``).  ``after`` settles the order of rows
    with equal ``order``."""
    own = [F.col(c) for c in after]
    marked = df.withColumns({"_chunk": stretch(order, chunk)} | {f"_v{k}": v for k, (_, v) in enumerate(values.values())})
    kinds = [kind for kind, _ in values.values()]
    parts = marked.groupBy(*keys, "_chunk").agg(*[_KINDS[kind][0](F.col(f"_v{k}"), F.col(order)).alias(f"_p{k}") for k, kind in enumerate(kinds)])
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select(*keys, "_chunk", *[_KINDS[kind][1](F.col(f"_p{k}")).over(before).alias(f"_c{k}") for k, kind in enumerate(kinds)])
    here = W.partitionBy(*keys, "_chunk").orderBy(order, *own).rowsBetween(W.unboundedPreceding, -1 if excluding else 0)
    local = marked.withColumns({f"_l{k}": _KINDS[kind][1](F.col(f"_v{k}")).over(here) for k, kind in enumerate(kinds)})
    met = local.join(carried, [*keys, "_chunk"])
    out = met.withColumns({name: _KINDS[kind][2](F.col(f"_c{k}"), F.col(f"_l{k}")) for k, (name, (kind, _)) in enumerate(values.items())})
    return out.drop("_chunk", *[f"_{c}{k}" for c in "vlc" for k in range(len(kinds))])


def windowed(df: DataFrame, columns: Mapping[str, Column] | Sequence[LagTransform], reach: int | None = None, y: str = "y", keys: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """Lags and rolling statistics of dense steps ``t``: a stretch takes along the last ``reach`` rows of the
    one before.  ``columns`` are rolling transforms, or named Columns over windows by keys and ``_chunk``."""
    if not isinstance(columns, Mapping):
        if not all(isinstance(c, _Rolling) for c in columns):
            raise TypeError("an expanding statistic reaches back without bound; use expanding")
        reach = max(c.shift + c.window - 1 for c in columns)
        columns = {c.name: c.column(y, [*keys, "_chunk"]) for c in columns}
    home = stretch("t", chunk)
    spread = df.withColumn("_chunk", F.explode(F.sequence(home, stretch(F.col("t") + reach, chunk))))
    return spread.withColumns(columns).where(F.col("_chunk") == home).drop("_chunk")


def shifted(df: DataFrame, shift: int, y: str = "y", name: str = "_y", keys: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """``y`` of ``shift`` steps before."""
    if not shift:
        return df.withColumn(name, F.col(y))
    return windowed(df, {name: F.lag(y, shift).over(W.partitionBy(*keys, "_chunk").orderBy("t"))}, shift, y, keys, chunk)


def expanding(df: DataFrame, shift: int = 1, y: str = "y", mean: str | None = None, std: str | None = None, keys: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """Mean and sample deviation of everything up to ``shift`` steps ago, as columns of the given names; sums are
    taken around the series' mean."""
    held = shifted(df, shift, y, "_y", keys, chunk)
    centre = df.groupBy(*keys).agg(F.avg(y).alias("_centre"))
    x = F.col("_y") - F.col("_centre")
    held = held.join(centre, list(keys))
    sums = running(held, {"_n": ("sum", F.when(x.isNotNull(), 1).otherwise(0)), "_s": ("sum", x), "_q": ("sum", x * x)}, keys, "t", chunk)
    n, s, q = F.col("_n"), F.col("_s"), F.col("_q")
    out = {}
    if mean:
        out[mean] = F.when(n > 0, F.col("_centre") + s / n)
    if std:
        out[std] = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), q - s * s / n) / (n - 1)))
    return sums.withColumns(out).drop("_y", "_centre", "_n", "_s", "_q")


def zero_run_length(df: DataFrame, y: str = "y", name: str = "zero_run", keys: Sequence[str] = KEYS, threshold: float = 0.5, chunk: int = CHUNK) -> DataFrame:
    """Consecutive zeros up to and with each step: the zeros so far less those up to the last demand."""
    zeros = running(df, {"_z": ("sum", F.when(F.col(y) < threshold, 1).otherwise(0))}, keys, "t", chunk)
    past = running(zeros, {"_b": ("max", F.when(F.col(y) >= threshold, F.col("_z")))}, keys, "t", chunk)
    return past.withColumn(name, F.when(F.col(y).isNotNull(), F.col("_z") - F.coalesce("_b", F.lit(0)))).drop("_z", "_b")


def nonzero_interval(df: DataFrame, y: str = "y", name: str = "nz_interval", keys: Sequence[str] = KEYS, threshold: float = 0.5, chunk: int = CHUNK) -> DataFrame:
    """Steps between the last two demands, 1 before the second."""
    hit = F.when(F.col(y) > threshold, F.col("t"))
    before = running(df, {"_h": ("last", hit)}, keys, "t", chunk, excluding=True)
    gaps = running(before, {"_g": ("last", hit - F.col("_h"))}, keys, "t", chunk)
    return gaps.withColumn(name, F.coalesce("_g", F.lit(1)).cast("int")).drop("_h", "_g")


def undiff(forecast: DataFrame, ends: DataFrame, order: int = 1, d: str = "yhat", keys: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """(keys, h, d) undifferenced ``order`` times; ``ends``: keys and end_0 .. end_{order - 1}, the last value of the
    history and of its differences."""
    out = forecast.join(ends.select(*keys, *[f"end_{k}" for k in range(order)]), list(keys))
    for k in range(order - 1, -1, -1):
        out = running(out, {"_s": ("sum", F.col(d))}, keys, "h", chunk).withColumn(d, F.col(f"end_{k}") + F.col("_s")).drop("_s")
    return out.drop(*[f"end_{k}" for k in range(order)])


def invert_seasonal_diff(forecast: DataFrame, seeds: DataFrame, season: int, d: str = "yhat", keys: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """(keys, h, d) with the seasonal difference undone; ``seeds``: keys, phase (0 for the first step ahead) and
    seed, the history's last season."""
    out = forecast.withColumn("phase", F.pmod(F.col("h") - 1, F.lit(season))).join(seeds, [*keys, "phase"], "left")
    summed = running(out, {"_s": ("sum", F.col(d))}, [*keys, "phase"], "h", chunk)
    return summed.withColumn(d, F.col("seed") + F.col("_s")).drop("_s", "phase", "seed")


def smoothed(df: DataFrame, alpha: float, y: str = "y", name: str = "level", keys: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """(keys, t, level): simple smoothing with a fixed factor.  A stretch maps the level it is entered with
    to where it ends by one multiplication and one addition; missing values leave the level as it is."""
    ordered = F.array_sort(F.collect_list(F.struct("t", F.col(y).cast("double").alias("y"))))
    parts = df.withColumn("_chunk", stretch("t", chunk)).groupBy(*keys, "_chunk").agg(ordered.alias("s"))
    known = lambda v: v["y"].isNotNull()
    # the first known value of a series is its first level
    first = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    parts = parts.withColumn("_own", F.get(F.filter("s", known), F.lit(0))).withColumn("_first", F.first("_own", ignorenulls=True).over(first))
    weight = lambda v: F.when(~known(v) | (v["t"] == F.col("_first.t")), 0.0).otherwise(alpha)
    fold = lambda s, v: F.struct((s["a"] * (1.0 - weight(v))).alias("a"), (s["b"] + weight(v) * (F.coalesce(v["y"], F.lit(0.0)) - s["b"])).alias("b"))
    parts = parts.withColumn("_map", F.aggregate("s", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), fold))
    earlier = F.collect_list("_map").over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    entry = F.aggregate(earlier, F.col("_first.y"), lambda level, m: m["a"] * level + m["b"])
    entered = parts.withColumn("_in", entry)
    step = lambda s, v: F.transform(F.array(s["l"] + weight(v) * (F.coalesce(v["y"], F.lit(0.0)) - s["l"])), lambda l: F.struct(l.alias("l"), F.concat(s["o"], F.array(F.struct(v["t"].alias("t"), l.alias("l")))).alias("o")))[0]  # noqa: E731,E741
    out = F.aggregate("s", F.struct(F.col("_in").alias("l"), F.array().cast("array<struct<t:int,l:double>>").alias("o")), step, lambda s: s["o"])
    return entered.select(*keys, F.explode(out).alias("r"), "_first").select(*keys, F.col("r.t").alias("t"), F.when(F.col("r.t") >= F.col("_first.t"), F.col("r.l")).alias(name))
