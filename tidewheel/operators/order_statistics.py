"""Quantiles over growing frames in near-linear time.

The values of a series are replaced by their ranks, which are read digit by digit, sixteen ways a
level, highest first.  A question for the k-th smallest of the values so far starts with all ranks;
on each level it sees how many of the values so far have each next digit, goes into
the digit that holds the k-th, and asks there for what is left of k.  After ceil(log16 T) levels it
holds the rank of its answer.  A level is one running count by digit, within the ranks that share the
digits above; it is a scan with carry-over, so neither a long series nor a common value has to
fit a task, and the work is T log T and not the T^2 of sorting every frame anew.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.scan import CHUNK, numbered, running
from tidewheel.sources.shared import cut

KEYS = ("series_id",)
BITS = 4


def _descend(seen: DataFrame, asked: DataFrame, keys: Sequence[str], chunk: int) -> DataFrame:
    """``seen`` (keys, at, rank) and ``asked`` (keys, at, k from 0, ...) -> ``asked`` with ``rank``, that of the k-th
    smallest value at or before ``at``."""
    top = seen.agg(F.max("rank")).first()[0]
    levels = max(1, -(-int(top or 0).bit_length() // BITS))
    rest = [c for c in asked.columns if c not in (*keys, "at", "k")]
    told = F.struct("k", *rest)
    asked = asked.select(*keys, "at", F.lit(0).cast("long").alias("_node"), told.alias("_q"))
    kind = asked.schema["_q"].dataType
    wide = 1 << BITS
    for level in range(levels - 1, -1, -1):
        digit = F.col("rank").bitwiseAND((1 << BITS * (level + 1)) - 1)
        values = seen.select(*keys, "at", F.shiftright("rank", BITS * (level + 1)).alias("_node"), F.lit(None).cast(kind).alias("_q"), F.shiftright(digit, BITS * level).cast("int").alias("_d"))
        both = values.unionByName(asked.withColumn("_d", F.lit(None).cast("int"))).withColumn("_late", F.col("_d").isNull())
        counts = {f"_n{d}": ("sum", F.when(F.col("_d") == d, 1).otherwise(0)) for d in range(wide)}
        met = running(both, counts, [*keys, "_node"], "at", chunk, after=["_late"]).where("_late")
        # the digit whose values hold the k-th, and how many stand before them
        start = F.struct(F.lit(-1).alias("d"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("to"))
        go = lambda s, p: F.when(s["to"] > F.col("_q.k"), s).otherwise(F.struct(p["d"].alias("d"), s["to"].alias("before"), (s["to"] + p["n"]).alias("to")))
        ways = F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"_n{d}").alias("n")) for d in range(wide)])
        met = met.withColumn("_way", F.aggregate(ways, start, go))
        left = F.struct((F.col("_q.k") - F.col("_way.before")).alias("k"), *[F.col(f"_q.{c}").alias(c) for c in rest])
        asked = cut(met.select(*keys, "at", (F.col("_node") * wide + F.col("_way.d")).alias("_node"), left.alias("_q")))
    return asked.select(*keys, "at", F.col("_node").alias("rank"), "_q.*").drop("k")


def expanding_quantile(panel: DataFrame, quantile: float = 0.5, shift: int = 1, y: str = "y", name: str = "value", keys: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """``panel`` with ``name``: the linearly interpolated quantile of the known values up to ``shift`` steps ago,
    NULL before the first."""
    known = panel.select(*keys, F.col("t").cast("long").alias("at"), F.col(y).cast("double").alias("v")).where(F.col("v").isNotNull())
    seen = cut(numbered(known, keys, ["v", "at"], "rank"))
    # at t the frame ends at t - shift; it holds so many known values
    ends = panel.select(*keys, "t", (F.col("t").cast("long") - shift).alias("at"), F.lit(None).cast("long").alias("rank"))
    held = seen.select(*keys, F.lit(None).cast("int").alias("t"), "at", "rank").unionByName(ends.withColumn("t", F.col("t").cast("int")))
    counted = running(held.withColumn("_late", F.col("rank").isNull()), {"n": ("sum", F.when(F.col("rank").isNotNull(), 1).otherwise(0))}, keys, "at", chunk, after=["_late"]).where("_late and n > 0")
    place = F.round(F.lit(float(quantile)) * (F.col("n") - 1), 9)
    ways = F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("k")
    asked = counted.select(*keys, "at", "t", place.alias("place"), ways).withColumn("order", F.col("k"))
    found = _descend(seen.select(*keys, "at", "rank"), asked, keys, chunk)
    values = found.join(seen.select(*keys, "rank", "v"), [*keys, "rank"])
    part = F.col("place") - F.floor("place")
    low, high = F.max(F.when(F.col("order") == F.floor("place"), F.col("v"))), F.max(F.when(F.col("order") == F.ceil("place"), F.col("v")))
    out = values.groupBy(*keys, "t").agg((low + F.first(part) * (high - low)).alias(name))
    return panel.join(out, [*keys, "t"], "left")


def at_levels(df: DataFrame, value: str, levels: Mapping[str, tuple[float, str]], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n, a column per name): the known values of ``value`` at the given levels of each key, where
    ``levels`` has (level, method) by name and the method takes the lower or the higher of two order
    statistics.  Values are numbered by range and the wanted numbers are picked: exact, and no key's values
    are gathered anywhere."""
    ranked = numbered(df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull()), keys, ["_v"], "_rank")
    n = ranked.groupBy(*keys).agg(F.count("*").alias("n"))
    round_ = {"lower": F.floor, "higher": F.ceil}
    places = n.withColumns({f"_p{k}": round_[method](F.round(F.lit(level) * (F.col("n") - 1), 9)) for k, (level, method) in enumerate(levels.values())})
    wanted = places.withColumn("_rank", F.explode(F.array_distinct(F.array(*[f"_p{k}" for k in range(len(levels))]))))
    met = ranked.join(wanted, [*keys, "_rank"])
    return met.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("_rank") == F.col(f"_p{k}"), F.col("_v"))).alias(name) for k, name in enumerate(levels)])
