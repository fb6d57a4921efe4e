"""Mixing sources to target weights.

Tokens are summed per source, each source's target follows from the weights (capped at
``max_repeats`` times its size, the excess reshared), and a document is emitted
floor(rate) times plus one copy when a uniform number hashed from the seed and the row
falls below the fraction of the rate.  The row is its id, source and text; rows equal in
these are told apart by a number of their own, so that each draws for itself, whatever
share of the table they are.

Defined cases: null text counts 0 words; a null source is a source of its own, last in
order; rows that share an id, null ids too, draw each for itself; a source of no words
has target 0 and none of its documents is taken; an empty table gives an empty mix.  Any
further columns are carried through untouched (of rows equal but for these, any may get
the copy); the operator's own columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm._session import cut
from tidewheel.llm._skew import attach

WORD = r"[^\x20\x09-\x0D]+"
#: Per-source rows up to which the target table is broadcast (a few dozen bytes each).
BROADCAST_SOURCES = 10_000
#: Digests of repeated rows up to which they are broadcast (about a hundred bytes each).
BROADCAST_REPEATED = 100_000
OWN = ("size", "source_size", "target", "rate", "copies", "taken")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(per: DataFrame) -> DataFrame:
    """``per`` with ``place``, the number of its source in code-point order from 0, null last: sources
    are dealt by range, counted per range, and numbered within each."""
    ranges = cut(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    counts = sorted((r["range"], r["count"]) for r in ranges.groupBy("range").count().collect())  # a row per partition
    before, start = {}, 0
    for number, count in counts:
        before[number], start = start, start + count
    starts = F.create_map(*[F.lit(v) for pair in before.items() for v in pair])
    within = F.row_number().over(W.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranges.withColumn("place", starts[F.col("range")] + within).drop("range")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, size) -> one row per source: source, source_size, weight, target.

    The water level starts at the total over all weights; sources it lifts above their cap are
    taken out with what the cap leaves, and the level is raised for the rest, until it lifts no
    further source above its cap.  A round is one sum over the sources, which may be many."""
    per = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    if per.isEmpty():
        return per.select("source", "source_size", F.lit(0.0).alias("weight"), F.lit(0.0).alias("target"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    per = cut(_ranked(per).withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_repeats).cast("double")).drop("place"))
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    level, open_ = 0.0, None
    while True:
        above = F.col("weight") * level > F.col("cap")
        taken, rest, count = per.agg(F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(~above, 1))).first()
        if count == open_ or not count:
            break
        level, open_ = (total - taken) / rest, count
    return per.select("source", "source_size", "weight", F.least("cap", F.col("weight") * level).alias("target"))


def row_digest(id_col: str) -> Column:
    """md5 of a row's id, source and text, nulls told apart from empty values."""
    told = [F.coalesce(F.concat(F.lit("1"), F.col(c).cast("string")), F.lit("0")) for c in (id_col, "source", "text")]
    return F.md5(F.concat(told[0], F.lit("\n"), told[1], F.lit("\n"), told[2]))


def draw(digest: Column, number: Column, seed: int) -> Column:
    """Uniform in [0, 1): the first 32 bits of md5(seed:digest:number)."""
    key = F.concat(F.lit(f"{seed}:"), digest, F.lit(":"), number.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... among the rows of equal ``key`` (never null).  Only repeated keys
    are numbered, partition by partition, each from what the key has in partitions before."""
    counts = cut(rows.groupBy(key).agg(F.count("*").alias("__tw_n")))
    again = counts.where("__tw_n > 1").withColumn("__tw_again", F.lit(True))
    many, total = again.agg(F.count("*"), F.coalesce(F.sum("__tw_n"), F.lit(0))).first()
    if not many:
        return rows.withColumn(name, F.lit(0).cast("long"))
    told = rows.join(F.broadcast(again.drop("__tw_n")), key, "left") if many <= BROADCAST_REPEATED else attach(rows, again, [key], "__tw_n", total, "left")
    single = told.where(F.col("__tw_again").isNull()).withColumn(name, F.lit(0).cast("long"))
    held = cut(told.where("__tw_again").withColumn("__tw_part", F.spark_partition_id()))
    before = W.partitionBy(key).orderBy("__tw_part").rowsBetween(W.unboundedPreceding, -1)  # a row per key and partition
    begins = held.groupBy(key, "__tw_part").agg(F.count("*").alias("__tw_m")).withColumn("__tw_begin", F.coalesce(F.sum("__tw_m").over(before), F.lit(0))).drop("__tw_m")
    within = F.row_number().over(W.partitionBy(key, "__tw_part").orderBy("__tw_part")) - 1
    repeated = held.join(begins, [key, "__tw_part"]).withColumn(name, F.col("__tw_begin") + within).drop("__tw_part", "__tw_begin")
    return single.unionByName(repeated).drop("__tw_again")


def plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Every document with size, source_size, target, rate, copies and taken (= copies * size)."""
    docs = docs.drop(*OWN)
    sized = docs.withColumn("size", word_count())
    targets = source_targets(sized.select("source", "size"), weights, max_repeats).drop("weight").withColumnRenamed("source", "__tw_source")
    bounded = targets.count() <= BROADCAST_SOURCES
    own = numbered(sized.withColumn("__tw_digest", row_digest(id_col)), "__tw_digest", "__tw_number")
    joined = own.join(F.broadcast(targets) if bounded else targets, F.col("source").eqNullSafe(F.col("__tw_source")), "left").drop("__tw_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(0.0)
    extra = F.when(draw(F.col("__tw_digest"), F.col("__tw_number"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    taken = joined.withColumn("rate", rate).withColumn("copies", (F.floor("rate") + extra).cast("int"))
    return taken.withColumn("taken", F.col("copies") * F.col("size")).drop("__tw_digest", "__tw_number")


def mix(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The mix itself: each document's row repeated ``copies`` times, with all its columns and no others."""
    rows = docs.select(F.struct("*").alias("__tw_row"), id_col, "text", "source")
    return plan(rows, id_col=id_col, **how).withColumn("__tw_copy", F.explode(F.expr("array_repeat(0, copies)"))).select("__tw_row.*")
