"""Readers, sinks and the panel: (series_id, ts, t, y, exogenous columns), one row a time step.

A reference-style single series is a panel with one ``series_id``.  Spark rows have no
order, so time is explicit: ``t`` is dense from 0 within a series, and NaN becomes NULL on
the way in (Spark tells them apart; window aggregates skip only NULL).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_time(keys: Sequence[str] = ("series_id",), order: str = "t"):
    return W.partitionBy(*keys).orderBy(order)


def read(spark: SparkSession, path: str, format: str = "parquet", schema=None, **options) -> DataFrame:
    """Any Spark source: parquet, orc, csv, json, jdbc, a table name (format="table")."""
    if format == "table":
        return spark.read.table(path)
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = (), **options) -> None:
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def clean(c: str | Column) -> Column:
    """Numeric column as double with NaN as NULL; fails on text under ANSI mode."""
    value = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(value), value)


def number(df: DataFrame, keys: Sequence[str] = ("series_id",), order: str = "ts") -> DataFrame:
    """Dense step ``t`` from 0 within each series."""
    return df.withColumn("t", (F.row_number().over(by_time(keys, order)) - 1).cast("int"))


def to_panel(df: DataFrame, series_id: str | Column, ts: str | Column, y: str | Column, exog: Sequence[str] = (), aggregate=F.sum, unit: str | None = None, exog_aggregate=None) -> DataFrame:
    """Rows of events to a panel: one value per series and (truncated) time.  Of other columns a
    period keeps the earliest non-null value (of equal times the least), or an aggregate of them."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    when = col(ts) if unit is None else F.date_trunc(unit, col(ts))
    base = df.select(col(series_id).cast("string").alias("series_id"), when.cast("timestamp_ntz").alias("ts"), clean(y).alias("y"), col(ts).alias("_at"), *exog)
    earliest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("_at", c)))
    kept = [(exog_aggregate or earliest)(c).alias(c) for c in exog]
    return number(base.groupBy("series_id", "ts").agg(aggregate("y").alias("y"), *kept))


def gap_fill(panel: DataFrame, unit: str = "HOUR", fill: float | None = 0.0) -> DataFrame:
    """Every step between a series' first and last: missing ones get ``fill`` (other columns NULL).

    Each row spreads over the steps up to the next row: one window over the data, no join
    with a calendar and no second scan."""
    later = panel.drop("t").withColumn("_next", F.lead("ts").over(by_time(order="ts")))
    steps = F.expr(f"sequence(ts, coalesce(_next - interval 1 {unit}, ts), interval 1 {unit})")
    rest = [c for c in later.columns if c not in ("series_id", "ts", "_next")]
    spread = later.withColumn("_ts", F.explode(steps))
    full = spread.select("series_id", F.col("_ts").alias("ts"), *[F.when(F.col("_ts") == F.col("ts"), F.col(c)).alias(c) for c in rest])
    return number(full if fill is None else full.withColumn("y", F.coalesce("y", F.lit(fill))))


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Daily calendar, both ends included, with step t from 0."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval 1 day)")).alias("ds"))
    return days.withColumn("t", F.datediff("ds", F.lit(start).cast("date")))


def wide(panel: DataFrame, targets: Sequence[str], column: str = "target") -> DataFrame:
    """Long (series_id, ts, target, y) to one column per target, aligned on ts."""
    spread = panel.groupBy("series_id", "ts").pivot(column, list(targets)).agg(F.first("y"))
    return number(spread)


# The panels that the queries run over.


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, f"{sf_dir}/events.parquet")
    return gap_fill(to_panel(events, "event_type", "ts", "value", unit="hour"))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, f"{sf_dir}/orders.parquet")
    return to_panel(orders, "o_orderpriority", "o_orderdate", F.lit(1.0), unit="month")


def monthly_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders a month as one multivariate series with targets F, O and P."""
    orders = read(spark, f"{sf_dir}/orders.parquet")
    long = orders.groupBy(F.lit("orders").alias("series_id"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return number(long.select("series_id", "ts", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in "FOP"]))


def daily_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_panel(read(spark, f"{sf_dir}/lineitem.parquet"), "l_returnflag", "l_shipdate", "l_quantity", unit="day")
