"""Streaming panels: hourly series and running errors from an unbounded source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, format: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def windowed_panel(events: DataFrame, series_id: str, ts: str, y: str, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(series_id, ts, y, n) per window, final once the watermark has passed it."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stamped.groupBy(F.col(series_id).alias("series_id"), window.alias("w")).agg(F.sum(y).alias("y"), F.count(y).alias("n")).select("series_id", F.col("w.start").alias("ts"), "y", "n")


def running_errors(actuals: DataFrame, forecasts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream of forecasts met with the stream of actual values, error by error."""
    a = actuals.withWatermark("ts", late).alias("a")
    f = forecasts.withWatermark("ts", late).alias("f")
    met = a.join(f, F.expr("a.series_id = f.series_id and a.ts = f.ts"))
    return met.select("a.series_id", "a.ts", (F.col("a.y") - F.col("f.yhat")).alias("resid"))


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Process what is there into an in-memory table and stop."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
