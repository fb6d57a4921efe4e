"""The transforms as SQL functions, for use in ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = (
    "box_cox(x DOUBLE, lmda DOUBLE) RETURNS DOUBLE RETURN CASE WHEN lmda = 0 THEN ln(x) ELSE (pow(x, lmda) - 1) / lmda END",
    "inverse_box_cox(z DOUBLE, lmda DOUBLE) RETURNS DOUBLE RETURN CASE WHEN lmda = 0 THEN exp(z) ELSE pow(lmda * z + 1, 1 / lmda) END",
    "fourier_sin(t DOUBLE, k INT, period DOUBLE) RETURNS DOUBLE RETURN sin(2 * pi() * k * t / period)",
    "fourier_cos(t DOUBLE, k INT, period DOUBLE) RETURNS DOUBLE RETURN cos(2 * pi() * k * t / period)",
    "absolute_percentage_error(y DOUBLE, yhat DOUBLE) RETURNS DOUBLE RETURN abs(try_divide(y - yhat, y))",
    "symmetric_percentage_error(y DOUBLE, yhat DOUBLE) RETURNS DOUBLE RETURN 100 * try_divide(2 * abs(y - yhat), abs(y) + abs(yhat))",
    "folds(n INT, splits INT, horizon INT, step INT) RETURNS TABLE (fold INT, cutoff INT) RETURN SELECT CAST(row_number() OVER (ORDER BY c) AS INT), CAST(c AS INT) FROM (SELECT n - horizon - k * step AS c FROM (SELECT explode(sequence(0, splits - 1)) AS k) WHERE n - horizon - k * step >= 0)",
)


def register(spark: SparkSession) -> None:
    for definition in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
