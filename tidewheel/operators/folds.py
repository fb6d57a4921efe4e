"""Rolling-origin folds: expanding training windows before each cutoff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("series_id",)


def cutoff_list(n: int, n_splits: int, test_size: int, step: int | None = None) -> list[int]:
    """Test starts n - H, n - H - step, ... down to 0, the last n_splits, ascending."""
    step = step or test_size
    return list(range(n - test_size, -1, -step))[:n_splits][::-1] if n >= test_size else []


def cutoffs(panel: DataFrame, n_splits: int, test_size: int, step: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, fold from 1, cutoff): training is t < cutoff, the test its next ``test_size`` steps."""
    step = step or test_size
    n = panel.groupBy(*keys).agg((F.max("t") + 1).alias("n"))
    starts = n.where(F.col("n") >= test_size).withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    kept = starts.withColumn("cutoff", F.col("n") - test_size - F.col("back") * step).where(F.col("cutoff") >= 0)
    most = F.least(F.lit(n_splits), F.floor((F.col("n") - test_size) / step) + 1)
    return kept.select(*keys, (most - F.col("back")).cast("int").alias("fold"), F.col("cutoff").cast("int"))


def train_rows(panel: DataFrame, folds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return panel.join(folds, list(keys)).where(F.col("t") < F.col("cutoff"))


def test_rows(panel: DataFrame, folds: DataFrame, test_size: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Test rows with their step ``h``, met by equality: each fold is exploded to its steps."""
    steps = folds.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(test_size)))).withColumn("t", F.col("cutoff") + F.col("h") - 1)
    return panel.join(steps, [*keys, "t"])
