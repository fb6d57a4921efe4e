"""Categorical encoders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Categories that one-hot encoding turns into columns, at most.
MAX_CATEGORIES = 1000


def categories(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values of the training data, frozen for later frames."""
    found = [r[0] for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().limit(MAX_CATEGORIES + 1).collect()]
    if len(found) > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} categories; use one_hot_vector or target encoding")
    return sorted(found)


def one_hot(df: DataFrame, column: str, values: Sequence[str], drop_first: bool = False, keep: bool = False) -> DataFrame:
    """``{column}_{value}`` as 0/1 doubles by exact value; a value not frozen is all zeros.
    ``drop_first`` leaves the smallest value out as the base."""
    used = list(values)[1:] if drop_first else list(values)
    out = df.withColumns({f"{column}_{v}": F.when(F.col(column).cast("string") == v, 1.0).otherwise(0.0) for v in used})
    return out if keep else out.drop(column)


def one_hot_vector(df: DataFrame, column: str, output: str | None = None, drop_first: bool = False):
    """Any number of categories as one sparse vector column: (fitted stages, frame).  The
    categories stay in the model, most frequent first; unseen values are all zeros."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    index = StringIndexer(inputCol=column, outputCol=f"_{column}_index", handleInvalid="keep")
    vector = OneHotEncoder(inputCol=f"_{column}_index", outputCol=output or f"{column}_vector", dropLast=drop_first)
    model = Pipeline(stages=[index, vector]).fit(df)
    return model, model.transform(df).drop(f"_{column}_index")


def kfold_target_encode(df: DataFrame, column: str, target: str, fold: Column, keys: Sequence[str] = ()) -> DataFrame:
    """``{column}_target_encoded``: the mean target of the row's category in the other folds,
    else the overall mean.  Two small aggregates joined back: totals per category and fold."""
    marked = df.withColumn("_fold", fold)
    by_fold = marked.groupBy(*keys, column, "_fold").agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    within = W.partitionBy(*keys, column)
    rest = by_fold.withColumn("_rs", F.sum("_s").over(within) - F.col("_s")).withColumn("_rn", F.sum("_n").over(within) - F.col("_n"))
    rest = rest.withColumn("_mean", F.when(F.col("_rn") > 0, F.coalesce("_rs", F.lit(0.0)) / F.col("_rn"))).select(*keys, F.col(column).alias("_c"), F.col("_fold").alias("_f"), "_mean")
    out = marked.join(rest, [*[marked[k].eqNullSafe(rest[k]) for k in keys], F.col(column).eqNullSafe(F.col("_c")), F.col("_fold") == F.col("_f")], "left")
    out = out.drop(*[rest[k] for k in keys]) if keys else out
    if keys:
        out = out.join(df.groupBy(*keys).agg(F.avg(target).alias("_overall")), list(keys))
    else:
        out = out.withColumn("_overall", F.lit(df.agg(F.avg(target)).first()[0]).cast("double"))
    return out.withColumn(f"{column}_target_encoded", F.coalesce("_mean", "_overall")).drop("_fold", "_c", "_f", "_mean", "_overall")


def target_encode_test(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Mean of the training rows' encoding per category, else their overall mean."""
    name = f"{column}_target_encoded"
    per = train.groupBy(F.col(column).alias("_c")).agg(F.avg(name).alias("_m"))
    overall = F.lit(train.agg(F.avg(name)).first()[0]).cast("double")
    out = test.join(per, F.col(column).eqNullSafe(F.col("_c")), "left").withColumn("_o", overall)
    return out.withColumn(name, F.coalesce("_m", "_o")).drop("_c", "_m", "_o")


def index_categories(df: DataFrame, column: str, output: str | None = None):
    """Fitted ``StringIndexer`` for tree models (unseen values become their own index) and the frame."""
    from pyspark.ml.feature import StringIndexer

    model = StringIndexer(inputCol=column, outputCol=output or f"{column}_index", handleInvalid="keep").fit(df)
    return model, model.transform(df)
