"""Every query with SQL agrees with DuckDB on the smallest tables; the rest run."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidewheel.plans import catalogue, matrix_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def _text(v):
    if v is None or v is pd.NaT:
        return ""
    if isinstance(v, float) and not math.isfinite(v):
        raise AssertionError(f"not a number: {v}")
    return str(v) if isinstance(v, bool) or not isinstance(v, (int, float)) else f"{float(v):.6f}"


def _norm(rows):
    return sorted(tuple(map(_text, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = [tuple(r[c] for c in columns) for r in found.collect()]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    answer = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    a, b = _norm(rows), _norm([tuple(r[names.index(c)] for c in columns) for r in answer.fetchall()])
    assert len(a) == len(b)
    off = [(x, y) for x, y in zip(a, b) if x != y]
    assert a and not off, off[:3]


@pytest.mark.parametrize("name", ["var_box_cox_forecast", "hmm_var_forecast", "ets_forecast", "sarima_forecast", "pooled_forecast", "backward_selection", "forward_selection_by_target", "stl_strength", "ets_fitted", "feature_importances"])
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 30
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streaming(spark, tmp_path):
    from tidewheel.streaming import features

    batch = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.coalesce(1).write.parquet(str(tmp_path / "in" / "one"))
    stream = features.read_stream(spark, str(tmp_path / "in" / "*"), batch.schema)
    features.run_available(features.windowed_panel(stream, "event_type", "ts", "value"), "panel_stream", str(tmp_path / "ck"), "append")
    assert spark.table("panel_stream").count() > 0
