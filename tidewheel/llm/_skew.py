"""Joins of many rows with one row per key, where a key may hold any share of the many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than one in so many of all rows, so at most so many keys are.
HOT = 128


def attach(many: DataFrame, one: DataFrame, on: Sequence[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (a row per key, ``size`` being the key's rows in ``many``, of
    ``total``); ``size`` is dropped.  Rows of hot keys never move: their side of ``one`` has at
    most HOT rows and is broadcast.  The others are shuffled, none of their keys being hot."""
    on = list(on)
    hot = F.col(size) * HOT > total
    few, rest = one.where(hot).drop(size), one.where(~hot).drop(size)
    lone = many.join(F.broadcast(few.select(*on)), on, "left_anti")
    return many.join(F.broadcast(few), on).unionByName(lone.join(rest, on, how))
