"""Running levels and error quantiles of unbounded series, kept in state.

Every series has a smoothed level and its last absolute errors in the state of a stateful processor.  Rows
wait there until the watermark has passed them and are then taken in order of time, so the result
does not depend on how a stream is cut into batches; rows later than that are dropped by Spark.

Waiting rows are sorted runs of blocks in a map state.  ``FAN`` runs of a tier are merged into one of the
next, and taking rows merges the runs that are there, so a series of any length passes through a worker
with a block of each of some runs in memory.
"""

from __future__ import annotations

import bisect
import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewheel.sources.shared import fresh_folder

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "series_id string, at long, row_id long, y double, level double, resid double, width double"
#: Rows sorted at once, rows of a block of state, runs of a tier that become one, rows given out at once.
SORTED, BLOCK, FAN, GIVEN = 1 << 16, 2048, 16, 10_000


def _sorted(rows: np.ndarray) -> np.ndarray:
    """Rows (at, whether row_id is null, row_id, bits of y) in that order."""
    return rows[np.lexsort(rows.T[::-1])]


def _up_to(rows: np.ndarray, last: list[int]) -> int:
    """How many of the sorted rows are not behind ``last``."""
    low, high = 0, len(rows)
    for column, value in zip(rows.T, last):
        held = column[low:high]
        low, high = low + int(np.searchsorted(held, value, "left")), low + int(np.searchsorted(held, value, "right"))
    return high


class Waiting:
    """Rows of one series in sorted runs.  A run is [tier, first time, next block, blocks left, rows of the next
    block that have been taken]; ``blocks`` is the map state that holds the rows by number of block."""

    def __init__(self, blocks, runs: list[list[int]], free: int):
        self.blocks, self.runs, self.free = blocks, runs, free

    def first(self) -> int | None:
        return min((run[1] for run in self.runs), default=None)

    def add(self, parts: Iterator[np.ndarray], tier: int = 0) -> None:
        """A run of sorted parts."""
        run, left = [tier, 0, self.free, 0, 0], np.empty((0, 4), np.int64)
        for part in parts:
            left = np.concatenate((left, part))
            while len(left) >= BLOCK:
                self._put(run, left[:BLOCK])
                left = left[BLOCK:]
        if len(left):
            self._put(run, left)
        if run[3]:
            self.runs.append(run)
        same = [r for r in self.runs if r[0] == tier]
        if len(same) >= FAN:
            self.runs = [r for r in self.runs if r[0] != tier]
            self.add(self._merged(same), tier + 1)

    def _put(self, run: list[int], rows: np.ndarray) -> None:
        if not run[3]:
            run[1] = int(rows[0, 0])
        self.blocks.updateValue((self.free,), (rows.tobytes(),))
        run[3] += 1
        self.free += 1

    def _head(self, run: list[int]) -> np.ndarray:
        return np.frombuffer(self.blocks.getValue((run[2],))[0], np.int64).reshape(-1, 4)[run[4] :]

    def _merged(self, runs: list[list[int]], end: int | None = None) -> Iterator[np.ndarray]:
        """Rows of ``runs`` before the time ``end``, in order; they are taken from the runs."""
        heads: dict[int, np.ndarray] = {}
        while True:
            near = [k for k, run in enumerate(runs) if run[3] and (end is None or run[1] < end)]
            if not near:
                return
            for k in near:
                if k not in heads:
                    heads[k] = self._head(runs[k])
            last = min(heads[k][-1].tolist() for k in near)
            taken = []
            for k in near:
                run, rows = runs[k], heads[k]
                n = _up_to(rows, last)
                if end is not None:
                    n = min(n, int(np.searchsorted(rows[:, 0], end, "left")))
                taken.append(rows[:n])
                if n < len(rows):
                    heads[k] = rows[n:]
                    run[1], run[4] = int(rows[n, 0]), run[4] + n
                    continue
                del heads[k]
                self.blocks.removeKey((run[2],))
                run[2:] = run[2] + 1, run[3] - 1, 0
                if run[3]:
                    heads[k] = self._head(run)
                    run[1] = int(heads[k][0, 0])
            yield _sorted(np.concatenate(taken))

    def take(self, end: int) -> Iterator[np.ndarray]:
        """Rows before ``end``, in order."""
        yield from self._merged(self.runs, end)
        self.runs = [run for run in self.runs if run[3]]


class Levels(StatefulProcessor):
    """``alpha`` smooths the level; ``width`` is the order statistic at ``coverage`` of the last ``keep`` absolute
    errors, this one included."""

    def __init__(self, alpha: float, coverage: float, keep: int):
        self.alpha, self.coverage, self.keep = alpha, coverage, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "level double, errors array<double>, runs array<array<long>>, free long")
        self.blocks = handle.getMapState("blocks", "block long", "rows binary")

    def close(self) -> None:
        pass

    def _state(self) -> tuple[float | None, list[float], Waiting]:
        level, errors, runs, free = self.held.get() if self.held.exists() else (None, [], [], 0)
        return level, list(errors), Waiting(self.blocks, [list(run) for run in runs], free)

    def _settle(self, key: tuple, level: float | None, errors: list[float], waiting: Waiting, now: int) -> Iterator[pd.DataFrame]:
        """Rows up to the watermark, in order; what is left waits for a timer."""
        lately, ranked = deque(errors), sorted(e for e in errors if e == e)  # no number ranks last
        place = [int(round(self.coverage * k, 9)) for k in range(self.keep)]
        for part in waiting.take((now + 1) * 1000) if now > 0 else ():
            for at in range(0, len(part), GIVEN):
                rows = part[at : at + GIVEN]
                ys, out = np.ascontiguousarray(rows[:, 3]).view(np.float64), []
                for y in ys.tolist():
                    if level is None:
                        level = y
                        out.append((level, None, None))
                        continue
                    resid = y - level
                    error = abs(resid)
                    if len(lately) == self.keep:
                        old = lately.popleft()
                        if old == old:
                            del ranked[bisect.bisect_left(ranked, old)]
                    lately.append(error)
                    if error == error:
                        bisect.insort(ranked, error)
                    k = place[len(lately) - 1]
                    level = level + self.alpha * resid
                    out.append((level, resid, ranked[k] if k < len(ranked) else float("nan")))
                settled = pd.DataFrame(out, columns=["level", "resid", "width"], dtype=float)
                told = pd.DataFrame({"series_id": key[0], "at": rows[:, 0], "row_id": pd.arrays.IntegerArray(rows[:, 2].copy(), rows[:, 1] > 0), "y": ys})
                yield pd.concat((told, settled), axis=1)
        self.held.update((level, list(lately), waiting.runs, waiting.free))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if waiting.runs:
            self.handle.registerTimer(max(waiting.first() // 1000, now + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        level, errors, waiting = self._state()
        parts, n = [], 0
        for frame in rows:
            parts.append(np.stack([*(frame[c].to_numpy(np.int64) for c in ("at", "unknown", "row_id")), frame["y"].to_numpy(np.float64).view(np.int64)], axis=1))
            n += len(frame)
            if n >= SORTED:
                waiting.add([_sorted(np.concatenate(parts))])
                parts, n = [], 0
        if parts:
            waiting.add([_sorted(np.concatenate(parts))])
        yield from self._settle(key, level, errors, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, *self._state(), timerValues.getCurrentWatermarkInMs())


def levels(rows: DataFrame, series_id: str, ts: str, row_id: str, y: str, alpha: float = 0.3, coverage: float = 0.9, keep: int = 50, late: str = "2 hours") -> DataFrame:
    """(series_id, at in microseconds, row_id, y, level, resid, width) of a stream, row by row once the watermark has
    passed.  ``row_id`` settles the order of equal times, null ones last; missing values are dropped."""
    stamped = rows.select(F.col(series_id).cast("string").alias("series_id"), F.col(ts).cast("timestamp").alias("ts"), F.col(row_id).cast("long").alias("row_id"), F.col(y).cast("double").alias("y"))
    known = stamped.where("y is not null and ts is not null and series_id is not null").withWatermark("ts", late)
    told = known.select("series_id", "ts", F.unix_micros("ts").alias("at"), F.col("row_id").isNull().cast("long").alias("unknown"), F.coalesce("row_id", F.lit(0)).alias("row_id"), "y")
    return told.groupBy("series_id").transformWithStateInPandas(Levels(alpha, coverage, keep), OUT, "Append", "EventTime")


def written(stream: DataFrame, kind: str = "levels", folder: str | None = None) -> DataFrame:
    """All that is there, run into files of the shared folder, and read back."""
    spark: SparkSession = stream.sparkSession
    folder = folder or fresh_folder(spark, kind)
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
        writer.queryName(f"{kind}_{uuid.uuid4().hex}").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.parquet(f"{folder}/rows")
