"""The stateful operators over streams: the same rows in, the same answers out, bounded by watermarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pointloom.operators.folds import IDENTITY, madgwick

QUATERNION = "qw double, qx double, qy double, qz double"


def rates(stream: DataFrame, by: tuple[str, ...], ts: str = "ts", width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Rows (by, start, n) of tumbling windows, final once the watermark has passed them."""
    windows = stream.withWatermark(ts, late).groupBy(*by, F.window(ts, width)).agg(F.count("*").alias("n"))
    return windows.select(*by, F.col("window.start").alias("start"), "n")


def latest(stream: DataFrame, by: tuple[str, ...], t: str = "t", tie: str = "seq") -> DataFrame:
    """The newest row of each group; for update or complete mode."""
    value = [c for c in stream.columns if c not in by]
    return stream.groupBy(*by).agg(F.max_by(F.struct(*value), F.struct(t, tie)).alias("v")).select(*by, "v.*")


def near_pairs(left: DataFrame, right: DataFrame, by: str, ts: str = "ts", tolerance: str = "50 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Pairs of rows of two streams at most ``tolerance`` apart; state is dropped as the watermark passes. Right columns are prefixed right_."""
    a = left.withWatermark(ts, late)
    b = right.select(*(F.col(c).alias(f"right_{c}") for c in right.columns)).withWatermark(f"right_{ts}", late)
    gap = F.expr(f"INTERVAL {tolerance}")
    return a.join(b, (F.col(by) == F.col(f"right_{by}")) & (F.col(f"right_{ts}") >= F.col(ts) - gap) & (F.col(f"right_{ts}") <= F.col(ts) + gap))


def nearest(left: DataFrame, right: DataFrame, by: str, order: str = "seq", ts: str = "ts", values: tuple[str, ...] = (), late: str = "10 seconds", idle: int = 60_000) -> DataFrame:
    """Rows (by, order, ts, right_order, right_ts, right_values ..): each left row with the right row nearest in time, as ``asof_nearest`` over whole tables.

    A left row is emitted once, when the watermark shows that no nearer row can come: it has passed a right row after it, or is
    farther from the left row than the last right row before it. Ties go to the earlier row; of right rows of one time the
    greatest ``order`` counts for rows at or after them, the least for rows before. State holds what the watermark has
    not passed, left rows that wait, and the last right row. ``idle`` milliseconds after its newest row a group gives what it
    has (nulls where no right row came) and is forgotten. ``order`` and ``values`` are numbers.
    """
    kind = left.schema[by].dataType.simpleString()
    nothing = [F.lit(None).cast("double").alias(v) for v in values]
    side = lambda df, flag, cols: df.withWatermark(ts, late).select(by, ts, F.col(order).cast("double").alias("_order"), F.lit(flag).alias("_left"), *cols)
    both = side(left, 1.0, nothing).unionByName(side(right, 0.0, [F.col(v).cast("double").alias(v) for v in values]))
    width = 3 + len(values)
    names = [by, order, ts, f"right_{order}", f"right_{ts}", *(f"right_{v}" for v in values)]

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held, newest = group.get if group.exists else (b"", 0)
        rows = np.frombuffer(held, dtype=np.float64).reshape(-1, width)
        for frame in frames:
            at = frame[ts].to_numpy().astype("datetime64[us]").astype(np.int64)
            rows = np.concatenate((rows, np.column_stack((at, frame[["_left", "_order", *values]].to_numpy(dtype=np.float64)))))
        newest = max(newest, int(rows[:, 0].max(initial=0)))
        passed = group.getCurrentWatermarkMs() * 1000
        over = passed >= (newest // 1000 + 1 + idle) * 1000
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        asked, there = rows[rows[:, 1] == 1], rows[rows[:, 1] == 0]
        t = asked[:, 0]
        last, first = np.searchsorted(there[:, 0], t, "right") - 1, np.searchsorted(there[:, 0], t, "right")
        time = np.concatenate((there[:, 0], [np.inf]))  # -1 and len(there) both fall on the end
        before, after = np.where(last >= 0, t - time[last], np.inf), time[first] - t
        known = over | ((t <= passed) & ((time[first] <= passed) | (t + before <= passed)))
        pick = np.where(before <= after, last, first)
        have = np.isfinite(np.minimum(before, after))
        got = np.concatenate((there, np.full((1, width), np.nan)))[np.where(have, pick, len(there))][known]
        done, wait = asked[known], asked[~known]
        if over:
            group.remove()
        else:
            keep = there[max(0, np.searchsorted(there[:, 0], passed, "right") - 1) :]
            group.update((np.concatenate((wait, keep)).tobytes(), newest))
            need = np.where(np.isfinite(before[~known]), np.maximum(t[~known], np.minimum(t[~known] + before[~known], time[first[~known]])), np.inf)
            next_ = min([newest // 1000 + 1 + idle, *(int(x) // 1000 + 1 for x in need if np.isfinite(x))])
            group.setTimeoutTimestamp(max(next_, group.getCurrentWatermarkMs() + 1))
        stamp = lambda x: pd.Series(pd.to_datetime(pd.Series(x), unit="us"))
        number = lambda x: pd.Series(x).astype("Int64")
        columns = [pd.Series([key[0]] * len(done), dtype=object), number(done[:, 2]), stamp(done[:, 0]), number(got[:, 2]), stamp(got[:, 0]), *(pd.Series(got[:, 3 + i]) for i in range(len(values)))]
        yield pd.DataFrame(dict(zip(names, columns)))

    out = f"{by} {kind}, {order} long, {ts} timestamp, right_{order} long, right_{ts} timestamp" + "".join(f", right_{v} double" for v in values)
    return both.groupBy(by).applyInPandasWithState(step, out, "held binary, newest long", "append", GroupStateTimeout.EventTimeTimeout)


Fold = Callable[[Any, tuple, np.ndarray], tuple[tuple, list[list]]]


def in_event_order(stream: DataFrame, by: str, ts: str, order: str, inputs: list[str], start: tuple, state: str, fold: Fold, out: str, late: str, idle: int | None = None, flush: Callable[[Any, tuple], list[list]] | None = None) -> DataFrame:
    """Fold the rows of each group in the order of ``ts``, then ``order``, however they arrive.

    Rows wait in the state until the watermark (``late`` behind the newest row) has passed them, for none older can come
    then. Rows beyond the watermark are dropped by Spark, which counts them in each progress report as
    numRowsDroppedByWatermark. ``fold(key, state, rows)`` gets an array (order, inputs) and gives the next state and rows to emit.
    A group without waiting rows ends ``idle`` milliseconds after its last one, if given: ``flush`` may emit what is left of it.
    """
    kind = stream.schema[by].dataType.simpleString()
    names = [c.split()[0] for c in f"{by} {kind}, {out}".split(", ")]
    width = 2 + len(inputs)

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        *own, held, newest = group.get if group.exists else (*start, b"", 0)
        rows = np.frombuffer(held, dtype=np.float64).reshape(-1, width)
        for frame in frames:
            at = frame[ts].to_numpy().astype("datetime64[us]").astype(np.int64)
            rows = np.concatenate((rows, np.column_stack((at, frame[[order, *inputs]].to_numpy(dtype=np.float64)))))
        passed = group.getCurrentWatermarkMs() * 1000
        ready, rest = rows[rows[:, 0] <= passed], rows[rows[:, 0] > passed]
        newest = max(newest, int(rows[:, 0].max(initial=0)))
        done: list[list] = []
        if len(ready):
            own, done = fold(key[0], tuple(own), ready[np.lexsort((ready[:, 1], ready[:, 0]))][:, 1:])
        end = newest // 1000 + 1 + (idle or 0)
        if not len(rest) and idle is not None and passed >= end * 1000:
            done = done + (flush(key[0], tuple(own)) if flush else [])
            group.remove()
        else:
            group.update((*own, rest.tobytes(), newest))
            if len(rest):
                group.setTimeoutTimestamp(int(rest[:, 0].min()) // 1000 + 1)
            elif idle is not None:
                group.setTimeoutTimestamp(end)
        yield pd.DataFrame({c: pd.Series([r[i] for r in done], dtype=None if done else object) for i, c in enumerate(names)})

    rows = stream.withWatermark(ts, late).groupBy(by)
    return rows.applyInPandasWithState(step, f"{by} {kind}, {out}", f"{state}, held binary, newest long", "append", GroupStateTimeout.EventTimeTimeout)


def attitude(stream: DataFrame, by: str, order: str = "seq", ts: str = "ts", rate: float = 100.0, beta: float = 0.1, late: str = "10 seconds") -> DataFrame:
    """The six-axis attitude of a group each time the watermark has passed some of its rows: by, seq of the last of them, quaternion; see ``in_event_order``."""

    def fold(key: Any, q: tuple, rows: np.ndarray) -> tuple[tuple, list[list]]:
        at, none = np.array([q]), np.full((1, 3), np.nan)
        for i in range(len(rows)):
            at = madgwick(at, rows[i : i + 1, 1:4], rows[i : i + 1, 4:7], none, beta, 1.0 / rate)
        q = tuple(at[0].tolist())
        return q, [[key, int(rows[-1, 0]), *q]]

    return in_event_order(stream, by, ts, order, ["gx", "gy", "gz", "ax", "ay", "az"], IDENTITY, QUATERNION, fold, f"{order} long, {QUATERNION}", late)


def sweeps(stream: DataFrame, by: str, order: str = "seq", ts: str = "ts", azimuth: str = "azimuth_deg", late: str = "10 seconds", idle: int = 60_000) -> DataFrame:
    """Sweeps (by, sweep, n, complete) of returns: a sweep ends where the azimuth falls from over 270 to under 90 degrees, or, incomplete, where a group has no return for ``idle`` milliseconds; see ``in_event_order``."""

    def fold(key: Any, state: tuple, rows: np.ndarray) -> tuple[tuple, list[list]]:
        sweep, n, last = state
        done = []
        for az in rows[:, 1].tolist():
            if az < last and last > 270 and az < 90:
                done.append([key, sweep, n, True])
                sweep, n = sweep + 1, 0
            n, last = n + 1, az
        return (sweep, n, last), done

    def flush(key: Any, state: tuple) -> list[list]:
        return [[key, state[0], state[1], False]] if state[1] else []

    return in_event_order(stream, by, ts, order, [azimuth], (0, 0, -1.0), "sweep long, n long, last double", fold, "sweep long, n long, complete boolean", late, idle, flush)
