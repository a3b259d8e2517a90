"""Working memory with a lifetime: what a session remembers at each of its turns, as a stream.

A session has one row of state: the remembered turns, the time of the last one, and the turns that wait for the watermark. It travels with
the session's rows, so a session costs no call to the state store of its own, and it is woken when the watermark reaches a waiting turn or
passes the end of its memory's lifetime.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_TURNS = 10
TTL_SECONDS = 86_400
_STATE = "last long, turns array<string>, at array<long>, turn_id array<string>"
_SCHEMA = "session_id string, turn_id string, ts timestamp, window_size long, remembered array<string>, starts_anew boolean"


def remembered(at: np.ndarray, carried: int, ttl: int, size: int, last: int | None) -> tuple[np.ndarray, np.ndarray]:
    """For turns at ascending times after ``carried`` remembered ones: how many turns the memory holds with each of them, and whether
    it starts anew there: at a first turn or after a pause of more than ``ttl``."""
    before = np.concatenate([[at[0] - ttl - 1 if last is None else last], at[:-1]])
    forgot = at - before > ttl
    place = np.arange(len(at))
    start = np.maximum.accumulate(np.where(forgot, place, -carried))
    return np.minimum(place - start + 1, size), forgot


def working_memory_stream(turns: DataFrame, size: int = WINDOW_TURNS, ttl_seconds: float = TTL_SECONDS, delay: str = "1 minute") -> DataFrame:
    """``session_id, turn_id, ts, window_size, remembered, starts_anew`` for every turn (session_id, turn_id, ts) of a stream.

    A session remembers its last ``size`` turns in order of time and turn id. Its memory starts anew at its first turn and after a
    pause of more than ``ttl_seconds``, and a session that is silent for longer keeps no state. Turns that come after the watermark has
    passed them are dropped. Sets the state store that keeps state off the heap.
    """
    ttl = int(ttl_seconds * 1_000_000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, turns, *waiting = state.get if state.exists else (None, [], [], [])
        rows = [*zip(*waiting)]
        for frame in frames:
            rows += zip(frame["at"].to_numpy(np.int64).tolist(), frame["turn_id"])
        rows.sort(key=lambda r: (r[0], r[1] is not None, r[1]))
        watermark = state.getCurrentWatermarkMs()
        n = bisect_right(rows, watermark * 1000, key=lambda r: r[0])
        due, left = rows[:n], rows[n:]
        if due:
            at = np.array([r[0] for r in due], np.int64)
            held, forgot = remembered(at, len(turns), ttl, size, last)
            ids = [*turns, *(r[1] for r in due)]
            ends = range(len(turns) + 1, len(ids) + 1)
            yield pd.DataFrame({
                "session_id": key[0], "turn_id": [r[1] for r in due], "ts": pd.to_datetime(at, unit="us"), "window_size": held,
                "remembered": [ids[e - n:e] for e, n in zip(ends, held.tolist())], "starts_anew": forgot})
            last, turns = int(at[-1]), ids[len(ids) - int(held[-1]):]
        over = None if last is None else (last + ttl) // 1000 + 1
        if over is not None and over <= watermark:
            # No turn can come any more that would find this memory in force.
            last, turns, over = None, [], None
        # A time-out is due once the watermark is beyond it.
        nexts = [(left[0][0] - 1) // 1000] if left else []
        nexts += [over] if over is not None else []
        if nexts:
            state.update((last, list(turns), [r[0] for r in left], [r[1] for r in left]))
            state.setTimeoutTimestamp(max(min(nexts), watermark, 1))
        elif state.exists:
            state.remove()

    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass",
                                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = turns.withWatermark("ts", delay).select("session_id", "turn_id", "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("session_id").applyInPandasWithState(step, _SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def working_memory(turns: DataFrame, size: int = WINDOW_TURNS, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """The same for a table of turns, without Python: pauses cut a session into stretches, and a window looks back in each."""
    from pyspark.sql import Window as W
    at = F.unix_micros("ts")
    order = W.partitionBy("session_id").orderBy("ts", "turn_id")
    gap = F.coalesce(at - F.lag(at).over(order) > int(ttl_seconds * 1_000_000), F.lit(True))
    cut = turns.select("session_id", "turn_id", "ts", gap.alias("starts_anew")).withColumn(
        "_stretch", F.sum(F.col("starts_anew").cast("long")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    back = W.partitionBy("session_id", "_stretch").orderBy("ts", "turn_id").rowsBetween(-(size - 1), W.currentRow)
    found = cut.withColumn("remembered", F.collect_list("turn_id").over(back))
    return found.select("session_id", "turn_id", "ts", F.size("remembered").cast("long").alias("window_size"), "remembered", "starts_anew")
