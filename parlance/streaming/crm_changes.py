"""Customer statistics kept by signed changes: no customer table is read to know how many there are of each kind.

The state of a user is what its stage and size are and when they were said. A batch that changes one gives a row -1 for the old
value and +1 for the new; the statistics are the sums of all changes, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import crm

_CHANGES = "kind string, value string, change long"
_STATE = ", ".join(f"{c}_at long, {c}_event long, {c} string" for c in ("stage", "size"))


def _newer(old: tuple, frame: pd.DataFrame, column: str) -> tuple:
    """The later of what was said before (micros, event, value) and in these rows; empty values say nothing."""
    said = frame[frame[column].notna() & (frame[column] != "")]
    if not len(said):
        return old
    last = said.sort_values(["at", "event_id", column]).iloc[-1]
    new = (int(last["at"]), int(last["event_id"]), last[column])
    return new if old[2] is None or new > old else old


def stats_changes(events: DataFrame) -> DataFrame:
    """Rows (kind, value, change) of a stream of profile events: kind is total, stage or size, as in ``customer_stats``.

    Needs user_id, ts, event_id, stage and size. Events may come in any order of time: the latest by (ts, event_id) counts. A null
    user is one customer, as in the fold; rows without a time or event id count as a customer and say nothing. The state holds
    six values for a user, and a hot user's rows pass in Arrow batches of which only the latest is kept.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else None
        stage, size = (tuple(before[:3]), tuple(before[3:])) if before else ((None,) * 3, (None,) * 3)
        was = (stage[2], size[2])
        for frame in frames:
            timed = frame[frame["at"].notna() & frame["event_id"].notna()]
            stage, size = _newer(stage, timed, "stage"), _newer(size, timed, "size")
        state.update((*stage, *size))
        out = [] if before else [("total", None, 1)]
        shown = [None if not before else was[0] or crm.DEFAULT_STAGE, stage[2] or crm.DEFAULT_STAGE]
        for kind, (old, new) in (("stage", shown), ("size", (was[1], size[2]))):
            if old != new:
                out += [(kind, v, n) for v, n in ((old, -1), (new, 1)) if v is not None]
        if out:
            yield pd.DataFrame(out, columns=["kind", "value", "change"])

    return (events.select("user_id", F.unix_micros("ts").alias("at"), "event_id", "stage", "size").groupBy("user_id")
            .applyInPandasWithState(step, _CHANGES, _STATE, "update", GroupStateTimeout.NoTimeout))


def stats_into(events: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps the changes under ``path``, summed in each micro-batch: a few rows for each, whatever the number of customers. A
    repeated batch replaces its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("kind", "value").agg(F.sum("change").alias("change")).filter("change <> 0")
        sums.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stats_changes(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """The statistics as they stand: ``kind, value, customers``; kinds that nobody is of any more are gone."""
    changes = spark.read.schema(_CHANGES).option("recursiveFileLookup", "true").parquet(path)
    return changes.groupBy("kind", "value").agg(F.sum("change").alias("customers")).filter("customers <> 0")
