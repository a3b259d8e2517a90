"""Streaming forms of the inbox, session and CRM operators.

Event time is watermarked by ``delay``; rows older than the watermark are dropped, which bounds
every state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import lexicons as L
from ..operators import crm, inbox, memory, signals
from ..operators.prep import chunk_documents, embedded_points, with_point_id
from ..sources import vector_table, webhooks


def inbox_stream(payloads: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Payload texts (body, received_at, payload_id) to queued messages: flattened, deduplicated by platform id, with defaults."""
    return dedup_stream(inbox.enqueue(webhooks.flatten_payloads(webhooks.with_payload_ids(payloads))), delay)


def dedup_stream(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first message of every platform id that arrives within the delay, and all messages without an
    id; those take no state."""
    rows = messages.withWatermark("received_at", delay)
    return rows.filter(inbox.has_mid()).dropDuplicatesWithinWatermark(["mid"]).unionByName(rows.filter(~inbox.has_mid()))


def session_stream(turns: DataFrame, timeout_seconds: int = memory.SESSION_TIMEOUT,
                   delay: str = "10 minutes") -> DataFrame:
    """Finished session stretches, once the watermark has passed their end."""
    return memory.sessions(turns.withWatermark("ts", delay), timeout_seconds)


def reply_stream(messages: DataFrame, replies: DataFrame, within: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Messages with the replies that come within a time; those without one are given out when
    that time is over."""
    m = messages.withWatermark("received_at", delay).alias("m")
    r = replies.withWatermark("replied_at", delay).alias("r")
    on = F.expr(f"m.message_id = r.message_id AND r.replied_at >= m.received_at "
                f"AND r.replied_at <= m.received_at + INTERVAL {within}")
    return m.join(r, on, "leftOuter").select(
        "m.message_id", "m.sender_id", "m.message_text", "m.received_at",
        F.col("r.reply").alias("ai_reply"), "r.replied_at",
        F.when(F.col("r.replied_at").isNotNull(), "replied").otherwise("pending").alias("status"))


_BATCH_SCHEMA = ("sender_id string, window_start timestamp, flattened_message string, ids string, "
                 "message_count int")
_STATE_SCHEMA = "at array<long>, message_id array<string>, message_text array<string>"


def anchored_batch_stream(messages: DataFrame, seconds: float = 5.0, delay: str = "1 minute") -> DataFrame:
    """Anchored batches of every sender, given out once the watermark has passed their end.

    The state of a sender is what it sent since its last finished batch, so it is bounded by the
    sender's rate over the batch length and the delay.
    """
    width = int(round(seconds * 1_000_000))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = pd.DataFrame(dict(zip(("at", "message_id", "message_text"), state.get))) if state.exists else None
        parts = [waiting] if waiting is not None else []
        for frame in frames:
            parts.append(pd.DataFrame({
                "at": frame["at"].to_numpy(), "message_id": frame["message_id"], "message_text": frame["message_text"]}))
        rows = pd.concat(parts, ignore_index=True).sort_values(["at", "message_id"], ignore_index=True)
        times = rows["at"].to_numpy(dtype=np.int64)
        anchors, _ = inbox._anchors(times, width, int(times[0]))
        done = anchors + width <= state.getCurrentWatermarkMs() * 1000
        rows["anchor"] = anchors
        finished, left = rows[done], rows[~done]
        if len(left):
            state.update((left["at"].tolist(), left["message_id"].tolist(), left["message_text"].tolist()))
            wake = int(left["anchor"].iloc[0] + width) // 1000 + 1
            state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if len(finished):
            grouped = finished.groupby("anchor", sort=True)
            yield pd.DataFrame({
                "sender_id": key[0],
                "window_start": [pd.Timestamp(a, unit="us") for a in grouped.groups],
                "flattened_message": [", ".join(t for t in g if t) for _, g in grouped["message_text"]],
                "ids": [", ".join(g) for _, g in grouped["message_id"]],
                "message_count": grouped.size().to_numpy(),
            })

    return (messages.withWatermark("received_at", delay)
            .select("sender_id", "message_id", "message_text", "received_at", F.unix_micros("received_at").alias("at"))
            .groupBy("sender_id")
            .applyInPandasWithState(step, _BATCH_SCHEMA, _STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout))


_LIFECYCLE_SCHEMA = ("session_id string, turn_id string, ts timestamp, lifecycle_state string, "
                     "is_first_turn_of_session boolean, idle_seconds long, session_no long, turn_count long")
_LIFECYCLE_STATE = ("last long, session_no long, turn_count long, at array<long>, turn_id array<string>, "
                    "is_user array<boolean>")


def lifecycle_stream(turns: DataFrame, timeout_seconds: float = memory.SESSION_TIMEOUT,
                     delay: str = "1 minute", retention_seconds: float | None = None) -> DataFrame:
    """Lifecycle of every user turn, given out in time order once the watermark has passed the turn.

    The state of a session is its last turn's time, two counters, and the turns that still wait for
    the watermark. With ``retention_seconds`` a session without a turn for that long is forgotten, and its next
    turn is a first contact again; without it three numbers stay for every session ever seen.
    """
    limit = int(timeout_seconds * 1_000_000)
    retention = None if retention_seconds is None else int(retention_seconds * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, session_no, turn_count, *waiting = state.get if state.exists else (None, 0, 0, [], [], [])
        rows = sorted([*zip(*waiting), *(r for f in frames for r in zip(
            f["at"].tolist(), f["turn_id"].tolist(), (f["role"] == "user").tolist()))])
        passed = state.getCurrentWatermarkMs() * 1000
        out = []
        for at, turn_id, is_user in rows:
            if at > passed:
                break
            if retention is not None and last is not None and at - last >= retention * 1000:
                last, session_no, turn_count = None, 0, 0
            if is_user:
                idle = None if last is None else at - last
                name = ("first_contact" if idle is None else
                        "returning_session" if idle > limit else "active_ongoing")
                first = name != "active_ongoing"
                session_no, turn_count = session_no + first, 1 if first else turn_count + 1
                out.append((key[0], turn_id, pd.Timestamp(at, unit="us"), name, first,
                            0 if idle is None else idle // 1_000_000, session_no, turn_count))
            last = at
        left = [r for r in rows if r[0] > passed]
        forgotten = None if retention is None or last is None else last // 1000 + retention
        if not left and forgotten is not None and forgotten <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
        else:
            state.update((last, int(session_no), int(turn_count), *map(list, zip(*left))) if left
                         else (last, int(session_no), int(turn_count), [], [], []))
            wake = left[0][0] // 1000 + 1 if left else forgotten
            if wake is not None:
                state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "turn_id", "ts", "lifecycle_state",
                                             "is_first_turn_of_session", "idle_seconds", "session_no", "turn_count"])

    return (turns.withWatermark("ts", delay)
            .select("session_id", "turn_id", "role", "ts", F.unix_micros("ts").alias("at"))
            .groupBy("session_id")
            .applyInPandasWithState(step, _LIFECYCLE_SCHEMA, _LIFECYCLE_STATE, "append", GroupStateTimeout.EventTimeTimeout))


def append_to(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that appends to parquet files."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def fold_customers_into(events: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps customer records under ``path``: each micro-batch writes the records of its own events, which
    merge in any order, and nothing else. The batch id names the folder, so a repeated batch is not counted twice."""
    def write(batch: DataFrame, batch_id: int) -> None:
        crm.fold_records(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def inbound_customers_into(payloads: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes",
                           lexicon: L.ProfileLexicon = L.ProfileLexicon(), available_now: bool = True) -> StreamingQuery:
    """The inbound chain as payloads arrive: inbox rows, their profile signals, customer records."""
    events = crm.events_from_inbox(signals.profile_signals(inbox_stream(payloads, delay), lexicon, "message_text"))
    return fold_customers_into(events, path, checkpoint, available_now)


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    """The customers as they stand after all micro-batches."""
    records = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return crm.customers_of(crm.merge_records(records))


def index_documents_into(docs: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Chunks and embeds every micro-batch of documents into the index under ``path``; a document that comes again
    replaces all chunks that it had."""
    def upsert(batch: DataFrame, batch_id: int) -> None:
        vector_table.replace_documents(with_point_id(chunk_documents(batch)), batch, path, embedded_points())

    writer = docs.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
