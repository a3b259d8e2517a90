"""The message inbox: dedup, queue, replies, anchored batches, telemetry, notifications."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ordered import MAX_ROWS, SLOT, joined, keyed
from ..functions.text import non_empty
from .memory import latest_by_key

DEFAULT_SENDER_NAME = "Facebook User"
DEFAULT_PLATFORM = "messenger"


def has_mid() -> Column:
    """True where the platform gave an id. Messages without one are never duplicates."""
    return non_empty(F.col("mid")).isNotNull()


def dedup_messages(messages: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The first message of every platform id, without ids already in ``seen.mid``, and all messages that have none."""
    order = W.partitionBy("mid").orderBy("received_at", "message_id")
    known = messages.filter(has_mid())
    if seen is not None:
        known = known.join(seen.select("mid"), "mid", "left_anti").select(*messages.columns)
    first = known.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == 1)
    return first.select(*messages.columns).unionByName(messages.filter(~has_mid()))


def enqueue(messages: DataFrame) -> DataFrame:
    """Inbox rows with defaults. The id is ``fb_`` and a full hash of where the message came from: its payload and its
    place there, or else its own ``message_id``; so a replay gives the same ids, and two messages two ids."""
    if {"payload_id", "ordinal"} <= set(messages.columns):
        origin = F.concat_ws("|", "payload_id", F.col("ordinal").cast("string"))
    elif "message_id" in messages.columns:
        origin = F.col("message_id")
    else:
        raise ValueError("messages need payload_id and ordinal, or message_id")

    def given(column: str, default: str) -> Column:
        return F.coalesce(non_empty(F.col(column)), F.lit(default)) if column in messages.columns else F.lit(default)

    return messages.select(
        F.concat(F.lit("fb_"), F.sha1(origin)).alias("message_id"),
        "mid", "sender_id", given("sender_name", DEFAULT_SENDER_NAME).alias("sender_name"),
        given("platform", DEFAULT_PLATFORM).alias("platform"),
        "message_text", "audio_url", F.lit("pending").alias("status"), "received_at")


def mark_replied(inbox: DataFrame, replies: DataFrame) -> DataFrame:
    """Inbox rows with their latest reply ``(message_id, reply, replied_at)``."""
    last = latest_by_key(replies.select("message_id", F.col("reply").alias("ai_reply"), "replied_at"),
                         "message_id", ["replied_at", "ai_reply"])
    joined = inbox.drop("ai_reply", "replied_at").join(last, "message_id", "left")
    return joined.withColumn("status", F.when(F.col("replied_at").isNotNull(), "replied").otherwise(F.col("status")))


def pending_messages(inbox: DataFrame, limit: int | None = 10) -> DataFrame:
    """Pending messages, oldest first."""
    rows = inbox.filter(F.col("status") == "pending").select(
        "message_id", "sender_id", "sender_name", "platform", "message_text", "audio_url",
        (F.coalesce("audio_url", F.lit("")) != "").alias("is_voice_message"), "received_at")
    return rows if limit is None else rows.orderBy("received_at", "message_id").limit(limit)


def message_replies(inbox: DataFrame) -> DataFrame:
    return inbox.filter(F.col("status") == "replied").select("message_id", "ai_reply")


def telemetry(events: DataFrame, limit: int = 50, kept: int = 100) -> DataFrame:
    """The newest events, newest first; only the last ``kept`` are held at all."""
    return events.orderBy(F.col("received_at").desc(), F.col("event_id").desc()).limit(min(limit, kept))


def latest_per_thread(messages: DataFrame, own_account: str, seen: DataFrame | None = None) -> DataFrame:
    """The newest message of every thread, unless it is our own or was seen before. The newest is
    picked first: a thread whose newest message is our own gives no row."""
    at = F.struct("received_at", "message_id")
    newest = messages.groupBy("thread_id").agg(F.max_by(F.struct(
        "message_id", "sender_id", "message_text", "received_at"), at).alias("m")).select("thread_id", "m.*")
    fresh = newest.filter(F.col("sender_id") != own_account)
    return fresh if seen is None else fresh.join(seen.select("message_id"), "message_id", "left_anti")


def notifications(messages: DataFrame) -> DataFrame:
    """One JSON text per message for a Kafka or file sink; the text is cut to 200 characters."""
    return messages.select(F.to_json(F.struct(
        F.lit("new_message").alias("type"), "sender_id",
        F.substring("message_text", 1, 200).alias("text"), "platform")).alias("value"))


# -- anchored batches -----------------------------------------------------------------------------

_ANCHOR_SCHEMA = "sender_id string, message_id string, message_text string, at long, anchor long"


def _anchors(times: np.ndarray, width: int, entry: int) -> tuple[np.ndarray, int]:
    """Anchors of ascending times, and when the last batch closes. A time before ``entry`` belongs to
    a batch opened earlier, whose anchor is ``entry - width``."""
    out = np.empty(len(times), dtype=np.int64)
    i = int(np.searchsorted(times, entry, side="left"))
    out[:i] = entry - width
    while i < len(times):
        j = int(np.searchsorted(times, times[i] + width, side="left"))
        out[i:j] = times[i]
        entry = int(times[i]) + width
        i = j
    return out, entry


def _exits(times: np.ndarray, width: int, slot_start: int) -> tuple[list[int], list[int]]:
    """How a slot maps the moment an earlier batch closes to the moment its own last batch closes.

    Only batches that close within ``width`` after the slot's first time reach into it. The map is a step
    function: ``exits[k]`` holds for closing moments up to ``upto[k]``.
    """
    n = len(times)
    after = np.searchsorted(times, times + width, side="left")
    closes = times + width
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            closes[i] = closes[after[i]]
    first_out = int(np.searchsorted(times, slot_start + width, side="left"))
    upto, exits = [], []
    for i in range(min(first_out + 1, n)):
        if exits and exits[-1] == int(closes[i]):
            upto[-1] = int(times[i])
        else:
            upto.append(int(times[i]))
            exits.append(int(closes[i]))
    return upto, exits


def _slot_entries(times: DataFrame, width: int) -> DataFrame:
    """When the batch that reaches into each slot closes: ``sender_id, _slot, entry``; null if none does."""
    def reduce_slot(pdf: pd.DataFrame) -> pd.DataFrame:
        ascending = np.sort(pdf["at"].to_numpy())
        upto, exits = _exits(ascending, width, int(ascending[0]))
        return pd.DataFrame({"sender_id": [pdf["sender_id"].iloc[0]], SLOT: [pdf[SLOT].iloc[0]],
                             "upto": [upto], "exits": [exits]})

    def chain_slots(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(SLOT)
        closing, entries = None, []
        for upto, exits in zip(pdf["upto"], pdf["exits"]):
            entries.append(closing)
            k = 0 if closing is None else bisect_left(list(upto), closing)
            if k < len(exits):
                closing = int(exits[k])
        return pd.DataFrame({"sender_id": pdf["sender_id"], SLOT: pdf[SLOT],
                             "entry": pd.array(entries, dtype="Int64")})

    steps = times.groupBy("sender_id", SLOT).applyInPandas(
        reduce_slot, f"sender_id string, {SLOT} long, upto array<long>, exits array<long>")
    return steps.groupBy("sender_id").applyInPandas(chain_slots, f"sender_id string, {SLOT} long, entry long")


def anchored_messages(messages: DataFrame, seconds: float = 5.0, max_rows: int = MAX_ROWS) -> DataFrame:
    """Messages with the anchor of their batch.

    A sender's first message opens a batch that takes everything of that sender for ``seconds``; the
    first message at or after its end opens the next. Each batch depends on the one before, so a
    task walks a sender's times in order. Senders with more than ``max_rows`` messages are cut into
    slots: each slot is first reduced to a small step function from "an earlier batch closes
    at" to "the last batch closes at", these are chained per sender, and then every slot is walked
    by itself from its known start.
    """
    width = int(round(seconds * 1_000_000))
    found = keyed(messages.select("sender_id", "message_id", "message_text", "received_at"),
                  ["sender_id"], ["received_at", "message_id"], max_rows)
    rows = found.df.withColumn("at", F.unix_micros("received_at"))
    if found.split:
        # One row per slot, and only senders beyond max_rows have slots; the planner sees how many.
        entries = _slot_entries(rows.filter(F.col(SLOT) >= 0).select("sender_id", SLOT, "at"), width)
        rows = joined(rows, entries, ["sender_id", SLOT], "left")
    else:
        rows = rows.withColumn(SLOT, F.lit(-1).cast("long")).withColumn("entry", F.lit(None).cast("long"))
    ordered = (rows.select("sender_id", SLOT, "message_id", "message_text", "at", "entry")
               .repartition(*[F.col(c) for c in found.parts])
               .sortWithinPartitions("sender_id", SLOT, "at", "message_id"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entry = None, None
        for batch in batches:
            senders = batch.column("sender_id").to_numpy(zero_copy_only=False)
            slots = batch.column(SLOT).to_numpy(zero_copy_only=False)
            times = batch.column("at").to_numpy(zero_copy_only=False)
            given = batch.column("entry").to_pylist()
            anchors = np.empty(len(times), dtype=np.int64)
            cuts = np.nonzero((senders[1:] != senders[:-1]) | (slots[1:] != slots[:-1]))[0] + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(times)]):
                if hi > lo:
                    if (senders[lo], slots[lo]) != key:
                        key = senders[lo], slots[lo]
                        entry = int(times[lo]) if given[lo] is None else given[lo]
                    anchors[lo:hi], entry = _anchors(times[lo:hi], width, entry)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sender_id"), batch.column("message_id"), batch.column("message_text"),
                 batch.column("at"), pa.array(anchors)],
                names=["sender_id", "message_id", "message_text", "at", "anchor"])

    return ordered.mapInArrow(walk, _ANCHOR_SCHEMA).select(
        "sender_id", "message_id", "message_text", F.timestamp_micros("at").alias("received_at"),
        F.timestamp_micros("anchor").alias("window_start"))


def anchored_batches(messages: DataFrame, seconds: float = 5.0, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per batch: joined text (null texts dropped), joined ids, count."""
    placed = anchored_messages(messages, seconds, max_rows)
    ordered = F.sort_array(F.collect_list(F.struct("received_at", "message_id", "message_text")))
    return placed.groupBy("sender_id", "window_start").agg(ordered.alias("_m")).select(
        "sender_id", "window_start",
        F.array_join(F.filter(F.col("_m.message_text"), lambda t: t != ""), ", ").alias("flattened_message"),
        F.array_join(F.col("_m.message_id"), ", ").alias("ids"),
        F.size("_m").alias("message_count"))
