"""Customer records folded from profile events, and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .memory import context_arrays, latest_by_key

DEFAULT_LANGUAGE = "english"
DEFAULT_STAGE = "New Lead"


def fold_records(events: DataFrame) -> DataFrame:
    """What the events of each user say, as records that can be merged in any order.

    ``events``: user_id, ts, event_id, size, fabric, language, location, stage, tags, notes. Every value
    keeps the time and id of its event. Every aggregate merges partial results, so a hot user sends one row per
    task; of the tags only distinct ones are gathered.
    """
    def last(column: str, empty_counts: bool = False) -> Column:
        value = F.col(column)
        there = value.isNotNull() if empty_counts else value.isNotNull() & (value != "")
        return F.max(F.when(there, F.struct("ts", "event_id", value.alias("value")))).alias(column)

    # One row per tag, so that a user's tags are gathered as often as there are different ones; the rest of an event
    # counts once.
    rows = events.select(*[c for c in events.columns if c != "tags"], F.posexplode_outer("tags").alias("_at", "_tag"))
    once = F.when(F.coalesce("_at", F.lit(0)) == 0, 1).otherwise(0).cast("long")
    return rows.groupBy("user_id").agg(
        last("size"), F.max(F.struct("ts", "event_id", F.col("fabric").alias("value"))).alias("fabric"),
        last("language"), last("location"), last("stage"), last("notes", True),
        F.sum(once).alias("total_turns"), F.max("ts").alias("last_active"), F.array_sort(F.collect_set("_tag")).alias("tags"))


def merge_records(records: DataFrame) -> DataFrame:
    """One record per user from any number of them; a user has no more than were put together."""
    newest = [F.max(c).alias(c) for c in ("size", "fabric", "language", "location", "stage", "notes", "last_active")]
    return records.groupBy("user_id").agg(
        *newest, F.sum("total_turns").alias("total_turns"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))


def customers_of(records: DataFrame) -> DataFrame:
    """Records as customers: the values, with defaults for language, stage and notes."""
    return records.select(
        "user_id", F.col("size.value").alias("preferred_size"), F.col("fabric.value").alias("preferred_fabric"),
        F.coalesce("language.value", F.lit(DEFAULT_LANGUAGE)).alias("preferred_language"),
        F.col("location.value").alias("location"), F.coalesce("stage.value", F.lit(DEFAULT_STAGE)).alias("stage"),
        "total_turns", "last_active", "tags", F.coalesce("notes.value", F.lit("")).alias("notes"))


def fold_customers(events: DataFrame) -> DataFrame:
    """One row per user from profile events.

    Size, language, location and stage keep their last non-empty value, notes the last that is not
    null; fabric is that of the latest event even if null. Turns are counted and tags united.
    """
    return customers_of(fold_records(events))


def merge_customers(records: DataFrame, events: DataFrame) -> DataFrame:
    """Records after a further batch of events, earlier or later ones than those already folded."""
    return merge_records(records.unionByName(fold_records(events)))


def events_from_messages(labelled: DataFrame) -> DataFrame:
    """Profile events of messages that went through ``profile_signals``: user_id, ts, event_id plus
    the signals."""
    return labelled.select("user_id", "ts", "event_id", "size", "fabric", F.col("language_signal").alias("language"),
                           "location", "stage", "tags", F.lit(None).cast("string").alias("notes"))


def events_from_inbox(labelled: DataFrame) -> DataFrame:
    """The same from inbox rows: the sender is the user, the message's id gives the event's."""
    return events_from_messages(labelled.select(
        "*", F.col("sender_id").alias("user_id"), F.col("received_at").alias("ts"), F.xxhash64("message_id").alias("event_id")))


def tag_events(tags: DataFrame) -> DataFrame:
    """Manual tags ``(user_id, ts, event_id, tags, notes)`` as profile events. Through the fold they
    count as a turn and clear the fabric."""
    none = F.lit(None).cast("string")
    return tags.select("user_id", "ts", "event_id", none.alias("size"), none.alias("fabric"), none.alias("language"),
                       none.alias("location"), none.alias("stage"), "tags", "notes")


def list_customers(customers: DataFrame, stage: str | None = None, size: str | None = None,
                   location: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of customers, most recently active first; the language is not part of it."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("need 1 <= limit <= 200 and offset >= 0")
    rows = customers
    if stage:
        rows = rows.filter(F.col("stage") == stage)
    if size:
        rows = rows.filter(F.col("preferred_size") == size.upper())
    if location:
        rows = rows.filter(F.contains(F.lower("location"), F.lit(location.lower())))
    return rows.drop("preferred_language").orderBy(F.col("last_active").desc(), "user_id").offset(offset).limit(limit)


def customer_stats(customers: DataFrame) -> DataFrame:
    """Total, count per stage and count per size as rows ``kind, value, customers``, in one pass."""
    sets = customers.groupingSets([[], ["stage"], ["preferred_size"]], "stage", "preferred_size").agg(
        F.count(F.lit(1)).alias("customers"), F.grouping("stage").alias("_no_stage"),
        F.grouping("preferred_size").alias("_no_size"))
    kind = (F.when((F.col("_no_stage") == 1) & (F.col("_no_size") == 1), "total")
            .when(F.col("_no_stage") == 0, "stage").otherwise("size"))
    return (sets.select(kind.alias("kind"), F.coalesce("stage", "preferred_size").alias("value"), "customers")
            .filter((F.col("kind") != "size") | F.col("value").isNotNull()))


def dossiers(customers: DataFrame, turns: DataFrame, size: int = 10) -> DataFrame:
    """Customers with the last turns of the session named like the user."""
    recent = context_arrays(turns, size).select(F.col("session_id").alias("user_id"),
                                                F.col("turns").alias("recent_turns"))
    return customers.join(recent, "user_id", "left")


def upsert_notes(notes: DataFrame) -> DataFrame:
    """The latest free-text note ``(sender_id, customer_name, profile_notes, ts)`` per customer."""
    return latest_by_key(notes, "sender_id", ["ts", "profile_notes", "customer_name"]).select(
        "sender_id", "customer_name", "profile_notes", F.col("ts").alias("last_interaction"))


def health(turns: DataFrame, customers: DataFrame, index: DataFrame) -> DataFrame:
    """One row: sessions, customers, indexed vectors."""
    zero = F.lit(0).cast("long")
    counts = (
        turns.agg(F.count_distinct("session_id").alias("s")).select("s", zero.alias("c"), zero.alias("v"))
        .unionByName(customers.agg(F.count(F.lit(1)).alias("c")).select(zero.alias("s"), "c", zero.alias("v")))
        .unionByName(index.agg(F.count(F.lit(1)).alias("v")).select(zero.alias("s"), zero.alias("c"), "v")))
    return counts.agg(F.sum("s").alias("active_sessions"), F.sum("c").alias("total_crm_customers"),
                      F.sum("v").alias("indexed_vectors"))
