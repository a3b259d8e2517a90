"""Conversation memory: turn log, windows, session lifecycle, user profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import lexicons as L
from ..functions.ordered import MAX_ROWS, keyed, with_history, with_running
from ..functions.text import space_words

SESSION_TIMEOUT = 10_800
WINDOW_TURNS = 10
HISTORY_TURNS = 20


def user_turns(turns: DataFrame) -> DataFrame:
    """The scan that feeds consolidation: user turns, five columns."""
    return turns.filter(F.col("role") == "user").select("turn_id", "session_id", "user_id", "role", "content")


def latest_by_key(rows: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``. Each task keeps one row per key before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    newest = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") == 1).drop("_r")


def upsert_turns(log: DataFrame, new: DataFrame) -> DataFrame:
    """The turn log after new turns; a turn id that comes again replaces the older row.

    Ties go to the new turns, then by whatever other columns the log has, so that the result does not depend on row order.
    """
    both = log.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = sorted(c for c in log.columns if c not in ("turn_id", "ts"))
    return latest_by_key(both, "turn_id", ["ts", "_new", *rest]).drop("_new")


def session_history(turns: DataFrame, limit: int = HISTORY_TURNS) -> DataFrame:
    """The first ``limit`` turns of every session in time order, with their position."""
    order = W.partitionBy("session_id").orderBy("ts", "turn_id")
    return turns.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def context_window(turns: DataFrame, size: int = WINDOW_TURNS) -> DataFrame:
    """The last ``size`` turns of every session, with ``from_end`` counting back from 1."""
    newest = W.partitionBy("session_id").orderBy(F.col("ts").desc(), F.col("turn_id").desc())
    return turns.withColumn("from_end", F.row_number().over(newest)).filter(F.col("from_end") <= size)


def context_arrays(turns: DataFrame, size: int = WINDOW_TURNS, columns: tuple[str, ...] = ("role", "content"),
                   ) -> DataFrame:
    """``session_id, turns``: the context window as one array per session, oldest first. At most
    ``size`` turns of a session reach the collecting task."""
    window = context_window(turns, size)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("from_end")).alias("o"), F.struct(*columns).alias("t"))))
    return window.groupBy("session_id").agg(ordered.alias("_t")).select("session_id", F.col("_t.t").alias("turns"))


def turns_per_user(turns: DataFrame) -> DataFrame:
    return turns.groupBy("user_id").agg(F.count(F.lit(1)).alias("turns"))


def last_turn_times(turns: DataFrame, by: str = "session_id") -> DataFrame:
    return turns.groupBy(by).agg(F.max("ts").alias("last_turn_at"))


def session_lifecycle(turns: DataFrame, timeout_seconds: float = SESSION_TIMEOUT,
                      max_rows: int = MAX_ROWS) -> DataFrame:
    """Lifecycle of every user turn.

    ``first_contact`` without an earlier turn in the session, ``returning_session`` if more than
    the timeout passed since the last turn of either role, else ``active_ongoing``. ``turn_count``
    counts the user turns since the last start; ``idle_seconds`` is cut to whole seconds.
    """
    order = ["ts", "turn_id"]
    seen = with_history(keyed(turns, ["session_id"], order, max_rows), order, 1, F.col("ts"), "_before")
    idle = F.unix_micros("ts") - F.unix_micros(F.get("_before", 0))
    state = (F.when(F.size("_before") == 0, "first_contact")
             .when(idle > int(timeout_seconds * 1_000_000), "returning_session")
             .otherwise("active_ongoing"))
    first = F.col("is_first_turn_of_session")
    marked = seen.select(
        seen.df.filter(F.col("role") == "user").withColumn("lifecycle_state", state)
        .withColumn("is_first_turn_of_session", F.col("lifecycle_state") != "active_ongoing")
        .withColumn("idle_seconds", F.coalesce(F.floor(idle / 1_000_000), F.lit(0)).cast("long")))
    counted = with_running(marked, order, {"_row": ("sum", F.lit(1).cast("long")),
                                           "session_no": ("sum", first.cast("long"))})
    placed = with_running(counted, order, {"_start": ("max", F.when(first, F.col("_row")))}).rows()
    # Without a start there was an earlier turn of the other side only; counting begins at the first row.
    return (placed.withColumn("turn_count", F.col("_row") - F.coalesce("_start", F.lit(1)) + 1)
            .drop("_before", "_row", "_start"))


def sessions(turns: DataFrame, timeout_seconds: int = SESSION_TIMEOUT) -> DataFrame:
    """One row per session stretch without a longer pause than the timeout: start, end, turns.

    Works on a table or on a stream with a watermark. A pause of exactly the timeout does not end
    a stretch. With ``spark.sql.sessionWindow.merge.sessions.in.local.partition``, which ``get_session`` sets,
    tasks merge their own sessions before the shuffle, so a hot session id sends only a few rows.
    """
    gap = F.session_window("ts", f"{timeout_seconds} seconds")
    return turns.groupBy("session_id", gap.alias("w")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("turns"),
    ).select("session_id", "started_at", "ended_at", "turns")


def active_sessions(turns: DataFrame, since: Column | None = None) -> DataFrame:
    """The number of sessions with a turn at or after ``since`` (all sessions without it)."""
    live = turns if since is None else turns.filter(F.col("ts") >= since)
    return live.agg(F.count_distinct("session_id").alias("active_sessions"))


def consolidate_profiles(turns: DataFrame, topics: int = 5) -> DataFrame:
    """Per user: messages, the most frequent words and a summary sentence.

    Words are white-space separated and lower-cased; those in the stop list after stripping
    punctuation go, as do those of three characters or fewer before stripping. Ties go to the word
    that came first. Counted per (user, word) before anything is gathered.
    """
    said = turns.filter(F.col("role") == "user")
    words = said.select("user_id", "ts", F.posexplode(space_words(F.lower("content"))).alias("pos", "raw"))
    bare = F.btrim("raw", F.lit(L.TOPIC_STRIP))
    kept = words.withColumn("word", bare).filter((F.length("raw") > 3) & ~F.col("word").isin(*L.TOPIC_STOPWORDS))
    # Time and place of a word as one number, which a hash aggregate can keep the minimum of.
    place = F.unix_micros("ts").cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)") + F.col("pos")
    counts = kept.groupBy("user_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    order = W.partitionBy("user_id").orderBy(F.col("n").desc(), "first", "word")
    top = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= topics)
    ranked = top.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("r", "word"))).alias("_t")).select(
        "user_id", F.col("_t.word").alias("key_topics"))
    totals = said.groupBy("user_id").agg(F.count(F.lit(1)).alias("messages"))
    joined = totals.join(ranked, "user_id", "left").withColumn(
        "key_topics", F.coalesce("key_topics", F.array().cast("array<string>")))
    focus = F.when(F.size("key_topics") > 0, F.array_join("key_topics", ", ")).otherwise(L.TOPIC_FALLBACK)
    return joined.select(
        "user_id", "messages", "key_topics",
        F.concat(F.lit("User has engaged in "), "messages", F.lit(" interaction turns. Frequent focus areas: "),
                 focus, F.lit(".")).alias("profile_summary"))


def upsert_profiles(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Profiles after a consolidation run. Users in ``new`` get its summary and topics and one more
    interaction; the others stay as they are. ``interaction_count`` counts runs, not messages."""
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    fresh = F.col("n._new").isNotNull()

    def pick(column: str) -> Column:
        return F.when(fresh, F.col(f"n.{column}")).otherwise(F.col(f"o.{column}")).alias(column)

    return o.join(n, F.col("o.user_id") == F.col("n.user_id"), "full_outer").select(
        F.coalesce("n.user_id", "o.user_id").alias("user_id"),
        pick("profile_summary"), pick("key_topics"),
        (F.coalesce("o.interaction_count", F.lit(0)) + fresh.cast("int")).alias("interaction_count"),
        F.when(fresh, now).otherwise(F.col("o.last_updated")).alias("last_updated"))


def memory_view(turns: DataFrame, profiles: DataFrame, size: int = WINDOW_TURNS) -> DataFrame:
    """Every session with its context window and the profile of its (latest) user."""
    owners = turns.groupBy("session_id").agg(F.max_by("user_id", F.struct("ts", "turn_id")).alias("user_id"))
    return (owners.join(context_arrays(turns, size), "session_id")
            .join(profiles, "user_id", "left"))


def clear_sessions(turns: DataFrame, cleared: DataFrame) -> DataFrame:
    """The working set without the listed sessions."""
    return turns.join(cleared.select("session_id"), "session_id", "left_anti")
