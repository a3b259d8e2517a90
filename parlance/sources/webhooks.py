"""Nested messaging payloads as flat messages. Works on a table and on a stream of JSON texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import non_empty
from ..schemas import PAYLOAD

# What stands in for the text of a message that is only a recording.
VOICE_PLACEHOLDER = "[Voice Message Attached - Listen to audio_url]"
VOICE_TYPES = ("audio", "voice", "video")
# Payload objects and the platform they mean.
PLATFORMS = (("page", "messenger"), ("instagram", "instagram"))
WHATSAPP_OBJECT = "whatsapp_business_account"
CHANGE_FIELDS = ("messages", "messaging_postbacks")
# What telemetry says of a queued message, by the array that it came in.
QUEUED = {"messaging": "QUEUED_FOR_SPARK", "standby": "STANDBY_QUEUED", "changes": "CHANGES_QUEUED",
          "whatsapp": "WHATSAPP_QUEUED"}


def read_webhook_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of payload files, one JSON text per line: body, received_at (the file's time) and payload_id.

    The id is a hash of the file's path and the line's number, so reading a file again gives the same
    ids. A file is read as a whole; a receiver starts a new one every few megabytes.
    """
    reader = spark.readStream.format("text").option("wholetext", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(path).select(
        F.col("_metadata.file_modification_time").alias("received_at"), F.col("_metadata.file_path").alias("_path"),
        F.posexplode(F.split("value", "\r?\n")).alias("_line", "body"))
    return lines.filter(F.trim("body") != "").select(
        "body", "received_at", F.sha1(F.concat_ws("|", "_path", "_line")).alias("payload_id"))


def with_payload_ids(payloads: DataFrame) -> DataFrame:
    """Payloads with ``payload_id``. Without one, it is a hash of body and time and a number that tells equal ones
    apart, so the same batch always gives the same ids. Not for streams, whose source knows the place."""
    if "payload_id" in payloads.columns:
        return payloads
    if payloads.isStreaming:
        raise ValueError("a stream of payloads needs a column payload_id")
    same = W.partitionBy("body", "received_at").orderBy(F.lit(0))
    return payloads.withColumn("payload_id", F.sha1(F.concat_ws(
        "|", F.coalesce("body", F.lit("")), F.unix_micros("received_at").cast("string"), F.row_number().over(same).cast("string"))))


def _audio_url(attachments: Column) -> Column:
    """The URL of the first recording; null if that one has none."""
    kind = lambda a: F.lower(F.coalesce(a["type"], F.lit("")))
    first = F.get(F.filter(attachments, lambda a: kind(a).rlike("|".join(VOICE_TYPES))), 0)
    return F.coalesce(non_empty(first["payload"]["url"]), non_empty(first["file_url"]))


def _row(sender: Column, text: Column, mid: Column, audio: Column, platform: Column, status: str) -> Column:
    return F.struct(sender.alias("sender_id"), text.alias("message_text"), mid.alias("mid"),
                    audio.alias("audio_url"), platform.alias("platform"), F.lit(status).alias("queue_status"))


def _messages_of(entries: Column, kind: Column) -> Column:
    """All messages of a payload's entries, in order, as one array of rows."""
    none = F.lit(None).cast("string")
    platform = F.coalesce(*[F.when(kind == name, F.lit(p)) for name, p in PLATFORMS], none)

    def messaging(e: Column) -> Column:
        message = e["message"]
        audio = _audio_url(message["attachments"])
        text = F.coalesce(non_empty(message["text"]), F.when(audio.isNotNull(), F.lit(VOICE_PLACEHOLDER)))
        sender = F.when(~F.coalesce(message["is_echo"], F.lit(False)), e["sender"]["id"])
        return _row(sender, text, message["mid"], audio, platform, QUEUED["messaging"])

    def standby(e: Column) -> Column:
        return _row(e["sender"]["id"], non_empty(e["message"]["text"]), e["message"]["mid"], none, platform,
                    QUEUED["standby"])

    def change(c: Column) -> Column:
        value = c["value"]
        party = non_empty(value["from"])
        sender = F.coalesce(non_empty(value["sender"]["id"]), F.get_json_object(party, "$.id"),
                            F.when(~party.startswith("{"), party))
        text = F.coalesce(non_empty(value["message"]["text"]), non_empty(value["text"]),
                          F.get(value["messages"], 0)["text"]["body"])
        mid = F.coalesce(non_empty(value["message"]["mid"]), value["mid"])
        wanted = c["field"].isin(*CHANGE_FIELDS) | c["messages"].isNotNull()
        return _row(F.when(wanted, sender), non_empty(text), mid, none, platform, QUEUED["changes"])

    def listed(m: Column) -> Column:
        return _row(m["from"], non_empty(m["text"]["body"]), none, none, F.lit("whatsapp"), QUEUED["whatsapp"])

    empty = F.filter(F.array(_row(none, none, none, none, none, "")), lambda x: F.lit(False))

    def each(items: Column, make) -> Column:
        return F.coalesce(F.transform(items, make), empty)

    def rows(entry: Column) -> Column:
        direct = F.concat(each(entry["messaging"], messaging), each(entry["standby"], standby),
                          each(entry["changes"], change))
        listed_rows = F.flatten(F.transform(
            F.coalesce(entry["changes"], F.array()), lambda c: each(c["value"]["messages"], listed)))
        return F.when(platform.isNotNull(), direct).when(kind == WHATSAPP_OBJECT, listed_rows).otherwise(empty)

    return F.filter(F.flatten(F.transform(entries, rows)), lambda m: F.coalesce(
        (m["sender_id"] != "") & (m["message_text"] != ""), F.lit(False)))


def flatten_payloads(payloads: DataFrame) -> DataFrame:
    """Flat messages from ``body`` (JSON text), with their ordinal in the payload; other columns are kept.

    Every entry's messaging, standby and changes arrays, or its listed messages, become one array
    of rows that is exploded once, so the payload is parsed and read a single time. Echoes of own
    messages and rows without a sender or without text and recording are left out. Bodies that are
    no JSON give no rows.
    """
    keep = [c for c in payloads.columns if c != "body"]
    parsed = payloads.withColumn("_p", F.from_json("body", PAYLOAD))
    exploded = parsed.select(*keep, F.posexplode(_messages_of(F.col("_p.entry"), F.col("_p.object"))).alias("ordinal", "_m"))
    return exploded.select(*keep, "ordinal", "_m.*")


def telemetry_entries(payloads: DataFrame) -> DataFrame:
    """One row per payload: its object, and status, sender and text of the last message queued from
    it, or the status ``RECEIVED``. Other columns are kept."""
    parsed = payloads.withColumn("_p", F.from_json("body", PAYLOAD))
    found = parsed.withColumn("_m", F.try_element_at(
        _messages_of(F.col("_p.entry"), F.col("_p.object")), F.lit(-1)))
    return found.select(
        *payloads.columns, F.coalesce("_p.object", F.lit("unknown")).alias("object"),
        F.coalesce("_m.queue_status", F.lit("RECEIVED")).alias("status"),
        F.col("_m.sender_id").alias("sender_id"), F.col("_m.message_text").alias("text"))


def simple_messages(bodies: DataFrame, default_session: str = "tester_01") -> DataFrame:
    """The simple form ``{chatInput | message, sessionId, userId}``."""
    def field(name: str) -> Column:
        return non_empty(F.get_json_object("body", f"$.{name}"))

    session = F.coalesce(field("sessionId"), F.lit(default_session))
    return bodies.select(
        session.alias("session_id"), F.coalesce(field("userId"), session).alias("user_id"),
        F.coalesce(field("chatInput"), field("message"), F.lit("")).alias("message_text"))
