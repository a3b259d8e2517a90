"""Registered queries on webhooks, the inbox and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crm, inbox
from ..session import work_dir
from ..sources import vector_table, webhooks
from ..streaming import crm_changes, jobs, seen, working
from . import inputs as I, pipelines
from .conversations import _CUSTOMER_COLUMNS, _LIFECYCLE_SQL, _SESSIONS_SQL, _session_rows, customer_rows
from .registry import query

_FLAT_SQL = """flat AS (
  SELECT event_id, ts AS received_at, CAST(user_id AS VARCHAR) AS sender_id,
    CASE WHEN event_type = 'view' AND value < 20 THEN '[Voice Message Attached - Listen to audio_url]'
         ELSE event_type || ' ' || props END AS message_text,
    CASE WHEN event_type <> 'error' THEN 'mid.' || event_id END AS mid,
    CASE WHEN event_type = 'view' THEN 'https://cdn.example/' || event_id END AS audio_url,
    CASE event_type WHEN 'click' THEN 'messenger' WHEN 'signup' THEN 'messenger' WHEN 'error' THEN 'whatsapp' ELSE 'instagram' END AS platform,
    CASE event_type WHEN 'signup' THEN 'STANDBY_QUEUED' WHEN 'purchase' THEN 'CHANGES_QUEUED'
      WHEN 'error' THEN 'WHATSAPP_QUEUED' ELSE 'QUEUED_FOR_SPARK' END AS queue_status
  FROM events WHERE NOT (event_type IN ('click', 'view') AND value < 5))"""


@query("webhook_flatten", f"WITH {_FLAT_SQL} SELECT event_id, sender_id, message_text, mid, audio_url, platform, queue_status FROM flat")
def webhook_flatten(spark, sf_dir):
    return webhooks.flatten_payloads(I.payloads(spark, sf_dir)).drop("received_at", "ordinal")


@query("simple_messages", """SELECT CAST(user_id AS VARCHAR) AS session_id,
  CASE WHEN event_type = 'click' THEN 'c' || user_id ELSE CAST(user_id AS VARCHAR) END AS user_id, props AS message_text FROM events""")
def simple_messages(spark, sf_dir):
    user, click = F.col("user_id").cast("string"), F.col("event_type") == "click"
    body = F.to_json(F.struct(
        user.alias("sessionId"), F.when(click, F.concat(F.lit("c"), user)).alias("userId"),
        F.when(click, F.col("props")).alias("chatInput"), F.when(~click, F.col("props")).alias("message")))
    return webhooks.simple_messages(I.table(spark, sf_dir, "events").select(body.alias("body")))


_DEDUP_SQL = """dedup AS (
  SELECT * FROM messages WHERE mid IS NULL
  UNION ALL SELECT * FROM (SELECT * FROM messages WHERE mid IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY mid ORDER BY received_at, message_id) = 1))"""


@query("inbound_messages", f"""WITH {_FLAT_SQL}
SELECT sender_id AS user_id, count(*) AS total_turns, epoch_us(max(received_at)) AS last_active,
  CASE WHEN bool_or(contains(message_text, 'purchase')) THEN 'Ready to Order' ELSE 'New Lead' END AS stage
FROM flat GROUP BY 1""")
def inbound_messages(spark, sf_dir):
    """Payloads to inbox rows to customer records, with the default word lists."""
    _, events = pipelines.process_inbound(I.payloads(spark, sf_dir))
    return crm.fold_customers(events).select("user_id", "total_turns", F.unix_micros("last_active").alias("last_active"), "stage")


def _repeated_payloads(spark, sf_dir):
    """Payloads of a channel without message ids: every user's events say the same, twice each, at one time."""
    e = I.table(spark, sf_dir, "events")
    said = F.struct(F.col("user_id").cast("string").alias("from"), F.struct(F.lit("ok").alias("body")).alias("text"))
    value = F.struct(F.struct(F.array(said, said).alias("messages")).alias("value"))
    body = F.struct(F.lit("whatsapp_business_account").alias("object"), F.array(F.struct(F.array(value).alias("changes"))).alias("entry"))
    return e.select(F.to_json(body).alias("body"), F.lit("2024-01-01").cast("timestamp").alias("received_at"))


_REPEATED_SQL = """SELECT CAST(user_id AS VARCHAR) AS sender_id, 2 * count(*) AS messages, 2 * count(*) AS ids FROM events GROUP BY 1"""


def _counted(queued):
    return queued.groupBy("sender_id").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("message_id").alias("ids"))


@query("inbound_repeated", _REPEATED_SQL)
def inbound_repeated(spark, sf_dir):
    """Equal texts without an id are messages of their own."""
    queued, _ = pipelines.process_inbound(_repeated_payloads(spark, sf_dir))
    return _counted(queued)


@query("stream_inbound_repeated", _REPEATED_SQL)
def stream_inbound_repeated(spark, sf_dir):
    """The same from payload files, several micro-batches, every file with one time."""
    path = work_dir(spark, "repeated")
    payloads = _repeated_payloads(spark, sf_dir).select(F.col("body").alias("value"))
    # A file is read as a whole, so files stay at a few megabytes however many payloads there are.
    payloads.repartition(3 * spark.sparkContext.defaultParallelism).write.option("maxRecordsPerFile", PAYLOADS_A_FILE).text(path)
    some = _third(spark.read.text(path))
    return _counted(_drained(spark, jobs.inbox_stream(webhooks.read_webhook_stream(spark, path, some)), "repeated-inbox"))


@query("stream_inbound", f"""WITH {_FLAT_SQL}
SELECT sender_id AS user_id, count(*) AS total_turns, epoch_us(max(received_at)) AS last_active,
  CASE WHEN bool_or(contains(message_text, 'purchase')) THEN 'Ready to Order' ELSE 'New Lead' END AS stage
FROM flat GROUP BY 1""")
def stream_inbound(spark, sf_dir):
    """Payloads as they arrive, over several micro-batches, to customer records."""
    base = work_dir(spark, "inbound")
    payloads = _as_files(spark, I.payloads(spark, sf_dir).withColumn("payload_id", F.col("event_id").cast("string")).drop("event_id"), "inbound-payloads")
    jobs.inbound_customers_into(payloads, f"{base}/out", f"{base}/checkpoint", "60 days").awaitTermination()
    return jobs.read_customers(spark, f"{base}/out").select(
        "user_id", "total_turns", F.unix_micros("last_active").alias("last_active"), "stage")


@query("inbox_dedup", f"WITH {I.SQL_MESSAGES}, {_DEDUP_SQL} SELECT message_id, mid FROM dedup")
def inbox_dedup(spark, sf_dir):
    return inbox.dedup_messages(I.event_messages(spark, sf_dir)).select("message_id", "mid")


@query("inbox_dedup_seen", f"""WITH {I.SQL_MESSAGES}, {_DEDUP_SQL}
SELECT message_id, mid FROM dedup WHERE mid IS NULL OR mid NOT IN (SELECT user_id || '/' || props FROM events WHERE event_type = 'click')""")
def inbox_dedup_seen(spark, sf_dir):
    """Ids of earlier clicks count as seen before."""
    messages = I.event_messages(spark, sf_dir)
    seen = messages.filter(F.col("audio_url").isNotNull()).select("mid")
    return inbox.dedup_messages(messages, seen).select("message_id", "mid")


@query("inbox_enqueue", f"""WITH {I.SQL_MESSAGES}
SELECT 'fb_' || sha1(message_id) AS message_id,
  mid, sender_id, 'Facebook User' AS sender_name, coalesce(platform, 'messenger') AS platform, message_text, audio_url,
  'pending' AS status, epoch_us(received_at) AS received_at FROM messages""")
def inbox_enqueue(spark, sf_dir):
    return inbox.enqueue(I.event_messages(spark, sf_dir)).withColumn("received_at", F.unix_micros("received_at"))


def _answered(spark, sf_dir):
    return inbox.mark_replied(I.inbox(spark, sf_dir), I.replies(spark, sf_dir))


@query("inbox_replied", f"""WITH {I.SQL_MESSAGES}, {I.SQL_REPLIES}
SELECT message_id, CASE WHEN replied_at IS NULL THEN 'pending' ELSE 'replied' END AS status, reply AS ai_reply,
  coalesce(epoch_us(replied_at), 0) AS replied_at FROM messages LEFT JOIN replies USING (message_id)""")
def inbox_replied(spark, sf_dir):
    return _answered(spark, sf_dir).select(
        "message_id", "status", "ai_reply", F.coalesce(F.unix_micros("replied_at"), F.lit(0)).alias("replied_at"))


@query("inbox_pending", f"""WITH {I.SQL_MESSAGES}, {I.SQL_REPLIES}
SELECT message_id, sender_id, coalesce(platform, 'messenger') AS platform, message_text, audio_url IS NOT NULL AS is_voice_message
FROM messages WHERE message_id NOT IN (SELECT message_id FROM replies)""")
def inbox_pending(spark, sf_dir):
    return inbox.pending_messages(_answered(spark, sf_dir), None).select(
        "message_id", "sender_id", "platform", "message_text", "is_voice_message")


@query("inbox_pending_page", f"""WITH {I.SQL_MESSAGES}, {I.SQL_REPLIES}
SELECT message_id, message_text FROM messages WHERE message_id NOT IN (SELECT message_id FROM replies)
ORDER BY received_at, message_id LIMIT 10""")
def inbox_pending_page(spark, sf_dir):
    return inbox.pending_messages(_answered(spark, sf_dir)).select("message_id", "message_text")


@query("inbox_reply_lookup", f"WITH {I.SQL_MESSAGES}, {I.SQL_REPLIES} SELECT message_id, reply AS ai_reply FROM messages JOIN replies USING (message_id)")
def inbox_reply_lookup(spark, sf_dir):
    return inbox.message_replies(_answered(spark, sf_dir))


@query("telemetry_ring", "SELECT event_id, event_type, epoch_us(ts) AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def telemetry_ring(spark, sf_dir):
    events = I.table(spark, sf_dir, "events").withColumnRenamed("ts", "received_at")
    return inbox.telemetry(events).select("event_id", "event_type", F.unix_micros("received_at").alias("at"))


@query("telemetry_entries", f"""WITH {_FLAT_SQL}
SELECT e.event_id, CASE event_type WHEN 'click' THEN 'page' WHEN 'signup' THEN 'page' WHEN 'error' THEN 'whatsapp_business_account' ELSE 'instagram' END AS object,
  coalesce(queue_status, 'RECEIVED') AS status, sender_id, message_text AS text FROM events e LEFT JOIN flat f USING (event_id)""")
def telemetry_entries(spark, sf_dir):
    """What the webhook log says of every payload."""
    return webhooks.telemetry_entries(I.payloads(spark, sf_dir)).select("event_id", "object", "status", "sender_id", "text")


@query("latest_per_thread", """WITH newest AS (
  SELECT *, user_id || '/' || event_type AS thread_id FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT thread_id, CAST(event_id AS VARCHAR) AS message_id FROM newest WHERE user_id <> 7 AND value <= 30""")
def latest_per_thread(spark, sf_dir):
    """Threads are a user's events of one type; user 7 is our own account, costly events were seen."""
    e = I.table(spark, sf_dir, "events")
    message_id = F.col("event_id").cast("string").alias("message_id")
    messages = e.select(F.concat("user_id", F.lit("/"), "event_type").alias("thread_id"), message_id,
                        F.col("user_id").cast("string").alias("sender_id"), F.col("props").alias("message_text"),
                        F.col("ts").alias("received_at"))
    seen = e.filter(F.col("value") > 30).select(message_id)
    return inbox.latest_per_thread(messages, "7", seen).select("thread_id", "message_id")


@query("notifications", """SELECT CAST(doc_id AS VARCHAR) AS sender_id, 'new_message' AS type, md5(substr(text, 1, 200)) AS text_md5, lang AS platform
FROM documents""")
def notifications(spark, sf_dir):
    """Notification texts, read back from their JSON."""
    messages = I.table(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").cast("string").alias("sender_id"), F.col("text").alias("message_text"), F.col("lang").alias("platform"))
    parsed = inbox.notifications(messages).select(
        F.from_json("value", "type string, sender_id string, text string, platform string").alias("n")).select("n.*")
    return parsed.withColumn("text_md5", F.md5("text")).drop("text")


# An hour is long enough here for batches of several messages.
_HOUR = 3600
_ANCHOR_SQL = """RECURSIVE ordered AS (
  SELECT *, epoch_us(received_at) AS t, row_number() OVER (PARTITION BY sender_id ORDER BY received_at, message_id) AS rn FROM messages),
walk AS (
  SELECT sender_id, rn, t, t AS anchor FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.sender_id, o.rn, o.t, CASE WHEN o.t >= w.anchor + 3600000000 THEN o.t ELSE w.anchor END
  FROM walk w JOIN ordered o ON o.sender_id = w.sender_id AND o.rn = w.rn + 1),
batches AS (
  SELECT w.sender_id, anchor, string_agg(message_text, ', ' ORDER BY o.rn) AS flattened_message,
         string_agg(message_id, ', ' ORDER BY o.rn) AS ids, CAST(count(*) AS INTEGER) AS message_count
  FROM walk w JOIN ordered o USING (sender_id, rn) GROUP BY 1, 2)"""


def _batch_rows(batches):
    return batches.select("sender_id", F.unix_micros("window_start").alias("window_start"), "flattened_message", "ids", "message_count")


_ANCHORED = f"WITH {_ANCHOR_SQL.replace('RECURSIVE ', 'RECURSIVE ' + I.SQL_MESSAGES + ', ', 1)}"


@query("anchored_batches", f"""{_ANCHORED}
SELECT sender_id, anchor AS window_start, flattened_message, ids, message_count FROM batches""")
def anchored_batches(spark, sf_dir):
    return _batch_rows(inbox.anchored_batches(I.event_messages(spark, sf_dir), _HOUR))


@query("anchored_batches_split", f"""{_ANCHORED}
SELECT sender_id, anchor AS window_start, flattened_message, ids, message_count FROM batches""")
def anchored_batches_split(spark, sf_dir):
    """The same with every busy sender cut into time slots."""
    return _batch_rows(inbox.anchored_batches(I.event_messages(spark, sf_dir), _HOUR, max_rows=60))


# -- streams, run until what is there has been read ------------------------------------------------

def _event_stream(spark, sf_dir):
    return spark.readStream.schema(I.EVENTS).parquet(f"{sf_dir}/events*.parquet")


PAYLOADS_A_FILE = 20_000


def _third(files):
    """How many of a table's files are a third of them."""
    return max(1, -(-len(files.inputFiles()) // 3))


def _as_files(spark, df, label):
    """The rows as a stream of files in no order of time, a third of them in each micro-batch. All cores write and read."""
    path = work_dir(spark, label)
    df.repartition(3 * spark.sparkContext.defaultParallelism).write.parquet(path)
    some = _third(spark.read.schema(df.schema).parquet(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", some).parquet(path)


def _in_steps(df, time, path, start, steps=3):
    """The rows arrive under ``path`` in steps of their time; the stream that ``start`` makes runs after each from where it stopped."""
    ends = df.agg(F.min(F.unix_micros(time)).alias("lo"), F.max(F.unix_micros(time)).alias("hi")).first()
    step = F.floor((F.unix_micros(time) - ends["lo"]) * steps / (ends["hi"] - ends["lo"] + 1))
    for i in range(steps):
        df.filter(step == i).write.mode("append").parquet(path)
        start(df.sparkSession.readStream.schema(df.schema).parquet(path)).awaitTermination()


def _drained_in_steps(spark, df, stream, label, steps=3):
    """All that a stream gives of rows that arrive in steps of ``ts``."""
    base = work_dir(spark, label)
    _in_steps(df, "ts", f"{base}/in", lambda arrived: jobs.append_to(stream(arrived), f"{base}/out", f"{base}/checkpoint"), steps)
    return spark.read.schema(stream(spark.readStream.schema(df.schema).parquet(f"{base}/in")).schema).parquet(f"{base}/out")


def _drained(spark, df, label):
    """Appends all that a stream gives to files and reads them back."""
    base = work_dir(spark, label)
    jobs.append_to(df, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def _turn_stream(spark, sf_dir):
    return _event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("session_id"), "ts")


@query("stream_sessions", f"""WITH {I.SQL_EVENT_TURNS}, stretches AS (
  WITH {_SESSIONS_SQL})
SELECT * FROM stretches WHERE ended_at + 10800000000 <= (SELECT epoch_ms(max(ts)) - 600000 FROM events) * 1000""")
def stream_sessions(spark, sf_dir):
    """Stretches that have ended by the watermark, ten minutes before the last event."""
    return _session_rows(_drained(spark, jobs.session_stream(_turn_stream(spark, sf_dir)), "sessions"))


@query("stream_lifecycle", f"""WITH {I.SQL_EVENT_TURNS}, labelled AS (
  WITH {_LIFECYCLE_SQL})
SELECT l.* FROM labelled l JOIN turns t USING (turn_id)
WHERE epoch_us(t.ts) <= (SELECT epoch_ms(max(ts)) - 60000 FROM events) * 1000""")
def stream_lifecycle(spark, sf_dir):
    """Turns up to the watermark, a minute before the last event."""
    turns = I.event_turns_of(_event_stream(spark, sf_dir))
    return _drained(spark, jobs.lifecycle_stream(turns), "lifecycle").drop("ts")


_MEMORY_SQL = f"""WITH {I.SQL_EVENT_TURNS}, gaps AS (
  SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER s) > 86400000000, true) AS starts_anew FROM turns WINDOW s AS (PARTITION BY session_id ORDER BY ts, turn_id)),
stretches AS (
  SELECT *, sum(CAST(starts_anew AS INTEGER)) OVER (PARTITION BY session_id ORDER BY ts, turn_id ROWS UNBOUNDED PRECEDING) AS stretch FROM gaps),
memory AS (
  SELECT *, list(turn_id) OVER (PARTITION BY session_id, stretch ORDER BY ts, turn_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS remembered FROM stretches)
SELECT session_id, turn_id, len(remembered) AS window_size, array_to_string(remembered, ' ') AS remembered, starts_anew FROM memory"""


def _memory_rows(df):
    return df.select("session_id", "turn_id", "window_size", F.array_join("remembered", " ").alias("remembered"), "starts_anew")


@query("working_memory", _MEMORY_SQL)
def working_memory(spark, sf_dir):
    """What every turn's session remembers at that turn: ten turns at most, none from before a pause of more than a day."""
    return _memory_rows(working.working_memory(I.event_turns(spark, sf_dir)))


@query("stream_working_memory", f"""{_MEMORY_SQL}
WHERE epoch_us(ts) <= (SELECT epoch_ms(max(ts)) - 60000 FROM events) * 1000""")
def stream_working_memory(spark, sf_dir):
    """The same as a stream of several batches, for turns up to the watermark, a minute before the last event."""
    turns = I.event_turns(spark, sf_dir).select("session_id", "turn_id", "ts")
    return _memory_rows(_drained_in_steps(spark, turns, working.working_memory_stream, "working-memory"))


@query("stream_dedup", f"WITH {I.SQL_MESSAGES} SELECT DISTINCT coalesce(mid, message_id) AS id FROM messages")
def stream_dedup(spark, sf_dir):
    """Platform ids that a stream with a long delay lets through, each once."""
    messages = _event_stream(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("message_id"), F.col("ts").alias("received_at"),
        F.when(F.col("event_type") != "error", F.concat("user_id", F.lit("/"), "props")).alias("mid"))
    kept = jobs.dedup_stream(messages, "60 days")
    return _drained(spark, kept, "dedup").select(F.coalesce("mid", "message_id").alias("id"))


@query("stream_dedup_seen", f"WITH {I.SQL_MESSAGES}, {_DEDUP_SQL} SELECT message_id, mid FROM dedup")
def stream_dedup_seen(spark, sf_dir):
    """Messages that arrive in several batches, in order of time; ids are remembered for good, without a watermark."""
    base = work_dir(spark, "dedup-seen")
    messages = I.event_messages(spark, sf_dir)
    _in_steps(messages, "received_at", f"{base}/in", lambda arrived: seen.dedup_into(arrived, f"{base}/out", f"{base}/checkpoint"))
    return seen.read_messages(spark, f"{base}/out").select("message_id", "mid")


@query("stream_anchored_batches", f"""{_ANCHORED}
SELECT sender_id, anchor AS window_start, flattened_message, ids, message_count FROM batches
WHERE anchor + 3600000000 <= (SELECT epoch_ms(max(ts)) - 60000 FROM events) * 1000""")
def stream_anchored_batches(spark, sf_dir):
    """Batches that have ended by the watermark, a minute before the last event."""
    messages = _event_stream(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("sender_id"), F.col("event_id").cast("string").alias("message_id"),
        F.concat("event_type", F.lit(" "), "props").alias("message_text"), F.col("ts").alias("received_at"))
    return _batch_rows(_drained(spark, jobs.anchored_batch_stream(messages, _HOUR), "anchored"))


@query("stream_replies", f"""WITH {I.SQL_MESSAGES}, {I.SQL_REPLIES}
SELECT message_id, CASE WHEN replied_at IS NULL THEN 'pending' ELSE 'replied' END AS status, coalesce(reply, '') AS ai_reply
FROM messages LEFT JOIN replies USING (message_id)
WHERE replied_at IS NOT NULL OR epoch_us(received_at) + 86400000000 <= (
  SELECT least(epoch_ms(max(received_at)), (SELECT epoch_ms(max(replied_at)) FROM replies)) - 600000 FROM messages) * 1000""")
def stream_replies(spark, sf_dir):
    """Messages joined with the replies of a day; those without one are given out when that day has
    passed on the slower of the two streams."""
    messages = _event_stream(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("message_id"), F.col("user_id").cast("string").alias("sender_id"),
        F.col("props").alias("message_text"), F.col("ts").alias("received_at"))
    replies = I.replies_of(_event_stream(spark, sf_dir))
    return _drained(spark, jobs.reply_stream(messages, replies), "replies").select(
        "message_id", "status", F.coalesce("ai_reply", F.lit("")).alias("ai_reply"))


@query("stream_crm", f"WITH {I.SQL_CUSTOMERS} SELECT {_CUSTOMER_COLUMNS} FROM customers")
def stream_crm(spark, sf_dir):
    """Customer records kept up to date by micro-batches that are not in the order of time."""
    base = work_dir(spark, "crm")
    events = _as_files(spark, I.profile_events(spark, sf_dir), "crm-events")
    jobs.fold_customers_into(events, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return customer_rows(jobs.read_customers(spark, f"{base}/out"))


@query("stream_crm_stats", f"""WITH {I.SQL_CUSTOMERS}
SELECT 'total' AS kind, NULL AS value, count(*) AS customers FROM customers
UNION ALL SELECT 'stage', stage, count(*) FROM customers GROUP BY 2
UNION ALL SELECT 'size', preferred_size, count(*) FROM customers WHERE preferred_size IS NOT NULL GROUP BY 2""")
def stream_crm_stats(spark, sf_dir):
    """Customer statistics as sums of signed changes, from batches that are not in the order of time."""
    base = work_dir(spark, "crm-stats")
    events = _as_files(spark, I.profile_events(spark, sf_dir), "crm-stats-events")
    crm_changes.stats_into(events, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return crm_changes.read_stats(spark, f"{base}/out")


@query("stream_inbox", f"""WITH {_FLAT_SQL}
SELECT sender_id, message_text, mid, platform, audio_url, 'pending' AS status FROM flat""")
def stream_inbox(spark, sf_dir):
    """Payloads written as files, read as a stream, flattened, deduplicated and queued."""
    payloads = _as_files(spark, I.payloads(spark, sf_dir).withColumn("payload_id", F.col("event_id").cast("string")).drop("event_id"), "payloads")
    queued = jobs.inbox_stream(payloads, "60 days")
    return _drained(spark, queued, "inbox").select("sender_id", "message_text", "mid", "platform", "audio_url", "status")


@query("stream_index", f"WITH {I.SQL_CHUNKS} SELECT chunk_id, md5(content) AS content_md5 FROM chunks")
def stream_index(spark, sf_dir):
    """Documents read as a stream into the index."""
    base = work_dir(spark, "stream-index")
    docs = spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").parquet(
        f"{sf_dir}/documents*.parquet").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("Document "), "doc_id").alias("doc_title"),
        F.col("source").alias("source_uri"), F.col("text").alias("raw_text"))
    jobs.index_documents_into(docs, f"{base}/index", f"{base}/checkpoint").awaitTermination()
    return vector_table.read_index(spark, f"{base}/index").select("chunk_id", F.md5("content").alias("content_md5"))
