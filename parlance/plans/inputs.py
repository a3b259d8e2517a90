"""The operators' inputs as derived from the given tables, in Spark and in checking SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import prep

EPOCH = 1_704_067_200  # 2024-01-01
# The events' times are stored without a zone; read as UTC instants.
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def table(spark: SparkSession, sf_dir: str, name: str, spread_by: str | None = None) -> DataFrame:
    """A given table. ``spread_by`` deals its rows out when the files split into fewer tasks than
    there are cores: a file of one row group is one task, and text work is all on the CPU."""
    reader = spark.read.schema(EVENTS) if name == "events" else spark.read
    df = reader.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread_by and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, spread_by)
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents", "doc_id").select(
        doc_id.alias("doc_id"), F.concat(F.lit("Document "), doc_id).alias("doc_title"),
        F.col("source").alias("source_uri"), F.col("text").alias("raw_text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.chunk_documents(documents(spark, sf_dir))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.documents_to_points(documents(spark, sf_dir))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as turns: two conversations per user, pauses that grow with the turn."""
    t = table(spark, sf_dir, "conversations", "conv_id")
    session = F.col("conv_id").cast("string")
    return t.select(
        F.concat(session, F.lit("-"), F.col("turn")).alias("turn_id"), session.alias("session_id"),
        F.concat(F.lit("u"), F.floor(F.col("conv_id") / 2)).alias("user_id"), "role",
        F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("conv_id") * 86400 + F.col("turn") * F.col("turn") * 2000).alias("ts"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user turn of every session."""
    last = turns(spark, sf_dir).filter(F.col("role") == "user").groupBy("session_id").agg(
        F.max_by(F.struct("user_id", "content"), F.struct("ts", "turn_id")).alias("q"))
    return last.select(F.col("session_id").alias("query_id"), "session_id", F.col("q.user_id").alias("user_id"),
                       F.col("q.content").alias("query"))


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a timed turn log: one session per user, errors count as the other side's turns."""
    return event_turns_of(table(spark, sf_dir, "events"))


def event_turns_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").cast("string").alias("turn_id"), F.col("user_id").cast("string").alias("session_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(F.col("event_type") == "error", "assistant").otherwise("user").alias("role"),
        F.col("event_type").alias("content"), "ts")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as inbox messages. Events of one user with the same properties are taken as one
    message delivered several times; errors carry no platform id."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    return e.select(
        F.col("event_id").cast("string").alias("message_id"),
        F.when(F.col("event_type") != "error", F.concat(user, F.lit("/"), "props")).alias("mid"),
        user.alias("sender_id"), F.lit(None).cast("string").alias("sender_name"),
        F.when(F.col("event_type") == "view", "instagram").alias("platform"),
        F.concat("event_type", F.lit(" "), "props").alias("message_text"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("https://cdn.example/"), "event_id")).alias("audio_url"),
        F.col("ts").alias("received_at"))


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as pending inbox rows under their own ids."""
    return event_messages(spark, sf_dir).withColumn("status", F.lit("pending")).withColumn(
        "sender_name", F.lit("Customer")).withColumn("platform", F.coalesce("platform", F.lit("messenger")))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply, two minutes later, for every message worth more than ten."""
    return replies_of(table(spark, sf_dir, "events"))


def replies_of(events: DataFrame) -> DataFrame:
    return events.filter(F.col("value") > 10).select(
        F.col("event_id").cast("string").alias("message_id"),
        F.concat(F.lit("re: "), "event_type").alias("reply"),
        (F.col("ts") + F.expr("INTERVAL 2 MINUTES")).alias("replied_at"))


def profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as profile events: the type says what the event is about, props.k gives values."""
    return profile_events_of(table(spark, sf_dir, "events"))


def profile_events_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")

    def only(when: Column, value: Column) -> Column:
        return F.when(when, value)

    return events.select(
        F.col("user_id").cast("string").alias("user_id"), "ts", "event_id",
        only(kind == "view", F.when(k < 30, "S").when(k < 60, "M").otherwise("L")).alias("size"),
        only(kind == "click", F.concat(F.lit("fabric"), F.floor(k / 10))).alias("fabric"),
        only((kind == "signup") & (k > 80), F.lit("hinglish")).alias("language"),
        only((kind == "click") & (k > 50), F.concat(F.lit("Town "), F.floor(k / 10))).alias("location"),
        F.when(kind == "purchase", "Ready to Order").when(kind == "error", "Support")
        .when((kind == "view") & (k > 70), "Browsing").alias("stage"),
        F.when(kind != "error", F.array(kind, F.concat(F.lit("k:"), F.floor(k / 25)))).alias("tags"),
        only((kind == "error") & (k < 20), F.concat(F.lit("note "), k)).alias("notes"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a nested messaging payload; its type picks the array that it travels in."""
    e = table(spark, sf_dir, "events", "event_id")
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    text = F.concat("event_type", F.lit(" "), "props")
    mid = F.concat(F.lit("mid."), F.col("event_id"))
    sender = F.struct(user.alias("id"))
    recording = F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("file_url")),
                        F.struct(F.lit("Audio/ogg").alias("type"), F.concat(F.lit("https://cdn.example/"), "event_id").alias("file_url")))
    spoken = (kind == "view") & (F.col("value") < 20)
    message = F.struct(mid.alias("mid"), F.when(~spoken, text).alias("text"),
                       F.when(F.col("value") < 5, True).alias("is_echo"),
                       F.when(kind == "view", recording).alias("attachments"))
    event = F.struct(sender.alias("sender"), message.alias("message"))
    change = F.struct(F.lit("messages").alias("field"),
                      F.struct(sender.alias("from"), F.struct(mid.alias("mid"), text.alias("text")).alias("message")).alias("value"))
    listed = F.struct(F.struct(F.array(F.struct(user.alias("from"), F.struct(text.alias("body")).alias("text"))).alias("messages")).alias("value"))

    def body(name: str, part: str, item: Column) -> Column:
        return F.to_json(F.struct(F.lit(name).alias("object"), F.array(F.struct(F.array(item).alias(part))).alias("entry")))

    return e.select(
        "event_id", F.col("ts").alias("received_at"),
        F.when(kind == "click", body("page", "messaging", event))
        .when(kind == "view", body("instagram", "messaging", event))
        .when(kind == "signup", body("page", "standby", event))
        .when(kind == "purchase", body("instagram", "changes", change))
        .otherwise(body("whatsapp_business_account", "changes", listed)).alias("body"))


# -- the same inputs for the checking SQL ---------------------------------------------------------

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SPACE}+'), lambda w: w <> '')"


def sql_tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}')"


SQL_DOCS = """docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'Document ' || doc_id AS doc_title, source AS source_uri, text AS raw_text
  FROM documents)"""

SQL_CHUNKS = f"""{SQL_DOCS}, doc_words AS (
  SELECT doc_id, doc_title, source_uri, {sql_words('raw_text')} AS w FROM docs),
starts AS (
  SELECT *, unnest(range(0, CAST(ceil(len(w) / 462.0) AS BIGINT))) AS i FROM doc_words WHERE len(w) > 0),
chunks AS (
  SELECT doc_id || '_chk_' || i AS chunk_id, doc_id, doc_title, source_uri, CAST(i AS INTEGER) AS chunk_index,
         array_to_string(w[i * 462 + 1 : i * 462 + 512], ' ') AS content,
         CAST(len(w[i * 462 + 1 : i * 462 + 512]) AS INTEGER) AS token_count
  FROM starts)"""


def sql_vectors(name: str, source: str, key: str, text: str) -> str:
    """Non-zero slots of the feature-hashing vectors of ``source`` as CTE ``name(key, slot, x)``."""
    return f"""{name}_tokens AS (
  SELECT {key}, t, count(*) AS n FROM (SELECT {key}, unnest({sql_tokens(text)}) AS t FROM {source}) GROUP BY ALL),
{name}_sums AS (
  SELECT {key}, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 768 AS slot,
         sum(CASE WHEN CAST('0x' || substr(md5(t), 9, 1) AS BIGINT) % 2 = 0 THEN n ELSE -n END) AS v
  FROM {name}_tokens GROUP BY ALL),
{name} AS (
  SELECT {key}, CAST(slot AS INTEGER) AS slot,
         CAST(v / sqrt(CAST(sum(v * v) OVER (PARTITION BY {key}) AS DOUBLE)) AS FLOAT) AS x
  FROM {name}_sums WHERE v <> 0)"""


def sql_hybrid(queries: str, k: int, dense_weight: float) -> str:
    """Fused hits ``hits(query_id, chunk_id, score, rrf_score, rank)`` of CTE ``queries`` on ``chunks``."""
    return f"""{sql_vectors('chunk_vec', 'chunks', 'chunk_id', 'content')},
{sql_vectors('query_vec', queries, 'query_id', 'query')},
chunk_norm AS (SELECT chunk_id, sqrt(sum(x::DOUBLE * x)) AS n FROM chunk_vec GROUP BY 1),
query_norm AS (SELECT query_id, sqrt(sum(x::DOUBLE * x)) AS n FROM query_vec GROUP BY 1),
dots AS (
  SELECT q.query_id, c.chunk_id, sum(q.x::DOUBLE * c.x) AS d
  FROM query_vec q JOIN chunk_vec c USING (slot) GROUP BY 1, 2),
dense AS (
  SELECT query_id, chunk_id, round(d / (qn.n * cn.n), 9) AS score
  FROM dots JOIN query_norm qn USING (query_id) JOIN chunk_norm cn USING (chunk_id)),
dense_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM dense
  QUALIFY r <= {2 * k}),
{sql_lexical(queries, 2 * k)},
fused AS (
  SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.chunk_id, l.chunk_id) AS chunk_id,
         coalesce(l.score, d.score) AS score,
         coalesce({dense_weight}::DOUBLE * (1.0::DOUBLE / (60 + d.r)), 0.0::DOUBLE)
           + coalesce((1.0::DOUBLE - {dense_weight}::DOUBLE) * (1.0::DOUBLE / (60 + l.r)), 0.0::DOUBLE) AS rrf_score,
         d.r AS dense_rank, l.r AS lexical_rank
  FROM dense_ranked d FULL JOIN lexical_ranked l ON d.query_id = l.query_id AND d.chunk_id = l.chunk_id),
hits AS (
  SELECT query_id, chunk_id, score, rrf_score, CAST(row_number() OVER (
           PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank NULLS LAST, lexical_rank) AS INTEGER) AS rank
  FROM fused QUALIFY rank <= {k})"""


def sql_lexical(queries: str, k: int) -> str:
    return f"""lex_tokens AS (
  SELECT chunk_id, t, count(*) AS n FROM (SELECT chunk_id, unnest({sql_tokens('content')}) AS t FROM chunks) GROUP BY ALL),
lex_sizes AS (SELECT chunk_id, sum(n) AS size FROM lex_tokens GROUP BY 1),
lex_terms AS (SELECT DISTINCT query_id, unnest({sql_tokens('query')}) AS t FROM {queries}),
lexical AS (
  SELECT query_id, chunk_id, CAST(sum(n) AS DOUBLE) / (any_value(size) + 1.0::DOUBLE) AS score
  FROM lex_terms JOIN lex_tokens USING (t) JOIN lex_sizes USING (chunk_id) GROUP BY 1, 2),
lexical_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM lexical
  QUALIFY r <= {k})"""


SQL_BENCHMARK = "benchmark_queries AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark)"

SQL_TURNS = f"""turns AS (
  SELECT conv_id || '-' || turn AS turn_id, CAST(conv_id AS VARCHAR) AS session_id,
         'u' || (conv_id // 2) AS user_id, role, text AS content,
         make_timestamp(({EPOCH} + conv_id * 86400 + turn * turn * 2000) * 1000000) AS ts
  FROM conversations)"""

SQL_QUESTIONS = f"""{SQL_TURNS}, questions AS (
  SELECT session_id AS query_id, session_id, user_id, content AS query FROM turns WHERE role = 'user'
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, turn_id DESC) = 1)"""

SQL_EVENT_TURNS = """turns AS (
  SELECT CAST(event_id AS VARCHAR) AS turn_id, CAST(user_id AS VARCHAR) AS session_id,
         CAST(user_id AS VARCHAR) AS user_id,
         CASE WHEN event_type = 'error' THEN 'assistant' ELSE 'user' END AS role, event_type AS content, ts
  FROM events)"""

SQL_MESSAGES = """messages AS (
  SELECT CAST(event_id AS VARCHAR) AS message_id,
         CASE WHEN event_type <> 'error' THEN user_id || '/' || props END AS mid,
         CAST(user_id AS VARCHAR) AS sender_id,
         CASE WHEN event_type = 'view' THEN 'instagram' END AS platform,
         event_type || ' ' || props AS message_text,
         CASE WHEN event_type = 'click' THEN 'https://cdn.example/' || event_id END AS audio_url,
         ts AS received_at
  FROM events)"""

SQL_REPLIES = """replies AS (
  SELECT CAST(event_id AS VARCHAR) AS message_id, 're: ' || event_type AS reply, ts + INTERVAL 2 MINUTE AS replied_at
  FROM events WHERE value > 10)"""

SQL_PROFILE_EVENTS = """raw_events AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
profile_events AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, ts, event_id,
    CASE WHEN event_type = 'view' THEN CASE WHEN k < 30 THEN 'S' WHEN k < 60 THEN 'M' ELSE 'L' END END AS size,
    CASE WHEN event_type = 'click' THEN 'fabric' || (k // 10) END AS fabric,
    CASE WHEN event_type = 'signup' AND k > 80 THEN 'hinglish' END AS language,
    CASE WHEN event_type = 'click' AND k > 50 THEN 'Town ' || (k // 10) END AS location,
    CASE WHEN event_type = 'purchase' THEN 'Ready to Order' WHEN event_type = 'error' THEN 'Support'
         WHEN event_type = 'view' AND k > 70 THEN 'Browsing' END AS stage,
    CASE WHEN event_type <> 'error' THEN [event_type, 'k:' || (k // 25)] END AS tags,
    CASE WHEN event_type = 'error' AND k < 20 THEN 'note ' || k END AS notes
  FROM raw_events)"""

SQL_FOLD = """tag_sets AS (
  SELECT user_id, list_sort(list(DISTINCT t)) AS tags
  FROM (SELECT user_id, unnest(tags) AS t FROM profile_events) GROUP BY 1),
customers AS (
  SELECT e.user_id,
    arg_max(size, (ts, event_id)) FILTER (size IS NOT NULL) AS preferred_size,
    arg_max_null(fabric, (ts, event_id)) AS preferred_fabric,
    coalesce(arg_max(language, (ts, event_id)) FILTER (language IS NOT NULL), 'english') AS preferred_language,
    arg_max(location, (ts, event_id)) FILTER (location IS NOT NULL) AS location,
    coalesce(arg_max(stage, (ts, event_id)) FILTER (stage IS NOT NULL), 'New Lead') AS stage,
    count(*) AS total_turns, max(ts) AS last_active, coalesce(any_value(s.tags), []) AS tags,
    coalesce(arg_max(notes, (ts, event_id)) FILTER (notes IS NOT NULL), '') AS notes
  FROM profile_events e LEFT JOIN tag_sets s USING (user_id) GROUP BY e.user_id)"""

SQL_CUSTOMERS = f"{SQL_PROFILE_EVENTS}, {SQL_FOLD}"
