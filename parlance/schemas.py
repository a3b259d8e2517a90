"""Fixed input and output schemas."""

from pyspark.sql import types as T

RAW_DOCUMENT = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("doc_title", T.StringType()),
    T.StructField("source_uri", T.StringType()),
    T.StructField("raw_text", T.StringType()),
])

CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("doc_title", T.StringType()),
    T.StructField("source_uri", T.StringType()),
    T.StructField("chunk_index", T.IntegerType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("token_count", T.IntegerType(), False),
])

EMBEDDED_CHUNK = T.StructType(
    CHUNK.fields + [T.StructField("embedding", T.ArrayType(T.FloatType(), False), False)])

VECTOR_POINT = T.StructType([T.StructField("point_id", T.StringType(), False)] + EMBEDDED_CHUNK.fields)

TURN = T.StructType([
    T.StructField("turn_id", T.StringType(), False),
    T.StructField("session_id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("role", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
])

MESSAGE = T.StructType([
    T.StructField("message_id", T.StringType(), False),
    T.StructField("mid", T.StringType()),
    T.StructField("sender_id", T.StringType(), False),
    T.StructField("sender_name", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("message_text", T.StringType(), False),
    T.StructField("audio_url", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("received_at", T.TimestampType(), False),
])

# Nested messaging payload. Fields that arrive either as text or as an object are read as text
# and taken apart with JSON paths.
_PARTY = T.StructType([T.StructField("id", T.StringType())])
_ATTACHMENT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("payload", T.StructType([T.StructField("url", T.StringType())])),
    T.StructField("file_url", T.StringType()),
])
_MESSAGE_BODY = T.StructType([
    T.StructField("mid", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("is_echo", T.BooleanType()),
    T.StructField("attachments", T.ArrayType(_ATTACHMENT)),
])
_MESSAGING_EVENT = T.StructType([
    T.StructField("sender", _PARTY),
    T.StructField("message", _MESSAGE_BODY),
])
_LISTED_MESSAGE = T.StructType([
    T.StructField("from", T.StringType()),
    T.StructField("text", T.StructType([T.StructField("body", T.StringType())])),
])
_CHANGE_VALUE = T.StructType([
    T.StructField("sender", _PARTY),
    T.StructField("from", T.StringType()),
    T.StructField("message", _MESSAGE_BODY),
    T.StructField("text", T.StringType()),
    T.StructField("mid", T.StringType()),
    T.StructField("messages", T.ArrayType(_LISTED_MESSAGE)),
])
PAYLOAD = T.StructType([
    T.StructField("object", T.StringType()),
    T.StructField("entry", T.ArrayType(T.StructType([
        T.StructField("messaging", T.ArrayType(_MESSAGING_EVENT)),
        T.StructField("standby", T.ArrayType(_MESSAGING_EVENT)),
        T.StructField("changes", T.ArrayType(T.StructType([
            T.StructField("field", T.StringType()),
            T.StructField("value", _CHANGE_VALUE),
            T.StructField("messages", T.StringType()),
        ]))),
    ]))),
])
