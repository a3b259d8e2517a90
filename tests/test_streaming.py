import datetime as dt
import json

from pyspark.sql import functions as F

from parlance.operators import crm, inbox, memory
from parlance.sources import files, vector_table, webhooks
from parlance.streaming import jobs

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def drain(spark, df, tmp_path, name):
    out = str(tmp_path / name)
    jobs.append_to(df, out, str(tmp_path / (name + "-cp"))).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def as_stream(spark, df, tmp_path, name):
    path = str(tmp_path / name)
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path), path


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_webhook_stream_to_inbox(spark, tmp_path):
    body = json.dumps({"object": "page", "entry": [{"messaging": [
        {"sender": {"id": "S"}, "message": {"mid": "m1", "text": "hello"}}]}]})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(body + "\n" + body + "\n")
    queued = jobs.inbox_stream(webhooks.read_webhook_stream(spark, str(tmp_path / "in")))
    rows = drain(spark, queued, tmp_path, "out").collect()
    assert [(r.sender_id, r.message_text, r.status) for r in rows] == [("S", "hello", "pending")]


def test_equal_lines_without_an_id_all_stay(spark, tmp_path):
    said = {"from": "91", "text": {"body": "ok"}}
    body = json.dumps({"object": "whatsapp_business_account", "entry": [{"changes": [{"value": {"messages": [said, said]}}]}]})
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / f"{name}.json").write_text(f"{body}\n\n{body}\n")
    stream = webhooks.read_webhook_stream(spark, str(tmp_path / "in"), 1)
    first = {r.message_id for r in drain(spark, jobs.inbox_stream(stream), tmp_path, "out").collect()}
    again = {r.message_id for r in drain(spark, jobs.inbox_stream(stream), tmp_path, "again").collect()}
    assert len(first) == 8 and first == again


MESSAGES = "sender_id string, message_id string, message_text string, received_at timestamp"


def test_anchored_batches_over_micro_batches(spark, tmp_path):
    first = spark.createDataFrame([("s", f"m{t}", f"w{t}", at(t)) for t in (0, 3, 6)], MESSAGES)
    later = spark.createDataFrame([("s", f"m{t}", f"w{t}", at(t)) for t in (4, 9, 20)] + [("z", "end", "end", at(500))], MESSAGES)
    stream, path = as_stream(spark, first, tmp_path, "in")
    for batch in (None, later):
        if batch is not None:
            batch.coalesce(1).write.mode("append").parquet(path)
        got = drain(spark, jobs.anchored_batch_stream(stream, 5), tmp_path, "out")
    stream_rows = {(r.sender_id, r.window_start, r.flattened_message, r.message_count) for r in got.collect()}
    whole = inbox.anchored_batches(first.unionByName(later), 5).filter("sender_id = 's'")
    assert stream_rows == {(r.sender_id, r.window_start, r.flattened_message, r.message_count) for r in whole.collect()}


def test_session_stream(spark, tmp_path):
    rows = [("s", at(0)), ("s", at(10_800)), ("s", at(21_600.000001)), ("t", at(100_000))]
    stream, _ = as_stream(spark, spark.createDataFrame(rows, "session_id string, ts timestamp"), tmp_path, "in")
    got = drain(spark, jobs.session_stream(stream), tmp_path, "out").collect()
    assert sorted((r.session_id, r.turns) for r in got) == [("s", 1), ("s", 2)]


def test_customer_stream_equals_the_batch_fold(spark, tmp_path):
    schema = ("user_id string, ts timestamp, event_id long, size string, fabric string, language string, location string, "
              "stage string, tags array<string>, notes string")
    first = spark.createDataFrame([("u", at(0), 0, "M", "Silk", None, "Kochi", None, ["a"], None)], schema)
    second = spark.createDataFrame([("u", at(1), 1, None, None, "hinglish", None, "Support", ["b"], ""),
                                    ("v", at(2), 2, None, "Linen", None, None, None, None, None)], schema)
    stream, path = as_stream(spark, first, tmp_path, "in")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    jobs.fold_customers_into(stream, out, checkpoint).awaitTermination()
    second.coalesce(1).write.mode("append").parquet(path)
    jobs.fold_customers_into(stream, out, checkpoint).awaitTermination()
    want = crm.fold_customers(first.unionByName(second))
    cols = want.columns
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select(cols).collect())
    assert key(jobs.read_customers(spark, out)) == key(want)


def test_replies_join(spark, tmp_path):
    messages = spark.createDataFrame([("m1", "s", "a", at(0)), ("m2", "s", "b", at(1)), ("m3", "s", "end", at(400_000))],
                                     "message_id string, sender_id string, message_text string, received_at timestamp")
    replies = spark.createDataFrame([("m1", "re", at(60)), ("zz", "end", at(400_000))],
                                    "message_id string, reply string, replied_at timestamp")
    m, _ = as_stream(spark, messages, tmp_path, "m")
    r, _ = as_stream(spark, replies, tmp_path, "r")
    got = {x.message_id: (x.status, x.ai_reply) for x in drain(spark, jobs.reply_stream(m, r), tmp_path, "out").collect()}
    assert got == {"m1": ("replied", "re"), "m2": ("pending", None)}


def test_index_stream(spark, tmp_path):
    docs = files.inline_documents(spark, [{"doc_id": "d", "doc_title": "T", "source_uri": "u", "raw_text": "hello there"}])
    stream, _ = as_stream(spark, docs, tmp_path, "in")
    jobs.index_documents_into(stream, str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination()
    assert vector_table.read_index(spark, str(tmp_path / "index")).select(F.col("chunk_id")).first()[0] == "d_chk_0"


def test_lifecycle_over_micro_batches(spark, tmp_path):
    schema = "turn_id string, session_id string, user_id string, role string, content string, ts timestamp"

    def turns(rows):
        return spark.createDataFrame([(f"t{sec}", s, "u", role, "x", at(sec)) for s, role, sec in rows], schema)

    first = turns([("s", "user", 0), ("s", "assistant", 10), ("s", "user", 20_000), ("r", "assistant", 5), ("r", "user", 6)])
    second = turns([("s", "user", 20_030), ("s", "user", 30_830), ("s", "user", 50_000), ("z", "user", 90_000)])
    stream, path = as_stream(spark, first, tmp_path, "in")
    drain(spark, jobs.lifecycle_stream(stream), tmp_path, "out")
    second.coalesce(1).write.mode("append").parquet(path)
    got = drain(spark, jobs.lifecycle_stream(stream), tmp_path, "out")
    cols = ["session_id", "turn_id", "lifecycle_state", "is_first_turn_of_session", "idle_seconds", "session_no", "turn_count"]
    want = memory.session_lifecycle(first.unionByName(second)).filter("session_id <> 'z'")
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_lifecycle_forgets_after_the_retention(spark, tmp_path):
    schema = "turn_id string, session_id string, user_id string, role string, content string, ts timestamp"

    def turns(rows):
        return spark.createDataFrame([(f"t{sec}", s, "u", "user", "x", at(sec)) for s, sec in rows], schema)

    stream, path = as_stream(spark, turns([("s", 0), ("z", 200_000)]), tmp_path, "in")
    drain(spark, jobs.lifecycle_stream(stream, retention_seconds=100_000), tmp_path, "out")
    turns([("s", 300_000), ("z", 310_000), ("z", 320_000)]).coalesce(1).write.mode("append").parquet(path)
    got = drain(spark, jobs.lifecycle_stream(stream, retention_seconds=100_000), tmp_path, "out").collect()
    assert {r.turn_id: r.lifecycle_state for r in got} == {
        "t0": "first_contact", "t300000": "first_contact", "t200000": "first_contact", "t310000": "first_contact"}


def test_stream_inputs_are_files_for_all_cores(spark):
    # Before, three tasks wrote all rows, and a third of them was one file.
    from parlance.plans import messages
    rows = spark.range(600).withColumn("ts", F.timestamp_seconds("id"))
    stream = messages._as_files(spark, rows, "as-files")
    path = stream._jdf.queryExecution().toString().split("FileSource[")[1].split("]")[0]
    assert len(spark.read.parquet(path).inputFiles()) == 3 * spark.sparkContext.defaultParallelism
    assert messages._third(spark.read.parquet(path)) == spark.sparkContext.defaultParallelism
    assert spark.read.parquet(path).count() == 600
