import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import inbox as Q
from parlance.sources import webhooks

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
MESSAGES = "message_id string, mid string, sender_id string, platform string, message_text string, audio_url string, received_at timestamp"


def messages(spark, rows):
    """rows of (sender, seconds, text, mid)."""
    return spark.createDataFrame([
        (f"m{i:04}", mid, s, "instagram", text, None, T0 + dt.timedelta(microseconds=round(sec * 1e6)))
        for i, (s, sec, text, mid) in enumerate(rows)], MESSAGES)


def flatten(spark, *payloads):
    df = spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "i int, body string")
    return webhooks.flatten_payloads(df).orderBy("i").collect()


def page(**entry):
    return {"object": "page", "entry": [{"id": "P", "time": 1, **entry}]}


def test_representative_payload(spark):
    body = {"object": "instagram", "entry": [{"id": "A", "time": 1700000000, "messaging": [{
        "sender": {"id": "IG_1"}, "recipient": {"id": "A"}, "message": {"mid": "mid_1", "text": "Do you have cotton in pink?"}}]}]}
    (r,) = flatten(spark, body)
    assert (r.sender_id, r.message_text, r.mid, r.platform) == ("IG_1", "Do you have cotton in pink?", "mid_1", "instagram")


def test_all_arrays_and_rules(spark):
    sender = {"id": "S"}
    rows = flatten(
        spark,
        page(messaging=[{"sender": sender, "message": {"text": "echo", "is_echo": True}},
                        {"sender": sender, "message": {"mid": "v", "attachments": [
                            {"type": "image", "payload": {"url": "i"}}, {"type": "Audio", "payload": {"url": "a"}}]}},
                        {"sender": {}, "message": {"text": "no sender"}}, {"sender": sender, "message": {"text": ""}}],
             standby=[{"sender": sender, "message": {"text": "standby", "mid": "s"}}]),
        page(changes=[{"field": "messages", "value": {"from": {"id": "F"}, "message": {"text": "c1", "mid": "c"}}},
                      {"field": "feed", "value": {"from": {"id": "F"}, "text": "not a message"}},
                      {"field": "messages", "value": {"from": "plain", "messages": [{"text": {"body": "c2"}}]}}]),
        {"object": "whatsapp_business_account", "entry": [{"changes": [{"value": {"messages": [
            {"from": "91", "text": {"body": "wa"}}, {"from": "91", "type": "image"}]}}]}]},
        {"object": "other", "entry": [{"messaging": [{"sender": sender, "message": {"text": "x"}}]}]},
        "no json")
    got = [(r.i, r.sender_id, r.message_text, r.mid, r.audio_url, r.platform, r.queue_status) for r in rows]
    assert sorted(got, key=str) == sorted([
        (0, "S", webhooks.VOICE_PLACEHOLDER, "v", "a", "messenger", "QUEUED_FOR_SPARK"),
        (0, "S", "standby", "s", None, "messenger", "STANDBY_QUEUED"),
        (1, "F", "c1", "c", None, "messenger", "CHANGES_QUEUED"),
        (1, "plain", "c2", None, None, "messenger", "CHANGES_QUEUED"),
        (2, "91", "wa", None, None, "whatsapp", "WHATSAPP_QUEUED")], key=str)


def test_simple_form(spark):
    df = spark.createDataFrame([('{"chatInput": "hi", "sessionId": "s"}',), ('{"message": "yo", "userId": "u"}',)], "body string")
    assert [tuple(r) for r in webhooks.simple_messages(df).collect()] == [("s", "s", "hi"), ("tester_01", "u", "yo")]


def test_dedup_keeps_messages_without_an_id(spark):
    df = messages(spark, [("s", 0, "a", "x"), ("s", 1, "b", "x"), ("s", 2, "c", None), ("s", 3, "d", None), ("s", 4, "e", "")])
    assert sorted(r.message_text for r in Q.dedup_messages(df).collect()) == ["a", "c", "d", "e"]
    seen = spark.createDataFrame([("x",)], "mid string")
    assert sorted(r.message_text for r in Q.dedup_messages(df, seen).collect()) == ["c", "d", "e"]


def test_inbox_flow(spark):
    box = Q.enqueue(messages(spark, [("s", 0, "first", "x"), ("s", 1, "second", "y")]))
    assert box.filter("message_id rlike '^fb_[0-9a-f]{40}$' and sender_name = 'Facebook User'").count() == 2
    assert [r.message_text for r in Q.pending_messages(box).collect()] == ["first", "second"]
    first = box.filter("message_text = 'first'").first().message_id
    replies = spark.createDataFrame([(first, "early", T0), (first, "late", T0 + dt.timedelta(1))],
                                    "message_id string, reply string, replied_at timestamp")
    after = Q.mark_replied(box, replies)
    assert [r.message_text for r in Q.pending_messages(after).collect()] == ["second"]
    assert [tuple(r) for r in Q.message_replies(after).collect()] == [(first, "late")]


def test_enqueue_gives_the_same_ids_again(spark):
    df = messages(spark, [("s", 0, "a", "x"), ("s", 1, "b", None)])
    ids = lambda: sorted(r.message_id for r in Q.enqueue(df).collect())
    assert ids() == ids()


def test_telemetry_threads_and_notifications(spark):
    events = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i)) for i in range(120)], "event_id int, received_at timestamp")
    assert [r.event_id for r in Q.telemetry(events, 3).collect()] == [119, 118, 117]
    assert Q.telemetry(events, 500).count() == 100
    df = messages(spark, [("me", 5, "mine", None), ("s", 1, "old", None), ("s", 2, "new", None), ("t", 3, "seen", None)])
    df = df.withColumn("thread_id", F.when(F.col("sender_id").isin("me"), "a").when(F.col("sender_id") == "s", "b").otherwise("c"))
    df = df.unionByName(df.filter("thread_id = 'a'").withColumn("sender_id", F.lit("s")).withColumn("received_at", F.lit(T0)))
    seen = df.filter("message_text = 'seen'").select("message_id")
    assert [r.message_text for r in Q.latest_per_thread(df, "me", seen).collect()] == ["new"]
    note = json.loads(Q.notifications(messages(spark, [("s", 0, "x" * 300, None)])).first().value)
    assert note == {"type": "new_message", "sender_id": "s", "text": "x" * 200, "platform": "instagram"}


def anchors_by_hand(times, width):
    out, anchor = [], None
    for t in sorted(times):
        if anchor is None or t >= anchor + width:
            anchor = t
        out.append((t, anchor))
    return out


def test_anchored_batches(spark):
    df = messages(spark, [("s", t, f"w{t}", None) for t in (0, 3, 4.9, 6, 9, 20)])
    got = Q.anchored_batches(df, 5).orderBy("window_start").collect()
    assert [(r.window_start - T0.replace(tzinfo=None)).total_seconds() for r in got] == [0, 6, 20]
    assert [r.message_count for r in got] == [3, 2, 1]
    assert got[0].flattened_message == "w0, w3, w4.9" and got[0].ids == "m0000, m0001, m0002"


def test_null_texts_are_dropped_from_the_joined_text(spark):
    df = messages(spark, [("s", 0, "a", None), ("s", 1, None, None), ("s", 2, "", None)])
    r = Q.anchored_batches(df, 5).first()
    assert (r.flattened_message, r.message_count) == ("a", 3)


@pytest.mark.parametrize("max_rows", [10_000, 7, 2])
@pytest.mark.parametrize("seed", [5, 6])
def test_anchors_match_a_plain_restatement_also_in_slots(spark, max_rows, seed):
    rng = random.Random(seed)
    rows = []
    for s in ("a", "b"):
        t = 0.0
        for _ in range(60):
            t += rng.choice([0, 0.5, 1, 1, 2, 4.999999, 5, 5.000001, 30])
            rows.append((s, t, "x", None))
    rng.shuffle(rows)
    got = {}
    for r in Q.anchored_messages(messages(spark, rows), 5, max_rows).collect():
        start = T0.replace(tzinfo=None)
        us = lambda v: round((v - start) / dt.timedelta(microseconds=1))
        got.setdefault(r.sender_id, []).append((us(r.received_at), us(r.window_start)))
    for s in ("a", "b"):
        assert sorted(got[s]) == anchors_by_hand([round(t * 1e6) for u, t, *_ in rows if u == s], 5_000_000)


def test_telemetry_of_payloads(spark):
    sender = {"id": "S"}
    bodies = [page(messaging=[{"sender": sender, "message": {"text": "a"}}, {"sender": sender, "message": {"text": "b"}}]),
              page(messaging=[{"sender": sender, "message": {"text": "echo", "is_echo": True}}]), {"object": "other"}, {}]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, body string")
    got = [(r.object, r.status, r.text) for r in webhooks.telemetry_entries(df).orderBy("i").collect()]
    assert got == [("page", "QUEUED_FOR_SPARK", "b"), ("page", "RECEIVED", None), ("other", "RECEIVED", None),
                   ("unknown", "RECEIVED", None)]


def test_short_slots_share_tasks(spark):
    # Before, every slot was a range with a task of its own.
    from parlance.functions import ordered
    rows = spark.range(40_000).select(F.lit("s").alias("key"), F.col("id").alias("at"))
    split = ordered.keyed(rows, ["key"], ["at"], 20)
    slots = split.df.groupBy(ordered.SLOT).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).orderBy(ordered.SLOT).collect()
    assert max(r["n"] for r in slots) <= 20 and sum(r["n"] for r in slots) == 40_000
    assert all(a["hi"] < b["lo"] for a, b in zip(slots, slots[1:]))
    assert len(split.df.inputFiles()) <= ordered.MAX_RANGES
