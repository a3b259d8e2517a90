import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import crm, memory as M

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "turn_id string, session_id string, user_id string, role string, content string, ts timestamp"


def turns(spark, rows):
    return spark.createDataFrame([
        (f"t{i:04}", s, u, role, text, T0 + dt.timedelta(seconds=sec)) for i, (s, u, role, text, sec) in enumerate(rows)], SCHEMA)


def test_windows_and_history(spark):
    df = turns(spark, [("s", "u", "user", f"m{i}", i) for i in range(4)])
    assert [r.content for r in M.context_window(df, 3).orderBy("ts").collect()] == ["m1", "m2", "m3"]
    assert [r.content for r in M.session_history(df, 3).orderBy("ts").collect()] == ["m0", "m1", "m2"]
    assert [t.content for t in M.context_arrays(df, 3).first().turns] == ["m1", "m2", "m3"]


def test_log_upsert(spark):
    log = turns(spark, [("s", "u", "user", "old", 5)])
    new = log.withColumn("content", F.lit("new"))
    assert [r.content for r in M.upsert_turns(log, new).collect()] == ["new"]
    assert [r.content for r in M.upsert_turns(log, new.withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 HOUR"))).collect()] == ["old"]


def lifecycle_by_hand(rows, timeout):
    """rows of one session in order: (role, seconds)."""
    out, last, count = [], None, 0
    for role, sec in rows:
        if role == "user":
            if last is None:
                state, count, idle = "first_contact", 1, 0
            elif sec - last > timeout:
                state, count, idle = "returning_session", 1, int(sec - last)
            else:
                state, count, idle = "active_ongoing", count + 1, int(sec - last)
            out.append((state, count, idle))
        last = sec
    return out


@pytest.mark.parametrize("max_rows", [1000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_lifecycle_matches_a_plain_restatement(spark, max_rows, seed):
    rng = random.Random(seed)
    sessions = {}
    for s in ("a", "b", "c"):
        sec, rows = 0.0, []
        for _ in range(rng.randint(1, 25)):
            sec += rng.choice([1.5, 60, 10_800, 10_800.000001, 10_900, 40_000])
            rows.append((rng.choice(["user", "user", "assistant"]) if rows else "user", sec))
        sessions[s] = rows
    df = turns(spark, [(s, "u", role, "x", sec) for s, rows in sessions.items() for role, sec in rows])
    got = M.session_lifecycle(df, max_rows=max_rows).orderBy("session_id", "turn_id").collect()
    for s, rows in sessions.items():
        mine = [(r.lifecycle_state, r.turn_count, r.idle_seconds) for r in got if r.session_id == s]
        assert mine == lifecycle_by_hand(rows, 10_800)


def test_a_hot_session_without_an_id_is_split_too(spark):
    rows = [(f"t{i:03}", None if i % 3 else "s", "u", "user" if i % 4 else "assistant", "x", T0 + dt.timedelta(minutes=40 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "turn_id string, session_id string, user_id string, role string, content string, ts timestamp")
    out = lambda **kw: sorted((tuple(r) for r in M.session_lifecycle(df, **kw).select("turn_id", "lifecycle_state", "turn_count", "idle_seconds").collect()))
    assert out(max_rows=5) == out() and len(out()) == 45


def test_idle_at_and_over_the_timeout(spark):
    df = turns(spark, [("s", "u", "user", "a", 0), ("s", "u", "user", "b", 10_800), ("s", "u", "user", "c", 21_600.000001)])
    assert [r.lifecycle_state for r in M.session_lifecycle(df).orderBy("ts").collect()] == [
        "first_contact", "active_ongoing", "returning_session"]
    assert [r.turns for r in M.sessions(df).orderBy("started_at").collect()] == [2, 1]


def test_known_user_in_a_new_session_is_a_first_contact(spark):
    df = turns(spark, [("s1", "u", "user", "a", 0), ("s2", "u", "user", "b", 1)])
    assert {r.lifecycle_state for r in M.session_lifecycle(df).collect()} == {"first_contact"}


def test_profiles(spark):
    df = turns(spark, [("s", "u", "user", "Cotton tops? cotton abc? The cotton", 0), ("s", "u", "user", "tops are nice", 1),
                       ("s", "u", "assistant", "hello hello hello", 2), ("s", "v", "user", "a an", 3)])
    got = {r.user_id: r for r in M.consolidate_profiles(df).collect()}
    assert got["u"].key_topics == ["cotton", "tops", "abc", "nice"]
    assert got["u"].profile_summary == (
        "User has engaged in 2 interaction turns. Frequent focus areas: cotton, tops, abc, nice.")
    assert got["v"].profile_summary.endswith("General Inquiries.")


def test_profile_upsert_counts_runs(spark):
    new = M.consolidate_profiles(turns(spark, [("s", "u", "user", "cotton", 0)]))
    old = spark.createDataFrame([("u", "was", ["x"], 4, T0), ("w", "stays", [], 1, T0)],
                                "user_id string, profile_summary string, key_topics array<string>, interaction_count int, last_updated timestamp")
    got = {r.user_id: r for r in M.upsert_profiles(old, new, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert (got["u"].interaction_count, got["u"].key_topics) == (5, ["cotton"])
    assert (got["w"].interaction_count, got["w"].profile_summary) == (1, "stays")


def test_view_and_clear(spark):
    df = turns(spark, [("s", "u", "user", "hello cotton", 0), ("r", "v", "user", "hi", 0)])
    view = {r.session_id: r for r in M.memory_view(df, M.consolidate_profiles(df)).collect()}
    assert view["s"].key_topics == ["hello", "cotton"] and view["r"].messages == 1
    kept = M.clear_sessions(df, spark.createDataFrame([("s",)], "session_id string"))
    assert [r.session_id for r in kept.collect()] == ["r"]


EVENTS = "user_id string, ts timestamp, event_id long, size string, fabric string, language string, location string, stage string, tags array<string>, notes string"


def events(spark, rows):
    return spark.createDataFrame([
        (u, T0 + dt.timedelta(seconds=i), i, *rest) for i, (u, *rest) in enumerate(rows)], EVENTS)


def fold_by_hand(rows):
    out = {}
    for u, size, fabric, language, location, stage, tags, notes in rows:
        c = out.setdefault(u, dict(size=None, language=None, location=None, stage=None, turns=0, tags=set(), notes=None))
        c["size"], c["fabric"] = size or c["size"], fabric
        c["language"], c["location"], c["stage"] = language or c["language"], location or c["location"], stage or c["stage"]
        c["turns"] += 1
        c["tags"] |= set(tags or [])
        c["notes"] = notes if notes is not None else c["notes"]
    return {u: (c["size"], c["fabric"], c["language"] or "english", c["location"], c["stage"] or "New Lead", c["turns"],
                sorted(c["tags"]), c["notes"] or "") for u, c in out.items()}


def as_tuples(customers):
    return {r.user_id: (r.preferred_size, r.preferred_fabric, r.preferred_language, r.location, r.stage, r.total_turns,
                        list(r.tags), r.notes) for r in customers.collect()}


@pytest.mark.parametrize("seed", [3, 4])
def test_fold_and_merge_match_a_plain_restatement(spark, seed):
    rng = random.Random(seed)
    pick = lambda *v: rng.choice([None, None, *v])
    rows = [(rng.choice("abc"), pick("M", "L", ""), pick("Silk"), pick("hinglish"), pick("Kochi"), pick("Support"),
             rng.choice([None, ["x"], ["y", "x"], []]), pick("", "note")) for _ in range(40)]
    df = events(spark, rows)
    assert as_tuples(crm.fold_customers(df)) == fold_by_hand(rows)
    first, second = df.filter("event_id < 20"), df.filter("event_id >= 20")
    # In whatever order the batches come.
    for old, new in ((first, second), (second, first)):
        assert as_tuples(crm.customers_of(crm.merge_customers(crm.fold_records(old), new))) == fold_by_hand(rows)


def test_an_older_event_changes_nothing_newer(spark):
    newer = events(spark, [("u", None, None, None, None, None, None, None), ("u", "M", "Silk", None, None, None, None, None)])
    older = events(spark, [("u", "L", "Linen", None, "Kochi", None, ["x"], None)])
    r = crm.customers_of(crm.merge_customers(crm.fold_records(newer), older)).first()
    assert (r.preferred_size, r.preferred_fabric, r.location, r.total_turns) == ("M", "Silk", "Kochi", 3)
    assert r.last_active == newer.agg({"ts": "max"}).first()[0]


def test_later_message_without_fabric_clears_it(spark):
    df = events(spark, [("u", "M", "Silk", None, None, None, None, None), ("u", None, None, None, None, None, None, None)])
    r = crm.fold_customers(df).first()
    assert (r.preferred_size, r.preferred_fabric) == ("M", None)


def test_manual_tags_count_as_a_turn(spark):
    df = events(spark, [("u", "M", "Silk", None, None, None, ["a"], None)])
    tags = spark.createDataFrame([("u", T0 + dt.timedelta(days=1), 9, ["vip"], "call back")],
                                 "user_id string, ts timestamp, event_id long, tags array<string>, notes string")
    r = crm.fold_customers(df.unionByName(crm.tag_events(tags))).first()
    assert (r.total_turns, r.preferred_fabric, list(r.tags), r.notes) == (2, None, ["a", "vip"], "call back")


def test_listing_and_stats(spark):
    df = events(spark, [("a", "M", None, None, "Kochi", "Support", None, None), ("b", "L", None, None, "Kollam", "Support", None, None),
                        ("c", None, None, None, None, None, None, None)])
    customers = crm.fold_customers(df)
    assert [r.user_id for r in crm.list_customers(customers, stage="Support").collect()] == ["b", "a"]
    assert [r.user_id for r in crm.list_customers(customers, size="m", location="KOCH").collect()] == ["a"]
    assert [r.user_id for r in crm.list_customers(customers, limit=1, offset=1).collect()] == ["b"]
    assert "preferred_language" not in crm.list_customers(customers).columns
    with pytest.raises(ValueError):
        crm.list_customers(customers, limit=0)
    stats = {(r.kind, r.value): r.customers for r in crm.customer_stats(customers).collect()}
    assert stats == {("total", None): 3, ("stage", "Support"): 2, ("stage", "New Lead"): 1, ("size", "M"): 1, ("size", "L"): 1}


def test_dossiers_and_notes(spark):
    customers = crm.fold_customers(events(spark, [("u", "M", None, None, None, None, None, None)]))
    view = crm.dossiers(customers, turns(spark, [("u", "u", "user", f"m{i}", i) for i in range(12)])).first()
    assert [t.content for t in view.recent_turns] == [f"m{i}" for i in range(2, 12)]
    notes = spark.createDataFrame([("u", "A", "old", T0), ("u", "B", "new", T0 + dt.timedelta(1))],
                                  "sender_id string, customer_name string, profile_notes string, ts timestamp")
    assert crm.upsert_notes(notes).first().profile_notes == "new"
