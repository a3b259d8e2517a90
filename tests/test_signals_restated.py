"""Signals on tables of literal messages with the labels that their rules give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import signals as S

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
TURNS = "session_id string, turn_id string, role string, content string, ts timestamp, is_voice boolean"

# One conversation: role, text, spoken, label and why.
CONVERSATION = [
    ("user", "Kochi delivery undo", False, "manglish"),         # two words of the first family
    ("user", "ok", False, "manglish"),                          # a short reply takes the turn before
    ("assistant", "welcome", False, "english"),                 # no sign at all
    ("user", "hai", False, "hinglish"),                         # a word of the second family
    ("user", "OK", False, "hinglish"),                          # again the user turn before
    ("user", "क्या आप", False, "hindi_script"),
    ("user", "क्या आप", True, "hinglish"),                        # spoken script becomes its romanised label
    ("user", "എന്താണ്", False, "malayalam_script"),
    ("user", "क्या आप", True, "hindi_script"),                    # the first script was typed lately
    ("user", "   ", False, "english"),
    ("user", "kya undo", False, "manglish"),                    # one word each: the first family
    ("user", "kya bhai undo", False, "hinglish"),               # the second has more
    ("user", "irukka kya undo", False, "manglish"),             # one word of all three
    ("user", "irukka enna kya", False, "tanglish"),             # the third has most
    ("user", "irukka kya", False, "hinglish"),                  # the second before the third
    ("user", "do you churidhar", False, "english"),             # English outweighs a clothing word
    ("user", "churidhar", False, "manglish"),
    ("user", "വ price", False, "english"),                      # one letter is no script
    ("user", "വി क्", False, "malayalam_script"),                # a tie goes to the first script
    ("user", "yes", False, "malayalam_script"),
    ("assistant", "undo", False, "manglish"),
    ("assistant", "undo", False, "manglish"),
    ("user", "yes", False, "english"),                          # no user turn among the last two
]


def turns(spark, conversations):
    return spark.createDataFrame([
        (session, f"{i:03}", role, text, T0 + dt.timedelta(seconds=i), voice)
        for session, turn_list in conversations.items() for i, (role, text, voice, *_) in enumerate(turn_list)], TURNS)


@pytest.mark.parametrize("max_rows", [10_000, 4])
def test_languages_of_a_conversation(spark, max_rows):
    rows = S.detect_language(turns(spark, {"s": CONVERSATION}), max_rows=max_rows).orderBy("turn_id").collect()
    assert [r.language for r in rows] == [c[3] for c in CONVERSATION]


def test_slots_change_nothing(spark):
    rng = random.Random(7)
    shuffled = {f"s{n}": rng.choices([c[:3] for c in CONVERSATION], k=25) for n in range(12)}
    df = turns(spark, shuffled)
    label = lambda **kw: sorted((r.session_id, r.turn_id, r.language) for r in S.detect_language(df, **kw).collect())
    assert label(max_rows=4) == label()


# Text, size, fabric, place, stage.
PROFILES = [
    ("size xl please", "XL", None, None, None),
    ("3XL cotton", "3XL", "Cotton", None, None),
    ("I'm in Kollam", None, None, "Kollam", None),
    ("m size silk or cotton", "M", "Cotton", None, None),
    ("size s", "S", None, None, None),
    ("small or large", "L", None, None, None),
    ("Medium", "M", None, None, None),
    ("xs", "XS", None, None, None),
    ("sizes", None, None, None, None),
    ("", None, None, None, None),
    ("book it, ship to KOCHI", None, None, "Kochi", "Ready to Order"),
]


def test_profile_signals(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PROFILES)], "i int, content string")
    rows = S.profile_signals(df).orderBy("i").collect()
    assert [(r.content, r["size"], r.fabric, r.location, r.stage) for r in rows] == PROFILES


# Text, intent, greeting only.
INTENTS = [
    ("hi", "CHIT_CHAT", True), ("hello there", "CHIT_CHAT", True), ("this one", "CHIT_CHAT", True),
    ("hello my dear friend", "RAG_QUERY", False), ("what is the price", "RAG_QUERY", False),
    ("compare cotton and silk", "DEEP_REASONING", False), ("word " * 35, "RAG_QUERY", False),
    ("word " * 36, "DEEP_REASONING", False), ("yo", "RAG_QUERY", True), ("", "RAG_QUERY", False),
]


def test_intents(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(INTENTS)], "i int, content string")
    rows = df.select("content", S.route_intent(F.col("content")).alias("intent"),
                     S.is_greeting_only(F.col("content")).alias("greeting"), "i").orderBy("i").collect()
    assert [(r.content, r.intent, r.greeting) for r in rows] == INTENTS


# Reply, language, what is left.
REPLIES = [
    ("hello ✨ there 🌸", "manglish", "hello there"), ("hello ✨ there", "english", "hello there"),
    ("one-two", "english", "one-two"), ("  two   spaces ", "manglish", "two spaces"), ("വില", "manglish", "വില"),
    ("വില", "english", "വില"),
]


def test_clean_replies(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(REPLIES)], "i int, content string, language string, want string")
    rows = df.select(S.clean_reply(F.col("content"), F.col("language")).alias("got"), "want", "i").orderBy("i").collect()
    assert [r.got for r in rows] == [r.want for r in rows]
