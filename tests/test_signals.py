import datetime as dt

import pytest
from pyspark.sql import functions as F

from parlance import lexicons as L
from parlance.operators import signals as S

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def conversation(spark, turns, voice=False, session="s"):
    rows = [(session, f"t{i:03}", role, text, T0 + dt.timedelta(minutes=i), voice) for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "session_id string, turn_id string, role string, content string, ts timestamp, is_voice boolean")


def languages(spark, turns, voice=False, **kw):
    rows = S.detect_language(conversation(spark, turns, voice), **kw).orderBy("turn_id").collect()
    return [r.language for r in rows]


def each(spark, texts, voice=False):
    """Every text as a session of its own."""
    rows = [(f"s{i}", "t", "user", t, T0, voice) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "session_id string, turn_id string, role string, content string, ts timestamp, is_voice boolean")
    got = {r.session_id: r.language for r in S.detect_language(df).collect()}
    return [got[f"s{i}"] for i in range(len(texts))]


CASES = [
    ("Do you have daily wear cotton tops?", "english"), ("What are the available sizes?", "english"),
    ("Churidar undo?", "manglish"), ("Price ethraya aanu?", "manglish"), ("Kochi delivery undo?", "manglish"),
    ("ചുരിദാർ ടോപ്പുകൾ ഉണ്ടോ?", "malayalam_script"), ("എന്താണ് വില?", "malayalam_script"),
    ("Kya aapke paas kurti hai?", "hinglish"), ("Price kitna hai bhai?", "hinglish"),
    ("Cotton top dikhao", "hinglish"), ("Delivery kab tak milegi?", "hinglish"),
    ("क्या आपके पास चूड़ीदार टॉप्स हैं?", "hindi_script"), ("इसकी कीमत क्या है?", "hindi_script"),
    ("Kurti irukka?", "tanglish"), ("Price evvalavu sollunga", "tanglish"), ("Chennai delivery irukka?", "tanglish"),
    ("சுடிதார் டாப்ஸ் இருக்கிறதா?", "tamil_script"), ("விலை என்ன?", "tamil_script"),
    ("హలో! కుర్తీలు ఉన్నాయా?", "telugu_script"), ("مرحبا هل لديكم فساتين؟", "arabic_script"),
    ("Keralathil delivery undo?", "manglish"), ("Bhai daily wear tops ka rate kya hai?", "hinglish"),
    ("Do you have churidhar for my nephew", "english"), ("churidhar", "manglish"), ("  ", "english"), ("kerala kochi", "english"),
]


def test_language_of_single_messages(spark):
    assert each(spark, [c[0] for c in CASES]) == [c[1] for c in CASES]


def test_voice_messages_get_romanised_labels(spark):
    cases = [("മലയാളത്തിൽ ടോപ്സ് ഉണ്ടോ?", "manglish"), ("ethra divasam edukum?", "manglish"),
             ("क्या आपके पास कॉटन कुर्ती है?", "hinglish"), ("kya price hai bhai?", "hinglish"),
             ("Do you deliver to Kerala?", "english")]
    assert each(spark, [c[0] for c in cases], voice=True) == [c[1] for c in cases]


def test_voice_after_typed_script_keeps_the_script(spark):
    rows = [("s", "t0", "user", "എന്താണ് വില?", T0, False), ("s", "t1", "user", "മലയാളം", T0 + dt.timedelta(seconds=1), True),
            ("s", "t2", "user", "क्या है यह", T0 + dt.timedelta(seconds=2), True)]
    df = spark.createDataFrame(rows, "session_id string, turn_id string, role string, content string, ts timestamp, is_voice boolean")
    got = {r.turn_id: r.language for r in S.detect_language(df).collect()}
    assert got == {"t0": "malayalam_script", "t1": "malayalam_script", "t2": "hindi_script"}


def test_language_follows_each_turn(spark):
    turns = [("user", "Keralathil delivery undo?"), ("assistant", "Athe, 2-3 daysil delivery undu."),
             ("user", "Achha, aur cotton tops ka price kya hai?"), ("assistant", "Pure cotton se shuru."),
             ("user", "What sizes do you have?"), ("assistant", "We have sizes S to XXL."), ("user", "ഓർഡർ എങ്ങനെ ചെയ്യണം?")]
    assert languages(spark, turns)[::2] == ["manglish", "hinglish", "english", "malayalam_script"]


SHORT = [("user", "Keralathil delivery undo?"), ("assistant", "Athe."), ("user", "ok"), ("assistant", "Welcome."), ("user", "ok"),
         ("user", "s")]


@pytest.mark.parametrize("max_rows", [1000, 2])
def test_short_replies_inherit(spark, max_rows):
    # The second "ok" follows an "ok" (same text) and an assistant turn; "s" follows an "ok".
    got = languages(spark, SHORT, max_rows=max_rows)
    assert [got[2], got[4], got[5]] == ["manglish", "english", "english"]


def test_short_reply_after_hinglish(spark):
    turns = [("user", "Bhai kurti ka rate kitna hai"), ("assistant", "Rates tak hain."), ("user", "OK")]
    assert languages(spark, turns)[2] == "hinglish"


def column(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_intents(spark):
    texts = ["Hello there!", "What is the delivery fee?", "Compare cotton and rayon step by step", "this one",
             "word " * 36, "good morning", "how are you doing today"]
    assert column(spark, texts, S.route_intent) == [
        "CHIT_CHAT", "RAG_QUERY", "DEEP_REASONING", "CHIT_CHAT", "DEEP_REASONING", "CHIT_CHAT", "RAG_QUERY"]


def test_flags(spark):
    voice = ["Please send a voice note", "Voice il parayumo", "Bolke batao please", "Solli anupunga", "Just send photo",
             "Do you ship to Kochi?", None]
    assert column(spark, voice, S.wants_voice_reply) == [True, True, True, True, False, False, False]
    assert column(spark, ["Who am I?!", "what is MY SIZE", "price"], S.asks_for_memory) == [True, True, False]
    assert column(spark, ["hii", "yo bro", "show me tops please"], S.is_greeting_only) == [True, True, False]


def test_sizes(spark):
    texts = ["size XXL please", "3xl?", "I'm fine", "m size undo", "size  s", "size l", "a medium one", "xs", "SIZE S", "extra", "xl"]
    assert column(spark, texts, S.extract_size) == ["XXL", "3XL", None, "M", None, "L", "M", "XS", "S", None, "XL"]


def test_profile_signals(spark):
    df = spark.createDataFrame([("I want to order a silk top, size m, to Kochi",), ("tracking?",), ("ok",)], "content string")
    a, b, c = S.profile_signals(df).collect()
    assert (a.stage, a.tags) == ("Ready to Order", ["High Intent", "Size:M", "Fabric:Silk", "Location:Kochi", "Lang:English"])
    assert (b.stage, b.tags, b.language_signal) == ("Support", ["Post-Purchase Support"], None)
    assert (c.stage, c.tags) == (None, [])


def test_clean_reply(spark):
    texts = ["Hey! Hum daily wear cotton Churidar tops offer karte hain.", "Tops ✨🌸 here 🌸", "Kerala-il undo, Kochi-yil shop-inte",
             "Good മ one-two", "വില only a", "pay-kku well-anu"]
    got = column(spark, texts, lambda t: S.clean_reply(t, F.lit("hinglish")))
    assert got == ["Hey! Hum daily wear cotton Churidar tops offer karte hain.", "Tops here", "Kerala yil undo, Kochi il shop inte",
                   "Good ma one two", "vaila only a", "paykku well anu"]
    hindi = "नमस्ते! हम डेली वियर टॉप्स  में।"
    assert column(spark, [hindi], lambda t: S.clean_reply(t, F.lit("hindi_script"))) == [hindi.replace("  ", " ")]


def test_reply_splitting_and_parsing(spark):
    assert column(spark, ["a\n\n b \n\n\n\nc", " one ", "\n\n"], S.split_reply) == [["a", "b"], ["one"], []]
    raw = ['```json\n{"messages": ["x", "y"]}\n```', '{"a": 1}', "plain ``` text", '{"messages": "no list"}', '{"messages": []}']
    assert column(spark, raw, S.parse_model_reply) == [["x", "y"], ['{"a": 1}'], ["plain ``` text"], ['{"messages": "no list"}'], []]


def test_size_scrub(spark):
    assert column(spark, ["is S size ok", "sizes", "size"], S.scrub_size_mentions) == [
        "is sizes S-XXL ok", "sizes S-XXL", "size"]


def test_canned_replies(spark):
    templates = spark.createDataFrame([("new", "english", "hello"), ("new", "*", "hi")], "state string, language string, reply string")
    rows = spark.createDataFrame([("new", "english"), ("new", "tanglish"), ("old", "english")], "state string, language string")
    got = {(r.state, r.language): r.reply for r in S.canned_replies(rows, templates).collect()}
    assert got == {("new", "english"): "hello", ("new", "tanglish"): "hi", ("old", "english"): None}


def test_signal_mix_and_single_pass(spark):
    df = spark.createDataFrame([("hello", "a"), ("price?", "a"), ("compare this", "b")], "content string, who string")
    labelled = S.label_messages(df)
    got = {(r.who, r.intent): (r.n, r.share) for r in S.signal_mix(labelled, "intent", ["who"]).collect()}
    assert got == {("a", "CHIT_CHAT"): (1, 0.5), ("a", "RAG_QUERY"): (1, 0.5), ("b", "CHIT_CHAT"): (1, 1.0)}
    assert "Exchange" not in labelled._jdf.queryExecution().executedPlan().toString()


def test_word_lists_are_whole():
    assert len(set(L.MANGLISH_WORDS)) == len(L.MANGLISH_WORDS)
    assert set(L.MANGLISH_PLACES) <= set(L.MANGLISH_WORDS)
