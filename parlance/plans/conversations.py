"""Registered queries on text signals, conversation memory and customer records."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..operators import crm, memory, prep, signals
from . import inputs as I
from .documents import ROUTER, _TOPICS_SQL, _router_sql
from .registry import query

# -- signals --------------------------------------------------------------------------------------

_BLOCKS = (("latin_accents", r"\x{00E0}-\x{00FF}"), ("german_sharp", r"\x{00DF}-\x{00DF}"),
           ("malayalam_script", r"\x{0D00}-\x{0D7F}"), ("hindi_script", r"\x{0900}-\x{097F}"),
           ("tamil_script", r"\x{0B80}-\x{0BFF}"), ("arabic_script", r"\x{0600}-\x{06FF}"))


def _count_sql(text: str, block: str) -> str:
    return f"CAST(length({text}) - length(regexp_replace({text}, '[{block}]', '', 'g')) AS INTEGER)"


def _dominant_sql(blocks) -> str:
    names = [b[0] for b in blocks]
    most = f"greatest({', '.join(names)})"
    whens = " ".join(f"WHEN {n} = {most} THEN '{n}'" for n in names)
    return f"CASE WHEN {most} >= 2 THEN CASE {whens} END END"


_COUNTS = ", ".join(f"{_count_sql('text', b)} AS {n}" for n, b in _BLOCKS)


@query("script_counts", f"""WITH counted AS (SELECT doc_id, {_COUNTS} FROM documents)
SELECT *, {_dominant_sql(_BLOCKS)} AS dominant FROM counted""")
def script_counts(spark, sf_dir):
    """Six blocks, among them two that occur in the texts."""
    counted = I.table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", signals.script_counts(F.col("text"), _BLOCKS).alias("c"))
    return counted.select("doc_id", "c.*", signals.dominant_script(F.col("c"), _BLOCKS).alias("dominant"))


# Families of words that occur in the texts stand in for the romanised languages.
LANGUAGES = L.LanguageLexicon(
    families=(("french", ("le", "la", "les", "des", "une", "dans", "avec", "pas")),
              ("german", ("der", "die", "und", "das", "von", "mit", "nicht", "sich")),
              ("spanish", ("el", "los", "las", "por", "con", "para", "del", "una"))),
    clothing=("le", "des"), clothing_cues=("the", "and", "of"),
    scripts=(("accented", r"\x{00F1}-\x{00F3}"), ("sharp", r"\x{00DF}-\x{00DF}"), ("umlaut", r"\x{00F6}-\x{00FC}"),
             ("telugu_script", r"\x{0C00}-\x{0C7F}"), ("kannada_script", r"\x{0C80}-\x{0CFF}"),
             ("arabic_script", r"\x{0600}-\x{06FF}")),
    voice_labels=(("accented", "spanish"), ("sharp", "german"), ("umlaut", "german")))

# The same ladder on one-word messages, where the short-reply rule decides most.
ONE_WORD = L.LanguageLexicon(
    families=(("f1", ("view",)), ("f2", ("purchase",)), ("f3", ("signup",))), clothing=(), clothing_cues=(),
    short_replies=("click", "error"))


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]" if words else "CAST([] AS VARCHAR[])"


def _language_sql(lexicon: L.LanguageLexicon, turns: str, voice: str) -> str:
    counts = ", ".join(f"{_count_sql('content', b)} AS {n}" for n, b in lexicon.scripts)
    (n1, w1), (n2, w2), (n3, w3) = lexicon.families
    spoken = lambda c: "CASE " + " ".join(f"WHEN {c} = '{s}' THEN '{v}'" for s, v in lexicon.voice_labels) + f" ELSE {c} END"
    first = lexicon.scripts[0][0]
    past = " ".join(f"""lag({{0}}, {i}) OVER w AS {{1}}{i},""" for i in (1, 2))
    return f"""counted AS (
  SELECT *, {counts}, list_distinct(regexp_extract_all(lower(content), '[a-zA-Z]+')) AS ws,
         {I.sql_strip('lower(content)')} AS clean, {voice} AS voice FROM {turns}),
voted AS (
  SELECT *, {_dominant_sql(lexicon.scripts)} AS script,
    list_intersect(ws, {_sql_list(w1)}) AS h1, len(list_intersect(ws, {_sql_list(w1)})) AS a,
    len(list_intersect(ws, {_sql_list(w2)})) AS b, len(list_intersect(ws, {_sql_list(w3)})) AS c FROM counted),
own AS (
  SELECT *, CASE WHEN a > 0 AND len(list_filter(h1, lambda x: NOT list_contains({_sql_list(lexicon.clothing)}, x))) = 0
                      AND list_has_any(ws, {_sql_list(lexicon.clothing_cues)}) THEN '{lexicon.default}'
                 WHEN b > a AND b >= c THEN '{n2}' WHEN c > a AND c >= b THEN '{n3}' WHEN a > 0 THEN '{n1}' END AS vote,
         list_contains({_sql_list(lexicon.short_replies)}, clean) AS short FROM voted),
past AS (
  SELECT *, {past.format('role', 'role_')} {past.format('clean', 'clean_')} {past.format('script', 'script_')} {past.format('vote', 'vote_')}
    count(*) FILTER (role = 'user' AND {first} >= 2) OVER (
      PARTITION BY session_id ORDER BY ts, turn_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS typed
  FROM own WINDOW w AS (PARTITION BY session_id ORDER BY ts, turn_id)),
labelled AS (
  SELECT *, CASE WHEN clean = '' THEN '{lexicon.default}' ELSE coalesce(
    CASE WHEN voice AND typed = 0 THEN {spoken('script')} ELSE script END, vote,
    CASE WHEN short THEN
      CASE WHEN role_1 = 'user' AND clean_1 <> clean THEN coalesce(CASE WHEN voice THEN {spoken('script_1')} ELSE script_1 END, vote_1, '{lexicon.default}')
           WHEN role_2 = 'user' AND clean_2 <> clean THEN coalesce(CASE WHEN voice THEN {spoken('script_2')} ELSE script_2 END, vote_2, '{lexicon.default}')
      END END, '{lexicon.default}') END AS language
  FROM past)"""


_SPOKEN_SQL = "length(content) % 2 = 1"


@query("language_labels", f"""WITH {I.SQL_TURNS}, {_language_sql(LANGUAGES, 'turns', _SPOKEN_SQL)}
SELECT turn_id, language FROM labelled""")
def language_labels(spark, sf_dir):
    """Texts of odd length are taken as spoken."""
    turns = I.turns(spark, sf_dir).withColumn("is_voice", F.length("content") % 2 == 1)
    return signals.detect_language(turns, LANGUAGES).select("turn_id", "language")


@query("short_reply_language", f"""WITH {I.SQL_EVENT_TURNS}, {_language_sql(ONE_WORD, 'turns', 'FALSE')}
SELECT turn_id, language FROM labelled""")
def short_reply_language(spark, sf_dir):
    return signals.detect_language(I.event_turns(spark, sf_dir), ONE_WORD).select("turn_id", "language")


@query("language_mix", f"""WITH {I.SQL_TURNS}, {_language_sql(LANGUAGES, 'turns', 'FALSE')},
counts AS (SELECT role, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, language, count(*) AS n FROM labelled GROUP BY ALL)
SELECT role, week, language, n, round(n / sum(n) OVER (PARTITION BY role, week), 6) AS share FROM counts""")
def language_mix(spark, sf_dir):
    """Languages per role and week."""
    labelled = signals.detect_language(I.turns(spark, sf_dir), LANGUAGES).withColumn(
        "week", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))
    return signals.signal_mix(labelled, "language", ["role", "week"]).withColumn("share", F.round("share", 6))


PROFILE = L.ProfileLexicon(
    fabrics=("widget", "gear", "bolt", "gizmo"), locations=("red", "blue", "hot", "small"),
    stages=(("Ready to Order", "High Intent", ("promo",)), ("Support", "Post-Purchase Support", ("economy", "ring")),
            ("Browsing", "Shopper", ("large", "standard"))),
    romanised=("promo",), english_cues=("gear",))


def _cap(word: str) -> str:
    return f"upper(substr({word}, 1, 1)) || lower(substr({word}, 2))"


def _first_sql(text: str, words) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{w}') THEN '{w}'" for w in words) + " END"


def _any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _size_sql(text: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{s}'" for p, s in L.SIZE_PATTERNS)
    letters = L.SIZE_LETTER_PATTERN.replace("(?<![a-zA-Z'])", "")
    hit = f"regexp_extract({text}, '(?:^|[^a-zA-Z''])({letters[2:]})', 1)"
    return (f"CASE {whens} WHEN contains({hit}, 'xl') THEN 'XL' " + " ".join(
        f"WHEN contains({hit}, 'size {c}') OR contains({hit}, '{c} size') THEN '{c.upper()}'" for c in "lms") + " END")


_PARTS_SQL = """messages AS (
  SELECT p_partkey AS event_id, 'u' || (p_partkey // 10) AS user_id, make_timestamp(1704067200000000 + p_partkey * 1000000) AS ts,
         p_type || ' ' || p_name || CASE WHEN p_size < 10 THEN ' size m' WHEN p_size < 20 THEN ' i''m not xs' WHEN p_size < 30 THEN ' l size' ELSE '' END AS content
  FROM part)"""


def _part_messages(spark, sf_dir):
    """Part descriptions as messages with size mentions."""
    size = F.col("p_size")
    hint = F.when(size < 10, " size m").when(size < 20, " i'm not xs").when(size < 30, " l size").otherwise("")
    return I.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("event_id"), F.concat(F.lit("u"), F.floor(F.col("p_partkey") / 10)).alias("user_id"),
        F.timestamp_seconds(F.lit(I.EPOCH) + F.col("p_partkey")).alias("ts"),
        F.concat("p_type", F.lit(" "), "p_name", hint).alias("content"))


def _signals_sql(lexicon: L.ProfileLexicon) -> str:
    stage = "CASE " + " ".join(f"WHEN {_any_sql('clean', w)} THEN '{s}'" for s, _, w in lexicon.stages) + " END"
    tag = "CASE " + " ".join(f"WHEN {_any_sql('clean', w)} THEN '{t}'" for _, t, w in lexicon.stages) + " END"
    words = "list_distinct(regexp_extract_all(clean, '[a-zA-Z]+'))"
    language = (f"CASE WHEN {_count_sql('content', lexicon.script_block)} >= 2 THEN '{lexicon.script_label}' "
                f"WHEN list_has_any({words}, {_sql_list(lexicon.romanised)}) THEN '{lexicon.romanised_label}' "
                f"WHEN list_has_any({words}, {_sql_list(lexicon.english_cues)}) OR len({words}) >= 2 THEN '{lexicon.english_label}' END")
    return f"""lowered AS (SELECT *, lower(content) AS clean FROM messages),
found AS (
  SELECT *, {_size_sql('clean')} AS size, {_first_sql('clean', lexicon.fabrics)} AS fabric_word,
         {_first_sql('clean', lexicon.locations)} AS location_word, {language} AS language_signal,
         {stage} AS stage, {tag} AS stage_tag FROM lowered),
signals AS (
  SELECT event_id, user_id, ts, size, {_cap('fabric_word')} AS fabric, {_cap('location_word')} AS location, language_signal, stage,
         list_filter([stage_tag, 'Size:' || size, 'Fabric:' || {_cap('fabric_word')}, 'Location:' || {_cap('location_word')},
                      'Lang:' || {_cap('language_signal')}], lambda x: x IS NOT NULL) AS tags
  FROM found)"""


@query("profile_signals", f"""WITH {_PARTS_SQL}, {_signals_sql(PROFILE)}
SELECT event_id, size, fabric, location, language_signal, stage, array_to_string(tags, ' / ') AS tags FROM signals""")
def profile_signals(spark, sf_dir):
    return signals.profile_signals(_part_messages(spark, sf_dir), PROFILE).select(
        "event_id", "size", "fabric", "location", "language_signal", "stage", F.array_join("tags", " / ").alias("tags"))


@query("message_profiles", f"""WITH {_PARTS_SQL}, {_signals_sql(PROFILE)}, tag_sets AS (
  SELECT user_id, string_agg(t, ' / ' ORDER BY t) AS tags FROM (SELECT DISTINCT user_id, unnest(tags) AS t FROM signals) GROUP BY 1)
SELECT s.user_id, arg_max(size, ts) FILTER (size IS NOT NULL) AS preferred_size, arg_max_null(fabric, ts) AS preferred_fabric,
  coalesce(arg_max(stage, ts) FILTER (stage IS NOT NULL), 'New Lead') AS stage,
  coalesce(arg_max(language_signal, ts) FILTER (language_signal IS NOT NULL), 'english') AS preferred_language,
  count(*) AS total_turns, any_value(t.tags) AS tags
FROM signals s LEFT JOIN tag_sets t USING (user_id) GROUP BY s.user_id""")
def message_profiles(spark, sf_dir):
    """Messages to customer records: signals, then the fold."""
    events = crm.events_from_messages(signals.profile_signals(_part_messages(spark, sf_dir), PROFILE))
    return crm.fold_customers(events).select(
        "user_id", "preferred_size", "preferred_fabric", "stage", "preferred_language", "total_turns",
        F.array_join("tags", " / ").alias("tags"))


@query("profile_language", f"""SELECT doc_id, CASE
  WHEN {_count_sql('text', L.SCRIPT_BLOCKS[0][1])} >= 2 THEN 'malayalam_script'
  WHEN list_has_any(regexp_extract_all(lower(text), '[a-zA-Z]+'), {_sql_list(L.PROFILE_MANGLISH_WORDS)}) THEN 'manglish'
  WHEN list_has_any(regexp_extract_all(lower(text), '[a-zA-Z]+'), {_sql_list(L.PROFILE_ENGLISH_CUES)})
    OR len(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z]+'))) >= 2 THEN 'english' END AS language_signal FROM documents""")
def profile_language(spark, sf_dir):
    """The coarser detector with its default lists, on the documents."""
    return I.table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", signals.profile_language(F.col("text")).alias("language_signal"))


_GREETINGS = ("und", "das", "the", "de")
_PROBES = ("the haed", "queai", "ungen und", "la le")
_VOICE = ("thion", "reaux", "schen", "ción")
_CLEAN_END = f"regexp_replace({I.sql_strip('lower(content)')}, '[!.,? ]+$', '')"


@query("intent_and_flags", f"""WITH {I.SQL_TURNS}, routed AS (
  SELECT turn_id, content, {_router_sql('content')} AS intent, {I.sql_strip('lower(content)')} AS clean FROM turns)
SELECT turn_id, intent, CASE intent WHEN 'DEEP_REASONING' THEN 'deep' ELSE 'fast' END AS model_tier,
  clean IN {tuple(_GREETINGS)} OR (len({I.sql_words('clean')}) <= 2 AND {_any_sql('clean', _GREETINGS)}) AS greeting_only,
  {_any_sql(_CLEAN_END, _PROBES)} AS asks_for_memory, {_any_sql('lower(content)', _VOICE)} AS wants_voice_reply
FROM routed""")
def intent_and_flags(spark, sf_dir):
    labelled = signals.label_messages(I.turns(spark, sf_dir), router=ROUTER, greetings=_GREETINGS, probes=_PROBES, voice=_VOICE)
    return labelled.select("turn_id", "intent", "model_tier", "greeting_only", "asks_for_memory", "wants_voice_reply")


@query("intent_mix", f"""WITH {I.SQL_TURNS}, counts AS (SELECT role, {_router_sql('content')} AS intent, count(*) AS n FROM turns GROUP BY ALL)
SELECT role, intent, n, round(n / sum(n) OVER (PARTITION BY role), 6) AS share FROM counts""")
def intent_mix(spark, sf_dir):
    labelled = I.turns(spark, sf_dir).withColumn("intent", signals.route_intent(F.col("content"), ROUTER))
    return signals.signal_mix(labelled, "intent", ["role"]).withColumn("share", F.round("share", 6))


@query("clean_replies", f"""WITH marked AS (
  SELECT doc_id, lang, replace(replace(text, 'the ', 'the ✨🌸 '), ' de', ' സുഖം de') AS t FROM documents),
bare AS (SELECT *, regexp_replace(t, '[\\x{{2728}}\\x{{1F338}}\\x{{1F4AB}}\\x{{1F31F}}\\x{{1F33C}}\\x{{1F389}}]+', '', 'g') AS b FROM marked),
spelled AS (
  SELECT *, CASE WHEN length(regexp_replace(b, '[^a-zA-Z]', '', 'g')) > 0
      AND length(regexp_replace(b, '[^a-zA-Z]', '', 'g')) >= length(regexp_replace(b, '[^\\x{{0D00}}-\\x{{0D7F}}]', '', 'g'))
    THEN regexp_replace(replace(replace(replace(b, 'ം', 'm'), 'ു', 'u'), 'സ', 'sa'), '[\\x{{0D00}}-\\x{{0D7F}}]', '', 'g') ELSE b END AS s FROM bare),
hyphens AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s,
    '(?i)\\b([A-Za-z]+)-(te|nte|inte)\\b', '\\1 inte', 'g'), '(?i)\\bKerala-il\\b', 'Kerala yil', 'g'),
    '(?i)\\b([A-Za-z]+)-(il|yil)\\b', '\\1 il', 'g'), '(?i)\\b([A-Za-z]+)-(kku|ku)\\b', '\\1kku', 'g'),
    '(?i)\\b([A-Za-z]+)-(anu|aanu|alla)\\b', '\\1 \\2', 'g'), '([A-Za-z]{{2,}})-([A-Za-z]{{2,}})', '\\1 \\2', 'g') AS h FROM spelled)
SELECT doc_id, md5({I.sql_strip("regexp_replace(CASE WHEN lang = 'en' THEN b ELSE h END, ' +', ' ', 'g')")}) AS reply_md5 FROM hyphens""")
def clean_replies(spark, sf_dir):
    """Documents with signs and foreign letters put in; English ones only lose the signs."""
    docs = I.table(spark, sf_dir, "documents", "doc_id")
    text = F.replace(F.replace(F.col("text"), F.lit("the "), F.lit("the ✨🌸 ")), F.lit(" de"), F.lit(" സുഖം de"))
    language = F.when(F.col("lang") == "en", "english").otherwise("manglish")
    return docs.select("doc_id", F.md5(signals.clean_reply(text, language)).alias("reply_md5"))


@query("scrub_sizes", """SELECT p_partkey, regexp_replace(t, '(?i)\\b(size\\s*S|S\\s*size)\\b', 'sizes S-XXL', 'g') AS scrubbed
FROM (SELECT p_partkey, p_name || ' Size s, ' || p_type || ' size' AS t FROM part)""")
def scrub_sizes(spark, sf_dir):
    text = F.concat("p_name", F.lit(" Size s, "), "p_type", F.lit(" size"))
    return I.table(spark, sf_dir, "part").select("p_partkey", signals.scrub_size_mentions(text).alias("scrubbed"))


@query("split_replies", f"""WITH paired AS (SELECT conv_id, turn, replace(text, chr(10), chr(10) || chr(10)) AS t FROM conversations),
pieces AS (
  SELECT conv_id, turn, CASE WHEN contains(t, chr(10) || chr(10))
    THEN list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda p: {I.sql_strip('p')}), lambda p: p <> '')[1:2]
    ELSE [{I.sql_strip('t')}] END AS p FROM paired)
SELECT conv_id, turn, CAST(generate_subscripts(p, 1) AS INTEGER) AS part, md5(unnest(p)) AS part_md5 FROM pieces""")
def split_replies(spark, sf_dir):
    """Lines as paragraphs of replies."""
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    pieces = I.table(spark, sf_dir, "conversations", "conv_id").select(
        "conv_id", "turn", F.posexplode(signals.split_reply(text)).alias("i", "p"))
    return pieces.select("conv_id", "turn", (F.col("i") + 1).alias("part"), F.md5("p").alias("part_md5"))


@query("parse_replies", f"""WITH parsed AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN string_split(text, chr(10))
    WHEN 'assistant' THEN [CAST(to_json({{'answer': text}}) AS VARCHAR)] ELSE [text] END AS m FROM conversations)
SELECT conv_id, turn, CAST(len(m) AS INTEGER) AS messages, md5(array_to_string(m, '|')) AS messages_md5 FROM parsed""")
def parse_replies(spark, sf_dir):
    """User texts as fenced JSON with a list, assistant texts as other JSON, the rest as no JSON."""
    turns = I.table(spark, sf_dir, "conversations", "conv_id")
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.split("text", "\n").alias("messages"))), F.lit("\n```"))
    output = (F.when(F.col("role") == "user", fenced)
              .when(F.col("role") == "assistant", F.to_json(F.struct(F.col("text").alias("answer")))).otherwise(F.col("text")))
    parsed = turns.select("conv_id", "turn", signals.parse_model_reply(output).alias("m"))
    return parsed.select("conv_id", "turn", F.size("m").alias("messages"), F.md5(F.array_join("m", "|")).alias("messages_md5"))


_STATES = ("first_contact", "returning_session", "active_ongoing")


@query("canned_replies", f"""WITH {I.SQL_EVENT_TURNS}, {_language_sql(ONE_WORD, 'turns', 'FALSE')}, timed AS (
  SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY ts, turn_id) AS before FROM labelled),
states AS (
  SELECT turn_id, language, CASE WHEN before IS NULL THEN 'first_contact'
    WHEN epoch_us(ts) - epoch_us(before) > 10800000000 THEN 'returning_session' ELSE 'active_ongoing' END AS state
  FROM timed WHERE role = 'user')
SELECT turn_id, state, language, state || ' ' || CASE WHEN language IN ('english', 'f2') THEN language ELSE 'any' END AS reply FROM states""")
def canned_replies(spark, sf_dir):
    """Reply templates by lifecycle state and language, with a row per state for all other languages."""
    templates = spark.createDataFrame(
        [(s, l, f"{s} {'any' if l == '*' else l}") for s in _STATES for l in ("english", "f2", "*")],
        "state string, language string, reply string")
    turns = signals.detect_language(I.event_turns(spark, sf_dir), ONE_WORD)
    states = memory.session_lifecycle(turns).withColumnRenamed("lifecycle_state", "state")
    return signals.canned_replies(states, templates).select("turn_id", "state", "language", "reply")


# -- memory ---------------------------------------------------------------------------------------

@query("turn_log_upsert", """WITH log AS (
  SELECT user_id || '/' || event_type AS turn_id, ts, event_type || ' ' || event_id AS content, 0 AS fresh FROM events
  UNION ALL
  SELECT user_id || '/' || event_type, ts, 'revised ' || event_id, 1 FROM events WHERE value > 20)
SELECT turn_id, epoch_us(ts) AS at, content FROM log
QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY ts DESC, fresh DESC) = 1""")
def turn_log_upsert(spark, sf_dir):
    """One turn id per user and type; later and revised turns replace earlier ones."""
    e = I.table(spark, sf_dir, "events")
    key = F.concat("user_id", F.lit("/"), "event_type").alias("turn_id")
    log = e.select(key, "ts", F.concat("event_type", F.lit(" "), "event_id").alias("content"))
    new = e.filter(F.col("value") > 20).select(key, "ts", F.concat(F.lit("revised "), "event_id").alias("content"))
    return memory.upsert_turns(log, new).select("turn_id", F.unix_micros("ts").alias("at"), "content")


@query("session_history", f"""WITH {I.SQL_TURNS}
SELECT session_id, turn_id, md5(content) AS content_md5,
       CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, turn_id) AS INTEGER) AS position FROM turns QUALIFY position <= 3""")
def session_history(spark, sf_dir):
    return memory.session_history(I.turns(spark, sf_dir), 3).select(
        "session_id", "turn_id", F.md5("content").alias("content_md5"), "position")


@query("event_history", f"""WITH {I.SQL_EVENT_TURNS}
SELECT session_id, turn_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, turn_id) AS INTEGER) AS position FROM turns
QUALIFY position <= 20""")
def event_history(spark, sf_dir):
    return memory.session_history(I.event_turns(spark, sf_dir)).select("session_id", "turn_id", "position")


@query("context_window", f"""WITH {I.SQL_EVENT_TURNS}
SELECT session_id, turn_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, turn_id DESC) AS INTEGER) AS from_end FROM turns
QUALIFY from_end <= 10""")
def context_window(spark, sf_dir):
    return memory.context_window(I.event_turns(spark, sf_dir)).select("session_id", "turn_id", "from_end")


@query("turns_per_user", f"WITH {I.SQL_TURNS} SELECT user_id, count(*) AS turns FROM turns GROUP BY 1")
def turns_per_user(spark, sf_dir):
    return memory.turns_per_user(I.turns(spark, sf_dir))


@query("last_turn_times", f"""WITH {I.SQL_EVENT_TURNS}, {I.SQL_TURNS.replace('turns AS', 'talks AS')}
SELECT 'session' AS kind, session_id AS id, epoch_us(max(ts)) AS at FROM turns GROUP BY 2
UNION ALL SELECT 'user', user_id, epoch_us(max(ts)) FROM talks GROUP BY 2""")
def last_turn_times(spark, sf_dir):
    by_session = memory.last_turn_times(I.event_turns(spark, sf_dir), "session_id").select(
        F.lit("session").alias("kind"), F.col("session_id").alias("id"), F.unix_micros("last_turn_at").alias("at"))
    by_user = memory.last_turn_times(I.turns(spark, sf_dir), "user_id").select(
        F.lit("user").alias("kind"), F.col("user_id").alias("id"), F.unix_micros("last_turn_at").alias("at"))
    return by_session.unionByName(by_user)


_LIFECYCLE_SQL = """timed AS (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY ts, turn_id) AS before FROM turns),
states AS (
  SELECT *, CASE WHEN before IS NULL THEN 'first_contact'
    WHEN epoch_us(ts) - epoch_us(before) > 10800000000 THEN 'returning_session' ELSE 'active_ongoing' END AS lifecycle_state
  FROM timed WHERE role = 'user'),
islands AS (
  SELECT *, sum(CASE WHEN lifecycle_state <> 'active_ongoing' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, turn_id) AS session_no
  FROM states)
SELECT turn_id, session_id, lifecycle_state, lifecycle_state <> 'active_ongoing' AS is_first_turn_of_session,
  coalesce((epoch_us(ts) - epoch_us(before)) // 1000000, 0) AS idle_seconds, CAST(session_no AS BIGINT) AS session_no,
  row_number() OVER (PARTITION BY session_id, session_no ORDER BY ts, turn_id) AS turn_count FROM islands"""


def _lifecycle(turns):
    return memory.session_lifecycle(turns).select(
        "turn_id", "session_id", "lifecycle_state", "is_first_turn_of_session", "idle_seconds", "session_no", "turn_count")


@query("session_lifecycle", f"WITH {I.SQL_EVENT_TURNS}, {_LIFECYCLE_SQL}")
def session_lifecycle(spark, sf_dir):
    return _lifecycle(I.event_turns(spark, sf_dir))


@query("conversation_lifecycle", f"WITH {I.SQL_TURNS}, {_LIFECYCLE_SQL}")
def conversation_lifecycle(spark, sf_dir):
    return _lifecycle(I.turns(spark, sf_dir))


_SESSIONS_SQL = """gaps AS (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts) <= 10800000000 THEN 0 ELSE 1 END AS starts
  FROM turns),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY session_id ORDER BY ts) AS n FROM gaps)
SELECT session_id, epoch_us(min(ts)) AS started_at, epoch_us(max(ts)) AS ended_at, count(*) AS turns FROM numbered GROUP BY session_id, n"""


def _session_rows(sessions):
    return sessions.select("session_id", F.unix_micros("started_at").alias("started_at"),
                           F.unix_micros("ended_at").alias("ended_at"), "turns")


@query("sessions", f"WITH {I.SQL_EVENT_TURNS}, {_SESSIONS_SQL}")
def sessions(spark, sf_dir):
    return _session_rows(memory.sessions(I.event_turns(spark, sf_dir)))


@query("active_sessions", f"""WITH {I.SQL_EVENT_TURNS}
SELECT count(DISTINCT session_id) AS active_sessions FROM turns WHERE ts >= TIMESTAMP '2024-01-30 12:00:00'""")
def active_sessions(spark, sf_dir):
    return memory.active_sessions(I.event_turns(spark, sf_dir), F.lit("2024-01-30 12:00:00").cast("timestamp"))


@query("profile_topics", f"WITH {I.SQL_TURNS}, {_TOPICS_SQL} SELECT user_id, messages, coalesce(topics, '') AS topics, profile_summary FROM profiles")
def profile_topics(spark, sf_dir):
    return memory.consolidate_profiles(I.turns(spark, sf_dir)).select(
        "user_id", "messages", F.array_join("key_topics", ", ").alias("topics"), "profile_summary")


@query("profile_upsert", f"""WITH {I.SQL_TURNS}, {_TOPICS_SQL},
old AS (SELECT DISTINCT user_id, 'old ' || user_id AS profile_summary FROM turns WHERE role = 'system')
SELECT coalesce(p.user_id, o.user_id) AS user_id, coalesce(p.profile_summary, o.profile_summary) AS profile_summary,
  CASE WHEN o.user_id IS NULL THEN 0 ELSE 3 END + CASE WHEN p.user_id IS NULL THEN 0 ELSE 1 END AS interaction_count,
  CASE WHEN p.user_id IS NULL THEN 'before' ELSE 'now' END AS updated
FROM old o FULL JOIN profiles p USING (user_id)""")
def profile_upsert(spark, sf_dir):
    """Users with a system turn have a profile from three runs already."""
    turns = I.turns(spark, sf_dir)
    old = turns.filter(F.col("role") == "system").select("user_id").distinct().select(
        "user_id", F.concat(F.lit("old "), "user_id").alias("profile_summary"),
        F.array().cast("array<string>").alias("key_topics"), F.lit(3).alias("interaction_count"), F.lit("before").alias("last_updated"))
    return memory.upsert_profiles(old, memory.consolidate_profiles(turns), F.lit("now")).select(
        "user_id", "profile_summary", "interaction_count", F.col("last_updated").alias("updated"))


@query("memory_view", f"""WITH {I.SQL_TURNS}, {_TOPICS_SQL}, recent AS (
  SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, turn_id DESC) <= 5)
SELECT session_id, r.user_id, md5(string_agg(role || ': ' || content, '|' ORDER BY ts, turn_id)) AS window_md5, any_value(p.profile_summary) AS profile_summary
FROM recent r LEFT JOIN profiles p ON p.user_id = r.user_id GROUP BY 1, 2""")
def memory_view(spark, sf_dir):
    turns = I.turns(spark, sf_dir)
    view = memory.memory_view(turns, memory.consolidate_profiles(turns), 5)
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["content"]))
    return view.select("session_id", "user_id", F.md5(F.array_join(said, "|")).alias("window_md5"), "profile_summary")


@query("cleared_sessions", f"""WITH {I.SQL_TURNS}
SELECT turn_id FROM turns WHERE session_id NOT IN (SELECT session_id FROM turns WHERE role = 'system')""")
def cleared_sessions(spark, sf_dir):
    """Sessions that began with a system turn are dropped."""
    turns = I.turns(spark, sf_dir)
    return memory.clear_sessions(turns, turns.filter(F.col("role") == "system")).select("turn_id")


# -- customer records -----------------------------------------------------------------------------

_CUSTOMER_COLUMNS = ("user_id, preferred_size, preferred_fabric, preferred_language, location, stage, total_turns, "
                     "epoch_us(last_active) AS last_active, array_to_string(tags, ',') AS tags, notes")


def customer_rows(customers):
    return customers.withColumn("last_active", F.unix_micros("last_active")).withColumn("tags", F.array_join("tags", ","))


@query("crm_fold", f"WITH {I.SQL_CUSTOMERS} SELECT {_CUSTOMER_COLUMNS} FROM customers")
def crm_fold(spark, sf_dir):
    return customer_rows(crm.fold_customers(I.profile_events(spark, sf_dir)))


@query("crm_incremental", f"WITH {I.SQL_CUSTOMERS} SELECT {_CUSTOMER_COLUMNS} FROM customers")
def crm_incremental(spark, sf_dir):
    """The second half of the month folded, the first half merged into it."""
    events = I.profile_events(spark, sf_dir)
    middle = F.lit("2024-01-16").cast("timestamp")
    known = crm.fold_records(events.filter(F.col("ts") >= middle))
    return customer_rows(crm.customers_of(crm.merge_customers(known, events.filter(F.col("ts") < middle))))


@query("crm_tagged", f"""WITH {I.SQL_PROFILE_EVENTS.replace('profile_events AS', 'event_rows AS')}, profile_events AS (
  SELECT * FROM event_rows UNION ALL
  SELECT CAST(user_id AS VARCHAR), max(ts) + INTERVAL 1 HOUR, max(event_id) + 1000000000, NULL, NULL, NULL, NULL, NULL, ['vip'], NULL
  FROM events WHERE event_type = 'purchase' GROUP BY 1), {I.SQL_FOLD}
SELECT {_CUSTOMER_COLUMNS} FROM customers""")
def crm_tagged(spark, sf_dir):
    """Buyers tagged by hand an hour after their last purchase."""
    tags = I.table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").groupBy(
        F.col("user_id").cast("string").alias("user_id")).agg(
        (F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), (F.max("event_id") + 1_000_000_000).alias("event_id")).select(
        "*", F.array(F.lit("vip")).alias("tags"), F.lit(None).cast("string").alias("notes"))
    events = I.profile_events(spark, sf_dir).unionByName(crm.tag_events(tags))
    return customer_rows(crm.fold_customers(events))


@query("crm_list", f"""WITH {I.SQL_CUSTOMERS}
SELECT user_id, preferred_size, location, stage, total_turns, epoch_us(last_active) AS last_active FROM customers
WHERE stage = 'Support' AND preferred_size = 'L' AND contains(lower(location), 'town') ORDER BY customers.last_active DESC, user_id LIMIT 50 OFFSET 2""")
def crm_list(spark, sf_dir):
    page = crm.list_customers(crm.fold_customers(I.profile_events(spark, sf_dir)), "Support", "l", "TOWN", 50, 2)
    return page.select("user_id", "preferred_size", "location", "stage", "total_turns", F.unix_micros("last_active").alias("last_active"))


@query("crm_stats", f"""WITH {I.SQL_CUSTOMERS}
SELECT 'total' AS kind, NULL AS value, count(*) AS customers FROM customers
UNION ALL SELECT 'stage', stage, count(*) FROM customers GROUP BY 2
UNION ALL SELECT 'size', preferred_size, count(*) FROM customers WHERE preferred_size IS NOT NULL GROUP BY 2""")
def crm_stats(spark, sf_dir):
    return crm.customer_stats(crm.fold_customers(I.profile_events(spark, sf_dir)))


@query("crm_dossiers", f"""WITH {I.SQL_CUSTOMERS}, {I.SQL_EVENT_TURNS}, recent AS (
  SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, turn_id DESC) <= 10),
lists AS (SELECT session_id, string_agg(role || ':' || content, ' ' ORDER BY ts, turn_id) AS recent FROM recent GROUP BY 1)
SELECT user_id, preferred_language, stage, total_turns, recent FROM customers LEFT JOIN lists ON session_id = user_id""")
def crm_dossiers(spark, sf_dir):
    view = crm.dossiers(crm.fold_customers(I.profile_events(spark, sf_dir)), I.event_turns(spark, sf_dir))
    said = F.transform("recent_turns", lambda t: F.concat(t["role"], F.lit(":"), t["content"]))
    return view.select("user_id", "preferred_language", "stage", "total_turns", F.array_join(said, " ").alias("recent"))


@query("crm_notes", """SELECT CAST(user_id AS VARCHAR) AS sender_id, 'Customer ' || user_id AS customer_name,
  event_type || ' ' || value AS profile_notes, epoch_us(ts) AS last_interaction FROM events WHERE event_type IN ('purchase', 'signup')
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""")
def crm_notes(spark, sf_dir):
    notes = I.table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "signup")).select(
        F.col("user_id").cast("string").alias("sender_id"), F.concat(F.lit("Customer "), "user_id").alias("customer_name"),
        F.concat("event_type", F.lit(" "), "value").alias("profile_notes"), "ts")
    return crm.upsert_notes(notes).withColumn("last_interaction", F.unix_micros("last_interaction"))


@query("health", f"""WITH {I.SQL_CHUNKS}
SELECT (SELECT count(DISTINCT user_id) FROM events) AS active_sessions, (SELECT count(DISTINCT user_id) FROM events) AS total_crm_customers,
       (SELECT count(*) FROM chunks) AS indexed_vectors""")
def health(spark, sf_dir):
    return crm.health(I.event_turns(spark, sf_dir), crm.fold_customers(I.profile_events(spark, sf_dir)),
                      prep.with_point_id(I.chunks(spark, sf_dir)))
