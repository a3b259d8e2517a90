"""Signals read from message texts: language, intent, preferences, flags, reply clean-up.

All but the history-dependent language rules are row-wise expressions, so one pass over the
messages computes them together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import lexicons as L
from ..functions.ordered import MAX_ROWS, keyed, with_history
from ..functions.text import (
    contains_any, first_contained, has_text, latin_words, space_words, spelled_out, strip, word_array)


# -- language -------------------------------------------------------------------------------------

def block_count(text: Column, block: str) -> Column:
    """Characters of ``text`` inside a Unicode block."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{block}]", ""))


def script_counts(text: Column, scripts=L.SCRIPT_BLOCKS) -> Column:
    return F.struct(*[block_count(text, block).alias(label) for label, block in scripts])


def dominant_script(counts: Column, scripts=L.SCRIPT_BLOCKS) -> Column:
    """The script with the most characters, the earlier one on a tie; null below two characters."""
    most = F.greatest(*[counts[label] for label, _ in scripts])
    label = reduce(lambda acc, s: F.when(counts[s[0]] == most, s[0]).otherwise(acc), reversed(scripts),
                   F.lit(None).cast("string"))
    return F.when(most >= 2, label)


def _votes(words: Column, lexicon: L.LanguageLexicon) -> Column:
    """Romanised label by votes of distinct words; null without any."""
    (first, first_words), (second, second_words), (third, third_words) = lexicon.families
    hits = F.array_intersect(words, word_array(first_words))
    a, b, c = F.size(hits), F.size(F.array_intersect(words, word_array(second_words))), F.size(
        F.array_intersect(words, word_array(third_words)))
    clothing_only = (a > 0) & (F.size(F.array_except(hits, word_array(lexicon.clothing))) == 0)
    english = clothing_only & F.arrays_overlap(words, word_array(lexicon.clothing_cues))
    return (F.when(english, lexicon.default)
            .when((b > a) & (b >= c), second)
            .when((c > a) & (c >= b), third)
            .when(a > 0, first))


def detect_language(turns: DataFrame, lexicon: L.LanguageLexicon = L.LanguageLexicon(),
                    max_rows: int = MAX_ROWS) -> DataFrame:
    """Adds ``language`` to turns ``(session_id, ts, turn_id, role, content)``.

    ``is_voice`` and ``preferred_language`` are used if present. The ladder: blank text gives the
    preferred language or the default; a dominant script gives its label, for voice its romanised
    one unless a user turn among the last four was typed in the first script; then votes of
    romanised words; then, for a short reply, the language of a user turn among the last two whose
    text differs, judged without its own history; else the default.
    """
    text = F.col("content")
    has_voice = "is_voice" in turns.columns
    voice = F.coalesce(F.col("is_voice"), F.lit(False)) if has_voice else F.lit(False)
    preferred = F.col("preferred_language") if "preferred_language" in turns.columns else F.lit(None).cast("string")
    first_script = lexicon.scripts[0][0]

    # What a turn says by itself; read once here and carried to later turns as a small struct.
    own = (
        turns.withColumn("_counts", script_counts(F.coalesce(text, F.lit("")), lexicon.scripts))
        .withColumn("_words", latin_words(F.coalesce(text, F.lit(""))))
        .withColumn("_script", dominant_script(F.col("_counts"), lexicon.scripts))
        .withColumn("_vote", _votes(F.col("_words"), lexicon))
        .withColumn("_native", F.col("_counts")[first_script] >= 2)
        .withColumn("_clean", strip(F.lower(text)))
        .withColumn("_short", F.coalesce(F.col("_clean").isin(*lexicon.short_replies), F.lit(False)))
        .drop("_words", "_counts"))
    note = F.struct(
        (F.col("role") == "user").alias("user"),
        F.col("_native").alias("native"),
        F.when(F.col("_short"), F.col("_clean")).alias("short_text"),
        F.col("_script").alias("script"),
        F.when(has_text(text), F.col("_vote")).alias("vote"))
    order = ["ts", "turn_id"]
    past = with_history(keyed(own, ["session_id"], order, max_rows), order, 4, note, "_past").rows()

    def romanised(script: Column) -> Column:
        out = script
        for label, spoken in lexicon.voice_labels:
            out = F.when(script == label, F.lit(spoken)).otherwise(out)
        return out

    typed_native = F.exists("_past", lambda t: t["user"] & t["native"])
    script_label = F.when(voice & ~typed_native, romanised(F.col("_script"))).otherwise(F.col("_script"))
    # The last two entries, newest first; the inner test keeps other texts than this one's.
    recent = F.filter(
        F.reverse(F.slice("_past", F.greatest(F.size("_past") - 1, F.lit(1)), F.lit(2))),
        lambda t: t["user"] & ~F.coalesce(t["short_text"] == F.col("_clean"), F.lit(False)))
    source = F.get(recent, 0)
    inherited = F.when(F.size(recent) > 0, F.coalesce(
        F.when(voice, romanised(source["script"])).otherwise(source["script"]), source["vote"],
        F.lit(lexicon.default)))
    language = (F.when(~has_text(text), F.coalesce(preferred, F.lit(lexicon.default)))
                .otherwise(F.coalesce(script_label, F.col("_vote"), F.when(F.col("_short"), inherited),
                                      F.lit(lexicon.default))))
    return past.withColumn("language", language).drop(
        "_script", "_vote", "_native", "_clean", "_short", "_past")


def profile_language(text: Column, lexicon: L.ProfileLexicon = L.ProfileLexicon()) -> Column:
    """The coarser detector that feeds profiles; null if there is no sign."""
    words = latin_words(text)
    romanised = F.arrays_overlap(words, word_array(lexicon.romanised))
    return (F.when(block_count(text, lexicon.script_block) >= 2, lexicon.script_label)
            .when(romanised, lexicon.romanised_label)
            .when(F.arrays_overlap(words, word_array(lexicon.english_cues)) | (F.size(words) >= 2),
                  lexicon.english_label))


# -- intent and flags -----------------------------------------------------------------------------

def _greeting(clean: Column, greetings) -> Column:
    """A greeting as such, or at most two words with a greeting anywhere inside them."""
    return clean.isin(*greetings) | ((F.size(space_words(clean)) <= 2) & contains_any(clean, greetings))


def route_intent(text: Column, lexicon: L.RouterLexicon = L.RouterLexicon()) -> Column:
    clean = strip(F.lower(text))
    deep = contains_any(clean, lexicon.triggers) | (F.size(space_words(clean)) > lexicon.max_words)
    return F.when(_greeting(clean, lexicon.greetings), "CHIT_CHAT").when(deep, "DEEP_REASONING").otherwise("RAG_QUERY")


def model_tier(intent: Column, lexicon: L.RouterLexicon = L.RouterLexicon()) -> Column:
    pairs = [F.lit(x) for item in lexicon.tiers.items() for x in item]
    return F.create_map(*pairs)[intent]


def is_greeting_only(text: Column, greetings=L.AGENT_GREETINGS) -> Column:
    return _greeting(strip(F.lower(text)), greetings)


def asks_for_memory(text: Column, triggers=L.MEMORY_PROBES) -> Column:
    clean = F.regexp_replace(strip(F.lower(text)), "[!.,? ]+$", "")
    return contains_any(clean, triggers)


def wants_voice_reply(text: Column, triggers=L.VOICE_REPLY_TRIGGERS) -> Column:
    return F.coalesce(contains_any(F.lower(text), triggers), F.lit(False))


# -- profile signals ------------------------------------------------------------------------------

def extract_size(text: Column, lexicon: L.ProfileLexicon = L.ProfileLexicon()) -> Column:
    """Clothing size by the first matching pattern; single letters only beside the word "size"."""
    clean = F.lower(text)
    out = None
    for pattern, size in lexicon.size_patterns:
        hit = clean.rlike(spelled_out(pattern))
        out = F.when(hit, size) if out is None else out.when(hit, size)
    spoken = F.regexp_extract(clean, spelled_out(lexicon.size_letter_pattern), 0)
    letters = F.when(spoken.contains("xl"), "XL")
    for letter in ("l", "m", "s"):
        letters = letters.when(spoken.contains(f"size {letter}") | spoken.contains(f"{letter} size"), letter.upper())
    return out.otherwise(F.when(spoken != "", letters))


def extract_stage(text: Column, lexicon: L.ProfileLexicon = L.ProfileLexicon()) -> Column:
    """Lifecycle stage and its tag as a struct; null fields if no keyword occurs."""
    clean = F.lower(text)
    tests = [contains_any(clean, words) for _, _, words in lexicon.stages]

    def pick(part: int) -> Column:
        return F.coalesce(*[F.when(t, F.lit(s[part])) for t, s in zip(tests, lexicon.stages)])

    return F.struct(pick(0).alias("stage"), pick(1).alias("tag"))


def _capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def profile_signals(messages: DataFrame, lexicon: L.ProfileLexicon = L.ProfileLexicon(),
                    column: str = "content") -> DataFrame:
    """Adds size, fabric, location, language signal, stage and the tag array of every message."""
    text = F.col(column)
    clean = F.lower(text)
    found = (
        messages.withColumn("size", extract_size(text, lexicon))
        .withColumn("fabric", _capitalised(first_contained(clean, lexicon.fabrics)))
        .withColumn("location", _capitalised(first_contained(clean, lexicon.locations)))
        .withColumn("language_signal", profile_language(text, lexicon))
        .withColumn("_stage", extract_stage(text, lexicon)))
    tags = F.array_compact(F.array(
        F.col("_stage.tag"),
        F.concat(F.lit("Size:"), "size"),
        F.concat(F.lit("Fabric:"), "fabric"),
        F.concat(F.lit("Location:"), "location"),
        F.concat(F.lit("Lang:"), _capitalised(F.col("language_signal")))))
    return found.withColumn("stage", F.col("_stage.stage")).withColumn("tags", tags).drop("_stage")


def label_messages(messages: DataFrame, router: L.RouterLexicon = L.RouterLexicon(),
                   profile: L.ProfileLexicon = L.ProfileLexicon(), greetings=L.AGENT_GREETINGS,
                   probes=L.MEMORY_PROBES, voice=L.VOICE_REPLY_TRIGGERS) -> DataFrame:
    """All row-wise signals of a message table or stream in one pass."""
    text = F.col("content")
    return (profile_signals(messages, profile)
            .withColumn("intent", route_intent(text, router))
            .withColumn("model_tier", model_tier(F.col("intent"), router))
            .withColumn("greeting_only", is_greeting_only(text, greetings))
            .withColumn("asks_for_memory", asks_for_memory(text, probes))
            .withColumn("wants_voice_reply", wants_voice_reply(text, voice)))


def signal_mix(labelled: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Count and share of every value of ``label`` within each group of ``by``."""
    counts = labelled.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    # Over the counts, one row per group and label.
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


# -- replies --------------------------------------------------------------------------------------

def clean_reply(text: Column, language: Column, spelling=L.MALAYALAM_TO_LATIN) -> Column:
    """Replies without decorative signs; outside the plain languages also without stray letters of
    the other script and without unnatural hyphens."""
    bare = F.regexp_replace(text, L.EMOJI_CLASS, "")

    def tidy(t: Column) -> Column:
        return strip(F.regexp_replace(t, " +", " "))

    latin = F.length(bare) - F.length(F.regexp_replace(bare, "[a-zA-Z]", ""))
    block = L.SCRIPT_BLOCKS[0][1]
    foreign = block_count(bare, block)
    spelled = bare
    for letters, latin_form in sorted(spelling, key=lambda p: len(p[0]), reverse=True):
        spelled = F.replace(spelled, F.lit(letters), F.lit(latin_form))
    spelled = F.regexp_replace(spelled, f"[{block}]", "")
    # The chain of replacements runs only where there is something to replace.
    latinised = F.when((foreign > 0) & (latin > 0) & (latin >= foreign), spelled).otherwise(bare)
    joined = latinised
    for pattern, replacement, any_case in L.HYPHEN_REWRITES:
        joined = F.regexp_replace(joined, spelled_out(pattern, any_case), replacement)
    out = F.when(language.isin(*L.PLAIN_LANGUAGES), bare).when(bare.contains("-"), joined).otherwise(latinised)
    return tidy(out)


def scrub_size_mentions(text: Column) -> Column:
    pattern, replacement = L.SIZE_MENTION
    return F.regexp_replace(text, spelled_out(pattern), replacement)


def split_reply(text: Column, parts: int = 2) -> Column:
    """The first non-blank parts between blank lines; one stripped part if there is no blank line."""
    pieces = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    return F.when(text.contains("\n\n"), F.slice(pieces, 1, parts)).otherwise(F.array(strip(text)))


def parse_model_reply(output: Column) -> Column:
    """Messages of a model's JSON reply: code fences go, a ``messages`` array is taken as it is, other
    JSON is kept as one message, and what is no JSON stays as it came."""
    clean = strip(F.replace(F.replace(output, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    json = F.try_parse_json(clean)
    messages = F.try_variant_get(json, "$.messages", "array<string>")
    return (F.when(json.isNull() | F.is_variant_null(json), F.array(output))
            .when(messages.isNotNull(), messages)
            .otherwise(F.array(clean)))


def canned_replies(labelled: DataFrame, templates: DataFrame, default_language: str = "*") -> DataFrame:
    """Adds ``reply`` from ``templates (state, language, reply)``, or the state's row for the
    default language. Templates are a hand-kept table of states by languages; the planner
    broadcasts it while it is small."""
    exact = templates.select(F.col("state").alias("_s"), F.col("language").alias("_l"), F.col("reply").alias("_exact"))
    other = templates.filter(F.col("language") == default_language).select(
        F.col("state").alias("_s2"), F.col("reply").alias("_other"))
    return (labelled
            .join(exact, (F.col("state") == F.col("_s")) & (F.col("language") == F.col("_l")), "left")
            .join(other, F.col("state") == F.col("_s2"), "left")
            .withColumn("reply", F.coalesce("_exact", "_other")).drop("_s", "_l", "_exact", "_s2", "_other"))
