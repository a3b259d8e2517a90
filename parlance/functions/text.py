"""Text expressions with one agreed meaning of white space and of a word."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every Unicode white-space character, the set that a Unicode-aware strip removes. (?U) widens Java's
# ASCII-only \s; the four separators 1c-1f are still missing there.
SPACE = r"[\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]+"


def squeeze(text: Column) -> Column:
    """Runs of white space become one space, none is left at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def has_text(text: Column) -> Column:
    """True unless the text is null or blank."""
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def space_words(text: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    return F.array_remove(F.split(text, f"(?U){SPACE}+"), "")


def spelled_out(pattern: str, any_case: bool = True) -> str:
    """A pattern with this module's meaning of a word and of white space. Java counts combining
    marks as word characters, so the word boundary is spelled out too."""
    letter = WORD[:-1]
    boundary = f"(?:(?<={letter})(?!{letter})|(?<!{letter})(?={letter}))"
    return ("(?iU)" if any_case else "(?U)") + pattern.replace(r"\b", boundary).replace(r"\s", SPACE)


def word_tokens(text: Column) -> Column:
    """Lower-case word tokens in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def latin_words(text: Column) -> Column:
    """Distinct lower-case runs of plain Latin letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z]+)"), 1))


def word_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def contains_any(text: Column, needles) -> Column:
    """True if any needle is a substring. Folds to a chain of code-generated ``contains``."""
    out = F.lit(False)
    for needle in needles:
        out = out | text.contains(needle)
    return out


def first_contained(text: Column, needles) -> Column:
    """The first needle, in list order, that is a substring; null if none is."""
    return F.coalesce(*[F.when(text.contains(n), F.lit(n)) for n in needles], F.lit(None).cast("string"))


def non_empty(text: Column) -> Column:
    """Null for an empty string."""
    return F.when(text != "", text)


def uuid5(name: Column, namespace_hex: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """RFC 4122 name-based UUID; the default namespace is the one for DNS names."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    # The variant nibble keeps its two low bits under the two fixed high bits.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
