"""Levels from values, from the token after a timestamp, and from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwood.config import LEVELS

#: Other words for levels (fixed values): those that free text may use, and those that
#: only a value of its own may use.
WORDS = {"WARNING": "WARN", "ERR": "ERROR", "CRITICAL": "FATAL"}
VALUE_WORDS = {"EMERG": "FATAL", "PANIC": "FATAL", "ALERT": "FATAL", "CRIT": "FATAL", "NOTICE": "INFO"}
#: One-letter codes and the eight syslog severities (fixed values).
LETTERS = {"V": "TRACE", "T": "TRACE", "D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL"}
SEVERITIES = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")

_IN_TEXT = r"(?i)(?<![A-Za-z])(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|ERR|FATAL|CRITICAL)(?![A-Za-z=])"


def _table(words: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in words.items() for x in pair))


def _ascii_upper(text: Column) -> Column:
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def trimmed(text: Column) -> Column:
    # most texts have nothing to trim
    return F.when(text.rlike(r"(?U)^\s|\s$(?![\s\S])"), F.regexp_replace(text, r"(?U)^\s+|\s+$(?![\s\S])", "")).otherwise(text)


def from_value(value: Column) -> Column:
    """The level that a value names, or null."""
    return _table({k: k for k in LEVELS} | WORDS | VALUE_WORDS)[_ascii_upper(trimmed(value))]


def from_letter(letter: Column) -> Column:
    return _table(LETTERS)[letter]


def in_text(text: Column) -> Column:
    """The first level word in free text that is no key (no = after it), or null."""
    found = F.regexp_extract(text, _IN_TEXT, 1)
    return F.when(found != "", _table({k: k for k in LEVELS} | WORDS)[_ascii_upper(found)])


def token_word(token: Column) -> Column:
    """What the token after a timestamp says: [x], <x>, x: and x, are x."""
    bare = F.when(token.rlike(r"(?s)^\[.*\]$|^<.*>$"), F.regexp_replace(token, r"(?s)^.(.*).$", "$1")).otherwise(token)
    return F.regexp_replace(bare, "[:,]+$", "")


def from_token(token: Column, word: Column) -> Column:
    """The level of the token after a timestamp, ``word`` being its ``token_word``: a level's
    name, a one-letter code or a syslog priority in angle brackets."""
    priority = F.substring(word, 1, 10).try_cast("bigint")
    by_number = F.try_element_at(F.array(*map(F.lit, SEVERITIES)), (priority % 8 + 1).cast("int"))
    numeric = word.rlike("^[0-9]+$") & token.rlike(r"(?s)^<.*>$")
    return (
        F.when(word == "", F.lit(None))
        .when(numeric, F.when((F.length(word) <= 10) & (priority <= 4_294_967_295), by_number))
        .when(F.length(word) == 1, from_letter(word))
        .otherwise(from_value(word))
    )


def rank(level: Column) -> Column:
    """0 for TRACE to 5 for FATAL."""
    return _table({k: str(i) for i, k in enumerate(LEVELS)})[level].cast("int")
