"""Typed fields of JSON and logfmt lines, and the keys that carry a line's own values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwood.config import LEVEL_KEYS, MESSAGE_KEYS, TIMESTAMP_KEYS
from driftwood.functions import levels, timestamps
from driftwood.functions.core import Stages

_EMPTY = "map<string,struct<kind:string,value:string>>"
_QUOTED = r'"(?:\\[\s\S]|[^"\\])*+(?:"|\\?$(?![\s\S]))'
#: Braces inside braces that are followed down; deeper blocks end at the line's end.
BRACE_DEPTH = 16


def _braces() -> str:
    inner = r"\{\}"
    for _ in range(BRACE_DEPTH):
        inner = rf"\{{(?:{_QUOTED}|[^{{}}\"]|{inner})*+\}}"
    return inner


#: key="quoted", key={braces}, key=word, or a bare word.
_TOKEN = rf"(?U)[^\s=]*=(?:{_QUOTED}|{_braces()}|\{{[\s\S]*|\S*)|[^\s=]+"


def empty_fields() -> Column:
    return F.create_map().cast(_EMPTY)


#: What follows a line's text where it is parsed, to see that the text is one value.
_END = "end of line"


def _last_wins(keys: Column, values: Column) -> Column:
    """A map in which a repeated key has its last value."""
    pairs = F.transform(keys, lambda k, i: F.struct(k.alias("k"), F.get(values, i).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["k"]))
    return F.map_from_arrays(last["k"], last["v"])


def as_map(keys: Column, values: Column) -> Column:
    unique = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.when(unique, F.map_from_arrays(keys, values)).otherwise(_last_wins(keys, values))


def parsed_json(text: Column) -> Column:
    """A line as a variant, parsed once: an array of its value and an end mark.  Null if
    the text is no JSON or repeats a key."""
    return F.call_function("try_parse_json", F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))


def _at(parsed: Column, i: int, kind: str) -> Column:
    return F.call_function("try_variant_get", parsed, F.lit(f"$[{i}]"), F.lit(kind))


def is_whole(parsed: Column) -> Column:
    """Whether what ``parsed_json`` read was one value and nothing else."""
    return F.coalesce((_at(parsed, 1, "string") == _END) & _at(parsed, 2, "variant").isNull(), F.lit(False))


def repeats_keys(text: Column, parsed: Column) -> Column:
    """Whether a line that the strict parser refused is an object but for repeated keys."""
    # the lenient parser also takes single quotes
    outside = F.regexp_replace(text, r'"(?:\\[\s\S]|[^"\\])*+"', "")
    single = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    loose = parsed.isNull() & text.rlike(r"^\s*\{") & ~outside.contains("'") & single & F.from_json(text, "map<string,variant>").isNotNull()
    return F.coalesce(loose, F.lit(False))


def json_members(text: Column, parsed: Column, repeated: Column) -> Column:
    """The members of an object by name; null for any other value.  ``repeated`` tells
    objects that repeat a key; the last member of a name counts."""
    entries = F.map_entries(F.from_json(text, "map<string,variant>"))
    return F.when(repeated, _last_wins(entries["key"], entries["value"])).otherwise(_at(parsed, 0, "map<string,variant>"))


def is_json(text: Column) -> Column:
    """Whether a whole line is one valid JSON value (repeated keys are fine)."""
    parsed = parsed_json(text)
    return is_whole(parsed) | repeats_keys(text, parsed)


def json_text(value: Column) -> Column:
    """A member's value as text; a JSON null is the word."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def typed_members(members: Column) -> Column:
    """Fields of JSON members.

    Numbers and nested values get the normal form of Spark's variants: 1.10 is 1.1, keys
    of nested objects are sorted, and there are no spaces.
    """

    def typed(name: Column, v: Column) -> Column:
        # the first letters of the type tell the kind
        kind = F.substring(F.call_function("schema_of_variant", v), 1, 2)
        named = F.when(kind == "ST", "string").when(kind == "BO", "bool").when(kind.isin("OB", "AR"), "json").when(kind == "VO", "null").otherwise("number")
        return F.struct(F.coalesce(named, F.lit("null")).alias("kind"), json_text(v).alias("value"))

    return F.transform_values(members, typed)


def typed_texts(texts: Column) -> Column:
    """Fields whose values are all strings."""
    return F.transform_values(texts, lambda k, v: F.struct(F.lit("string").alias("kind"), v.alias("value")))


def logfmt_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _is_pair(token: Column) -> Column:
    return token.contains("=")


def pair_count(tokens: Column) -> Column:
    return F.size(F.filter(tokens, _is_pair))


def logfmt_pairs(tokens: Column) -> Column:
    """Key and value (text) of each pair among the tokens, in order."""

    def pair(t: Column) -> Column:
        key = F.substring_index(t, "=", 1)
        raw = F.substring(t, F.length(key) + 2, F.length(t))
        bare = F.regexp_replace(raw, r'^"((?:\\[\s\S]|[^"\\])*+)"?', "$1")
        value = F.when(raw.startswith('"'), F.regexp_replace(bare, r"\\([\s\S])", "$1")).otherwise(raw)
        return F.struct(key.alias("key"), value.alias("value"))

    return F.transform(F.filter(tokens, _is_pair), pair)


def logfmt_words(tokens: Column) -> Column:
    """The bare words, joined by single spaces."""
    return F.array_join(F.filter(tokens, lambda t: ~_is_pair(t)), " ")


def first_key(keys: tuple[str, ...], *maps: Column) -> Column:
    """The first of the keys that one of the maps has, whatever its value."""
    chosen = F.lit(None).cast("string")
    for k in reversed(keys):
        there = F.lit(False)
        for m in maps:
            there = there | F.map_contains_key(m, k)
        chosen = F.when(there, F.lit(k)).otherwise(chosen)
    return chosen


def extracted(as_: str, members: str | None, texts: str | None, tz_offset_minutes: int, default_message: Column) -> Stages:
    """Columns of a line's own values, whose names begin with ``as_``: instant, naive, bad
    (a timestamp that is none), level, message, and taken (the keys these came from).
    ``members`` (of JSON) and ``texts`` (of logfmt) name its maps; where there are both, one
    of them is null.

    The first key present decides: a timestamp key whose value is none stays a field and
    is reported, a level key is taken even if it names no level.
    """
    maps = [F.col(m) for m in (members, texts) if m is not None]
    keys = {"ts": TIMESTAMP_KEYS, "lv": LEVEL_KEYS, "ms": MESSAGE_KEYS}
    k = {n: F.col(f"{as_}k_{n}") for n in keys}
    v = {n: F.col(f"{as_}v_{n}") for n in keys}

    def value(key: Column) -> Column:
        found = [] if texts is None else [F.col(texts)[key]]
        if members is not None:
            found.append(F.when(F.col(members).isNotNull(), json_text(F.col(members)[key])))
        return F.when(key.isNotNull(), F.coalesce(*found))

    found, stamp = F.col(f"{as_}instant").isNotNull(), F.col(f"{as_}stamp")
    own = {
        "naive": found & timestamps.value_is_naive(stamp),
        "bad": F.when(k["ts"].isNotNull() & ~found, k["ts"]),
        "level": levels.from_value(v["lv"]),
        "message": F.coalesce(v["ms"], default_message),
        "taken": F.array_compact(F.array(F.when(found, k["ts"]), k["lv"], k["ms"])),
    }
    return [
        {f"{as_}k_{n}": first_key(names, *maps) for n, names in keys.items()},
        {f"{as_}v_{n}": value(key) for n, key in k.items()},
        {f"{as_}stamp": levels.trimmed(v["ts"])},
        {f"{as_}instant": timestamps.value_instant(stamp, tz_offset_minutes)},
        {f"{as_}{n}": c for n, c in own.items()},
    ]
