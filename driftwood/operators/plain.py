"""Plain lines: timestamp prefix, level, payload and message."""

from __future__ import annotations

from datetime import datetime
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwood.config import Config
from driftwood.functions import levels, structured, timestamps
from driftwood.functions.core import Stages

def _lead_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+", "")


def _merged(first: Column, second: Column) -> Column:
    """Both maps; the second's values win."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k)), second)


def _text_value(value: Column, number: bool = False) -> Column:
    kind = F.when(value.rlike("^[0-9]+$"), "number").otherwise("string") if number else F.lit("string")
    return F.struct(kind.alias("kind"), value.alias("value"))


@lru_cache(64)
def plain_stages(text: str, as_: str, tz_offset_minutes: int, reference: datetime | None, config: Config) -> Stages:
    """Columns of what the line in ``text`` says, whose names begin with ``as_``:
    instant, naive, inferred, level, message, members and texts (the payload's), taken,
    record (a logcat line's own fields), prefix (the prefix's instant if a payload has
    another), shape, offset, rest_raw and identity.  A null line gives nulls.

    One expression finds the prefix of all shapes; all else works on short pieces of the
    line.  What several columns need is a column too, so it is computed once.  Columns are
    kept, as making some hundred of them takes longer than reading a small file.
    """
    line = F.col(text)
    c = lambda n: F.col(as_ + n)
    stages: Stages = []
    add = lambda **new: stages.append({as_ + n: v for n, v in new.items()})
    pattern = timestamps.prefix_pattern(config.head_window, reference)
    # a line without hh:mm:ss and without a leading epoch cannot have a prefix
    likely = line.rlike(r"[0-9]:[0-9]{2}:[0-9]|^[0-9]{10}")
    add(hit=F.when(likely, F.regexp_extract(line, pattern, 0)).otherwise(""))
    add(head=F.when(c("hit") != "", F.regexp_extract(c("hit"), pattern, 1)))
    add(stamp=F.when(F.octet_length(c("head")) < config.head_window, F.substring(c("hit"), F.length(c("head")) + 1, F.length(c("hit")))))
    add(shape=timestamps.shape_of(c("stamp")))
    add(when_=timestamps.stamp_text(c("stamp"), c("shape")))
    add(at=timestamps.stamp_instant(c("stamp"), c("shape"), c("when_"), tz_offset_minutes, reference))
    found = c("at").isNotNull()
    # a bracket that opens right before the timestamp goes with its closing one
    add(after=F.when(found, F.substring(line, F.length(c("hit")) + 1, F.length(line))))
    closed = F.concat(F.substring(c("head"), -1, 1), F.substring(c("after"), 1, 1)).isin("[]", "()", "<>")
    add(
        rest_raw=F.when(closed, F.substring(c("after"), 2, F.length(c("after")))).otherwise(c("after")),
        before=F.when(found, levels.trimmed(F.when(closed, F.regexp_replace(c("head"), r".$", "")).otherwise(c("head")))),
        # logcat: columns between the time and the tag
        parts=F.when(found & (c("shape") == "logcat"), F.split(F.regexp_replace(c("stamp"), " +", " "), " ")),
    )
    letter = F.when(c("shape") == "klog", F.regexp_extract(c("stamp"), "^([VTDIWEF])", 1)).when(c("shape") == "logcat", F.element_at(c("parts"), -2))
    add(letter=F.when(found, letter), rest=_lead_trim(c("rest_raw")))
    tag = F.regexp_replace(F.element_at(c("parts"), -1), ":$", "")
    pid, tid = F.element_at(c("parts"), -4), F.element_at(c("parts"), -3)
    record = F.create_map(F.lit("tag"), _text_value(tag), F.lit("pid"), _text_value(pid, True), F.lit("tid"), _text_value(tid, True))
    uid = F.create_map(F.lit("uid"), _text_value(F.try_element_at(c("parts"), F.lit(-5)), True))
    size = F.size(c("parts"))
    # level by position: the letter, else the next token
    by_letter = levels.from_letter(c("letter"))
    add(
        record=F.when(size == 7, F.map_concat(record, uid)).when(size >= 6, record),
        identity=F.when(size >= 6, F.to_json(F.struct(pid.alias("p"), tid.alias("t"), tag.alias("g"), c("letter").alias("l")))),
        by_letter=by_letter,
        token=F.when(found & by_letter.isNull(), F.regexp_extract(c("rest"), r"(?U)^(\S+)", 1)),
    )
    add(word=levels.token_word(c("token")))
    add(by_token=levels.from_token(c("token"), c("word")))
    add(rest=F.when(c("by_token").isNotNull(), _lead_trim(F.regexp_replace(c("rest"), r"(?U)^\S+", ""))).otherwise(c("rest")))
    # payload behind the prefix
    body, braced = levels.trimmed(c("rest")), c("rest").startswith("{")
    add(parsed=F.when(braced, structured.parsed_json(body)))
    add(repeated=braced & structured.repeats_keys(body, c("parsed")))
    pairs_likely = (F.length(c("rest")) - F.length(F.replace(c("rest"), F.lit("="), F.lit("")))) >= config.payload_min_pairs
    add(
        members=F.when(braced & (structured.is_whole(c("parsed")) | c("repeated")), structured.json_members(body, c("parsed"), c("repeated"))),
        tokens=F.when(~braced & pairs_likely, structured.logfmt_tokens(c("rest"))),
    )
    add(pairs=F.when(structured.pair_count(c("tokens")) >= config.payload_min_pairs, structured.logfmt_pairs(c("tokens"))))
    add(texts=F.when(c("pairs").isNotNull(), structured.as_map(c("pairs")["key"], c("pairs")["value"])))
    default = F.when(c("members").isNotNull(), "").otherwise(structured.logfmt_words(c("tokens")))
    stages += structured.extracted(as_ + "own_", as_ + "members", as_ + "texts", tz_offset_minutes, default)
    has_payload, own = c("members").isNotNull() | c("texts").isNotNull(), c("own_instant")
    joined = F.when(c("before") == "", c("rest")).when(c("rest") == "", c("before")).otherwise(F.concat_ws(" ", c("before"), c("rest")))
    add(message=F.when(has_payload, c("own_message")).when(found, joined).otherwise(line))
    by_prefix = F.coalesce(c("by_letter"), c("by_token"))
    has_own = has_payload & own.isNotNull()
    add(
        instant=F.when(has_own, own).otherwise(c("at")),
        naive=F.when(has_own, c("own_naive")).otherwise(found & timestamps.stamp_is_naive(c("shape"), c("when_"))),
        inferred=F.when(has_own, False).otherwise(found & c("shape").isin(*timestamps.YEARLESS)),
        level=F.when(has_payload, F.coalesce(c("own_level"), by_prefix)).when(found, F.coalesce(by_prefix, levels.in_text(c("message")))).otherwise(levels.in_text(c("message"))),
        taken=F.when(has_payload, c("own_taken")),
        prefix=F.when(has_own & (own != c("at")), c("at")),
        offset=F.when(found, F.octet_length(c("head"))),
        shape=F.when(found, c("shape")),
    )
    return stages


#: What of a plain line its fields are made of.
FIELD_PARTS = ("members", "texts", "taken", "record", "prefix")


@lru_cache(1)
def plain_fields() -> Column:
    """The fields of a plain line from columns of its ``FIELD_PARTS``."""
    part = F.col
    open_ = lambda m, typed: typed(F.map_filter(m, lambda k, v: ~F.array_contains(part("taken"), k)))
    payload = F.when(part("members").isNotNull(), open_(part("members"), structured.typed_members)).when(part("texts").isNotNull(), open_(part("texts"), structured.typed_texts))
    record, none = part("record"), structured.empty_fields()
    fields = F.when(record.isNotNull() & payload.isNotNull(), _merged(record, payload)).otherwise(F.coalesce(record, payload, none))
    prefix = F.create_map(F.lit("prefix_ts"), _text_value(timestamps.rfc3339(part("prefix"))))
    return F.when(part("prefix").isNotNull(), _merged(fields, prefix)).otherwise(fields)


def prefix_only(line: Column, reference: datetime | None, config: Config) -> Column:
    """A struct (shape, offset) of a line's prefix; nulls if it has none."""
    pattern = timestamps.prefix_pattern(config.head_window, reference)
    head = F.regexp_extract(line, pattern, 1)
    hit = F.regexp_extract(line, pattern, 0)
    there = (hit != "") & (F.octet_length(head) < config.head_window)
    shape = timestamps.shape_of(F.when(there, F.substring(hit, F.length(head) + 1, F.length(hit))))
    return F.struct(shape.alias("shape"), F.when(shape.isNotNull(), F.octet_length(head)).alias("offset"))
