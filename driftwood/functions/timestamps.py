"""Timestamps: values of fields, and the prefix that begins a plain line.

A prefix is found by one expression for all shapes: the shortest run of characters that
ends at a token start (the line's start, or after a space, a tab or an opening bracket),
followed by a whole timestamp with valid numbers.  The shape is then told by the first
characters and the instant is built from its parts.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_TIME = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
_FRACTION = r"(?:\.[0-9]++)?+"
# an offset needs its colon; digits that look like one without it spoil the whole
_ZONE = r"(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9]|(?![+-][0-9]{2}:?[0-9]{2}))"
_COLUMN = r"(?:[0-9]{1,16}|[a-z_]{1,16}|(?=[^ \t]{1,16}(?:[ \t]|$))u[0-9]+_a[0-9]+)(?=[ \t]|$)"


_LEAP = r"(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"


def _month_day(between: str) -> str:
    """A month and a day that it has in some year, as two digits each."""
    return f"(?:(?:0[13578]|1[02]){between}(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11){between}(?:0[1-9]|[12][0-9]|30)|02{between}(?:0[1-9]|1[0-9]|2[0-9]))"


_NAMED_DAY = r"(?i:jan|mar|may|jul|aug|oct|dec) {1,2}(?:0?[1-9]|[12][0-9]|3[01])|(?i:apr|jun|sep|nov) {1,2}(?:0?[1-9]|[12][0-9]|30)|(?i:feb) {1,2}(?:0?[1-9]|[12][0-9])"
_DAY_NAMED = r"(?:0[1-9]|[12][0-9]|3[01])/(?i:jan|mar|may|jul|aug|oct|dec)|(?:0[1-9]|[12][0-9]|30)/(?i:apr|jun|sep|nov)|(?:0[1-9]|[12][0-9])/(?i:feb)"
#: Integers from 10**9 up to the last microsecond that has a date.
_EPOCH = r"(?=[0-9]{10,19}(?:[ \t]|$(?![\s\S])))0*(?:[1-9][0-9]{9,17}|[1-7][0-9]{18}|8[01][0-9]{17}|820[0-9]{16})(?![0-9])"
#: Whole expressions of the shapes, in the order they are tried at a position.  What they
#: match can always be read, so a date that does not exist does not end the search.
SHAPES = {
    "iso8601": rf"(?!(?!{_LEAP})[0-9]{{4}}-02-29)[0-9]{{4}}-{_month_day('-')}[T ]{_TIME}{_FRACTION}{_ZONE}",
    "slash-date": rf"(?!(?!{_LEAP})[0-9]{{4}}/02/29)[0-9]{{4}}/{_month_day('/')}[T ]{_TIME}{_FRACTION}{_ZONE}",
    "klog": rf"[VTDIWEF]?{_month_day('')} {_TIME}{_FRACTION}",
    "logcat": rf"{_month_day('-')} {_TIME}\.[0-9]+(?: +{_COLUMN}){{2,3}} +[VDIWEFS] +[^: \t]+:",
    "syslog3164": rf"(?:{_NAMED_DAY})(?![0-9]) {_TIME}{_FRACTION}",
    "clf": rf"(?!29/(?i:feb)/(?!{_LEAP}))(?:{_DAY_NAMED})/[0-9]{{4}}:{_TIME}(?: [+-](?:[01][0-9]|2[0-3])[0-9]{{2}}|(?! [+-][0-9]{{4}}))",
    "epoch": rf"(?<![\s\S]){_EPOCH}",
}
#: Shapes without a year; they need a reference instant.
YEARLESS = ("klog", "logcat", "syslog3164")


def _leap(year: int) -> bool:
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


def prefix_pattern(window: int, reference: datetime | None) -> str:
    """Group 1 is the text before the timestamp; the whole match ends with it."""
    shapes = {s: p for s, p in SHAPES.items() if reference is not None or s not in YEARLESS}
    if reference is not None and not any(_leap(y) and (y, 2, 29) <= (reference.year, reference.month, reference.day) for y in (reference.year, reference.year - 1)):
        # neither year that could be meant has a 29 February
        for s, p in (("klog", "(?![VTDIWEF]?0229 )"), ("logcat", "(?!02-29 )"), ("syslog3164", "(?!(?i:feb) {1,2}29)")):
            shapes[s] = p + shapes[s]
    return rf"^([\s\S]{{0,{window - 1}}}?)(?<![^ \t\[(<])(?:{'|'.join(shapes.values())})"


def shape_of(stamp: Column) -> Column:
    """The shape of a whole timestamp, told by how it begins."""
    return (
        F.when(stamp.rlike("^[0-9]{4}-"), "iso8601")
        .when(stamp.rlike("^[0-9]{4}/"), "slash-date")
        .when(stamp.rlike("^[0-9]{2}-"), "logcat")
        .when(stamp.rlike("^[VTDIWEF]?[0-9]{4} "), "klog")
        .when(stamp.rlike("^[A-Za-z]{3} "), "syslog3164")
        .when(stamp.rlike("^[0-9]{2}/"), "clf")
        .when(stamp.rlike("^[0-9]{10,}$"), "epoch")
    )


def _civil(text: Column) -> Column:
    """The instant of a date and time, read as UTC; null if there is none."""
    # more digits of a second than six come only in long texts
    short = F.when((F.octet_length(text) > 26), F.regexp_replace(text, r"(\.[0-9]{6})[0-9]+", "$1")).otherwise(text)
    return F.concat(short, F.lit("Z")).try_cast("timestamp")


def _shifted(instant: Column, east_minutes: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(instant) - east_minutes.cast("bigint") * 60_000_000)


def _east(zone: Column) -> Column:
    """Minutes of ``+HH:MM`` or ``+HHMM``."""
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, -2, 2).try_cast("int")
    return F.when(zone.startswith("-"), -minutes).otherwise(minutes)


def from_epoch(value: Column) -> Column:
    """Seconds, milliseconds or microseconds, told by magnitude; null below 1e9."""
    n = value.try_cast("bigint")
    within = lambda size: (n > -size) & (n < size)
    return F.timestamp_micros(F.when(within(10**9), None).when(within(10**11), n * 1_000_000).when(within(10**14), n * 1000).otherwise(n))


_NUMBER = r"^-?[0-9]+$(?![\s\S])"
#: A zone needs all digits, a missing one an upper-case T.
_ZONED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})$(?![\s\S])"
_NAIVE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ][0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(?:\.[0-9]+)?$(?![\s\S])"


def value_instant(text: Column, tz_offset_minutes: int = 0) -> Column:
    """The instant of a (trimmed) value: an integer is an epoch, else a date and time with
    an offset, else one without, which is read at ``tz_offset_minutes``.  Null if none."""
    utc = text.rlike("[Zz]$")
    cut = lambda n: F.translate(F.substring(text, F.lit(1), F.octet_length(text) - n), "t", "T")
    zoned = F.when(utc, _civil(cut(1))).otherwise(_shifted(_civil(cut(6)), _east(F.substring(text, -6, 6))))
    naive = _shifted(_civil(text), F.lit(tz_offset_minutes)) if tz_offset_minutes else _civil(text)
    return F.when(text.rlike(_ZONED), zoned).when(text.rlike(_NAIVE), naive).when(text.rlike(_NUMBER), from_epoch(text))


def value_is_naive(text: Column) -> Column:
    return text.rlike(_NAIVE)


def stamp_text(stamp: Column, shape: Column) -> Column:
    """A prefix timestamp as ``yyyy-MM-dd HH:mm:ss`` with fraction and zone as they are, or
    from the month on where the shape has no year."""
    name = F.lower(F.when(shape == "clf", F.substring(stamp, 4, 3)).otherwise(F.substring(stamp, 1, 3)))
    month = F.lpad((F.floor(F.instr(F.lit("".join(MONTHS)), name) / 3) + 1).cast("string"), 2, "0")
    return (
        F.when(shape == "iso8601", stamp)
        .when(shape == "slash-date", F.translate(stamp, "/", "-"))
        .when(shape == "logcat", F.regexp_extract(stamp, r"^\S+ \S+", 0))
        .when(shape == "klog", F.regexp_replace(stamp, r"^[VTDIWEF]?([0-9]{2})([0-9]{2}) ", "$1-$2 "))
        .when(shape == "syslog3164", F.concat(month, F.regexp_replace(F.substring(stamp, 4, 64), r"^ +", "-")))
        .when(shape == "clf", F.concat(F.substring(stamp, 8, 4), F.lit("-"), month, F.lit("-"), F.substring(stamp, 1, 2), F.lit(" "), F.substring(stamp, 13, 64)))
    )


def stamp_instant(stamp: Column, shape: Column, text: Column, tz_offset_minutes: int, reference: datetime | None) -> Column:
    """The instant of a prefix timestamp whose ``stamp_text`` is ``text``."""
    local = lambda c: _shifted(_civil(c), F.lit(tz_offset_minutes)) if tz_offset_minutes else _civil(c)
    zone = r" ?[+-][0-9]{2}:?[0-9]{2}$"
    there = text.rlike(r":[0-9]{2}(?:\.[0-9]+)?" + zone)
    dated = (
        F.when(text.endswith("Z"), _civil(F.regexp_replace(text, "Z$", "")))
        .when(there, _shifted(_civil(F.regexp_replace(text, zone, "")), _east(F.regexp_extract(text, r"[+-][0-9:]{4,6}$", 0))))
        .otherwise(local(text))
    )
    whole = F.when(shape == "epoch", from_epoch(stamp))
    if reference is None:
        return whole.when(shape.isin(*YEARLESS), None).otherwise(dated)
    at = (reference if reference.tzinfo else reference.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
    moment = F.timestamp_micros(F.lit((at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)))
    own, before = (local(F.concat(F.lit(f"{y:04d}-"), text)) for y in (at.year, at.year - 1))
    return whole.when(shape.isin(*YEARLESS), F.when(own <= moment, own).otherwise(before)).otherwise(dated)


def stamp_is_naive(shape: Column, text: Column) -> Column:
    return (shape != "epoch") & (shape.isin(*YEARLESS) | ~text.rlike(r"(?:Z|:[0-9]{2}(?:\.[0-9]+)? ?[+-][0-9]{2}:?[0-9]{2})$"))


def rfc3339(instant: Column) -> Column:
    """As ``2026-08-08T17:42:01+00:00``, with 3 or 6 digits of a second if it has them."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    # no fraction, or three or six digits of it
    return F.concat(F.regexp_replace(whole, r"\.000000$|(?<=\.[0-9]{3})000$", ""), F.lit("+00:00"))
