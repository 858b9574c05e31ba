"""Names and limits that give log semantics their exact meaning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Config:
    """Limits are part of the results, so they are parameters (fixed default values)."""

    sample_lines: int = 100
    threshold: float = 0.8
    head_window: int = 64
    payload_min_pairs: int = 2
    logfmt_min_share: float = 0.5
    example_cap: int = 5_000
    value_cap: int = 10_000
    chain_cap: int = 1_000
    retention: int = 100_000
    target_buckets: int = 120
    list_cap: int = 50
    sniff_bytes: int = 8_192
    severe_skip: float = 0.2


#: Levels by severity, and the keys that carry a line's own values, by precedence (fixed values).
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
TIMESTAMP_KEYS = ("timestamp", "ts", "time", "@timestamp", "t")
LEVEL_KEYS = ("level", "lvl", "severity")
MESSAGE_KEYS = ("message", "msg")
FORMATS = ("json", "logfmt", "plain")

#: Widths of histogram buckets in seconds, 1s to 365d (fixed values).
BUCKET_LADDER = (1, 5, 10, 30, 60, 300, 600, 1_800, 3_600, 10_800, 21_600, 43_200, 86_400, 604_800, 2_592_000, 31_536_000)

VALUE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
FIELDS = T.MapType(T.StringType(), VALUE)
LINES = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("used_fallback", T.BooleanType()),
    ]
)
ENTRIES = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("timestamp_used_default_tz", T.BooleanType()),
        T.StructField("timestamp_year_inferred", T.BooleanType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("fields", FIELDS),
        T.StructField("continuation_of", T.LongType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("event", T.LongType()),
        T.StructField("chained", T.BooleanType()),
    ]
)
