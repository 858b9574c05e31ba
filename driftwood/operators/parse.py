"""From lines to entries and diagnostics."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.config import FORMATS, Config
from driftwood.functions import levels, structured
from driftwood.functions.core import Stages, added, parted
from driftwood.operators import chains
from driftwood.operators.detect import detect, is_blank
from driftwood.operators.plain import FIELD_PARTS, plain_fields, plain_stages

DIAGNOSTICS = "source string, ordinal bigint, reason string, detail string"


@dataclass(frozen=True)
class ParseResult:
    """``entries`` (schema ``config.ENTRIES``), ``diagnostics`` (source, ordinal, reason,
    detail), the ``lines`` they come from and ``detection`` (None for a given format)."""

    entries: DataFrame
    diagnostics: DataFrame
    lines: DataFrame
    detection: DataFrame | None
    config: Config = Config()


@lru_cache(64)
def _entry(format: str) -> dict[str, Column]:
    """The columns of entries, and what diagnostics need, of lines whose parts are settled."""
    chains_ = format == "plain"
    root = F.col("continuation_of") if chains_ else F.lit(None).cast("bigint")
    if chains_:
        fields = plain_fields()
    else:
        own = lambda m, typed: typed(F.map_filter(m, lambda k, v: ~F.array_contains(F.col("own_taken"), k)))
        fields = F.coalesce(own("own", structured.typed_members if format == "json" else structured.typed_texts), structured.empty_fields())
    if format == "json":
        stream = F.create_map(F.lit("stream"), F.struct(F.lit("string").alias("kind"), F.col("stream").alias("value")))
        fields = F.when(F.col("stream").isNotNull(), F.map_concat(F.map_filter(plain_fields(), lambda k, v: k != "stream"), stream)).otherwise(fields)
    return {
        "timestamp": F.col("instant"),
        "timestamp_used_default_tz": F.coalesce("naive", F.lit(False)),
        "timestamp_year_inferred": F.coalesce("inferred", F.lit(False)),
        "level": F.col("level"),
        "message": F.coalesce("message", F.lit("")),
        "fields": fields,
        "continuation_of": root,
        "ts_ms": F.unix_millis("instant"),
        "event": F.coalesce(root, "ordinal") if chains_ else F.col("ordinal"),
        "chained": F.col("chained") if chains_ else F.lit(False),
        "reason": F.col("reason"),
        "detail": F.col("detail"),
        "truncated_root": F.col("truncated_root") if chains_ else F.lit(None).cast("bigint"),
    }


def _entries(df: DataFrame, format: str) -> DataFrame:
    return df.select("source", "ordinal", *(c.alias(n) for n, c in _entry(format).items()))


@lru_cache(64)
def _json_stages(tz: int, reference: datetime | None, config: Config) -> tuple[Stages, dict[str, Column]]:
    text, parsed, repeated, m = F.col("_text"), F.col("_parsed"), F.col("_repeated"), F.col("_members")
    is_text = lambda k: F.call_function("schema_of_variant", m[k]) == "STRING"
    docker = F.col("_docker")
    stages = [
        {"_text": levels.trimmed(F.col("text"))},
        {"_parsed": structured.parsed_json(text)},
        {"_repeated": structured.repeats_keys(text, parsed)},
        {"_ok": structured.is_whole(parsed) | repeated},
        {"_members": F.when(F.col("_ok"), structured.json_members(text, parsed, repeated))},
        {"_docker": F.coalesce((F.size("_members") == 3) & is_text("log") & is_text("stream") & is_text("time"), F.lit(False))},
        # records of a container's log: the line inside is parsed as the plain line it is
        {"_log": F.when(docker, F.regexp_replace(m["log"].cast("string"), "[\n\r]+$", ""))},
    ]
    stages += structured.extracted("_o_", "_members", None, tz, F.lit(""))
    stages += plain_stages("_log", "_p_", tz, reference, config)
    inner = docker & F.col("_p_instant").isNotNull()
    bad = F.when(~docker, F.col("_o_bad"))
    parts = {
        "instant": F.when(inner, F.col("_p_instant")).otherwise(F.col("_o_instant")),
        "naive": F.when(inner, F.col("_p_naive")).otherwise(F.col("_o_naive")),
        "inferred": F.when(inner, F.col("_p_inferred")),
        "level": F.when(docker, F.col("_p_level")).otherwise(F.col("_o_level")),
        "message": F.when(docker, F.col("_p_message")).otherwise(F.col("_o_message")),
        "reason": F.when(~F.col("_ok"), "invalid_json").when(m.isNull(), "non_object_json").when(bad.isNotNull(), "unparsable_timestamp"),
        "detail": bad,
        **{n: F.col(f"_p_{n}") for n in FIELD_PARTS},
        "own": F.when(~docker, m),
        "own_taken": F.col("_o_taken"),
        "stream": F.when(docker, m["stream"].cast("string")),
    }
    return stages, parts


def _parse_json(lines: DataFrame, tz: int, reference: datetime | None, config: Config) -> DataFrame:
    stages, parts = _json_stages(tz, reference, config)
    return _entries(parted(added(lines, stages), ["source", "ordinal"], parts), "json")


@lru_cache(64)
def _logfmt_stages(tz: int) -> tuple[Stages, dict[str, Column]]:
    stages = [
        {"_tokens": structured.logfmt_tokens(F.col("text"))},
        {"_pairs": structured.logfmt_pairs(F.col("_tokens"))},
        {"_texts": structured.as_map(F.col("_pairs.key"), F.col("_pairs.value"))},
    ]
    stages += structured.extracted("_o_", None, "_texts", tz, structured.logfmt_words(F.col("_tokens")))
    bad = F.col("_o_bad")
    parts = {n: F.col(f"_o_{n}") for n in ("instant", "naive", "level", "message")}
    parts |= {"inferred": F.lit(False), "reason": F.when(bad.isNotNull(), "unparsable_timestamp"), "detail": bad, "own": F.col("_texts"), "own_taken": F.col("_o_taken")}
    return stages, parts


def _parse_logfmt(lines: DataFrame, tz: int, reference: datetime | None, config: Config) -> DataFrame:
    stages, parts = _logfmt_stages(tz)
    return _entries(parted(added(lines, stages), ["source", "ordinal"], parts), "logfmt")


@lru_cache(64)
def _plain_parts() -> dict[str, Column]:
    parts = {n: F.col(f"_p_{n}") for n in ("instant", "naive", "inferred", "level", "message", *FIELD_PARTS)}
    parts |= chains.marks(F.col("text"), F.col("_p_message"), F.col("_p_shape").isNotNull(), F.col("_p_identity"), F.col("_p_rest_raw"))
    none = F.lit(None).cast("string")
    return parts | {"reason": none, "detail": none}


def _parse_plain(lines: DataFrame, tz: int, reference: datetime | None, config: Config) -> DataFrame:
    df = parted(added(lines, plain_stages("text", "_p_", tz, reference, config)), ["source", "ordinal"], _plain_parts())
    return _entries(chains.linked(df, config), "plain")


_COLUMNS = ["source", "ordinal", "timestamp", "timestamp_used_default_tz", "timestamp_year_inferred", "level", "message", "fields", "continuation_of", "ts_ms", "event", "chained"]


def parse(
    lines: DataFrame,
    format: str = "auto",
    tz_offset_minutes: int = 0,
    reference: datetime | None = None,
    config: Config = Config(),
    formats: DataFrame | None = None,
) -> ParseResult:
    """Entries of ``lines`` (source, ordinal, text and, optionally, used_fallback).

    ``format`` is one of json, logfmt and plain, or auto, which detects it for each source
    from its first lines, or takes it from ``formats`` (source, format; sources that are
    not there give no entries).  Timestamps without an offset are read at ``tz_offset_minutes``;
    those without a year get the latest that is not after ``reference``, and are not
    recognised without one.  Blank lines give no entries; malformed JSON lines give a
    diagnostic instead.  Everything is lazy but the formats found, one short word for each
    format and never more than three.
    """
    if format not in (*FORMATS, "auto"):
        raise ValueError(f"format {format!r} is none of {FORMATS} and auto")
    if "used_fallback" not in lines.columns:
        lines = lines.withColumn("used_fallback", F.lit(False))
    lines = lines.select("source", F.col("ordinal").cast("bigint").alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"), "used_fallback")
    real = lines.where(~is_blank(F.col("text")))
    detection = None
    if format == "auto":
        detection = detect(lines, reference, config) if formats is None else formats
        kinds = [r[0] for r in detection.select("format").distinct().collect()]
        whole = len(kinds) == 1 and formats is None
        by_kind = {k: real if whole else real.join(detection.where(F.col("format") == k).select("source"), "source", "left_semi") for k in kinds}
    else:
        by_kind = {format: real}
    entries, problems = None, lines.where("used_fallback").select("source", "ordinal", F.lit("encoding_fallback").alias("reason"), F.lit(None).cast("string").alias("detail"))
    for kind in FORMATS:
        if kind not in by_kind:
            continue
        made = {"json": _parse_json, "logfmt": _parse_logfmt, "plain": _parse_plain}[kind](by_kind[kind], tz_offset_minutes, reference, config)
        if kind == "plain":
            bad = made.where("truncated_root IS NOT NULL").select("source", "ordinal", F.lit("chain_truncated").alias("reason"), F.col("truncated_root").cast("string").alias("detail"))
        else:
            bad = made.where("reason IS NOT NULL").select("source", "ordinal", "reason", "detail")
        problems = problems.unionByName(bad)
        if kind == "json":
            made = made.where("reason IS NULL OR reason = 'unparsable_timestamp'")
        made = made.select(*_COLUMNS)
        entries = made if entries is None else entries.unionByName(made)
    if entries is None:  # no line at all
        entries = _parse_logfmt(real, tz_offset_minutes, reference, config).select(*_COLUMNS)
    return ParseResult(entries, problems, lines, detection, config)
