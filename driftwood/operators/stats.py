"""Accounting of lines, diagnostics and counts of entries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.config import Config
from driftwood.operators.detect import is_blank
from driftwood.operators.parse import ParseResult
from driftwood.operators.search import Search, in_range, marked

REASONS = ("invalid_json", "non_object_json", "unparsable_timestamp", "encoding_fallback", "chain_truncated")


def diagnostic_counts(result: ParseResult) -> DataFrame:
    """Rows reason, n: exact, of reasons that occur."""
    return result.diagnostics.groupBy("reason").agg(F.count("*").alias("n"))


def diagnostic_examples(result: ParseResult, limit: int | None = None) -> DataFrame:
    """The first diagnostics in order of lines (``example_cap`` of them by default)."""
    return result.diagnostics.orderBy("source", "ordinal", "reason").limit(limit or result.config.example_cap)


def accounting(result: ParseResult) -> DataFrame:
    """One row: total_lines, blank_lines, entries, malformed, skip_ratio, severe.

    Entries, blank and malformed lines add up to all lines; the other diagnostics are of
    lines that are entries too.
    """
    lines = result.lines.agg(F.count("*").alias("total_lines"), F.count_if(is_blank(F.col("text"))).alias("blank_lines"))
    problems = result.diagnostics.agg(F.count("*").alias("diagnostics"), F.count_if(F.col("reason").isin("invalid_json", "non_object_json")).alias("malformed"))
    row = lines.crossJoin(problems)  # one row each
    row = row.withColumn("entries", F.col("total_lines") - F.col("blank_lines") - F.col("malformed"))
    seen = F.col("diagnostics") + F.col("entries")
    row = row.withColumn("skip_ratio", F.when(seen > 0, F.col("diagnostics") / seen).otherwise(0.0))
    return row.select("total_lines", "blank_lines", "entries", "malformed", "diagnostics", "skip_ratio", (F.col("skip_ratio") > result.config.severe_skip).alias("severe"))


def counts(entries: DataFrame, facets: dict[str, Iterable[str]] | None = None, search: Search = Search(), start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """One row: total, timestamped, timestampless, matching, in_range (matching ones), and
    shown, which is in_range if there is a range, else matching."""
    hit = F.col("matches")
    row = marked(entries, facets, search).agg(
        F.count("*").alias("total"), F.count("ts_ms").alias("timestamped"), F.count_if(hit).alias("matching"), F.count_if(hit & in_range(start_ms, end_ms)).alias("in_range")
    )
    shown = F.col("matching") if start_ms is None or end_ms is None else F.col("in_range")
    return row.select("total", "timestamped", (F.col("total") - F.col("timestamped")).alias("timestampless"), "matching", "in_range", shown.alias("shown"))


def tail(entries: DataFrame, n: int = Config().retention) -> DataFrame:
    """The last ``n`` entries of each source by line number: what a live view retains.

    The cut is found from counts of blocks of line numbers, so nothing is sorted.
    """
    from pyspark.sql import Window

    keep = max(1, n)
    size = max(1, keep // 16)
    blocks = entries.groupBy("source", F.floor(F.col("ordinal") / size).alias("_b")).agg(F.count("*").alias("_n"))
    after = Window.partitionBy("source").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_after", F.coalesce(F.sum("_n").over(after), F.lit(0))).where(F.col("_after") < keep)
    rows = entries.withColumn("_b", F.floor(F.col("ordinal") / size)).join(blocks, ["source", "_b"])
    # only the oldest block is cut inside
    order = Window.partitionBy("source", "_b").orderBy(F.desc("ordinal"))
    columns = [c for c in entries.columns if c not in ("event", "chained")]  # roots may be cut off
    whole = rows.where(F.col("_after") + F.col("_n") <= keep)
    part = rows.where(F.col("_after") + F.col("_n") > keep).withColumn("_at", F.row_number().over(order)).where(F.col("_after") + F.col("_at") <= keep)
    return whole.select(*columns).unionByName(part.select(*columns))
