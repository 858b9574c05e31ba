"""Event histograms and time spans."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.config import BUCKET_LADDER, Config
from driftwood.operators.search import Search, in_range, marked


def bucket_width_ms(span_ms: int, target: int = Config().target_buckets) -> int:
    """The least readable width that cuts the span into at most ``target`` buckets."""
    needed = -(-max(span_ms, 1) // target)
    at = bisect_left(BUCKET_LADDER, needed, key=lambda seconds: 1000 * seconds)
    if at < len(BUCKET_LADDER):
        return 1000 * BUCKET_LADDER[at]
    # beyond the ladder, whole multiples of its last step
    return -(-needed // (1000 * BUCKET_LADDER[-1])) * 1000 * BUCKET_LADDER[-1]


def bucket_count(span_ms: int, width_ms: int) -> int:
    return max(1, -(-span_ms // width_ms))


def layout(min_ms: int, max_ms: int, cover_tail: bool = False, target: int = Config().target_buckets) -> tuple[int, int, int]:
    """(start, width, count) of a histogram over a span.

    The count follows from the span, the start is aligned below its beginning; so events
    at the very end can be outside the last bucket, unless ``cover_tail`` adds buckets.
    """
    if min_ms == max_ms:
        min_ms, max_ms = min_ms - 500, max_ms + 500
    width = bucket_width_ms(max_ms - min_ms, target)
    start = min_ms // width * width
    count = bucket_count(max_ms - min_ms, width)
    if cover_tail:
        count = max(count, (max_ms - start) // width + 1)
    return start, width, count


def histogram(
    entries: DataFrame,
    start_ms: int,
    width_ms: int,
    count: int,
    facets: dict[str, Iterable[str]] | None = None,
    search: Search = Search(),
) -> DataFrame:
    """Rows bucket (from 0), start_ms, total and matching, one for every bucket.

    Lines that continue an event are not counted; orphans are.  Both counts come from one
    aggregation, whose result has at most ``count`` rows.
    """
    inside = in_range(start_ms, start_ms + width_ms * count)
    bucket = F.floor((F.col("ts_ms") - start_ms) / width_ms).cast("int").alias("bucket")
    events = marked(entries, facets, search).where((F.col("event") == F.col("ordinal")) & inside)
    total = events.groupBy(bucket).agg(F.count("*").alias("total"), F.count_if("matches").alias("matching"))
    every = entries.sparkSession.range(count).select(F.col("id").cast("int").alias("bucket"))
    rows = every.join(F.broadcast(total), "bucket", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select("bucket", (F.lit(start_ms) + F.col("bucket").cast("bigint") * width_ms).alias("start_ms"), zero("total"), zero("matching"))


def full_span(entries: DataFrame) -> DataFrame:
    """One row: min_ms, max_ms and n of the entries with a timestamp."""
    return entries.agg(F.min("ts_ms").alias("min_ms"), F.max("ts_ms").alias("max_ms"), F.count("ts_ms").alias("n"))


def _nth(counts: DataFrame, n: int, ranks: list[int]) -> list[int]:
    """The values of given ranks (from 0) among all values, found by narrowing down
    buckets of values: each pass sums a few thousand buckets and never sorts rows."""
    found = []
    for rank in ranks:
        low, high, before = *counts.agg(F.min("ts_ms"), F.max("ts_ms")).head(), 0
        while low < high:
            width = max(1, -(-(high - low + 1) // 4096))
            rows = counts.where(F.col("ts_ms").between(low, high)).groupBy(F.floor((F.col("ts_ms") - low) / width).alias("b")).agg(F.sum("c").alias("n"))
            for r in sorted(rows.collect()):
                if before + r["n"] > rank:
                    low, high = low + r["b"] * width, min(high, low + (r["b"] + 1) * width - 1)
                    break
                before += r["n"]
        found.append(low)
    return found


def robust_span(entries: DataFrame) -> tuple[int, int, int] | None:
    """(min_ms, max_ms, outliers): the span without outliers by Tukey's fences.

    Quartiles are the values at floor(n / 4) and floor(3n / 4) of the sorted timestamps,
    the fences 1.5 interquartile ranges outside (1000 ms if that is 0).  No predicate is
    applied and members count.  None without timestamps.
    """
    stamped = entries.where("ts_ms IS NOT NULL").groupBy("ts_ms").agg(F.count("*").alias("c")).cache()
    try:
        n = stamped.agg(F.sum("c")).head()[0]
        if not n:
            return None
        q1, q3 = _nth(stamped, n, [n // 4, min(n - 1, 3 * n // 4)])
        pad = 1.5 * (q3 - q1) if q3 > q1 else 1000
        inside = stamped.where((F.col("ts_ms") >= q1 - pad) & (F.col("ts_ms") <= q3 + pad))
        low, high, kept = inside.agg(F.min("ts_ms"), F.max("ts_ms"), F.sum("c")).head()
        return low, high, n - kept
    finally:
        stamped.unpersist()
