"""One object for a log: open it, query it, sum it up."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.config import Config
from driftwood.operators import inventory, search, stats, timeline
from driftwood.operators.parse import ParseResult, parse
from driftwood.plans.spec import QuerySpec
from driftwood.sources.lines import read_text


class Log:
    """A parsed log and its queries.  ``cache()`` keeps the entries for many of them."""

    def __init__(self, result: ParseResult):
        self.result, self.entries = result, result.entries

    @classmethod
    def open(cls, spark: SparkSession, path: str | list[str], format: str = "auto", tz_offset_minutes: int = 0, reference: datetime | None = None, config: Config = Config()) -> Log:
        return cls(parse(read_text(spark, path), format, tz_offset_minutes, reference, config))

    def cache(self) -> Log:
        self.entries = self.entries.cache()
        return self

    def query(self, spec: QuerySpec) -> DataFrame:
        return spec.apply(self.entries)

    def get(self, ordinal: int, source: str | None = None) -> DataFrame:
        rows = self.entries.where(F.col("ordinal") == ordinal)
        return rows if source is None else rows.where(F.col("source") == source)

    def members(self, ordinal: int, source: str | None = None) -> DataFrame:
        return search.members(self.entries, ordinal, source)

    def inventory(self) -> DataFrame:
        return inventory.inventory(self.entries, self.result.config)

    def facets(self, spec: QuerySpec = QuerySpec()) -> DataFrame:
        return inventory.facet_model(self.entries, dict(spec.facets), self.result.config)

    def level_counts(self) -> DataFrame:
        return inventory.level_counts(self.entries)

    def histogram(self, spec: QuerySpec = QuerySpec(), cover_tail: bool = False) -> DataFrame | None:
        """Over the robust span, which no predicate changes; None without timestamps."""
        span = timeline.robust_span(self.entries)
        if span is None:
            return None
        laid = timeline.layout(span[0], span[1], cover_tail, self.result.config.target_buckets)
        return timeline.histogram(self.entries, *laid, dict(spec.facets), search.compile_search(spec.query))

    def counts(self, spec: QuerySpec = QuerySpec()) -> DataFrame:
        ends = spec.range_ms or (None, None)
        return stats.counts(self.entries, dict(spec.facets), search.compile_search(spec.query), *ends)

    def summarize(self) -> DataFrame:
        return stats.accounting(self.result)
