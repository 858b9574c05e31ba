"""A query as data: range, facets, search, format and time zone, to and from a string."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, quote_plus

from pyspark.sql import DataFrame

from driftwood.operators.search import Search, compile_search, in_range, matching

_KEYS = ("range", "filter", "q", "format", "tz")


@dataclass(frozen=True)
class QuerySpec:
    """``range_ms`` is half-open; ``facets`` maps fields to wanted values."""

    range_ms: tuple[float, float] | None = None
    facets: dict[str, tuple[str, ...]] = field(default_factory=dict)
    query: str = ""
    format: str | None = None
    tz_offset_minutes: int | None = None

    def to_string(self) -> str:
        parts = []
        if self.range_ms:
            parts.append(("range", ",".join(f"{x:.17g}" for x in self.range_ms)))
        parts += [("filter", f"{k}={v}") for k, vs in self.facets.items() for v in vs]
        if self.query:
            parts.append(("q", self.query))
        if self.format:
            parts.append(("format", self.format))
        if self.tz_offset_minutes is not None:
            parts.append(("tz", str(self.tz_offset_minutes)))
        return "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in parts)

    def apply(self, entries: DataFrame, search: Search | None = None) -> DataFrame:
        """The entries it asks for, in order of lines."""
        found = matching(entries, dict(self.facets), search or compile_search(self.query))
        if self.range_ms:
            found = found.where(in_range(*self.range_ms))
        return found.orderBy("source", "ordinal")


@dataclass(frozen=True)
class Decoded:
    """A spec and what could not be read: each problem is reported, none stops the rest."""

    spec: QuerySpec
    unknown_keys: tuple[str, ...] = ()
    range_error: str | None = None
    malformed_filters: int = 0


def _number(text: str) -> float | None:
    if not text.strip():
        return 0.0  # an empty bound is 0
    try:
        value = float(text)
    except ValueError:
        return None
    return value if math.isfinite(value) else None


def parse_spec(text: str) -> Decoded:
    pairs = parse_qsl(text.removeprefix("#"), keep_blank_values=True)
    first = {}
    for k, v in pairs:
        first.setdefault(k, v)
    unknown = tuple(dict.fromkeys(k for k, _ in pairs if k not in _KEYS))
    range_ms = error = None
    if "range" in first:
        ends = [_number(x) for x in first["range"].split(",")]
        if len(ends) == 2 and None not in ends:
            range_ms = (ends[0], ends[1])
        else:
            error = f"range {first['range']!r} is not two comma-separated numbers"
    facets: dict[str, tuple[str, ...]] = {}
    malformed = 0
    for k, v in pairs:
        if k == "filter":
            name, eq, value = v.partition("=")
            if not eq or not name:
                malformed += 1
            elif value not in facets.get(name, ()):
                facets[name] = (*facets.get(name, ()), value)
    tz = _number(first["tz"]) if "tz" in first else None
    spec = QuerySpec(range_ms, facets, first.get("q", ""), first.get("format"), None if tz is None else int(tz))
    return Decoded(spec, unknown, error, malformed)


def unknown_fields(spec: QuerySpec, known: set[str]) -> tuple[QuerySpec, tuple[str, ...]]:
    """The spec without facets on fields that are not there, and those fields."""
    gone = tuple(k for k in spec.facets if k != "level" and k not in known)
    kept = {k: v for k, v in spec.facets.items() if k not in gone}
    return QuerySpec(spec.range_ms, kept, spec.query, spec.format, spec.tz_offset_minutes), gone
