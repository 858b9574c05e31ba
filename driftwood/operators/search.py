"""Search text, facets and ranges: compiled on the driver, evaluated as columns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwood.functions.core import settled


class QueryError(ValueError):
    """A search that cannot be compiled."""


@dataclass(frozen=True)
class Search:
    """``kind`` is none, substring (``text`` in lower case) or regex (``text`` as given)."""

    kind: str = "none"
    text: str = ""


def compile_search(raw: str, spark: SparkSession | None = None) -> Search:
    """``re:`` begins a regular expression, ``\\re:`` a literal ``re:``, anything else is a
    substring.  Expressions are Java's, so Spark itself checks them, now, over no data."""
    if not raw:
        return Search()
    if raw.startswith("re:"):
        pattern = raw[3:]
        try:
            (spark or SparkSession.active()).range(1).select(F.lit("").rlike(pattern)).collect()
        except PySparkException as e:
            raise QueryError(f"invalid regex: {e}") from e
        return Search("regex", pattern)
    return Search("substring", (raw[1:] if raw.startswith("\\re:") else raw).lower())


_PAIR = re.compile(r"([A-Za-z_][\w.-]*)=(.+)", re.A)


def split_facets(text: str, known: Iterable[str]) -> tuple[list[tuple[str, str]], str]:
    """The field=value words of known fields, and the remaining text.  The last word is
    still being typed unless white space follows it, and stays text."""
    fields, words = set(known), text.split()
    open_ = [] if text[-1:].isspace() else words[-1:]
    facets, rest = [], []
    for word in words[: len(words) - len(open_)]:
        m = _PAIR.fullmatch(word)
        if m and m[1] in fields:
            facets.append((m[1], m[2]))
        else:
            rest.append(word)
    return facets, " ".join(rest + open_)


def parse_bound(text: str) -> int | None:
    """Milliseconds of a date and time; one without a zone is UTC; None if it is none."""
    text = text.strip()
    if not text:
        return None
    try:
        at = datetime.fromisoformat(text.replace("z", "Z"))
    except ValueError:
        return None
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return round(at.timestamp() * 1000)


def format_bound(ms: int) -> str:
    at = datetime.fromtimestamp(ms // 1000, timezone.utc)
    return f"{at:%Y-%m-%dT%H:%M:%S}.{ms % 1000:03d}"


def range_of(start: str, end: str) -> tuple[int, int] | None:
    """The range between two typed bounds; None if both are empty.  Both are needed, and
    the end is not before the start: anything else is an error."""
    if not start.strip() and not end.strip():
        return None
    low, high = parse_bound(start), parse_bound(end)
    if low is None or high is None:
        raise QueryError("both bounds are needed, as dates and times")
    if high < low:
        raise QueryError("the end of the range is before its start")
    return low, high


def field_value(name: str) -> Column:
    """A field as text; ``level`` is the entry's level.  Null if there is none."""
    return F.col("level") if name == "level" else F.col("fields")[name]["value"]


def matches_facets(facets: dict[str, Iterable[str]]) -> Column:
    """One of the values in each of the fields; no values ask for nothing."""
    ok = F.lit(True)
    for name, values in facets.items():
        wanted = list(values)
        if wanted:
            ok = ok & F.coalesce(field_value(name).isin(wanted), F.lit(False))
    return ok


def matches_search(search: Search) -> Column:
    """In the message, the level or any field's value, but not in names of fields."""
    if search.kind == "none":
        return F.lit(True)

    def hit(c: Column) -> Column:
        return F.contains(F.lower(c), F.lit(search.text)) if search.kind == "substring" else c.rlike(search.text)

    found = F.coalesce(hit(F.col("message")), F.lit(False)) | F.coalesce(hit(F.col("level")), F.lit(False))
    return found | F.coalesce(F.exists(F.map_values("fields"), lambda v: F.coalesce(hit(v["value"]), F.lit(False))), F.lit(False))


def in_range(start_ms: int | None, end_ms: int | None) -> Column:
    """From the start up to, not including, the end; never without a timestamp."""
    if start_ms is None or end_ms is None:
        return F.lit(True)
    return F.coalesce((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms), F.lit(False))


def with_event(entries: DataFrame) -> DataFrame:
    """``entries`` with ``event``: the root's number, or the line's own if it continues
    nothing that is there (an orphan is an event of its own), and ``chained``: whether the
    event may have several lines.  Parsed entries have both; after a cut they are found
    again."""
    if {"event", "chained"} <= set(entries.columns):
        return entries
    roots = entries.where("continuation_of IS NULL").select("source", F.col("ordinal").alias("continuation_of"), F.lit(True).alias("_there"))
    members = entries.where("continuation_of IS NOT NULL").select("source", "continuation_of").distinct()
    # only roots that something continues are joined
    there = members.join(roots, ["source", "continuation_of"])
    heads = there.select("source", F.col("continuation_of").alias("ordinal"), F.lit(True).alias("_leads"))
    joined = entries.join(there, ["source", "continuation_of"], "left").join(heads, ["source", "ordinal"], "left")
    event = F.when(F.col("_there"), F.col("continuation_of")).otherwise(F.col("ordinal"))
    columns = [c for c in entries.columns if c not in ("event", "chained")]
    return joined.select(*columns, event.alias("event"), F.coalesce("_there", "_leads", F.lit(False)).alias("chained"))


def marked(entries: DataFrame, facets: dict[str, Iterable[str]] | None = None, search: Search = Search()) -> DataFrame:
    """``entries`` with ``matches``: whether the line's event is one whose root passes the
    facets and of which any line matches the search.  Lines whose root is not among the
    entries (any more) are events of their own.

    Lines that are events by themselves are told where they are; only those of events with
    several lines are shuffled, and formats without such events have none.
    """
    wanted = {k: list(v) for k, v in (facets or {}).items() if list(v)}
    rows = with_event(entries)
    if "fields" in rows.columns and (search.kind != "none" or set(wanted) - {"level"}):
        # fields are built once, however many tests look at them
        rows = rows.select(*(settled(F.col(c)).alias(c) if c == "fields" else c for c in rows.columns))
    passes, hit = matches_facets(wanted), matches_search(search)
    alone = rows.where(~F.col("chained")).withColumn("matches", passes & hit)
    event = Window.partitionBy("source", "event")
    # null where the root is not there
    root = F.max(F.when(F.col("ordinal") == F.col("event"), passes)).over(event)
    many = rows.where("chained").withColumns({"_root": root, "_hit": hit, "_any": F.max(hit).over(event)})
    held = F.col("_root").isNotNull()
    many = many.withColumns({"event": F.when(held, F.col("event")).otherwise(F.col("ordinal")), "matches": F.when(held, F.col("_root") & F.col("_any")).otherwise(passes & F.col("_hit"))})
    return alone.unionByName(many.drop("_root", "_hit", "_any"))


def matching(entries: DataFrame, facets: dict[str, Iterable[str]] | None = None, search: Search = Search()) -> DataFrame:
    """The ``entries`` that ``marked`` marks."""
    if search.kind == "none" and not any(list(v) for v in (facets or {}).values()):
        return entries
    return marked(entries, facets, search).where("matches").select(*entries.columns)


#: Two characters that are no characters, put around matches.
_OPEN, _CLOSE = "﷐", "﷑"


def match_ranges(text: Column, search: Search) -> Column:
    """Places of all matches in a text, for highlighting: array of (start, end), from 0,
    end exclusive, matches of no length left out.

    Matches are marked by one walk over the whole text, so what a match looks at around
    itself is there; their places are the lengths of what lies between the marks.
    """
    empty = F.array().cast("array<struct<start:int,end:int>>")
    if search.kind == "none" or not search.text:
        return empty
    # letters alike but for their case are alike one by one, so no place shifts
    pattern = f"(?iu){re.escape(search.text)}" if search.kind == "substring" else search.text
    plain = F.translate(text, _OPEN + _CLOSE, "��")
    parts = F.split(F.regexp_replace(plain, pattern, f"{_OPEN}$0{_CLOSE}"), f"[{_OPEN}{_CLOSE}]", -1)

    def put(state: Column, part: Column) -> Column:
        end = state["at"] + F.length(part)
        inside = F.when(state["odd"] & (end > state["at"]), F.array(F.struct(state["at"].alias("start"), end.alias("end")))).otherwise(empty)
        return F.struct(end.alias("at"), (~state["odd"]).alias("odd"), F.concat(state["ranges"], inside).alias("ranges"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), empty.alias("ranges"))
    return F.coalesce(F.aggregate(parts, begin, put, lambda s: s["ranges"]), empty)


def members(entries: DataFrame, ordinal: int, source: str | None = None) -> DataFrame:
    """The lines that continue a root, in order."""
    rows = entries.where(F.col("continuation_of") == ordinal)
    return (rows if source is None else rows.where(F.col("source") == source)).orderBy("source", "ordinal")


def chain_sizes(entries: DataFrame, facets: dict[str, Iterable[str]] | None = None, search: Search = Search(), start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """For each event: source, event, lines (root and members), and visible, how many of
    them a predicate lets through: all lines of a matching event that are in the range."""
    shown = F.col("matches") & in_range(start_ms, end_ms)
    return marked(entries, facets, search).groupBy("source", "event").agg(F.count("*").alias("lines"), F.count_if(shown).alias("visible"))
