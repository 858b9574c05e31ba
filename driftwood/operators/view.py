"""What a table of entries shows: events folded into their first lines, and rows by place."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwood.operators.search import Search, in_range, marked

#: Line numbers to a block whose rows are counted together.
BLOCK = 8_192


def collapsed(entries: DataFrame, facets: dict[str, Iterable[str]] | None = None, search: Search = Search(), start_ms: int | None = None, end_ms: int | None = None, expanded: DataFrame | None = None) -> DataFrame:
    """The matching ``entries`` in range, without the further lines of events that are not
    expanded, with ``lines``: how many an event's first line stands for, 1 for others.

    Expanded are the events of ``expanded`` (source, ordinal of their first lines) and those
    of which the search hits the *message* of a further line, so that a hit is never hidden.
    Lines whose first line is not among the rows shown are rows by themselves.  Only lines
    of events with several are looked at together.
    """
    rows = marked(entries, facets, search).where(F.col("matches") & in_range(start_ms, end_ms))
    alone = rows.where(~F.col("chained")).withColumn("lines", F.lit(1).cast("bigint"))
    event = Window.partitionBy("source", "event")
    leads = F.col("ordinal") == F.col("event")
    if search.kind == "none":
        hit = F.lit(False)
    elif search.kind == "substring":
        hit = F.contains(F.lower("message"), F.lit(search.text))
    else:
        # an expression that matches nothing but the empty text shows nothing
        hit = F.regexp_extract("message", search.text, 0) != ""
    many = rows.where("chained").withColumns({"_led": F.max(leads).over(event), "_n": F.count("*").over(event), "_open": F.max(~leads & hit).over(event)})
    if expanded is not None:
        opened = expanded.select(F.col("source").alias("_s"), F.col("ordinal").alias("_o")).distinct().withColumn("_by", F.lit(True))
        many = many.join(opened, (F.col("source") == F.col("_s")) & (F.col("event") == F.col("_o")), "left").withColumn("_open", F.col("_open") | F.coalesce("_by", F.lit(False)))
    shown = many.where(~F.col("_led") | leads | F.col("_open")).withColumn("lines", F.when(F.col("_led") & leads, F.col("_n")).otherwise(1).cast("bigint"))
    return alone.select(*entries.columns, "lines").unionByName(shown.select(*entries.columns, "lines"))


def viewport(rows: DataFrame, first: int, n: int) -> DataFrame:
    """The ``n`` rows from place ``first`` (from 0) in order of source and ordinal, with
    ``position``.

    Rows are counted by block of line numbers, and counts are summed up: by source, and
    then over sources, one row a source.  At most n + 1 blocks hold what is asked for; their
    line numbers become a filter on the rows, which a table sorted by them reads little
    for, and only rows of these blocks are put in order.
    """
    block = F.floor((F.col("ordinal") - 1) / BLOCK)
    blocks = rows.groupBy("source", block.alias("_block")).agg(F.count("*").alias("_n"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("source").agg(F.sum("_n").alias("_all")).withColumn("_sources", F.coalesce(F.sum("_all").over(before("source")), F.lit(0)))
    placed = blocks.withColumn("_begin", F.coalesce(F.sum("_n").over(before("source", "_block")), F.lit(0))).join(totals, "source")
    placed = placed.select("source", "_block", (F.col("_begin") + F.col("_sources")).alias("_begin"), "_n")
    held = placed.where((F.col("_begin") < first + n) & (F.col("_begin") + F.col("_n") > first)).collect()  # at most n + 1
    inside, begin = F.lit(False), F.lit(None).cast("bigint")
    for source, number, at, _ in held:
        here = (F.col("source") == source) & F.col("ordinal").between(number * BLOCK + 1, (number + 1) * BLOCK)
        inside, begin = inside | here, F.when(here, at).otherwise(begin)
    order = Window.partitionBy("source", block).orderBy("ordinal")
    found = rows.where(inside).withColumn("position", begin + F.row_number().over(order) - 1)
    return found.where(F.col("position").between(first, first + n - 1)).orderBy("position")
