"""Fields, their values, facets and counts.

Which values a field shows first, and where it shows one too many, is known from bounded
summaries that can be merged: of each field the ``value_cap`` + 1 distinct values of least
first line.  A value that is among these over all lines is so in the task that sees its
first line, so tasks drop all others as they go; summaries of all tasks meet by a hash of
the values, where they are cut in the same way, and their first lines alone by field.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.config import LEVELS, Config
from driftwood.sources.shared import written

#: Parts by hash of a field's values, and values that a task holds before it hands them on.
PARTS, HELD = 64, 1_000_000
#: Cuts of so many fields are broadcast; beyond, they are joined.
BROADCAST_FIELDS = 100_000
SUMMARY = "source string, field string, value string, n bigint, first bigint"


def _occurrences(entries: DataFrame) -> DataFrame:
    return entries.select("source", "ordinal", F.explode("fields").alias("field", "_v")).select("source", "field", F.col("_v.value").alias("value"), F.lit(1).cast("bigint").alias("n"), F.col("ordinal").alias("first"))


def _summarised(cap: int, held: int):
    """Of rows of ``SUMMARY``, those of one source, field and value as one, for each field at
    most ``cap`` + 1 values by first line.  A null value stands for all lines of the field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: dict[tuple, dict] = {}
        totals: dict[tuple, int] = {}

        def least(values: dict) -> dict:
            return dict(sorted(values.items(), key=lambda x: x[1][1])[: cap + 1])

        def out() -> Iterator[pa.RecordBatch]:
            for (source, field), values in fields.items():
                values = least(values)
                n = len(values)
                lines, firsts = zip(*values.values()) if n else ((), ())
                columns = [[source] * (n + 1), [field] * (n + 1), [*values, None], [*lines, totals[source, field]], [*firsts, None]]
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["source", "field", "value", "n", "first"])
            fields.clear()
            totals.clear()

        size = 0
        for batch in batches:
            # the rows of a batch are summed up before any of them is looked at
            table = pa.Table.from_batches([batch]).group_by(["source", "field", "value"], use_threads=False).aggregate([("n", "sum"), ("first", "min")])
            for source, field, value, n, first in zip(*(table.column(c).to_pylist() for c in ("source", "field", "value", "n_sum", "first_min"))):
                key = source, field
                values = fields.setdefault(key, {})
                if first is None:  # a total of a task
                    totals[key] = totals.get(key, 0) + n
                    continue
                known = values.get(value)
                if known is None:
                    values[value] = [n, first]
                    size += 1
                    if len(values) > 2 * (cap + 1):
                        size -= len(values) - cap - 1
                        fields[key] = least(values)
                else:
                    known[0] += n
                    known[1] = min(known[1], first)
                totals.setdefault(key, 0)
            if size > held:
                yield from out()
                size = 0
        yield from out()

    return run


def _summary(entries: DataFrame, cap: int) -> DataFrame:
    """Rows of ``SUMMARY``, a value in one row: of each field all values if they are no more
    than ``cap``, else at least the first ``cap`` + 1 of them, and the number of its lines
    in rows of null value."""
    each = _occurrences(entries)
    tasks = each.mapInArrow(_counted_in_tasks(cap), SUMMARY)
    dealt = tasks.repartition("source", "field", F.pmod(F.xxhash64("value"), F.lit(PARTS)))
    return dealt.mapInArrow(_summarised(cap, HELD), SUMMARY)


def _counted_in_tasks(cap: int):
    summarise = _summarised(cap, HELD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def with_totals() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch]).group_by(["source", "field"], use_threads=False).aggregate([("n", "sum")])
                n = table.num_rows
                sums = [table.column("source").combine_chunks(), table.column("field").combine_chunks(), pa.nulls(n, pa.string()), table.column("n_sum").combine_chunks(), pa.nulls(n, pa.int64())]
                yield batch
                yield pa.RecordBatch.from_arrays(sums, names=["source", "field", "value", "n", "first"])

        yield from summarise(with_totals())

    return run


def inventory(entries: DataFrame, config: Config = Config()) -> DataFrame:
    """Rows source, field, value, n, count, high_cardinality.

    ``count`` is how often the field occurs.  When a source brings one more distinct value
    of a field than ``value_cap``, the field is of high cardinality and no value is counted
    from that line on; so values are those first seen before it, counted before it.

    Lines are parsed once, now, into a table of summaries in the shared folder; only where
    fields are over the cap their lines before the cut are counted in a second pass.
    """
    cap, key = config.value_cap, ["source", "field"]
    found = written(_summary(entries, cap), "inventory")
    values = found.where("first IS NOT NULL").groupBy(*key, "value").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    sizes = values.groupBy(*key).agg(F.count("*").alias("_distinct"))
    over = sizes.where(F.col("_distinct") > cap).select(*key)
    totals = found.where("first IS NULL").groupBy(*key).agg(F.sum("n").alias("count"))
    # at most PARTS times the cap numbers a field
    firsts = values.join(over, key, "left_semi").groupBy(*key).agg(F.sort_array(F.collect_list("first")).alias("_firsts"))
    cut = written(firsts.select(*key, F.col("_firsts")[cap].alias("_cut")), "inventory-cuts")
    few = F.broadcast(cut) if cut.limit(BROADCAST_FIELDS + 1).count() <= BROADCAST_FIELDS else cut
    flagged = totals.join(few.select(*key, F.lit(True).alias("_over")), key, "left").select(*key, "count", F.coalesce("_over", F.lit(False)).alias("high_cardinality"))
    listed = values.join(few, key, "left_anti").select(*key, "value", "n")
    if not cut.isEmpty():
        # what occurs before the cut is a value of those before it
        before = _occurrences(entries).join(few, key).where(F.col("first") < F.col("_cut"))
        listed = listed.unionByName(before.groupBy(*key, "value").agg(F.sum("n").alias("n")))
    return listed.join(flagged, key).select(*key, "value", "n", "count", "high_cardinality")


def level_counts(entries: DataFrame) -> DataFrame:
    """Rows level, n of the levels that occur; members count."""
    return entries.where("level IS NOT NULL").groupBy("level").agg(F.count("*").alias("n"))


def facet_model(entries: DataFrame, active: dict[str, Iterable[str]] | None = None, config: Config = Config()) -> DataFrame:
    """Rows field, value, n, typed, place: ``level`` first, by severity, then the fields.

    A field is typed in, not listed (value null), if it is of high cardinality or has more
    than ``list_cap`` values.  Active values are always there, if need be with 0.
    """
    spark = entries.sparkSession
    chosen = [(k, v) for k, vs in (active or {}).items() for v in vs]
    wanted = spark.createDataFrame(chosen or [("", "")], "field string, value string").where("field != ''")
    found = level_counts(entries).select(F.lit("level").alias("field"), F.col("level").alias("value"), "n", F.lit(False).alias("_high"))
    known = written(inventory(entries, config), "facets")
    listed = known.groupBy("field", "value").agg(F.sum("n").alias("n"), F.max("high_cardinality").alias("_high"))
    rows = found.unionByName(listed)
    sizes = rows.groupBy("field").agg(F.count("*").alias("_k"), F.max("_high").alias("_h"))
    sizes = sizes.select("field", (F.col("_h") | ((F.col("field") != "level") & (F.col("_k") > config.list_cap))).alias("typed"))
    rows = rows.join(sizes, "field").where(~F.col("typed")).select("field", "value", "n")
    both = rows.unionByName(wanted.withColumn("n", F.lit(0).cast("bigint"))).groupBy("field", "value").agg(F.sum("n").alias("n"))
    names = sizes.where("typed").select("field", F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("n"))
    out = both.unionByName(names).join(sizes, "field", "left").withColumn("typed", F.coalesce("typed", F.lit(False)))
    place = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("value"))
    return out.withColumn("place", F.when(F.col("field") == "level", F.when(place > 0, place).otherwise(len(LEVELS) + 1)).otherwise(100).cast("int"))
