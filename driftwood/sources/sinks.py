"""Writing entries for later queries, and live lines as JSON envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.config import Config
from driftwood.operators import stats
from driftwood.sources.shared import written

#: Readers to broadcast; beyond, they are joined.
BROADCAST_READERS = 100_000


def write_entries(entries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Entries as Parquet by date, sorted by time inside files, so that time ranges prune
    folders and row groups.  Entries without a timestamp go to a folder of their own."""
    rows = entries.withColumn("date", F.to_date("timestamp"))
    rows.repartition("date", F.pmod(F.xxhash64("source", "ordinal"), F.lit(16))).sortWithinPartitions("date", "ts_ms", "source", "ordinal").write.partitionBy("date").mode(mode).parquet(path)


def envelope(kind: str, **parts: Column) -> Column:
    """A live message as one JSON text, its kind first."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), *(c.alias(k) for k, c in parts.items())))


def messages(lines: DataFrame, readers: DataFrame, ended: DataFrame, keep: int = Config().retention, buffer: int = 1_024) -> DataFrame:
    """What each reader is sent next: reader, source, place, kind, seq, count, lines and
    envelope (the message as JSON), to be sent in order of ``place``.

    ``lines`` (source, seq, text) is all that was written, numbered by one from 1 on;
    ``readers`` (reader, source, position) is how far each reader has come, null for one
    that has not connected yet; ``ended`` (source) are the sources that are over.  A new
    reader gets a snapshot of the last ``keep`` lines.  Any other gets what lies after its
    position, of which ``buffer`` lines are held for it: where more are due the oldest are
    dropped and a gap counts them, so the writer never waits.  A reader of a source that is
    over gets ``ended`` last, whenever it comes; one of a source without lines, a snapshot
    of none.  Of the lines no more than the last ``keep`` of a source are sent on.
    """
    heads = lines.groupBy("source").agg(F.max("seq").alias("last"))
    over = ended.select("source").distinct().withColumn("over", F.lit(True))
    who = readers.select("reader", "source", F.col("position").cast("bigint").alias("position"))
    who = who.join(heads, "source", "left").join(over, "source", "left")
    who = who.select("reader", "source", "position", F.coalesce("last", F.lit(0)).cast("bigint").alias("last"), F.coalesce("over", F.lit(False)).alias("over")).withColumn("lost", F.col("last") - buffer - F.col("position"))
    # of a source only what some reader is due, so what is joined is at most what is held
    due = F.when(F.col("position").isNull(), F.col("last") - keep).otherwise(F.greatest("position", F.col("last") - buffer))
    # one row a reader, used for each kind of message
    who = written(who.withColumn("after", due), "readers")
    small = who.limit(BROADCAST_READERS + 1).count() <= BROADCAST_READERS
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    low = who.groupBy("source").agg(F.min("after").alias("_low"))
    held = lines.select("source", "seq", F.coalesce("text", F.lit("")).alias("text")).join(near(low), "source").where(F.col("seq") > F.col("_low")).drop("_low")
    none, no_lines = F.lit(None).cast("bigint"), F.lit(None).cast("array<struct<seq:bigint,text:string>>")

    known = who.where("position IS NOT NULL")
    gaps = known.where("lost > 0").select("reader", "source", F.lit(0).cast("bigint").alias("place"), F.lit("gap").alias("kind"), none.alias("seq"), F.col("lost").alias("count"), no_lines.alias("lines"), envelope("gap", count=F.col("lost")).alias("envelope"))
    live = held.join(near(known.select("reader", "source", "after")), "source").where(F.col("seq") > F.col("after"))
    seq = F.col("seq").cast("bigint")
    live = live.select("reader", "source", seq.alias("place"), F.lit("line").alias("kind"), seq.alias("seq"), none.alias("count"), no_lines.alias("lines"), envelope("line", seq=seq, text=F.col("text")).alias("envelope"))

    # one snapshot a source, however many readers are new
    new = who.where("position IS NULL")
    kept = stats.tail(held.join(near(new.select("source").distinct()), "source", "left_semi").withColumnRenamed("seq", "ordinal"), keep)
    shots = kept.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.col("ordinal").cast("bigint").alias("seq"), "text"))).alias("lines"))
    first = new.join(shots, "source", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<struct<seq:bigint,text:string>>")))
    first = first.select("reader", "source", F.lit(0).cast("bigint").alias("place"), F.lit("snapshot").alias("kind"), F.col("last").alias("seq"), none.alias("count"), "lines", envelope("snapshot", lines=F.col("lines"), lastSeq=F.col("last")).alias("envelope"))

    done = who.where("over").select("reader", "source", (F.greatest("last", F.coalesce("position", F.lit(0))) + 1).alias("place"), F.lit("ended").alias("kind"), none.alias("seq"), none.alias("count"), no_lines.alias("lines"), envelope("ended").alias("envelope"))
    return first.unionByName(gaps).unionByName(live).unionByName(done)
