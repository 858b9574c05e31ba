"""Live lines: gaps, reconnects, retention, and entries from a stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwood.config import Config
from driftwood.operators import stats
from driftwood.operators.detect import detect, is_blank
from driftwood.operators.parse import ParseResult, parse
from driftwood.sources.lines import decoded, framed
from driftwood.streaming.follow import follow

#: Sequence numbers to a block when gaps are looked for.
BLOCK = 1_000_000


def stream_files(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """A stream of raw lines of the files that arrive in a folder: source, value.  Spark
    reads at its own pace, so a fast producer is never blocked and nothing is dropped."""
    rows = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files).text(path)
    return rows.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))


def gaps(lines: DataFrame) -> DataFrame:
    """Rows source, seq, missing: how many numbers are missing right before ``seq``.

    Blocks of numbers are looked at by themselves, each with the last number before it.
    """
    block = F.floor(F.col("seq") / BLOCK)
    rows = lines.select("source", "seq").withColumn("_b", block)
    ends = rows.groupBy("source", "_b").agg(F.max("seq").alias("_end"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_prev_end", F.max("_end").over(before)).drop("_end")
    order = Window.partitionBy("source", "_b").orderBy("seq")
    rows = rows.withColumn("_prev", F.lag("seq").over(order)).join(ends, ["source", "_b"])
    missing = F.col("seq") - F.coalesce("_prev", "_prev_end") - 1
    return rows.select("source", "seq", missing.alias("missing")).where("missing > 0")


def merged(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """A snapshot and the lines that follow, each number of an epoch (a producer's run)
    once.  On a stream, give ``live`` a watermark to bound what is remembered."""
    keys = ["source", "epoch", "seq"]
    return snapshot.unionByName(live).dropDuplicates(keys)


def with_epochs(lines: DataFrame) -> DataFrame:
    """``lines`` (source, session, announced, seq, ...) with ``epoch``, for ``merged``.

    A session is one connection to a producer, numbered in order of time; ``announced`` is
    the last number that the producer named when it began, the same for all its lines.  A
    producer that names less than what has been seen of it has begun anew, so that all its
    lines count again; otherwise numbers seen before are the same lines.  Sessions are
    ranked, not lines: one row a session is in a window.
    """
    keys = ["source", "session"]
    sessions = lines.groupBy(*keys).agg(F.max("announced").alias("_named"), F.greatest(F.max("seq"), F.max("announced")).alias("_seen"))
    order = Window.partitionBy("source").orderBy("session")
    sessions = sessions.withColumn("_anew", F.coalesce(F.col("_named") < F.lag("_seen").over(order), F.lit(False)))
    sessions = sessions.select(*keys, F.sum(F.col("_anew").cast("int")).over(order).cast("int").alias("epoch"))
    return lines.join(sessions, keys)


def rates(lines: DataFrame, at: str = "arrived", every: str = "1 second") -> DataFrame:
    """Lines per second of arrival: window start and lines.  Also on a stream."""
    return lines.groupBy(F.window(at, every).alias("w")).agg(F.count("*").alias("lines")).select(F.col("w.start").alias("start"), "lines")


class LiveTail:
    """Follows the log files that arrive in a folder into a table of lines that queries
    read.  A file is read once, when it arrives, up to its last byte; with ``growing`` what
    is appended to it is read too, each line when its newline has come.

    Each micro-batch is numbered after what the table has of its source and appended;
    entries and everything else are asked of the table, so that an event whose members
    arrive later, a changed query or a lost root are seen as they are.  A batch that runs
    again after a failure replaces what it wrote before (its folder is named after it).
    How far each source has come is kept beside the table, one row a source for each
    batch, so that a batch does not read the lines of those before it.  A source's format
    is settled by the first batch that has a line of it that is not blank, and holds from
    then on; ``reference`` is what lines without a year are judged by there.
    """

    def __init__(self, spark: SparkSession, inputs: str, table: str, checkpoint: str, config: Config = Config(), reference: datetime | None = None, growing: bool = False):
        self.growing = growing
        self.spark, self.inputs, self.table, self.checkpoint, self.config, self.reference = spark, inputs, table, checkpoint, config, reference

    def start(self, **trigger):
        """The running query; ``availableNow=True`` or ``processingTime=...`` as trigger."""
        stream = (follow if self.growing else stream_files)(self.spark, self.inputs)
        writer = stream.writeStream.foreachBatch(self._append).option("checkpointLocation", self.checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()

    def _append(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_id", F.monotonically_increasing_id())
        first = rows.groupBy("source", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        first = first.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        rows = rows.join(first.select("source", "block", "_first", "_before"), ["source", "block"])
        heads = self._heads(batch_id)
        rows = rows.join(heads.withColumnRenamed("ordinal", "_had"), "source", "left")
        ordinal = F.coalesce("_had", F.lit(0)) + F.col("_before") + F.col("_id") - F.col("_first") + 1
        out = rows.select("source", ordinal.cast("bigint").alias("ordinal"), framed(decoded(F.col("value"))).alias("text"), (~F.is_valid_utf8("value")).alias("used_fallback"), F.current_timestamp().alias("arrived"))
        out.write.mode("overwrite").parquet(f"{self.table}/batch={batch_id}")
        written = self.spark.read.parquet(f"{self.table}/batch={batch_id}")
        self._settle(written, batch_id)
        done = written.select("source", "ordinal").unionByName(heads).groupBy("source").agg(F.max("ordinal").alias("ordinal"))
        done.write.mode("overwrite").parquet(f"{self.table}-heads/{batch_id}")

    def _settle(self, written: DataFrame, batch_id: int) -> None:
        """Add the formats of the sources that a batch shows first, which later batches
        leave alone."""
        fresh = written.where(~is_blank(F.col("text")))
        known = self.formats(batch_id)
        if known is not None:
            fresh = fresh.join(known.select("source"), "source", "left_anti")
        detect(fresh, self.reference, self.config).write.mode("overwrite").parquet(f"{self.table}-formats/batch={batch_id}")

    def formats(self, before: int | None = None) -> DataFrame | None:
        """The formats settled so far (before a batch), as ``detect`` gives them."""
        if not self._exists(f"{self.table}-formats"):
            return None
        rows = self.spark.read.parquet(f"{self.table}-formats")
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")

    def _heads(self, batch_id: int) -> DataFrame:
        """The last number of each source before a batch."""
        if self._exists(f"{self.table}-heads/{batch_id - 1}"):
            return self.spark.read.parquet(f"{self.table}-heads/{batch_id - 1}")
        known = self._known(batch_id)
        if known is None:
            return self.spark.createDataFrame([], "source string, ordinal bigint")
        return known.groupBy("source").agg(F.max("ordinal").alias("ordinal"))

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _known(self, before: int | None = None) -> DataFrame | None:
        if not self._exists(self.table):
            return None
        rows = self.spark.read.option("basePath", self.table).parquet(self.table)
        return rows if before is None else rows.where(F.col("batch") < before)

    def lines(self) -> DataFrame | None:
        """All lines so far; None before the first batch."""
        return self._known()

    def entries(self, format: str = "auto", reference: datetime | None = None) -> DataFrame:
        """Entries of the lines that are retained: the last of each source.  What a live
        view counts by level are these."""
        kept = stats.tail(self.lines(), self.config.retention)
        return self._parsed(kept, format, reference).entries

    def whole(self, format: str = "auto", reference: datetime | None = None) -> ParseResult:
        """All lines of the stream, parsed: what its inventory, diagnostics and accounting
        are of, which do not forget what is no longer retained."""
        return self._parsed(self.lines(), format, reference)

    def _parsed(self, lines: DataFrame, format: str, reference: datetime | None) -> ParseResult:
        return parse(lines, format, reference=reference or self.reference, config=self.config, formats=self.formats())
