"""Lines from text files, from tables, and their framing and encoding."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwood.config import Config


def decoded(raw: Column) -> Column:
    """A line's bytes as text: UTF-8, or Latin-1 where they are no UTF-8."""
    valid = F.is_valid_utf8(raw.cast("string"))
    return F.when(valid, raw.cast("string")).otherwise(F.decode(raw.cast("binary"), "ISO-8859-1"))


def framed(text: Column) -> Column:
    """Without the one carriage return that may end a line."""
    return F.regexp_replace(text, r"\r$(?![\s\S])", "")


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files (globs, folders and compressed files too): source (the file),
    ordinal (from 1, blank lines counted), text and used_fallback.

    Line ends are newlines only.  Ordinals are exact without a sort: lines are counted in
    each split of a file, the counts are summed up by file in the order of splits, and
    each line's place in its split is added.  The counting pass reads the files once more.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("_raw"),
    )
    counts = rows.groupBy("source", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rows = rows.join(starts.select("source", "_block", "_first", "_before"), ["source", "_block"])
    valid = F.is_valid_utf8("_raw")
    return rows.select(
        "source",
        (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("ordinal"),
        framed(decoded(F.col("_raw"))).alias("text"),
        (~valid).alias("used_fallback"),
    )


def from_table(df: DataFrame, text: str, ordinal: str | Column, source: str | Column = "table") -> DataFrame:
    """Lines from a table with one line to a row.  ``source`` is a column or a name."""
    at = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    name = source if isinstance(source, Column) else F.col(source) if source in df.columns else F.lit(source)
    return df.select(name.cast("string").alias("source"), at.cast("bigint").alias("ordinal"), framed(F.col(text)).alias("text"), F.lit(False).alias("used_fallback"))


def from_texts(df: DataFrame, text: str, source: str) -> DataFrame:
    """Lines of whole texts, one text to a row, each a source of its own.  A line end at
    the very end begins no further line."""
    whole = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\n$(?![\\s\\S])", "")
    parts = F.when(F.coalesce(F.col(text), F.lit("")) != "", F.split(whole, "\n", -1)).otherwise(F.array())
    rows = df.select(F.col(source).cast("string").alias("source"), F.posexplode(parts).alias("_at", "text"))
    return rows.select("source", (F.col("_at") + 1).cast("bigint").alias("ordinal"), framed(F.col("text")).alias("text"), F.lit(False).alias("used_fallback"))


def binary_sources(spark: SparkSession, path: str | list[str], config: Config = Config()) -> DataFrame:
    """For each file its size, whether a NUL is among its first bytes, and whether it is
    empty.

    The listing gives names without reading files, those of empty ones too, which a scan
    would pass over; tasks ask for each file's size and read its head alone, so a file of
    any size costs the same.
    """
    names = spark.read.format("binaryFile").load(path).inputFiles()
    files = spark.createDataFrame([(n,) for n in names], "source string").repartition(max(1, min(len(names), spark.sparkContext.defaultParallelism)))
    size = config.sniff_bytes

    def sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                system, at = FileSystem.from_uri(name)
                with system.open_input_stream(at, buffer_size=0, compression=None) as f:
                    head = f.read(size)
                rows.append((unquote(name).replace("file:///", "file:/", 1), system.get_file_info(at).size, b"\0" in head))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.bool_()))], names=["source", "bytes", "binary"])

    found = files.mapInArrow(sniff, "source string, bytes bigint, binary boolean")
    return found.withColumn("empty", F.col("bytes") == 0)


def json_line_counts(lines: DataFrame) -> DataFrame:
    """For each source, lines that are JSON of any type and other non-blank lines."""
    from driftwood.functions import levels, structured
    from driftwood.operators.detect import is_blank

    real = lines.where(~is_blank(F.col("text")))
    ok = structured.is_json(levels.trimmed(F.col("text")))
    return real.groupBy("source").agg(F.count_if(ok).alias("entry_count"), F.count_if(~ok).alias("warnings"))
