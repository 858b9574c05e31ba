"""Tables written out as log lines, so that the driver's tables can be parsed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an event's type is written as, in which level's words.
WORDS = {"error": "ERROR", "purchase": "warning", "signup": "notice", "click": "debug", "view": "TRACE"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table; dealt out evenly where it has fewer splits than there are cores."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def word() -> Column:
    return F.create_map(*(F.lit(x) for p in WORDS.items() for x in p))[F.col("event_type")]


def stamp(pattern: str) -> Column:
    return F.date_format("ts", pattern)


def iso(separator: str = "'T'") -> Column:
    return F.date_format("ts", f"yyyy-MM-dd{separator}HH:mm:ss.SSS")


def as_lines(df: DataFrame, text: Column, source: str = "events") -> DataFrame:
    """Lines with the event's id as the number (from 1)."""
    return df.select(F.lit(source).alias("source"), (F.col("event_id") + 1).alias("ordinal"), text.alias("text"), F.lit(False).alias("used_fallback"))


def json_lines(df: DataFrame) -> DataFrame:
    body = F.struct(
        F.concat(iso(), F.lit("Z")).alias("timestamp"), word().alias("level"), F.concat(F.lit("event "), "event_type").alias("message"), F.col("user_id").alias("user"), F.col("event_type").alias("kind"), F.from_json("props", "struct<k:bigint>").alias("props")
    )
    return as_lines(df, F.to_json(body))


def logfmt_lines(df: DataFrame) -> DataFrame:
    text = F.concat(F.lit("ts="), iso(), F.lit("Z level="), word(), F.lit(' msg="event of \\"'), "event_type", F.lit('\\"" user='), "user_id", F.lit(" kind="), "event_type")
    return as_lines(df, text)


def plain_lines(df: DataFrame) -> DataFrame:
    return as_lines(df, F.concat(iso("' '"), F.lit("Z "), word(), F.lit(" user "), F.col("user_id").cast("string"), F.lit(" did "), "event_type"))


def chained_lines(df: DataFrame, most: int = 5) -> DataFrame:
    """Every event a line; an error is followed by event_id % most stack frames.  Numbers
    leave room for the frames, so lines of different events are never next to each other
    but for those of one event."""
    n = F.when(F.col("event_type") == "error", F.col("event_id") % most).otherwise(0)
    rows = df.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), n)))
    first = F.concat(iso("' '"), F.lit("Z "), word(), F.lit(" event "), "event_type")
    frame = F.concat(F.lit("  at module.frame"), F.col("_i").cast("string"), F.lit("(user"), F.col("user_id").cast("string"), F.lit(")"))
    return rows.select(F.lit("events").alias("source"), (F.col("event_id") * (most + 1) + F.col("_i") + 1).alias("ordinal"), F.when(F.col("_i") == 0, first).otherwise(frame).alias("text"), F.lit(False).alias("used_fallback"))
