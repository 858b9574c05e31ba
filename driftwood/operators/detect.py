"""Format detection from the first non-blank lines of each source."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwood.config import Config
from driftwood.functions import levels, structured
from driftwood.operators.plain import prefix_only


def is_blank(text):
    return text.rlike(r"(?U)^\s*$")


def sampled(lines: DataFrame, config: Config = Config()) -> DataFrame:
    """The first ``sample_lines`` non-blank lines of each source.

    Every task keeps only so many lines per source before the shuffle.
    """
    order = Window.partitionBy("source").orderBy("ordinal")
    rows = lines.where(~is_blank(F.col("text"))).select("source", "ordinal", "text")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= config.sample_lines).drop("_n")


def detect(lines: DataFrame, reference: datetime | None = None, config: Config = Config()) -> DataFrame:
    """One row per source of ``lines``: format, match_fraction, outcome (``threshold`` or
    ``fallback``), timestamp_shape and timestamp_offset.

    JSON wins at the threshold, then logfmt, else it is plain.  The shape is the one of
    most lines of a plain source; of equally many, the one first seen last.  A source of
    blank lines alone is plain with fraction 0.
    """
    text = levels.trimmed(F.col("text"))
    rows = sampled(lines, config).withColumn("_t", structured.logfmt_tokens(F.col("text")))
    pairs = structured.pair_count(F.col("_t"))
    rows = rows.withColumns(
        {
            "_json": text.startswith("{") & structured.is_json(text),
            "_logfmt": (pairs >= 1) & (pairs >= config.logfmt_min_share * F.size("_t")),
            "_prefix": prefix_only(F.col("text"), reference, config),
        }
    ).select("source", "ordinal", "_json", "_logfmt", "_prefix.shape", "_prefix.offset")
    shares = rows.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if("_json").alias("j"), F.count_if("_logfmt").alias("l"), F.count_if(F.col("shape").isNotNull()).alias("p")
    )
    modal = rows.where("shape IS NOT NULL").groupBy("source", "shape", "offset").agg(F.count("*").alias("c"), F.min("ordinal").alias("seen"))
    modal = modal.groupBy("source").agg(F.max_by(F.struct("shape", "offset"), F.struct("c", "seen")).alias("m"))
    every = lines.select("source").distinct()
    found = every.join(shares, "source", "left").join(modal, "source", "left")
    share = {k: F.coalesce(F.col(k) / F.col("n"), F.lit(0.0)) for k in "jlp"}
    at = F.lit(config.threshold)
    kind = F.when(share["j"] >= at, "json").when(share["l"] >= at, "logfmt").otherwise("plain")
    best = F.when(share["j"] >= at, share["j"]).when(share["l"] >= at, share["l"]).otherwise(F.greatest(*share.values()))
    outcome = F.when((kind != "plain") | (share["p"] >= at), "threshold").otherwise("fallback")
    return found.select(
        "source",
        kind.alias("format"),
        best.alias("match_fraction"),
        outcome.alias("outcome"),
        F.when(kind == "plain", F.col("m.shape")).alias("timestamp_shape"),
        F.when(kind == "plain", F.col("m.offset")).alias("timestamp_offset"),
    )
