"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a target number of words.  Whole passes over a source's documents are
taken as often as they fit; for what is left, documents are ordered by a hash of their
identity and a threshold is searched below which the hashes hold that many words.  The
search never sorts: sizes are summed by source and hash bucket, the bucket in which the
target falls is found, and only that bucket's documents are summed again by the next bits
of the hash, until a bucket holds documents of one hash only.  Thresholds are nested: a
larger target takes all that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.llm.cluster import checkpointed

#: Hex digits of the hash that are resolved at each level, and in all.
LEVEL_DIGITS, DIGITS = 3, 15
#: Weights of the sources in order, repeating, and the share of all words to take.
WEIGHTS, BUDGET_PERCENT, MOST_TIMES = (5, 2, 1), 150, 2
#: A table of thresholds of up to so many sources is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 10_000
#: A word (fixed value of the contract).
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = BUDGET_PERCENT, most: int = MOST_TIMES) -> DataFrame:
    """``sizes`` (source, source_size) with weight and target.

    Water filling: with l the words per unit of weight, a source takes min(l * weight,
    most * size).  Sources are ordered by the l at which they fill up; the right l is the
    first that leaves its source unfilled, which is the greatest such.  One row per source goes through one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % n + 1)
    ranked = sizes.withColumn("weight", weight.cast("long"))
    ranked = ranked.withColumn("full_at", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    by_full = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = ranked.withColumns(
        {
            "full_before": F.coalesce(F.sum("source_size").over(by_full), F.lit(0)) * most,
            "weight_before": F.coalesce(F.sum("weight").over(by_full), F.lit(0)),
            "all_words": F.sum("source_size").over(every),
            "all_weight": F.sum("weight").over(every),
        }
    )
    budget = F.col("all_words") * (percent / 100)
    level = (budget - F.col("full_before")) / (F.col("all_weight") - F.col("weight_before"))
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every))
    target = F.least(F.col("level") * F.col("weight"), (F.lit(most) * F.col("source_size")).cast("double"))
    filled = F.coalesce(target, (F.lit(most) * F.col("source_size")).cast("double"))
    return ranked.select("source", "source_size", "weight", filled.alias("target"))


def _joined(docs: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Null-safe join of documents to one row per source."""
    right = sources.withColumnRenamed("source", "_s")
    return docs.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", percent: int = BUDGET_PERCENT, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Columns key, source, size, source_size, target, taken for each row of ``docs``.

    size is the number of words (null text: 0), taken the words the mix takes of the row:
    its size times 0, 1 or 2.  A null source is a source of its own, the last; a null key
    is a key like any other.  Rows with the same source and key (repeated rows) share a
    hash and are taken alike.  A source without words has target 0.  Reruns agree, since
    the hash is of the key alone.  An empty table gives an empty result.
    """
    identity = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    base = docs.select(F.col(key), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.substring(F.md5(identity), 1, DIGITS).alias("_h"))
    # texts are read once; what follows works on a few numbers a row
    base = checkpointed(base)
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights, percent).withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goals = goals.withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size"))
    # one row per source: hashes before _below are in, those in bucket _at are still open
    open_ = goals.withColumns({"_at": F.lit(""), "_need": F.col("_left")})
    few = goals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    for level in range(LEVEL_DIGITS, DIGITS + 1, LEVEL_DIGITS):
        held = _joined(base, open_.select("source", "_at"), few)
        held = held.where(F.substring("_h", 1, level - LEVEL_DIGITS) == F.col("_at"))
        buckets = held.groupBy("source", F.substring("_h", 1, level).alias("_b")).agg(F.sum("size").alias("_n"))
        run = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        buckets = buckets.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0)))
        sums = _joined(buckets, open_.select("source", "_need"), few)
        # the boundary bucket is the last whose words before it are within the need
        edge = sums.where(F.col("_before") <= F.col("_need")).groupBy("source").agg(F.max(F.struct("_b", "_before", "_n")).alias("_e"))
        edge = edge.select("source", F.col("_e._b").alias("_at"), F.col("_e._before").alias("_took"), F.col("_e._n").alias("_n"))
        open_ = _joined(open_.drop("_at", "_n"), edge, few).withColumn("_need", F.col("_need") - F.col("_took")).drop("_took")
        open_ = checkpointed(open_)  # one row per source
    # the last bucket holds one hash: in, if that brings the sum nearer to the target
    ends = open_.select("source", "source_size", "target", "_whole", "_at", (F.col("_n") < 2 * F.col("_need")).alias("_in"))
    mixed = _joined(base, ends, few)
    extra = (F.col("_h") < F.col("_at")) | ((F.col("_h") == F.col("_at")) & F.col("_in"))
    times = F.least(F.col("_whole") + extra.cast("long"), F.lit(MOST_TIMES))
    return mixed.select(key, "source", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), times.cast("long").alias("times"))
