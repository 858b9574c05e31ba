"""Importance resampling towards a target distribution.

Features are runs of consecutive words, counted in a fixed number of hash buckets over all
documents and over all texts of the target.  A bucket's gain is the logarithm of how much
likelier the target is to show it; a document's weight is the mean gain of its features,
which tasks look up in one array of gains.  Noise that only depends on a document's key
turns the highest scores into a sample without replacement.

Which documents have the highest scores is found without sorting them: the digits of
(score, key) are resolved from the top, one count by digit a pass, and only the digit in
which the last place falls is looked into further.  The documents drawn, and no others, are
then sorted by range and numbered from the counts of the ranges before theirs.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.llm.arrow import kept_fields
from driftwood.llm.cluster import checkpointed

BUCKETS, SEED, PERCENT, LEAST_WORDS, LONGEST_RUN = 10_000, 2024, 10, 20, 1
#: Bits of a digit: a pass counts by at most so many values.
DIGIT_BITS = 12
#: Distinct features that a task counts or remembers before it lets go of them.
REMEMBERED = 200_000
#: What is in no word becomes a space, A to Z become small; bytes beyond ASCII stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def features_of(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of one to ``longest`` consecutive words, joined by one space."""
    runs = list(words)
    for n in range(2, longest + 1):
        runs += map(b" ".join, zip(*(words[i:] for i in range(n))))
    return runs


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return (v.as_py() for v in column)


def bucket_counts(texts: DataFrame, text: str, buckets: int, longest: int) -> list[int]:
    """How many features of all texts fall in each bucket.

    Tasks hand on at most one count a bucket, so what reaches the driver is one number a
    bucket and does not grow with the texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros(buckets, np.int64), Counter()

        def settle() -> None:
            for feature, n in seen.items():
                sums[zlib.crc32(feature) % buckets] += n
            seen.clear()

        for batch in batches:
            for value in _texts(batch, text):
                seen.update(features_of(words_of(value), longest))
                if len(seen) > REMEMBERED:
                    settle()
        settle()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], names=["bucket", "n"])

    rows = texts.select(text).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = [0] * buckets
    for bucket, n in rows.collect():  # at most one row a bucket
        found[bucket] = n
    return found


def gains(source: list[int], target: list[int]) -> list[int]:
    """By bucket, a thousand times the logarithm of the smoothed ratio, rounded down."""
    b, s_all, t_all = len(source), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(source, target)]


class _Gains(dict):
    """Gains by feature, looked up in the array of buckets once for each feature."""

    def __init__(self, by_bucket: list[int]):
        self.by_bucket = by_bucket

    def __missing__(self, feature: bytes) -> int:
        self[feature] = gain = self.by_bucket[zlib.crc32(feature) % len(self.by_bucket)]
        return gain


def _weighed(docs: DataFrame, text: str, by_bucket: list[int], longest: int, keep: list[str]) -> DataFrame:
    new = T.StructType([T.StructField("_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])
    fields = kept_fields(docs, new, keep)
    names = [f.name for f in fields]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Gains(by_bucket)
        for batch in batches:
            words, sizes, weights = [], [], []
            for value in _texts(batch, text):
                own = words_of(value)
                found = features_of(own, longest)
                words.append(len(own))
                sizes.append(len(found))
                weights.append(sum(map(known.__getitem__, found)) // len(found) if found else 0)
                if len(known) > REMEMBERED:
                    known.clear()
            made = [pa.array(x, pa.int64()) for x in (words, sizes, weights)]
            held = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(held + made, names=[*names, "_words", "n_features", "weight"])

    return docs.mapInArrow(weigh, T.StructType(fields + list(new)))


def _noise(key: Column, seed: int) -> Column:
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _key_digits(rows: DataFrame, key: str) -> list[Column]:
    """Whole numbers whose order, one after the other, is the key's; nulls come last."""
    value = F.col(key)
    missing = value.isNull().cast("long")
    if isinstance(rows.schema[key].dataType, T.IntegralType):
        whole = F.coalesce(value.cast("long"), F.lit(0))
        return [missing, F.shiftright(whole, 32), whole.bitwiseAND(F.lit(2**32 - 1))]
    # six bytes at a time, so that each number is one of 48 bits; the length tells apart what
    # only ends in zero bytes
    raw = F.encode(F.coalesce(value.cast("string"), F.lit("")), "UTF-8")
    longest = rows.agg(F.max(F.octet_length(raw))).head()[0] or 0
    padded = F.rpad(raw, F.lit(6 * (longest // 6 + 1)), F.unhex(F.lit("00")))
    parts = [F.conv(F.hex(F.substring(padded, F.lit(1 + 6 * i), F.lit(6))), 16, 10).cast("long") for i in range(longest // 6 + 1)]
    return [missing, *parts, F.octet_length(raw).cast("long")]


def _digit(value: Column, low: int, shift: int) -> Column:
    """The bits of what ``value`` is beyond ``low``, from ``shift`` up."""
    return F.shiftright(value - F.lit(low), shift)


def nth(rows: DataFrame, columns: list[str], n: int) -> list[int]:
    """The values of ``columns`` (whole numbers without nulls, each less than 2 ** 63
    apart) of the ``n``-th row in their order, from 1, exactly: a prefix of them if that
    already cuts off n rows.

    Each pass counts the rows that are still open by one digit, at most 2 ** DIGIT_BITS
    numbers, and goes on in the digit that holds the n-th row.  It ends as soon as a value
    is found all of whose rows are among the first n.
    """
    found, open_ = [], rows
    for name in columns:
        low, high, left = open_.agg(F.min(name), F.max(name), F.count("*")).head()
        if left == n:
            return found
        bits, prefix = max(0, high - low).bit_length(), 0
        for shift in range(-DIGIT_BITS * (-bits // DIGIT_BITS) - DIGIT_BITS, -1, -DIGIT_BITS):
            inside = open_ if shift + DIGIT_BITS >= bits else open_.where(_digit(F.col(name), low, shift + DIGIT_BITS) == prefix)
            counts = dict(inside.groupBy(_digit(F.col(name), low, shift).alias("d")).agg(F.count("*").alias("n")).collect())
            for prefix in sorted(counts):
                if n <= counts[prefix]:
                    break
                n -= counts[prefix]
        found.append(low + prefix)
        open_ = open_.where(F.col(name) == found[-1])
    return found


def _upto(columns: list[str], found: list[int]) -> Column:
    """Whether a row comes no later than the values found, column by column."""
    if not found:
        return F.lit(True)
    first, value = F.col(columns[0]), F.lit(found[0])
    if len(found) == 1:
        return first <= value
    return (first < value) | ((first == value) & _upto(columns[1:], found[1:]))


def ranked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``rank``, from 1 in the order of ``columns``: sorted by range, each
    numbered within its range after the counts of the ranges before."""
    rows = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    rows = checkpointed(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_before")
    place = F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    out = rows.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return out.withColumn("rank", (F.col("_before") + place + 1).cast("long")).drop("_part", "_at", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    longest: int = LONGEST_RUN,
    seed: int = SEED,
) -> DataFrame:
    """Columns key, n_features, weight, score and rank for each row of ``docs``.

    rank, from 1 by score, then key, is null for rows that are not drawn.  Drawn are
    ``percent`` of the rows of at least ``least_words`` words, rounded down.  Null and
    empty texts have no features and weight 0; null keys are hashed as ``null`` and come
    last among equal scores.  Rows that repeat a key share its noise and are drawn each on
    its own: those of equal score and key by a hash of the text, and equal rows in the
    order of the table written on the way, so exactly as many are drawn as are asked for.
    An empty target gives all buckets the same count; an empty table an empty result.
    Other columns are not handed on.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    by_bucket = gains(bucket_counts(rows, "_text", buckets, longest), bucket_counts(target.select(F.col(target_text).alias("_text")), "_text", buckets, longest))
    rows = rows.withColumn("_same", F.shiftright(F.xxhash64("_text"), 2))
    rows = _weighed(rows, "_text", by_bucket, longest, ["_key", "_same"])
    rows = rows.withColumn("score", F.col("weight") + _noise(F.col("_key"), seed))
    # some numbers a row; the texts are not read again
    rows = checkpointed(rows.withColumn("_row", F.monotonically_increasing_id()))
    digits = [(-F.col("score")).alias("_d0"), *(d.alias(f"_d{i}") for i, d in enumerate(_key_digits(rows, "_key"), 1))]
    names = [f"_d{i}" for i in range(len(digits))] + ["_same", "_row"]
    placed = rows.select("*", *digits)
    able = placed.where(F.col("_words") >= least_words)
    size = able.count() * percent // 100
    columns = [F.col("_key").alias(key), "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if size == 0:
        return placed.select(*columns, none)
    drawn = (F.col("_words") >= least_words) & _upto(names, nth(able, names, size))
    return ranked(placed.where(drawn), names).select(*columns, "rank").unionByName(placed.where(~drawn).select(*columns, none))
