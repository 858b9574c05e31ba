"""Document fingerprints: a homomorphic multiset hash of paragraphs, in SQL functions only.

A paragraph is a non-empty line.  It is hashed to a wide vector, and a document's
fingerprint is the sum of its paragraphs' vectors modulo powers of two.  So the order of
paragraphs does not matter, inserting one adds its vector and deleting one subtracts it.

The vector has two wide lanes of 62 bits, which make unequal multisets differ, and 64
narrow lanes.  These are sums over the paragraph's pieces, its sentences, each of which adds
one bit of a further hash to each lane; so documents of few long paragraphs can be likened
as well.  The narrow lanes are packed two to a word of 62 bits, which leaves the upper one
30 bits: no text has 2**30 pieces, since each takes two bytes of at most 2**31.  With the
number of pieces they are a sketch in which two documents' lanes correlate as far as they
share pieces (``likeness``).  A paragraph's vector depends on the paragraph alone.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: All sums are taken modulo 2**62, so that no addition overflows.
MODULUS = (1 << 62) - 1
#: One bit of each of two lanes, and the number of words that hold the 64 lanes.
LANE_BITS, LANE_WORDS = 0x0000_0001_0000_0001, 32
#: Between pieces: the ends of paragraphs, and space after what ends a sentence.
_PIECES = r"\n|(?<=[.!?\u3002\uff01\uff1f])[ \t\r]+"
_WHOLE = ["n", "wide0", "wide1"]
_PARTS = ["pieces", *(f"w{i:02d}" for i in range(LANE_WORDS))]
_SUMS = [*_WHOLE, *_PARTS]


def paragraphs(text: Column) -> Column:
    return _filled(text, "\n")


def _filled(text: Column, between: str) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), between, -1), lambda p: F.length(p) > 0)


def _whole(p: Column) -> list[Column]:
    """What a paragraph adds: one, and two hashes below 2**62."""
    return [F.lit(1).cast("long"), *(F.xxhash64(F.lit(f"wide{i}"), p).bitwiseAND(MODULUS) for i in range(2))]


def _lane_bits(piece: Column) -> list[Column]:
    """What a piece adds: one, and its bits i and 32 + i to word i."""
    lanes = F.xxhash64(F.lit("lanes"), piece)
    return [F.lit(1).cast("long"), *(F.shiftrightunsigned(lanes, i).bitwiseAND(LANE_BITS) for i in range(LANE_WORDS))]


def _summed(parts: Column, names: list[str], vector) -> Column:
    zero = F.struct(*(F.lit(0).cast("long").alias(s) for s in names))

    def add(total: Column, part: Column) -> Column:
        return F.struct(*((total[s] + part[s]).bitwiseAND(MODULUS).alias(s) for s in names))

    return F.aggregate(F.transform(parts, lambda p: F.struct(*(v.alias(s) for v, s in zip(vector(p), names)))), zero, add)


def fingerprint(text: Column) -> Column:
    """A struct of sums modulo 2**62: n, wide0, wide1 over paragraphs, pieces and w00 to w31
    over pieces.  Null is empty."""
    parts = F.struct(_summed(paragraphs(text), _WHOLE, _whole).alias("of"), _summed(_filled(text, _PIECES), _PARTS, _lane_bits).alias("by"))
    # named once, so that neither sum is made for each of its parts
    return F.transform(F.array(parts), lambda x: F.struct(*(x["of"][s].alias(s) for s in _WHOLE), *(x["by"][s].alias(s) for s in _PARTS)))[0]


def inserted(print_: Column, paragraph: Column) -> Column:
    """The fingerprint after a paragraph has been added."""
    return _with(print_, paragraph, lambda a, b: a + b)


def deleted(print_: Column, paragraph: Column) -> Column:
    """The fingerprint after a paragraph that it holds has been taken away."""
    return _with(print_, paragraph, lambda a, b: a - b)


def _with(print_: Column, paragraph: Column, change) -> Column:
    both = F.array(F.struct(print_.alias("a"), fingerprint(paragraph).alias("b")))
    return F.transform(both, lambda x: F.struct(*(change(x["a"][s], x["b"][s]).bitwiseAND(MODULUS).alias(s) for s in _SUMS)))[0]


def as_text(print_: Column) -> Column:
    """Fixed-width lowercase hex of all sums."""
    return F.lower(F.concat(*(F.lpad(F.hex(print_[s]), 16, "0") for s in _SUMS)))


def _lanes(print_: Column) -> Column:
    """The 64 lanes as differences of ones and zeros."""
    words = F.array(*(print_[f"w{i:02d}"] for i in range(LANE_WORDS)))
    spread = F.flatten(F.transform(F.array(F.lit(0), F.lit(32)), lambda s: F.transform(words, lambda w: F.call_function("shiftrightunsigned", w, s).bitwiseAND(0xFFFF_FFFF))))
    return F.transform(spread, lambda ones: (2 * ones - print_["pieces"]).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of two fingerprints' lanes, negative ones as 0; 1 if equal, 0 if
    one of them alone is empty.  It estimates the cosine of the piece counts with a
    standard error of about 1/8."""
    norm = F.sqrt(_dot(_lanes(a), _lanes(a)) * _dot(_lanes(b), _lanes(b)))
    cosine = F.when(norm > 0, _dot(_lanes(a), _lanes(b)) / norm).otherwise(0.0)
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(0.999)))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Columns key, text and next_text: the text of the row that follows by key; after
    the last row comes the first.

    Rows are dealt to ranges of the key (its quantiles, found in a pass over the key
    alone), each of which is sorted by itself, so texts are shuffled once and no task
    gets all rows.  The last row of a range finds the first of the next range in a table
    of one row per range.  Null keys come first; rows of one key are ordered by text.
    Strings, ordered by their bytes, have a place by the seven bytes after what all of them
    begin with; those that agree in these share a range.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)[key]
    docs = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # ranges are of a key that has quantiles: the key, or a string's place
    docs = docs.withColumn("_at", _place(docs) if kind == "string" else F.col("_key"))
    cuts = docs.select(F.percentile_approx("_at", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).head()[0]
    dealt = docs.withColumn("_part", F.coalesce(_bounds_below(F.col("_at"), sorted(set(cuts or []))), F.lit(-1)))
    order = Window.partitionBy("_part").orderBy(F.col("_key").asc_nulls_first(), "_text")
    rows = dealt.withColumn("_next", F.lead("_text").over(order))
    # the first key of each range, at most one row per range, and the range before it
    firsts = sorted((r["_part"], r["_first"]) for r in dealt.groupBy("_part").agg(F.min("_key").alias("_first")).collect())
    after = [(firsts[i - 1][0], *firsts[i]) for i in range(len(firsts))]
    wanted = F.broadcast(spark.createDataFrame(after, f"_part int, _of int, _first {kind}"))
    heads = docs.join(wanted, F.col("_key").eqNullSafe(F.col("_first"))).groupBy("_part").agg(F.min("_text").alias("_head"))
    rows = rows.join(heads, "_part", "left")
    return rows.select(F.col("_key").alias(key), F.col("_text").alias(text), F.coalesce("_next", "_head").alias("next_text"))


def _place(docs: DataFrame) -> Column:
    """A number that goes up with the strings of ``_key``."""
    ends = [(x or "").encode() for x in docs.agg(F.min("_key"), F.max("_key")).head()]
    common = len(os.path.commonprefix(ends))
    told = F.substring(F.hex(F.col("_key")), 2 * common + 1, 14)
    return F.conv(F.rpad(told, 14, "0"), 16, 10).cast("long")


def _bounds_below(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds are below the key, in two steps of sqrt(n) compares."""
    if not bounds:
        return F.when(key.isNotNull(), F.lit(0))
    step = math.isqrt(len(bounds)) + 1
    tops, every = F.array(*map(F.lit, bounds[step - 1 :: step])), F.array(*map(F.lit, bounds))
    if not bounds[step - 1 :: step]:
        return F.size(F.filter(every, lambda b: b < key))
    block = F.size(F.filter(tops, lambda b: b < key)) * step
    rank = block + F.size(F.filter(F.slice(every, block + 1, F.lit(step)), lambda b: b < key))
    return F.when(key.isNotNull(), rank)
