"""Personal data by base expressions and bootstrapped contextual extraction.

Base spans come from four expressions and their checks.  They are the seeds of a
bootstrap: every identifier-like piece of text (with a digit or an @), base span or not,
is an instance, and the words around it and its own shape are its lexical patterns.  The
graph of patterns and instances is scored in Spark in turns: a pattern is as sure of a
kind as its instances are, an instance outside the base as the two surest of its patterns.
Instances that have become sure are seeds from the next turn on and induce patterns of
their own.  Pieces on whose kind two patterns agree with high confidence become spans of
that kind.  What a context shows that cannot be of the kind at all speaks against it, and
so do many pieces beside few seeds: six turns lift a context in which a share r of the
pieces are seeds to about 1 - (1 - r) ** 7.  Base spans stay.

Identifiers are rare, so the graph is a small part of the text.  It is joined and summed,
never gathered; texts are read once for the graph and once where they are redacted.
"""

from __future__ import annotations

import re
from itertools import count

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.llm.arrow import add_columns
from driftwood.llm.cluster import checkpointed

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; seeds that a pattern needs, and the confidence it needs at the end.
ROUNDS, LEAST_SEEDS, CONFIDENCE = 6, 5, 0.8
#: Up to so many found spans are broadcast for redaction; beyond, they are joined.
BROADCAST_SPANS = 500_000
#: Words and shapes beyond so many characters stand in a pattern by their digest.
LONGEST = 60

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK, _PIECE, _MORE = re.compile(r"[0-9@]"), re.compile(r"\S+"), re.compile(r"[ ]\(?[0-9][0-9().-]*")
_EDGE = ".,;:!?\"'()[]{}<>"
_DIGITS = re.compile(r"\D+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address expression, in linear time: each
    has the longest local part before its @ that no earlier match has taken."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append((begin, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return found


def luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) in code points, by start, then kind."""
    if _MARK.search(text) is None:
        return []
    found = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p := g.lstrip("0")) < 3 or len(p) == 3 and int(p) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(found)


def _named(text: str) -> str:
    return text if len(text) <= LONGEST else f"#{xxhash.xxh3_128_hexdigest(text)}"


def shape(piece: str) -> str:
    """Digits as 9, runs of letters as a."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "9", piece))


def possible(piece: str) -> int:
    """The kinds, as bits, that a piece can be of at all: a sure context alone does not make
    a small number a phone number."""
    digits = sum(map(str.isdigit, piece))
    able = ("@" in piece, piece.count(".") >= 3 and digits >= 4, 12 <= digits <= 19, 7 <= digits <= 15)
    return sum(1 << k for k, ok in enumerate(able) if ok)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like pieces outside the base spans: white-space delimited, with a digit
    or an @, grown over following groups of digits, without punctuation at their ends."""
    found, done, k = [], 0, 0
    for m in _PIECE.finditer(text):
        a, b = m.span()
        if a < done or _MARK.search(m[0]) is None:
            continue
        while k < len(base) and base[k][1] <= a:
            k += 1
        stop = base[k][0] if k < len(base) else len(text)
        while (more := _MORE.match(text, b)) and more.end() <= stop:
            b = more.end()
        done = b
        if any(x < b and a < y for x, y, _ in base[max(0, k - 1) : k + 4]):
            continue
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        while a < b and text[a] in _EDGE:
            a += 1
        if a < b:
            found.append((a, b))
    return found


def _around(text: str, at: int, step: int) -> list[str]:
    """The two whole words of the line next to a place, before it (``step`` -1) or after it
    (1), as far away as they are."""
    reach = 96
    while True:
        part = text[max(0, at - reach) : at] if step < 0 else text[at : at + reach]
        line = part.rpartition("\n") if step < 0 else part.partition("\n")
        words = (line[2] if step < 0 else line[0]).split()
        # the outermost word may go on beyond what has been looked at
        if line[1] or len(words) > 2 or len(part) < reach:
            return words[-2:] if step < 0 else words[:2]
        reach *= 4


def patterns(text: str, a: int, b: int) -> list[str]:
    """The lexical patterns of the piece from a to b: two words before, two words after,
    the word on each side, and its shape."""
    plain = lambda w: "#" if _MARK.search(w) else _named(w.strip(_EDGE).lower())
    left = ["^", "^", *map(plain, _around(text, a, -1))][-2:]
    right = [*map(plain, _around(text, b, 1)), "$", "$"][:2]
    return [f"before {left[0]} {left[1]}", f"after {right[0]} {right[1]}", f"between {left[1]} {right[0]}", f"shape {_named(shape(text[a:b]))}"]


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.IntegerType())])
_INSTANCE = T.StructType(
    [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("instance", T.LongType()), T.StructField("able", T.IntegerType()), T.StructField("patterns", T.ArrayType(T.StringType()))]
)
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))
_INSTANCES_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("instance", pa.int64()), ("able", pa.int32()), ("patterns", pa.list_(pa.string()))]))
FOUND = T.StructType([T.StructField("base", T.ArrayType(_SPAN), False), T.StructField("instances", T.ArrayType(_INSTANCE), False)])


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def scanned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key, text_hash, base (spans) and instances with their patterns and the kinds
    that they can be of; a piece outside the base has a null kind."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        bases, instances = [], []
        for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
            t = t or ""
            base = base_spans(t)
            pieces = [*base, *((a, b, None) for a, b in candidates(t, base))] if base or _MARK.search(t) else []
            bases.append([{"start": a, "end": b, "kind": k} for a, b, k in base])
            instances.append([{"start": a, "end": b, "kind": k, "instance": _hash(t[a:b].lower()), "able": possible(t[a:b]), "patterns": patterns(t, a, b)} for a, b, k in pieces])
        return [pa.array(bases, _SPANS_ARROW), pa.array(instances, _INSTANCES_ARROW)]

    return add_columns(docs, FOUND, make, keep=[key, "text_hash"], owner="pii")


def _two_best(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (pattern, confidence and ``by``) summed up: score, the mean of the two
    greatest confidences, of patterns that differ."""
    # there are at most four patterns to an occurrence, but an instance may occur anywhere
    best = rows.groupBy(*by).agg(F.max(F.struct("confidence", "pattern")).alias("m"))
    rest = rows.join(best, by).where(F.col("pattern") != F.col("m.pattern")).groupBy(*by).agg(F.max("confidence").alias("next"))
    both = best.join(rest, by, "left")
    return both.select(*by, ((F.col("m.confidence") + F.coalesce("next", F.lit(0.0))) / 2).alias("score"))


def confident_patterns(instances: DataFrame) -> DataFrame:
    """Columns pattern, kind, confidence of the patterns that have any at the end.

    ``instances`` has instance, kind (null outside the base), able (the kinds that it can be
    of, as bits) and pattern.  A pattern's confidence in a kind is the sum of its distinct
    instances' scores for that kind over their number plus one.  A seed scores 1 for its
    kind; any other instance that can be of it scores the mean confidence of the two of its
    patterns that are surest.  Instances of a score of ``CONFIDENCE`` are seeds from then
    on.  Patterns with fewer than ``LEAST_SEEDS`` different seeds of a kind take no part.
    """
    edges = instances.groupBy("pattern", "instance").agg(F.max("kind").alias("seed"), F.max("able").alias("able"))
    edges = checkpointed(edges)
    size = checkpointed(edges.groupBy("pattern").agg(F.count("*").alias("n")))
    seeds = edges.where("seed IS NOT NULL").select("pattern", "instance", F.col("seed").alias("kind"))
    open_edges = edges.where("seed IS NULL").select("pattern", "instance", "able")
    made, scores = None, None
    for _ in range(ROUNDS + 1):
        known = seeds if made is None else seeds.unionByName(open_edges.join(made, "instance").select("pattern", "instance", "kind"))
        counted = known.groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= LEAST_SEEDS)
        able = counted.join(size, "pattern")
        if scores is None:
            gained = able.withColumn("gain", F.lit(0.0))
        else:
            # seeds that were made count in full among the seeds
            fresh = scores.where(F.col("score") < CONFIDENCE)
            gains = open_edges.join(fresh, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("gain"))
            gained = able.join(gains, ["pattern", "kind"], "left").fillna(0.0, "gain")
        patterns_ = checkpointed(gained.select("pattern", "kind", ((F.col("seeds") + F.col("gain")) / (F.col("n") + 1)).alias("confidence")))
        met = open_edges.join(patterns_, "pattern").where(F.expr("(shiftright(able, kind) & 1) = 1"))
        scores = checkpointed(_two_best(met.select("pattern", "confidence", "instance", "kind"), ["instance", "kind"]))
        made = scores.where(F.col("score") >= CONFIDENCE).select("instance", "kind")
    return patterns_


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, text_hash, base and found for each row: arrays of (start, end, kind)
    in code points, end exclusive, by start, then kind; kind numbers as in ``KINDS``.

    Null and empty texts have none.  Rows of one key and text get the same spans, so
    repeated rows do; found spans never overlap base spans.  Of kinds that claim one
    piece, the surest is taken, then the first.  An empty table gives an empty result;
    other columns are not handed on.
    """
    docs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), _text_hash(text).alias("text_hash"))
    seen = checkpointed(scanned(docs, "_key", "_text"))
    pieces = seen.select("_key", "text_hash", F.explode("instances").alias("i")).select("_key", "text_hash", "i.*")
    sure = checkpointed(confident_patterns(pieces.select("instance", "kind", "able", F.explode("patterns").alias("pattern"))))
    left = pieces.where("kind IS NULL AND able > 0").select(F.struct("_key", "text_hash").alias("row"), "start", "end", "able", F.explode("patterns").alias("pattern"))
    claims = left.join(sure, "pattern").where(F.expr("(shiftright(able, kind) & 1) = 1")).select("row", "start", "end", "kind", "pattern", "confidence")
    place = ["row", "start", "end"]
    claims = _two_best(checkpointed(claims), [*place, "kind"]).where(F.col("score") >= CONFIDENCE)
    claims = claims.groupBy(*place).agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("c"))
    found = claims.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end", (-F.col("c.k")).alias("kind")))).alias("found"))
    out = seen.select("_key", "text_hash", "base").join(found.select(F.col("row._key").alias("_k"), F.col("row.text_hash").alias("_h"), "found"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("text_hash") == F.col("_h")), "left")
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")
    return out.select(F.col("_key").alias(key), "text_hash", "base", F.coalesce("found", empty).alias("found"))


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of ``personal_data`` replaced by its kind in brackets
    (spans that touch each other by the first one's), and ``length``, if it is a column,
    set to the new number of code points.  Texts without spans stay as they are; a null
    text stays null and its length as it was.  Rows are told apart by key, null ones too,
    and text.  Other columns may have any names."""
    names = docs.columns
    taken = {n.lower() for n in names}
    own_key, own_hash, own_spans = (next(n for i in count() if (n := f"_{what}{i}") not in taken) for what in ("key", "hash", "found"))
    found = personal_data(docs, key, text).where(F.size("found") > 0).dropDuplicates([key, "text_hash"])
    found = checkpointed(found.select(F.col(key).alias(own_key), F.col("text_hash").alias(own_hash), F.col("found").alias(own_spans)))
    few = (found.agg(F.sum(F.size(own_spans))).head()[0] or 0) <= BROADCAST_SPANS
    same = F.col(key).eqNullSafe(F.col(own_key)) & (_text_hash(text) == F.col(own_hash))
    joined = docs.join(F.broadcast(found) if few else found, same, "left").drop(own_key, own_hash)
    has_length = length is not None and length.lower() in {n.lower() for n in names}
    fields = [f for f in docs.schema if f.name.lower() == text.lower() or has_length and f.name.lower() == length.lower()]

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        more = batch.column(batch.schema.get_field_index(own_spans)).to_pylist()
        out = []
        for t, extra in zip(texts, more):
            if t:
                t = replaced(t, sorted([*base_spans(t), *((s["start"], s["end"], s["kind"]) for s in extra or ())]))
            out.append(t)
        cols = {text.lower(): pa.array(out, pa.string())}
        if has_length:
            was = batch.column(batch.schema.get_field_index(next(n for n in names if n.lower() == length.lower()))).to_pylist()
            cols[length.lower()] = pa.array([w if t is None else len(t) for t, w in zip(out, was)], pa.int64())
        return [cols[f.name.lower()] for f in fields]

    return add_columns(joined, T.StructType(fields), make, keep=names, owner="pii").select(*names)


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    parts, done, end = [], 0, -1
    for a, b, k in spans:
        if a >= end:
            parts += [text[done:a], f"[{KINDS[k].upper()}]"]
        end = done = max(end, b)
    return "".join(parts) + text[done:]
