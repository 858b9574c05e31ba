"""Token counts by a map-side two-tier lookup.

A byte-level BPE splits a text into pre-tokens and merges bytes inside each of them, so a
text's token count is a sum over its pre-tokens.  ``frequent_lengths`` counts the
pre-tokens of the whole corpus in one pass of bounded memory (each task keeps a lossy
count and hands on a bounded summary) and ``count_tokens`` broadcasts the lengths of the
most frequent ones.  Every other pre-token is encoded inside the worker that met it and
remembered in a bounded cache of that worker.  No pre-token is ever a key of a shuffle: the
bounded summaries of the first pass travel whole.

The first pass decides only what is looked up and what is encoded, never a count.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftwood.llm.arrow import add_columns, texts_of
from driftwood.llm.worker import kept

#: The pre-token pattern of byte-level BPE (fixed value of the vocabulary's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blocks in which Unicode versions may differ between libraries; text with these
#: characters is split by the tokenizer's own pre-tokenizer.
RARE = regex.compile("[԰-῿⁰-⿿ꀀ-꯿힤-\U0010ffff]")

#: Entries of the broadcast table, of a task's summary and of a worker's caches.
TABLE_SIZE, SUMMARY_SIZE, CACHE_SIZE = 16_384, 4_096, 300_000
COUNTER_SIZE = 200_000
#: Summaries that are merged into one at each level of the tree.
FAN_IN = 16


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PreTokens:
    """Pre-tokens and token counts by one tokenizer file; lives in a Python worker."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec["pre_tokenizer"], spec["added_tokens"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not supported")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.find = regex.compile(PATTERN).findall
        strings = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, strings))) if strings else None
        self.frequent = frequent or {}
        self.merge = self._merger(spec["model"])
        self.cache: dict[str, int] = {}
        self.units = Units(self)

    def _merger(self, model: dict):
        """A count by merge ranks where the ids are the ranks, else by the library."""
        vocab = model["vocab"]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        letters = byte_letters()
        if model.get("ignore_merges") or made != sorted(made) or len(vocab) != 256 + len(made):
            return lambda piece: len(self.library.encode(piece, add_special_tokens=False).ids)
        import tiktoken

        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items()}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda piece: len(encoding.encode_ordinary(piece))

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings, with their own characters."""
        if RARE.search(text) is None:
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def length(self, piece: str) -> int:
        """Tokens of one pre-token: the broadcast table, then the worker's cache."""
        n = self.frequent.get(piece)
        if n is None:
            n = self.cache.get(piece)
            if n is None:
                if len(self.cache) >= CACHE_SIZE:
                    self.cache.clear()
                n = self.cache[piece] = self.merge(piece)
        return n

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between special strings and the number of those."""
        if self.special is None or self.special.search(text) is None:
            return [text], 0
        parts = self.special.split(text)
        return [p for p in parts if p], len(parts) - 1

    def count(self, text: str) -> int:
        parts, n = self.segments(text)
        for part in parts:
            got = split_units(part)
            values = list(map(self.units.__getitem__, got))
            if min(values) < 0:  # runs of white space need their neighbours
                n += sum(map(self.length, self.pieces(part)))
            else:
                n += sum(values) - 1
        if len(self.units) > CACHE_SIZE:
            self.units.clear()
        return n


def split_units(text: str) -> list[str]:
    """White-space delimited units; one that follows a line end begins with it.

    Splitting at single spaces and line ends never cuts a pre-token, because a space is
    part of the pre-token after it and a lone line end is one of its own.
    """
    return ("\n" + text).replace("\n", " \n")[1:].split(" ")


class Units(dict):
    """Token count by unit, filled as units are met; -1: cannot be counted alone."""

    def __init__(self, tokens: PreTokens):
        self.tokens = tokens

    def __missing__(self, unit: str) -> int:
        word = unit[1:] if unit[:1] == "\n" else unit
        if not word or word[0].isspace() or word[-1].isspace():
            n = -1
        else:
            led = len(word) < len(unit)
            n = led + sum(map(self.tokens.length, self.tokens.pieces(word if led else " " + word)))
        self[unit] = n
        return n


def loaded(path: str, key: object, frequent: dict[str, int] | None) -> PreTokens:
    """The worker's PreTokens, kept over its tasks for the same file and table."""
    held = kept("token_counts")
    if (path, key) not in held:
        held.clear()
        held[path, key] = PreTokens(path, frequent)
    return held[path, key]


SUMMARY = T.StructType([T.StructField("part", T.LongType()), T.StructField("pieces", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))])


def _merged(tables: Iterator[tuple[list, list]], size: int) -> list[tuple[str, int]]:
    total: Counter = Counter()
    for pieces, counts in tables:
        for p, n in zip(pieces, counts):
            total[p] += n
    return sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", size: int = TABLE_SIZE) -> dict[str, int]:
    """Lengths of the ``size`` most frequent pre-tokens of all texts.

    A task counts units lossily (it drops the rarest when ``COUNTER_SIZE`` is passed) and
    hands on one row, a summary of at most ``SUMMARY_SIZE`` pre-tokens, whatever its input.
    Summaries are merged in a tree, ``FAN_IN`` to one of at most ``size``; what is shuffled
    is whole summaries by their number, and the driver gets no more than one tree's top.
    """
    arrow = to_arrow_schema(SUMMARY)

    def row(part: int, top: list[tuple[str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([[p for p, _ in top]], arrow.field(1).type), pa.array([[n for _, n in top]], arrow.field(2).type)], schema=arrow)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        part = TaskContext.get().partitionId()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(split_units(t))
                    if len(counts) > COUNTER_SIZE:
                        counts = Counter(dict(counts.most_common(COUNTER_SIZE // 2)))
        tokens, pieces = loaded(path, None, None), Counter()
        for unit, n in counts.most_common(2 * SUMMARY_SIZE):
            if tokens.special is None or tokens.special.search(unit) is None:
                for p in tokens.pieces(unit if unit[:1] == "\n" else " " + unit):
                    pieces[p] += n
        if pieces:
            yield row(part, pieces.most_common(SUMMARY_SIZE))

    def merge(table: pa.Table) -> pa.Table:
        tables = zip(table.column("pieces").to_pylist(), table.column("counts").to_pylist())
        return pa.Table.from_batches([row(table.column("part")[0].as_py(), _merged(tables, size))])

    found, left = docs.select(text).mapInArrow(summarise, SUMMARY), docs.rdd.getNumPartitions()
    while left > FAN_IN:
        found = found.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(merge, SUMMARY)
        left = -(-left // FAN_IN)
    tokens = PreTokens(path)
    top = _merged(((r["pieces"], r["counts"]) for r in found.toLocalIterator()), size)
    return {p: tokens.merge(p) for p, _ in top}


def count_tokens(
    docs: DataFrame,
    path: str,
    text: str = "text",
    out: str = "n_tokens",
    keep: list[str] | None = None,
    table_size: int = TABLE_SIZE,
) -> DataFrame:
    """``docs`` with ``out``: the tokens of each whole text by the tokenizer at ``path``
    (a byte-level ``tokenizers`` file), without begin or end tokens, special strings as
    the library reads them.

    Null text counts 0, as an empty one does.  Repeated rows are counted each on its
    own; an empty table gives an empty result; an input column named ``out`` is replaced.
    ``keep`` names the input columns to hand on (None: all).
    """
    table = frequent_lengths(docs, path, text, table_size)
    sent = docs.sparkSession.sparkContext.broadcast(table)  # at most table_size entries
    key = hash((path, tuple(sorted(table))))
    new = T.StructType([T.StructField(out, T.LongType(), False)])

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        tokens = loaded(path, key, sent.value)
        return [pa.array([tokens.count(t) for t in texts_of(batch, text)], pa.int64())]

    return add_columns(docs, new, make, keep, owner="token_counts")
