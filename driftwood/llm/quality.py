"""Quality rules: base counts and the divergence of a text from language references.

A text's characters fall into classes and its words into the common words of a language
or the rest.  Both histograms are compared with those of the language's whole corpus by
the Jensen-Shannon distance (base 2, so 0 to 1).  A text fails when a distance is over
its threshold.  Short texts have noisy histograms, so each comparison asks for a least
number of characters or words and is passed over below it.

References cover all documents of a language and are exact: every task hands on the counts
of all its words, however many, and they are summed by language and word.  Only the common
words of a language, a few hundred at most by their share, are sent to the workers.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftwood.llm.arrow import add_columns, kept_fields
from driftwood.llm.worker import kept, released

#: Base rules (fixed values of the contract).
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 5, 10, 20
#: Words with at least this share of a language's words are common, at most so many.
COMMON_SHARE, MOST_COMMON = 0.003, 100
#: Different words that a task counts before it hands their counts on.
COUNTER_SIZE = 200_000
#: Thresholds of the distances and the least lengths they are applied to.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.45
LEAST_CHARS, LEAST_COMPARED_WORDS = 200, 100
#: Languages whose references are sent to the workers at a time; more take more passes.
LANGUAGES_AT_ONCE = 1_000

CLASSES = ("lower", "upper", "letter", "mark", "digit", "space", "punctuation", "symbol", "control")
_SPACE = bytes(range(9, 14)) + b" "
#: Classes by the first letter of a character's Unicode category, but for letters' case.
_BY_CATEGORY = {"M": "mark", "N": "digit", "Z": "space", "P": "punctuation", "S": "symbol", "C": "control", "L": "letter"}


def class_of(c: str) -> str:
    category = unicodedata.category(c)
    if category in ("Ll", "Lu", "Lt"):
        return "lower" if category == "Ll" else "upper"
    return "symbol" if c in SYMBOLS else "space" if "\t" <= c <= "\r" else _BY_CATEGORY[category[0]]


def _table(size: int) -> np.ndarray:
    return np.array([CLASSES.index(class_of(chr(i))) for i in range(size)], np.uint8)


_ASCII = _table(128)


def char_classes(text: str) -> np.ndarray:
    """Characters of each class in a text."""
    if text.isascii():
        found = _ASCII[np.frombuffer(text.encode(), np.uint8)]
    else:
        held = kept("quality")
        if "classes" not in held:
            held["classes"] = _table(0x110000)
        found = held["classes"][np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    return np.bincount(found, minlength=len(CLASSES))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, 0 to 1; 0 if one of them is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


def base_counts(data: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    symbols = len(data) - len(data.translate(None, SYMBOLS.encode()))
    bare = data.translate(None, _SPACE)
    # every byte but those inside a character begins one
    word_chars = len(bare) if bare.isascii() else len(bare.decode())
    lines = [x for x in data.split(b"\n") if x and x.translate(None, _SPACE)]
    repeated = 0
    if len(words) > WINDOW:
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        n = len(words) - WINDOW + 1
        # windows are numbered by pairing what is left with the next word, so equal
        # numbers mean equal windows
        window = ids[:n]
        for i in range(1, WINDOW):
            _, window = np.unique(window * len(number) + ids[i : i + n], return_inverse=True)
        twice = np.bincount(window)[window] > 1
        covered = np.zeros(len(words) + 1, np.int64)
        at = np.flatnonzero(twice)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
        repeated = int((np.cumsum(covered[:-1]) > 0).sum())
    return word_chars, symbols, len(lines) - len(set(lines)), repeated


REFERENCE = T.StructType([T.StructField("lang", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("item", T.StringType()), T.StructField("n", T.LongType())])


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows lang, kind (``class``, ``word`` or ``words``), item, n over all documents: the
    characters of each class, each word, and all words.  A null language is one of its own.
    Every task sums what it has before the shuffle, in counters of bounded size."""
    arrow = to_arrow_schema(REFERENCE)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("quality")
        chars: dict = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))
        words: dict = defaultdict(Counter)
        totals: Counter = Counter()

        def handed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(rows), 20_000):
                columns = zip(*rows[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        def counted() -> Iterator[pa.RecordBatch]:
            for k, c in words.items():
                yield from handed([(k, "word", w.decode(), n) for w, n in c.items()])
            words.clear()

        for batch in batches:
            for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    own = t.lower().encode().split()
                    chars[k] += char_classes(t)
                    totals[k] += len(own)
                    words[k].update(own)
                    if sum(map(len, words.values())) > COUNTER_SIZE:
                        yield from counted()
        yield from counted()
        yield from handed([(k, "class", name, int(n)) for k in chars for name, n in zip(CLASSES, chars[k])])
        yield from handed([(k, "words", "", n) for k, n in totals.items()])
        released()

    return docs.select(text, lang).mapInArrow(gather, REFERENCE).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def common(rows: DataFrame) -> DataFrame:
    """Of ``references``, all but the words that are not common: a bounded number of rows
    for each language.  Languages are few beside words, so their totals are joined."""
    totals = rows.where("kind = 'words'").select(F.col("lang").alias("_lang"), F.col("n").alias("_total"))
    held = rows.join(totals, F.col("lang").eqNullSafe(F.col("_lang")), "left").where((F.col("kind") != "word") | (F.col("n") >= COMMON_SHARE * F.col("_total")))
    # at most 1 / COMMON_SHARE words of a language are left to be ranked
    order = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    return held.withColumn("_at", F.row_number().over(order)).where((F.col("kind") != "word") | (F.col("_at") <= MOST_COMMON)).select("lang", "kind", "item", "n")


class Reference:
    """One language: the histogram of character classes and of its common words."""

    def __init__(self, classes: dict[str, int], words: dict[str, int], total: int):
        self.classes = np.array([classes.get(c, 0) for c in CLASSES], np.float64)
        self.slot = {w.encode(): i for i, w in enumerate(sorted(words))}
        counts = [words[w] for w in sorted(words)]
        self.words = np.array([*counts, max(0, total - sum(counts))], np.float64)

    def distances(self, chars: np.ndarray, words: list[bytes]) -> tuple[float, float]:
        slots = np.fromiter((self.slot.get(w, len(self.slot)) for w in words), np.int64, len(words))
        return js_distance(chars, self.classes), js_distance(np.bincount(slots, minlength=len(self.words)), self.words)


def collected(rows: DataFrame) -> Iterator[dict[str | None, Reference]]:
    """References by language, ``LANGUAGES_AT_ONCE`` of them at a time."""
    by: dict = {}
    now = None
    for r in rows.orderBy(F.col("lang").asc_nulls_first(), "kind", "item").toLocalIterator():
        if by and r["lang"] != now and len(by) >= LANGUAGES_AT_ONCE:
            yield {k: Reference(v["class"], v["word"], v["words"].get("", 0)) for k, v in by.items()}
            by = {}
        now = r["lang"]
        by.setdefault(now, defaultdict(dict))[r["kind"]][r["item"]] = r["n"]
    if by:
        yield {k: Reference(v["class"], v["word"], v["words"].get("", 0)) for k, v in by.items()}


COUNTS = T.StructType([T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
DISTANCES = T.StructType([T.StructField("char_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType())])
VERDICT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the base counts, base_failed, both distances and kept.

    A text is compared with the references of its own language; if that is null, with the
    nearest one.  Null and empty texts have no words, fail and are not kept.  Distances
    of texts under the least lengths are given but not judged.  Repeated rows are judged
    alike.  An empty table gives an empty result; input columns with the names of the
    output are replaced, others handed on as ``keep`` says (None: all).
    """
    handed = [f.name for f in kept_fields(docs, T.StructType([T.StructField(n, T.StringType()) for n in VERDICT]), keep)]
    rows = docs.select(*(F.col(c) for c in handed), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in collected(common(references(docs, text, lang).where("n > 0")))]

    def make(batch: pa.RecordBatch, known: dict, first: bool) -> list[pa.Array]:
        out = []
        column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
        old = [(None, None)] * batch.num_rows if first else list(zip(column("char_distance"), column("word_distance")))
        for t, k, far in zip(column("_text"), column("_lang"), old):
            t = t or ""
            data = t.encode()
            words = data.split()
            near = [known[k]] if k is not None and k in known else list(known.values()) if k is None or (first and len(blocks) == 1) else []
            if words and near:
                low, chars = t.lower().encode().split(), char_classes(t)
                far = min([*(r.distances(chars, low) for r in near), *([far] if far[0] is not None else [])], key=sum)
            out.append((*((len(words), *base_counts(data, words)) if first else ()), *far))
        kinds = [pa.int64()] * 5 * first + [pa.float64()] * 2
        return [pa.array(c, f) for c, f in zip(zip(*out) if out else [()] * len(kinds), kinds)]

    for i, sent in enumerate(blocks or [docs.sparkSession.sparkContext.broadcast({})]):
        new = T.StructType((list(COUNTS) if i == 0 else []) + list(DISTANCES))
        rows = add_columns(rows, new, lambda batch, sent=sent, first=i == 0: make(batch, sent.value, first), owner="quality")
    rows = rows.withColumns({c.name: F.coalesce(c.name, F.lit(0.0)) for c in DISTANCES})
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    far = (F.col("word_chars") >= LEAST_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)
    far |= (F.col("n_words") >= LEAST_COMPARED_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~(failed | far)).select(*handed, *VERDICT)
