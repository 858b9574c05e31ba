"""Language ID with a linear-chain conditional random field over words.

Each word of a text is labelled with a language, so code-switched texts are told apart
word by word.  A word's score for a language is a sum of learned weights of its features:
the word itself if it is in the lexicon (the frequent words of the sample), the languages
whose lexicon has it, its affixes and its letter n-grams.  Transitions between languages
are learned too.  Forward-backward gives each word's probabilities; a text's language is
the one with most words in expectation and its score is that share.

The field is fitted on the driver on a bounded sample of labelled rows
(``SAMPLE_DOCS`` whole texts for each language, fewer where ``SAMPLE_TEXTS`` are shared by
many languages but always one, each of at most ``SAMPLE_CHARS`` characters, chosen by a hash
of their key).  Its training sequences join pieces of
different texts, so that switches between languages are seen.
"""

from __future__ import annotations

import gc
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.llm.arrow import add_columns
from driftwood.llm.worker import kept, released

#: Bounds of the sample: texts of a language, characters of a text, texts of all languages.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TEXTS = 150, 20_000, 9_600
LEXICON, FEATURES, EPOCHS, BATCH, LENGTH = 500, 1 << 16, 4, 48, 96
#: Words to a chunk of the scan, words handled at a time, words in a worker's cache.
CHUNK, SLICE_WORDS, CACHE_SIZE = 32, 200_000, 100_000


#: What is cut from both ends of a word before its features are taken.
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»¿¡“”„‘’…–—"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


def cleaned(word: str) -> str:
    """A word as features see it; empty if it has no letters."""
    w = word.lower().strip(_EDGES)
    return w if w.isalpha() or any(map(str.isalpha, w)) else ""


def word_features(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of cleaned words, and which word each belongs to.

    Letter n-grams of two to four, taken over the word with marks at its ends, so that
    those with a mark are its prefixes and suffixes of one to three; the word itself and
    the languages of the lexicon that have it.  An empty word has no features.
    """
    has = [i for i, w in enumerate(words) if w]
    letters = np.frombuffer("".join([f"^{words[i]}$" for i in has]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(words[i]) + 2 for i in has], np.int64)
    owner = np.repeat(np.array(has, np.int64), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(letters))  # letters to the end
    found, of = [], []
    for n in (2, 3, 4):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h ^ letters[at + i]) * _FACTORS[i]
            h ^= h >> np.uint64(29)
        found.append((h * _FACTORS[0] >> np.uint64(32)) % np.uint64(FEATURES))
        of.append(owner[at])
    extra = [(zlib.crc32(f.encode()) % FEATURES, i) for i in has if words[i] in lexicon for f in (f"w{words[i]}", *(f"l{k}" for k in lexicon[words[i]]))]
    found.append(np.array([x for x, _ in extra], np.uint64))
    of.append(np.array([x for _, x in extra], np.int64))
    return np.concatenate(found).astype(np.int64), np.concatenate(of)


class Field:
    """The fitted model: labels, weights of features, transitions and starts (as logs)."""

    def __init__(self, labels: list[str], lexicon: dict[str, tuple[int, ...]]):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((FEATURES, k), np.float32)
        self.move, self.start = np.zeros((k, k), np.float32), np.zeros(k, np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores (words x labels) of cleaned words, 0 for empty ones."""
        found, of = word_features(words, self.lexicon)
        return np.stack([np.bincount(of, self.weights[found, j], minlength=len(words)) for j in range(len(self.labels))], axis=1).astype(np.float32)

    def marginals(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probabilities (words x labels) by forward-backward.

        ``scores`` holds the words of all texts, one after the other; ``sizes`` how many
        each (non-empty) text has.  Texts are cut into chunks; first each chunk's transfer
        matrix is made, then the vectors at chunk borders, then those inside, so that
        every step works on all chunks at once and long texts cost no more per word.
        """
        k = scores.shape[1]
        chunks_of = -(-sizes // CHUNK)
        first = np.concatenate([[0], np.cumsum(chunks_of)[:-1]])
        n = int(chunks_of.sum())
        text_of = np.repeat(np.arange(len(sizes)), chunks_of)
        nth = np.arange(n) - first[text_of]
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])[text_of] + nth * CHUNK
        held = np.minimum(CHUNK, sizes[text_of] - nth * CHUNK)
        at = begin[:, None] + np.minimum(np.arange(CHUNK), held[:, None] - 1)
        real = np.arange(CHUNK) < held[:, None]
        e = np.exp(scores - scores.max(axis=1, keepdims=True))[at]
        move = np.exp(self.move - self.move.max())
        start = np.broadcast_to(np.exp(self.start - self.start.max()), (k, k))
        # before its first word a text has no language: any state moves to the starts
        opening = np.where((nth == 0)[:, None, None], start, move)
        # (not needed for a text of one chunk)
        inner = np.flatnonzero(chunks_of[text_of] > 1)
        through = np.empty((n, k, k), np.float32)
        own, inside, part = opening[inner] * e[inner, 0, None, :], e[inner], ~real[inner]
        for t in range(1, CHUNK):
            step = (own.reshape(-1, k) @ move).reshape(-1, k, k) * inside[:, t, None, :]
            step /= step.sum(axis=(1, 2), keepdims=True)
            if part[:, t].any():
                step[part[:, t]] = own[part[:, t]]
            own = step
        through[inner] = own
        ahead, back = np.full((n, k), 1 / k, np.float32), np.full((n, k), 1 / k, np.float32)
        order = np.argsort(nth, kind="stable")
        ends = np.cumsum(np.bincount(nth))
        for c in range(1, len(ends)):
            now = order[ends[c - 1] : ends[c]]
            v = np.einsum("ni,nij->nj", ahead[now - 1], through[now - 1])
            ahead[now] = v / v.sum(axis=1, keepdims=True)
        for c in range(len(ends) - 1, 0, -1):
            now = order[ends[c - 1] : ends[c]]
            v = np.einsum("nij,nj->ni", through[now], back[now])
            back[now - 1] = v / v.sum(axis=1, keepdims=True)
        out = np.empty((n, CHUNK, k), np.float32)
        v = ahead
        for t in range(CHUNK):
            v = (np.einsum("ni,nij->nj", v, opening) if t == 0 else v @ move) * e[:, t]
            v = v / v.sum(axis=1, keepdims=True)
            out[:, t] = v
        v = back
        for t in range(CHUNK - 1, -1, -1):
            out[:, t] *= v
            step = (v * e[:, t]) @ move.T
            v = np.where(real[:, t, None], step / step.sum(axis=1, keepdims=True), v)
        out /= out.sum(axis=2, keepdims=True)
        return out[real]


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Field:
    """A field learned from (text, language) pairs by stochastic gradients (AdaGrad)."""
    rows = sorted((t, k) for t, k in rows if t.split())
    labels = sorted({k for _, k in rows})
    rng = np.random.default_rng(seed)
    lexicon: dict[str, list[int]] = {}
    for i, label in enumerate(labels):
        seen: Counter = Counter()
        for t, k in rows:
            if k == label:
                seen.update(map(cleaned, t.split()))
        for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if w:
                lexicon.setdefault(w, []).append(i)
    field = Field(labels, {w: tuple(v) for w, v in lexicon.items()})
    k = len(labels)
    if k < 2:
        return field
    number: dict[str, int] = {}
    texts = [(np.array([number.setdefault(w, len(number)) for w in t.split()]), labels.index(lab)) for t, lab in rows]
    flat, owner = word_features([cleaned(w) for w in number], field.lexicon)
    flat = flat[np.argsort(owner, kind="stable")]
    widths = np.bincount(owner, minlength=len(number))
    offsets = np.concatenate([[0], np.cumsum(widths)])
    by_label = [[x for x, y in texts if y == i] for i in range(k)]
    words = sum(len(x) for x, _ in texts)
    squares, move2, start2 = np.full((FEATURES, k), 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)
    for _ in range(max(1, EPOCHS * words // (BATCH * LENGTH))):
        ids, gold = np.empty((BATCH, LENGTH), np.int64), np.empty((BATCH, LENGTH), np.int64)
        for b in range(BATCH):
            done = 0
            while done < LENGTH:  # pieces of texts of any language, one after the other
                label = int(rng.integers(k))
                text = by_label[label][int(rng.integers(len(by_label[label])))]
                take = min(int(rng.integers(12, 120)), len(text), LENGTH - done)
                at = int(rng.integers(len(text) - take + 1))
                ids[b, done : done + take], gold[b, done : done + take] = text[at : at + take], label
                done += take
        used, where = np.unique(ids, return_inverse=True)
        where = where.reshape(ids.shape)
        of = np.repeat(np.arange(len(used)), widths[used])
        spots = flat[np.concatenate([np.arange(offsets[w], offsets[w + 1]) for w in used])]
        scores = np.zeros((len(used), k))
        for j in range(k):
            scores[:, j] = np.bincount(of, field.weights[spots, j], minlength=len(used))
        e = np.exp(scores - scores.max(axis=1, keepdims=True))[where]
        move, start = np.exp(field.move.astype(float)), np.exp(field.start.astype(float))
        a, z = np.empty((LENGTH, BATCH, k)), np.empty((LENGTH, BATCH, k))
        a[0] = start * e[:, 0]
        a[0] /= a[0].sum(axis=1, keepdims=True)
        for t in range(1, LENGTH):
            a[t] = (a[t - 1] @ move) * e[:, t]
            a[t] /= a[t].sum(axis=1, keepdims=True)
        z[-1] = 1
        pairs = np.zeros((k, k))
        for t in range(LENGTH - 1, 0, -1):
            right = z[t] * e[:, t]
            joint = a[t - 1][:, :, None] * move * right[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            z[t - 1] = right @ move.T
            z[t - 1] /= z[t - 1].sum(axis=1, keepdims=True)
        prob = a * z
        prob /= prob.sum(axis=2, keepdims=True)
        # gradients: what is expected less what is there
        grad = prob.transpose(1, 0, 2) - np.eye(k)[gold]
        real_pairs = np.zeros((k, k))
        np.add.at(real_pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        g_move, g_start = (pairs - real_pairs) / BATCH, grad[:, 0].mean(axis=0)
        per_word = np.stack([np.bincount(where.ravel(), grad[:, :, j].ravel(), minlength=len(used)) for j in range(k)], axis=1)
        touched, slot = np.unique(spots, return_inverse=True)
        g = np.stack([np.bincount(slot, per_word[of, j], minlength=len(touched)) for j in range(k)], axis=1) / BATCH
        squares[touched] += g * g
        field.weights[touched] -= 0.2 * g / np.sqrt(squares[touched])
        move2 += g_move**2
        start2 += g_start**2
        field.move -= 0.2 * g_move / np.sqrt(move2)
        field.start -= 0.2 * g_start / np.sqrt(start2)
    return field


def sample(docs: DataFrame, key: str, text: str, lang: str) -> list[tuple[str, str]]:
    """Labelled texts of each language within the bounds of the sample, the first by a hash
    of their key."""
    fit_for = docs.where(F.col(lang).isNotNull() & F.length(text).between(1, SAMPLE_CHARS))
    order = Window.partitionBy(lang).orderBy(F.xxhash64(key), key)
    share = max(1, min(SAMPLE_DOCS, SAMPLE_TEXTS // max(1, fit_for.select(lang).distinct().count())))
    chosen = fit_for.select(key, lang).withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= share)
    # as many keys as texts in the sample
    keys = F.broadcast(chosen.select(F.col(key).alias("_k")).distinct())
    rows = fit_for.join(keys, F.col(key).eqNullSafe(F.col("_k"))).select(text, lang)
    # rows that share a key with a chosen one are met too; of those, the first by text
    first = Window.partitionBy(lang).orderBy(F.xxhash64(text), text)
    rows = rows.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= share)
    return [(r[0], r[1]) for r in rows.select(text, lang).collect()]


class _Emissions:
    """Scores by word: row numbers in a table that grows as words are met."""

    def __init__(self, field: Field):
        self.field, self.rows = field, {}
        self.table = np.zeros((0, len(field.labels)), np.float32)
        self.letters = np.zeros(0, bool)

    def learn(self, texts: list[list[str]]) -> None:
        new = sorted(set().union(*texts).difference(self.rows))
        if new:
            clean = [cleaned(w) for w in new]
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.table = np.concatenate([self.table, self.field.emissions(clean)])
            self.letters = np.concatenate([self.letters, np.array([w != "" for w in clean])])


def _probabilities(field: Field, texts: list[str]):
    """For slices of texts: which of them have words, their sizes, and each word's
    probabilities (0 for words without letters)."""
    held, at, size = [], [], 0
    for i, t in enumerate(texts):
        words = t.split()
        if words:
            held.append(words)
            at.append(i)
            size += len(words)
        if held and (size > SLICE_WORDS or i == len(texts) - 1):
            live = kept("language")
            known = live.get("scores")
            if known is None or known.field is not field or len(known.rows) > CACHE_SIZE:
                known = live["scores"] = _Emissions(field)
            known.learn(held)
            sizes = np.array([len(h) for h in held])
            ids = np.fromiter(map(known.rows.__getitem__, chain.from_iterable(held)), np.int64, int(sizes.sum()))
            yield at, sizes, field.marginals(known.table[ids], sizes) * known.letters[ids][:, None]
            held, at, size = [], [], 0


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
RUNS = T.StructField("lang_runs", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("n_words", T.LongType())])), False)


def predict(docs: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None, runs: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score of each whole text; with ``runs`` also lang_runs,
    the languages of the words in order (each with its number of words).

    ``und`` with score 0 if the text is null, empty or without letters.  Ties go to the
    first language by name.  Repeated rows get the same answer, an empty table gives an
    empty result, and input columns with the names of the output are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        model = sent.value
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        names, scores, pieces = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        for at, sizes, p in _probabilities(model, texts):
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            sums = np.add.reduceat(p.astype(np.float64), begin, axis=0)
            for i, total, b, n in zip(at, sums, begin, sizes):
                if total.sum() > 0:
                    best = int(total.argmax())
                    names[i], scores[i] = model.labels[best], min(1.0, float(total[best] / total.sum()))
                if runs and total.sum() > 0:
                    own = p[b : b + n].argmax(axis=1)
                    cut = np.flatnonzero(np.diff(own)) + 1
                    pieces[i] = [{"lang": model.labels[own[s]], "n_words": int(e - s)} for s, e in zip([0, *cut], [*cut, n])]
        out = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
        if runs:
            out.append(pa.array(pieces, pa.list_(pa.struct([("lang", pa.string()), ("n_words", pa.int64())]))))
        return out

    return add_columns(docs, T.StructType(list(PREDICTED) + [RUNS] * runs), make, keep, rows=2048, owner="language")


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Field:
    """A field fitted on a bounded sample of the labelled rows of ``docs``.  Without any
    labelled text its only label is ``und``."""
    rows = sample(docs, key, text, lang)
    field = fit(rows) if rows else Field(["und"], {})
    # the driver goes on to other work
    del rows
    gc.collect()
    released()
    return field
