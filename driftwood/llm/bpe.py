"""BPE encoding and decoding: speculate, verify, and merge exactly only where that fails.

A word's tokens are proposed by greedy longest match against the vocabulary.  A sequence
of tokens is what the merges give exactly when every token comes out of its own bytes
whole and every adjacent pair is compatible, that is, when no merge across the seam would
have been applied before the merges that built its two sides.  Both tests are run as
numpy operations over all pairs of a batch of new words.  Only words that fail are merged
step by step.  Words met before come from a bounded table of the worker, which gives up
the words that were met least when it is full.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftwood.llm.arrow import add_columns, texts_of
from driftwood.llm.token_counts import RARE, byte_letters
from driftwood.llm.worker import kept

#: Words kept in a worker's table, and characters of text handled at a time.
CACHE_SIZE, SLICE_CHARS = 250_000, 800_000


def compiled(pattern: str) -> re.Pattern | regex.Pattern:
    """An expression that is only used on text up to U+FFFF.  Where its classes are letters,
    numbers and white space in brackets they are written out, and ``re``, which is faster,
    does the same."""
    if re.fullmatch(r"(?:[^][\\]|\[\^?(?:\\p\{[LN]\}|\\s)+\])*", pattern) is None:
        return regex.compile(pattern)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        pattern = pattern.replace(name, "".join(f"{re.escape(m[0])}-{re.escape(m[-1])}" for m in regex.findall(f"{name}+", every)))
    return re.compile(pattern)


class WordBpe:
    """A ``tokenizers`` BPE file with word ends; lives in a Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["unk_token"] or model.get("ignore_merges") or model.get("byte_fallback") or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: not a BPE model with word ends over bytes")
        if spec["decoder"] is not None:
            raise ValueError(f"{path}: only files without a decoder are supported")
        split = next((p for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"), None)
        if split is None or not split["invert"] or split["behavior"] != "Removed":
            raise ValueError(f"{path}: words must be what a pattern matches")
        self.path = path
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.find = compiled(split["pattern"]["Regex"]).findall
        self.value = byte_letters()
        self.letter = {b: c for c, b in self.value.items()}
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")")
        size = max([*vocab.values(), *added.values()]) + 1
        self.strings = np.full(size, "", dtype=object)
        for word, i in [*vocab.items(), *added.items()]:
            self.strings[i] = word
        self._rank(vocab, [m if isinstance(m, list) else m.split(" ") for m in model["merges"]])
        # the number of each known word; by number, where its ids begin, how many they are
        # and how often it was met.  Special strings come first, marked by a space, so that
        # no word is like them
        self.words = {" " + w: k for k, w in enumerate(added)}
        self.known = np.array(list(added.values()), np.int32)
        self.starts, self.sizes, self.uses = np.arange(len(added)), np.ones(len(added), np.int64), np.zeros(len(added), np.int64)
        self.merged_exactly = 0

    @cached_property
    def library(self):
        """The library's own tokenizer, which few texts need."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _rank(self, vocab: dict[str, int], merges: list[list[str]]) -> None:
        """Order tokens by the merge that makes them, symbols first."""
        made = {a + b for a, b in merges}
        symbols = [w for w in sorted(vocab, key=vocab.get) if w not in made]
        order = symbols + [a + b for a, b in merges]
        if len(set(order)) != len(order):
            raise ValueError("two merges make the same token")
        rank = {w: i for i, w in enumerate(order)}
        n, first = len(order), len(symbols)
        self.id_of = np.array([vocab[w] for w in order], np.int32)
        self.left, self.right = np.arange(n), np.arange(n)
        self.left[first:] = [rank[a] for a, _ in merges]
        self.right[first:] = [rank[b] for _, b in merges]
        keys = self.left[first:] * n + self.right[first:]
        self.size, self.first = n, first
        by = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[by], np.arange(first, n)[by]
        self.merge = dict(zip(keys.tolist(), range(first, n)))
        # a token is whole if its two sides are whole and nothing joins across before it
        ok = self.compatible(self.left[first:], self.right[first:], np.arange(first, n))
        whole = [True] * n
        for i, (a, b, fits) in enumerate(zip(self.left[first:].tolist(), self.right[first:].tolist(), ok.tolist()), first):
            whole[i] = fits and whole[a] and whole[b]
        self.whole = np.array(whole)
        longest: dict[str, int] = {}
        for w in order:
            bare = w[: -len(self.end)] if w.endswith(self.end) and len(w) > len(self.end) else w
            longest[bare[:2]] = max(longest.get(bare[:2], 1), len(bare))
        self.longest = longest
        self.inner = {w: i for w, i in rank.items() if not w.endswith(self.end) or w == self.end}
        self.last = {w[: -len(self.end)]: i for w, i in rank.items() if w.endswith(self.end) and w != self.end}
        self.ids = self.id_of.tolist()
        self.closes = np.zeros(n, bool)
        self.closes[list(self.last.values())] = True
        self.fast = self._merger()

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or a number beyond all ranks."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], 2 * self.size)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair of tokens stands as it is in the merges of its joint bytes.

        The two sides are taken apart from the seam outwards, the later-made one first;
        a merge across the seam that comes before the one undone last would have won.
        ``before`` bounds the ranks that count at first (none: any merge across counts).
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 3 * self.size // 2) if before is None else before.copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y, top = a[live], b[live], limit[live]
            bad = self.joined(x, y) < top
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            apart_x, apart_y = x >= self.first, y >= self.first
            # undo the later merge; of two alike the right one, which was made last
            take_x = apart_x & (~apart_y | (x > y))
            take_y = apart_y & ~take_x
            on = take_x | take_y
            limit[live] = np.where(take_x, x, np.where(take_y, y + 1, 0))
            a[live] = np.where(take_x, self.right[x], x)
            b[live] = np.where(take_y, self.left[y], y)
            live = live[on]
        return good

    def exact(self, word: str) -> list[int]:
        """Ranks by applying the merges in order, the leftmost first (a heap of pairs)."""
        parts = [self.inner[c] for c in word[:-1]] + [self.last[word[-1]]]
        n, size, merge = len(parts), self.size, self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := merge.get(parts[i] * size + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if parts[i] != x or j >= n or parts[j] != y:
                continue  # one of the two has gone into another merge
            parts[i], parts[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := merge.get(r * size + parts[k])) is not None:
                    heapq.heappush(heap, (q, i, r, parts[k]))
            if (h := before[i]) >= 0 and (q := merge.get(parts[h] * size + r)) is not None:
                heapq.heappush(heap, (q, h, parts[h], r))
        return [x for x in parts if x >= 0]

    def propose(self, word: str) -> list[int]:
        """Ranks by greedy longest match."""
        out, at, end = [], 0, len(word)
        inner, last, longest = self.inner, self.last, self.longest
        while at < end:
            far = min(end, at + longest.get(word[at : at + 2], 1))
            if far == end:
                got = last.get(word[at:])
                if got is not None:
                    out.append(got)
                    break
                far -= 1
            while word[at:far] not in inner:
                far -= 1
            out.append(inner[word[at:far]])
            at = far
        return out

    def verified(self, proposed: list[list[int]]) -> list[bool]:
        """Which sequences of tokens are what the merges give."""
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(sizes.sum()))
        word_of = np.repeat(np.arange(len(proposed)), sizes)
        good = np.ones(len(proposed), bool)
        good[word_of[~self.whole[flat]]] = False
        seams = np.flatnonzero(word_of[1:] == word_of[:-1])
        keys, where = np.unique(flat[seams] * self.size + flat[seams + 1], return_inverse=True)
        fits = self.compatible(keys // self.size, keys % self.size)
        good[word_of[seams[~fits[where]]]] = False
        return good.tolist()

    def learn(self, words: list[str]) -> None:
        """Add words, without their end marks, to the table."""
        letters = [w if w.isascii() and w.isprintable() else "".join([self.letter[b] for b in w.encode()]) for w in words]
        ranks = [self.propose(w) for w in letters]
        failed = [i for i, fine in enumerate(self.verified(ranks)) if not fine]
        if failed:
            # a fast merger, whose results are put to the same proof
            merged = self.fast([words[i] for i in failed])
            for i, got, fine in zip(failed, merged, self.verified(merged)):
                ranks[i] = got if fine else self.exact(letters[i])
            self.merged_exactly += len(failed)
        sizes = np.fromiter(map(len, ranks), np.int64, len(ranks))
        flat = np.fromiter(chain.from_iterable(ranks), np.int64, int(sizes.sum()))
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.starts = np.concatenate([self.starts, len(self.known) + np.cumsum(sizes) - sizes])
        self.known = np.concatenate([self.known, self.id_of[flat]])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])

    def forget(self) -> None:
        """Leave the special strings and at most half a table of words, those met most."""
        self.uses[: len(self.added)] = 1 << 62
        most = np.sort(np.argsort(-self.uses, kind="stable")[: CACHE_SIZE // 2])
        most = most[self.uses[most] > 1]
        names = list(self.words)
        self.words = {names[i]: k for k, i in enumerate(most.tolist())}
        self.known = self.gathered(most)
        self.sizes, self.uses = self.sizes[most], self.uses[most] // 2
        self.starts = np.cumsum(self.sizes) - self.sizes

    def gathered(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of known words, one after the other."""
        sizes = self.sizes[numbers]
        begin = self.starts[numbers] - (np.cumsum(sizes) - sizes)
        return self.known[np.repeat(begin, sizes) + np.arange(int(sizes.sum()))]

    def _merger(self):
        """Merging by rank in compiled code, a space standing for the end of a word."""
        import tiktoken

        value, table = self.value, {}
        for w, i in self.inner.items():
            table[bytes(value[c] for c in w)] = i
        for w, i in self.last.items():
            table[bytes(value[c] for c in w) + b" "] = i
        encoding = tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=table, special_tokens={})

        def merged(words: list[str]) -> list[list[int]]:
            flat = encoding.encode_ordinary(" ".join(words) + " ")
            ends = (np.flatnonzero(self.closes[flat]) + 1).tolist()
            return [flat[a:b] for a, b in zip([0, *ends], ends)]

        return merged

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        if RARE.search(text) is None:
            # lower case letter by letter: a final sigma is not special
            return self.find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if " " in text or "\n" in text:
            # no word reaches over white space, and few have rare characters
            return list(chain.from_iterable(map(self.pieces, text.replace("\n", " ").split(" "))))
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes([self.value[c] for c in w]).decode() for w, _ in found]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        split: list[list[str]] = []
        for t in texts:
            if "<" in t and self.special.search(t):
                # every second part is a special string
                parts = self.special.split(t)
                split.append(list(chain.from_iterable([" " + p] if i % 2 else self.pieces(p) for i, p in enumerate(parts))))
            else:
                split.append(self.pieces(t))
        met = set().union(*split)
        missing = met.difference(self.words)
        if len(self.words) + len(missing) > CACHE_SIZE:
            self.forget()
            missing = met.difference(self.words)
        if missing:
            self.learn(sorted(missing))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        ends, done = np.cumsum(counts), np.concatenate([[0], np.cumsum(self.sizes[numbers])])
        return self.gathered(numbers), done[ends] - done[ends - counts]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.strings[ids].tolist())


def loaded(path: str) -> WordBpe:
    """The worker's WordBpe, kept over its tasks for the same file."""
    held = kept("bpe")
    if path not in held:
        held.clear()
        held[path] = WordBpe(path)
    return held[path]


def _slices(texts: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    held = 0
    for t in texts:
        if held > SLICE_CHARS:
            out.append([])
            held = 0
        out[-1].append(t)
        held += len(t)
    return out


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``out`` (array of int): the ids of each whole text by the BPE file at
    ``path``, as its library gives them without begin and end tokens, truncation or padding.

    Null and empty texts have no ids.  Repeated rows are encoded each on its own, an empty
    table gives an empty result, an input column named ``out`` is replaced and all others
    named in ``keep`` (None: all) are handed on.
    """
    new = T.StructType([T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = loaded(path)
        done = [bpe.encode(part) for part in _slices(texts_of(batch, text))]
        ids, sizes = (np.concatenate(x) for x in zip(*done))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)), type=pa.list_(pa.field("element", pa.int32(), False)))]

    return add_columns(docs, new, make, keep, owner="bpe")


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``out``: the text that the library at ``path`` decodes ``ids`` to,
    special tokens kept.  Null or no ids give the empty text; ids outside the vocabulary
    are left out, as the library does."""
    new = T.StructType([T.StructField(out, T.StringType(), False)])

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = loaded(path)
        out_texts = []
        for x in batch.column(batch.schema.get_field_index(ids)):
            if not x.is_valid:
                out_texts.append("")
                continue
            got = x.values.to_numpy(zero_copy_only=False)
            inside = (got >= 0) & (got < len(bpe.strings))
            out_texts.append(bpe.decode(got if inside.all() else got[inside]))
        return [pa.array(out_texts, pa.string())]

    return add_columns(docs, new, make, keep, owner="bpe")
