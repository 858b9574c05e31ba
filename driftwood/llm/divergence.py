"""Source divergence audit by mergeable radix tries.

Each task counts the terms of its documents and turns the counts into byte tries, one a
language, whenever they have grown to a bound; sums are the same however often that
happens.  A trie is kept in pre-order: terms in order of their bytes, each as the number of
bytes that it shares with the one before and the rest, each with a leaf of its number of
documents and a counter a source.  It is cut where the first bytes change, and the parts of
all tries with the same first bytes meet in one task, which merges them by walking them
together, so that only one leaf is held.  Parts of a prefix that has too many leaves for
that are dealt out once more by a hash of their terms.

Two walks over the merged leaves of terms that are kept give everything else: one sums the
distances of each pair of sources, in tiles of a bounded number of sources, and one streams
candidates in UTF-8 order into bounded heaps, so of equal candidates the first by term stays.
"""

from __future__ import annotations

import gc
import heapq
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.llm.cluster import checkpointed

LEAST_DOCUMENTS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Counters that a task holds before they are turned into tries; first bytes that name the
#: parts of a trie; leaves of all tries that are merged in one task.
CELLS, PREFIX, MERGED = 600_000, 3, 1_000_000
#: Sources to a side of a tile of pairs.
TILE = 256
#: Statistics of so many (language, source) groups are broadcast; beyond, they are joined.
BROADCAST_GROUPS = 100_000
#: What is in no term becomes a space, A to Z become small; bytes beyond ASCII stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LEAF = "lang string, term string, documents bigint, sources array<string>, counts array<bigint>"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def packed(terms: list[bytes], leaves: list[list]) -> bytes:
    """A trie in pre-order: ``terms`` in order of bytes, and for each its number of documents
    followed by source, count, source, count and so on, sources by number."""
    shared, rest, last = [], [], b""
    for term in terms:
        n = 0
        for x, y in zip(term, last):
            if x != y:
                break
            n += 1
        shared.append(n)
        rest.append(term[n:])
        last = term
    sizes = np.fromiter(map(len, leaves), np.uint32, len(leaves))
    numbers = np.fromiter(chain.from_iterable(leaves), np.uint64, int(sizes.sum()))
    # most counts are small: a wider number is kept only where one is needed
    numbers = numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))
    parts = [np.array(shared, np.uint32).tobytes(), sizes.tobytes(), numbers.tobytes(), b"\0".join(rest)]
    return struct.pack("<IBI", len(terms), numbers.itemsize, len(numbers)) + zlib.compress(b"".join(parts), 1)


def walked(trie: bytes) -> Iterator[tuple[bytes, list[int]]]:
    """Terms of a packed trie, in order of bytes, which for UTF-8 is that of code points, and
    their leaves."""
    head = struct.calcsize("<IBI")
    n, width, m = struct.unpack("<IBI", trie[:head])
    data = zlib.decompress(trie[head:])
    shared, sizes = np.frombuffer(data, np.uint32, n).tolist(), np.frombuffer(data, np.uint32, n, 4 * n).tolist()
    numbers = np.frombuffer(data, f"u{width}", m, 8 * n).tolist()
    at, last = 0, b""
    for k, size, rest in zip(shared, sizes, data[8 * n + width * m :].split(b"\0")):
        last = last[:k] + rest
        yield last, numbers[at : at + size]
        at += size


def _packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["lang", "prefix", "part", "leaves", "sources", "trie"])


TRIES = "lang string, prefix binary, part int, leaves int, sources array<string>, trie binary"


def _counted(cells: int):
    """Parts of the tries of a task's documents (lang, source, text).  The empty term is the
    root, whose counters are the documents of each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        documents: dict[str, Counter] = {}

        def tries() -> Iterator[pa.RecordBatch]:
            for lang in sorted(documents):
                names = sorted(s for x, s in counts if x == lang)
                leaves = {term: [n] for term, n in documents.pop(lang).items()}
                for number, source in enumerate(names):
                    for term, n in counts.pop((lang, source)).items():
                        leaves[term] += number, n
                rows, size = [], 0
                for prefix, terms in groupby(sorted(leaves), lambda t: t[:PREFIX]):
                    terms = list(terms)
                    rows.append((lang, prefix, 0, len(terms), names, packed(terms, [leaves[t] for t in terms])))
                    size += len(terms)
                    if size >= 50_000:
                        yield _packed_rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _packed_rows(rows)

        # what is counted has no cycles, and there is much of it
        gc.disable()
        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                found = terms_of(text.as_py())
                found.append(b"")
                own, seen = counts.setdefault((lang, source), Counter()), documents.setdefault(lang, Counter())
                held -= len(own) + len(seen)
                own.update(found)
                seen.update(set(found))
                held += len(own) + len(seen)
                if held >= cells:
                    yield from tries()
                    held = 0
        yield from tries()
        gc.enable()

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of prefixes that have too many leaves, cut by a hash of their terms."""
    for batch in batches:
        for lang, prefix, _, _, sources, trie, parts in zip(*(c.to_pylist() for c in batch.columns)):
            cut: dict[int, tuple[list, list]] = {}
            for term, leaf in walked(trie):
                terms, leaves = cut.setdefault(zlib.crc32(term) % parts, ([], []))
                terms.append(term)
                leaves.append(leaf)
            yield _packed_rows([(lang, prefix, part, len(terms), sources, packed(terms, leaves)) for part, (terms, leaves) in cut.items()])


def _leaf_rows(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds, held, cells = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())), [], 0
    names = ["lang", "term", "documents", "sources", "counts"]
    for row in rows:
        held.append(row)
        cells += 1 + len(row[3])
        if cells >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, cells = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def _merged(least: int):
    """Tries of one (lang, prefix, part) after the other, walked together: the leaves of one
    term become one, of terms with enough documents and of the root."""

    def walk(names: list[str], trie: bytes) -> Iterator[tuple]:
        return ((term, names, leaf) for term, leaf in walked(trie))

    def together(lang: str, tries: list[tuple[list[str], bytes]]) -> Iterator[tuple]:
        for term, same in groupby(heapq.merge(*(walk(*t) for t in tries), key=itemgetter(0)), itemgetter(0)):
            same = list(same)
            documents = sum(leaf[0] for _, _, leaf in same)
            if documents >= least or not term:
                counts: dict[str, int] = {}
                for _, names, leaf in same:
                    for number, n in zip(leaf[1::2], leaf[2::2]):
                        counts[names[number]] = counts.get(names[number], 0) + n
                yield lang, term.decode(), documents, list(counts), list(counts.values())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def leaves() -> Iterator[tuple]:
            at, tries = None, []
            for batch in batches:
                for lang, prefix, part, sources, trie in zip(*(c.to_pylist() for c in batch.columns)):
                    if (lang, prefix, part) != at:
                        if at is not None:
                            yield from together(at[0], tries)
                        at, tries = (lang, prefix, part), []
                    tries.append((sources, trie))
            if at is not None:
                yield from together(at[0], tries)

        yield from _leaf_rows(leaves())

    return merge


def kept_terms(docs: DataFrame, text: str, lang: str, source: str, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """One leaf (``LEAF``) for each language and term of at least ``least`` documents, and
    for each language's root."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source)), F.col(text)).toDF("lang", "source", "text")
    # texts are read once
    tries = checkpointed(rows.mapInArrow(_counted(CELLS), TRIES))
    many = tries.groupBy("lang", "prefix").agg(F.sum("leaves").alias("n")).where(F.col("n") > MERGED)
    many = checkpointed(many.select("lang", "prefix", F.ceil(F.col("n") / MERGED).cast("int").alias("parts")))
    if not many.isEmpty():
        few = F.broadcast(many) if many.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else many
        cut = tries.join(few, ["lang", "prefix"]).select("lang", "prefix", "part", "leaves", "sources", "trie", "parts")
        tries = tries.join(few, ["lang", "prefix"], "left_anti").unionByName(cut.mapInArrow(_split, TRIES))
    key = ["lang", "prefix", "part"]
    dealt = tries.select(*key, "sources", "trie").repartition(*key).sortWithinPartitions(*key)
    return checkpointed(dealt.mapInArrow(_merged(least), LEAF))


def _share(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), exactly: in
    64-bit numbers where they suffice, else in Python's."""
    if len(counts) and int(counts.max()) > (2**63 - 1) // SCALE - SMOOTHING:
        exact = [SCALE * (int(c) + SMOOTHING) // (int(n) + SMOOTHING * terms) for c, n in np.broadcast(counts, totals)]
        return 1 + np.array(exact, np.int64)
    return 1 + (counts + SMOOTHING) * SCALE // (totals + SMOOTHING * terms)


def _with_groups(leaves: DataFrame, groups: DataFrame) -> DataFrame:
    """Kept leaves beside their language's statistics: terms, total, names and totals (of its
    sources, by name)."""
    stats = groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.sum("total").alias("total"), F.sort_array(F.collect_list(F.struct("source", "total"))).alias("g"))
    stats = stats.select("lang", "terms", "total", F.col("g.source").alias("names"), F.col("g.total").alias("totals"))
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return leaves.where("term != ''").join(F.broadcast(stats) if few else stats, "lang")


def _candidates(top: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[str, str], list] = {}
        at = 0
        for batch in batches:
            for lang, term, sources, counts, terms, total, names, totals in zip(*(c.to_pylist() for c in batch.columns)):
                at += 1
                there = [(s, c) for s, c in zip(sources, counts) if c]
                size = dict(zip(names, totals))
                own = np.array([c for _, c in there], np.int64)
                p = _share(own, np.array([size[s] for s, _ in there], np.int64), terms)
                q = _share(np.array([sum(counts)], np.int64), np.array([total], np.int64), terms)[0]
                for (source, _), f in zip(there, (p - q).tolist()):
                    if f > 0:
                        heap = heaps.setdefault((lang, source), [])
                        # a later term is the lesser of equal ones
                        (heapq.heappush if len(heap) < top else heapq.heappushpop)(heap, (f, -at, term))
        rows = [(lang, source, term, f) for (lang, source), heap in heaps.items() for f, _, term in heap]
        for i in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 50_000]), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "item", "value"])

    return best


def term_candidates(leaves: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """Rows lang, source, item, value: of each source the terms that it shows most beyond its
    language, with its ``top`` greatest and more."""
    rows = _with_groups(leaves, groups).sortWithinPartitions("lang", "term")
    rows = rows.select("lang", "term", "sources", "counts", "terms", "total", "names", "totals")
    return rows.mapInArrow(_candidates(top), "lang string, source string, item string, value bigint")


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of distances by pair of sources, one tile of them at a time: rows are in order of
    (lang, a, b), the numbers of the tile's two runs of sources."""
    at, names, sums = None, None, None

    def out() -> pa.RecordBatch:
        (left, right), own = names, at[1] == at[2]
        i, j = np.nonzero(np.tri(len(left), len(right), -1).T if own else np.ones(sums.shape))
        columns = [pa.array([at[0]] * len(i), pa.string()), pa.array([left[x] for x in i], pa.string()), pa.array([right[x] for x in j], pa.string()), pa.array(sums[i, j], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

    for batch in batches:
        for lang, a, b, terms, sources, counts, left, right, left_totals, right_totals in zip(*(c.to_pylist() for c in batch.columns)):
            if (lang, a, b) != at:
                if at is not None:
                    yield out()
                at, names, sums = (lang, a, b), (left, right), np.zeros((len(left), len(right)), np.int64)
                sizes = [np.array(x, np.int64) for x in (left_totals, right_totals)]
            found = dict(zip(sources, counts))
            p, q = (_share(np.array([found.get(s, 0) for s in run], np.int64), n, terms) for run, n in zip(names, sizes))
            sums += np.abs(p[:, None] - q[None, :])
    if at is not None:
        yield out()


def pair_distances(leaves: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows lang, a, b (a before b), value: the distance of two sources of a language, over
    all its kept terms."""
    rows = _with_groups(leaves, groups)
    tiles = F.ceil(F.size("names") / TILE).cast("int")
    a, b = F.explode(F.sequence(F.lit(0), tiles - 1)).alias("a"), F.explode(F.sequence(F.col("a"), F.ceil(F.size("names") / TILE).cast("int") - 1)).alias("b")
    rows = rows.select("*", a).select("*", b)
    run = lambda of, tile: F.slice(of, F.col(tile) * TILE + 1, F.lit(TILE))
    rows = rows.select("lang", "a", "b", "terms", "sources", "counts", run("names", "a"), run("names", "b"), run("totals", "a"), run("totals", "b"))
    rows = rows.sortWithinPartitions("lang", "a", "b")
    parts = rows.mapInArrow(_tiled, "lang string, a string, b string, value bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = rows.withColumn("rank", F.row_number().over(order))
    rows = rows if top is None else rows.where(F.col("rank") <= top)
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """Rows lang, source, part, item, value, rank.

    Part ``pair`` has the distance of a source to each other source of its language, part
    ``term`` the terms that a source shows beyond its language, the ``top`` first; ranks
    begin at 1 with the greatest value, equal ones by item in UTF-8 order.  Null text, lang
    and source are read as empty ones, so all documents take part; a language without kept
    terms has pairs of distance 0 and no terms.  Repeated rows count each on its own, and an
    empty table gives an empty result.
    """
    leaves = kept_terms(docs, text, lang, source, least)
    each = leaves.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("c")).select("lang", "term", "c.*")
    groups = each.groupBy("lang", F.col("sources").alias("source")).agg(F.sum(F.when(F.col("term") != "", F.col("counts")).otherwise(0)).alias("total"))
    sizes = leaves.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("terms"))
    groups = checkpointed(groups.join(sizes, "lang"))
    known = pair_distances(leaves, groups)
    # languages without kept terms have no leaf to walk over
    bare = groups.where("terms = 0").select("lang", "source")
    none = bare.toDF("lang", "a").join(bare.toDF("lang", "b"), "lang").where("a < b").select("lang", "a", "b", F.lit(0).cast("bigint").alias("value"))
    pairs = known.unionByName(none)
    both: list[Column] = [F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")]
    pairs = pairs.select("lang", F.explode(F.array(*both)).alias("s"), "value").select("lang", "s.source", "s.item", "value")
    return _ranked(pairs, "pair").unionByName(_ranked(term_candidates(leaves, groups, top), "term", top))
