"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text's words (lower case, split at white space) give a weighted set: its five-word
shingles and how often each occurs.  Two texts are linked when the probability Jaccard
similarity of their weighted sets is 0.8 or more; classes are the connected components.
On texts that repeat no shingle this is the Jaccard similarity of their shingle sets.

1. ``signatures``: every shingle sends arrivals of a Poisson process with its weight as
   rate to random registers; a register keeps the shingle that arrives first.  Shingles
   stop as soon as their next arrival is later than the slowest register.  Registers of
   two texts agree with the probability Jaccard similarity.
2. Texts with the same words are one node, so copies are never compared.
3. Nodes that agree in all registers of a band share a bucket.  Each bucket has a leader,
   drawn anew for each band, and members are paired with their leader only: at most one
   pair per node and band, however large the bucket.
4. Pairs are verified on the whole shingle sets.
5. Members of a bucket that are not yet connected meet the bucket's hub, its member with
   most links, for a few rounds.
6. Those that are still apart are paired by exact filters on their shingles (see
   ``_prefix_pairs``), so no link among the members of buckets is lost.

With 24 bands of 4 registers a pair at similarity 0.8 misses all buckets with a chance of
3e-6; above that it is smaller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.llm.arrow import add_columns
from driftwood.llm.cluster import checkpointed
from driftwood.llm.worker import kept, released

SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 24, 4
#: Rounds in which hubs are looked for, at most; they only save work.
HUB_ROUNDS = 3
#: Words of 64 bits in the maps of shingles by which pairs are passed over.
MAP_WORDS = 16
#: Ids of up to so many documents are broadcast; beyond, texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Shingles handled at a time, and words kept in a worker's cache.
SLICE_SHINGLES, CACHE_SIZE = 400_000, 100_000

_U = np.uint64
_FACTORS = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal, others unrelated numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _step(n: int) -> np.uint64:
    return _U(n * int(_FACTORS[0]) % 2**64)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def weighted_shingles(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A digest of the word sequence, and the sorted hashes and counts of the shingles.

    A text of one to four words has one shingle, all of it; one without words has none.
    """
    words = text.lower().split()
    node = xxhash.xxh3_128_digest(" ".join(words))
    if not words:
        return node, np.zeros(0, _U), np.zeros(0, np.int64)
    hashes = kept("near_dedup").setdefault("words", _WordHashes())
    if len(hashes) > CACHE_SIZE:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    mix = np.zeros(n, _U)
    for i in range(size):
        mix += h[i : i + n] * _FACTORS[i]
    found, counts = np.unique(mixed(mix), return_counts=True)
    return node, found, counts


def prob_min_hash(shingles: list[np.ndarray], weights: list[np.ndarray], registers: int) -> np.ndarray:
    """Signatures (texts x registers) of weighted sets, none of them empty."""
    owner = np.repeat(np.arange(len(shingles)), [len(s) for s in shingles])
    h, rate = np.concatenate(shingles), np.concatenate(weights).astype(np.float64)
    first = np.full(len(shingles) * registers, np.inf)
    kept = np.zeros(len(first), _U)
    at, step = np.zeros(len(h)), 0
    while len(h):
        step += 1
        draw = mixed(h + _step(2 * step))
        at = at - np.log((draw >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate
        slot = owner * registers + (mixed(h + _step(2 * step + 1)) % _U(registers)).astype(np.int64)
        np.minimum.at(first, slot, at)
        won = first[slot] == at
        kept[slot[won]] = h[won]
        slowest = first.reshape(-1, registers).max(axis=1)
        on = at < slowest[owner]
        h, rate, owner, at = h[on], rate[on], owner[on], at[on]
    return kept.reshape(-1, registers)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact similarity of two weighted sets (sorted hashes a, b with weights x, y):
    the sum over common elements i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = x.astype(np.float64), y.astype(np.float64)
    # an element j counts by x where x_j / y_j is at least x_i / y_i, else by y
    ratio = x[i] / y[j]
    order = np.argsort(ratio, kind="stable")
    ratio, u, v = ratio[order], x[i][order], y[j][order]
    only_x, only_y = x.sum() - u.sum(), y.sum() - v.sum()
    below_y = np.concatenate([[0.0], np.cumsum(v)])
    above_x = u.sum() - np.concatenate([[0.0], np.cumsum(u)])
    k = np.searchsorted(ratio, ratio, side="left")
    total = (only_x + above_x[k]) / u + (only_y + below_y[k]) / v
    return float((1.0 / total).sum())


SIGNATURES = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType(), False), False)])


def signatures(docs: DataFrame, key: str, text: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Columns key, those of ``more``, node (digest of the words; null for null text), bands (a hash for each
    band; none for a text without words)."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        nodes: list[bytes | None] = []
        bands = np.zeros((batch.num_rows, BANDS), np.int64)
        has = np.zeros(batch.num_rows, bool)
        at: list[int] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if held:
                signs = prob_min_hash([s for s, _ in held], [c for _, c in held], BANDS * BAND_ROWS)
                mix = np.zeros((len(held), BANDS), _U)
                for r in range(BAND_ROWS):
                    mix += signs[:, r * BANDS : (r + 1) * BANDS] * _FACTORS[r]
                bands[at] = mixed(mix + np.arange(1, BANDS + 1, dtype=_U) * _FACTORS[4]).view(np.int64)
                has[at] = True
                at.clear()
                held.clear()

        size = 0
        for i, t in enumerate(batch.column(batch.schema.get_field_index(text)).to_pylist()):
            if t is None:
                nodes.append(None)
                continue
            node, found, counts = weighted_shingles(t)
            nodes.append(node)
            if len(found):
                at.append(i)
                held.append((found, counts))
                size += len(found)
                if size > SLICE_SHINGLES:
                    flush()
                    size = 0
        flush()
        ends = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
        values = pa.array(bands[has].reshape(-1))
        return [pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), values, type=pa.list_(pa.field("element", pa.int64(), False)))]

    return add_columns(docs, SIGNATURES, make, keep=[key, *more], rows=2048, owner="near_dedup")


SHINGLES = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("shingles", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def unpacked(shingles: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of a packed set; no counts stand for ones."""
    found = np.frombuffer(shingles, _U)
    return found, np.frombuffer(counts, np.int32) if counts else np.ones(len(found), np.int32)


def shingle_sets(docs: DataFrame, text: str) -> DataFrame:
    """Columns node, shingles, counts (packed numbers; empty if all are 1) of each non-null text."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        made = [weighted_shingles(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        return [pa.array([m[0] for m in made], pa.binary()), pa.array([m[1].tobytes() for m in made], pa.binary()), pa.array([m[2].astype(np.int32).tobytes() if (m[2] != 1).any() else b"" for m in made], pa.binary())]

    return add_columns(docs, SHINGLES, make, keep=[], owner="near_dedup")


VERIFIED = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("similarity", T.DoubleType())])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The exact similarity of each pair of nodes."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("counts").alias("ca"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("counts").alias("cb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "ca", "sb", "cb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near_dedup")
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                sa, ca, sb, cb = (batch.column(c)[i].as_py() for c in (2, 3, 4, 5))
                found.append(probability_jaccard(*unpacked(sa, ca), *unpacked(sb, cb)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"])
        released()

    return both.mapInArrow(run, VERIFIED)


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of every linked node, root the least node of its component.

    ``known`` is what earlier links gave; then only new ``links`` are needed.  Alternates
    two steps that hang nodes on smaller neighbours until all hang on the least.  Each is a
    minimum over a node's neighbours in a window, so a turn has three shuffles; it is
    written to the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    if known is not None:
        edges = edges.union(known.select("node", "root").where("node != root"))
    edges, mark = checkpointed(edges.distinct()), None
    least = F.min("v").over(Window.partitionBy("u"))
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        large = both.withColumn("m", F.least("u", least)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", least).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = checkpointed(small.select("e.u", "e.v").where("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def _rooted(shared: DataFrame, roots: DataFrame) -> DataFrame:
    return shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _split(known: DataFrame) -> tuple[DataFrame, int]:
    """Buckets with several components, and how many members they have in all."""
    split = known.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
    split = checkpointed(split.where("lo != hi").select("bucket", "n"))
    return split.select("bucket"), split.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]


def _prefix_pairs(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may be similar enough.

    Let u be the weight of a set that is not common to both over the weight that is, and v
    the same of the other set.  The similarity is at most 1 / (1 + u + v): in each term,
    max(x_j / x_i, y_j / y_i) is at least x_j / x_i, the terms are then concave and
    homogeneous in the common weights, and so their sum is at most the term of the sums.

    Shingles that one component alone has are common to no pair asked for: their weight is
    not common, ever.  The others have one global order, the rarest first.  What a set has
    before the first common shingle is not common either, so a similar pair meets there
    with little enough before in both sets.  A shingle's holders without any partner of
    another component that meets the bound are left out before they are paired.  A pair
    that meets also has to meet the bound by its bit maps: each bit that one set has and
    the other lacks is a shingle that is not common.  No pair that is similar enough is
    left out.
    """
    slack = 1 / similarity - 1 + 1e-6
    held = apart.join(sets, "node").select("node", "root", "shingles", "counts")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, packed, counts in zip(*(batch.column(i) for i in range(3))):
                found, n = unpacked(packed.as_py(), counts.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()] * len(found), pa.binary()), pa.array(found.view(np.int64)), pa.array(n)], names=["node", "shingle", "count"])

    def components_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, packed in zip(*(batch.column(i) for i in range(2))):
                found = np.frombuffer(packed.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), root.as_py(), np.int64))], names=["shingle", "root"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(unpacked(s.as_py(), c.as_py())[1].sum()) for s, c in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], names=["node", "root", "total"])

    # components are told apart by 64 bits of their names here, so that the sums need no sort
    seen = held.select(F.xxhash64("root").alias("root"), "shingles").mapInArrow(components_of, "shingle bigint, root bigint")
    seen = seen.groupBy("shingle").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    rows = held.select("node", "shingles", "counts").mapInArrow(spread, "node binary, shingle bigint, count int")
    rows = rows.join(seen.where("lo != hi").select("shingle", "df"), "shingle")
    rows = checkpointed(rows.join(held.mapInArrow(total, "node binary, root binary, total bigint"), "node"))

    order = Window.partitionBy("node").orderBy("df", "shingle")
    own = F.col("total") - F.sum("count").over(Window.partitionBy("node"))
    before = own + F.coalesce(F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumns({"own": own, "before": before}).withColumn("apart", F.col("before") / (F.col("total") - F.col("before")))
    prefix = checkpointed(placed.where(F.col("apart") <= slack).select("node", "root", "shingle", "apart", "own", "total"))

    # of each shingle the least value of any component, and of any other component
    by_root = prefix.groupBy("shingle", "root").agg(F.min("apart").alias("least"))
    first = by_root.groupBy("shingle").agg(F.min(F.struct("least", "root")).alias("one"))
    second = by_root.join(first, "shingle").where(F.col("root") != F.col("one.root")).groupBy("shingle").agg(F.min("least").alias("two"))
    best = first.join(second, "shingle").select("shingle", F.col("one.root").alias("best_root"), F.col("one.least").alias("one"), "two")
    partner = F.when(F.col("root") == F.col("best_root"), F.col("two")).otherwise(F.col("one"))
    prefix = prefix.join(best, "shingle").where(F.col("apart") + partner <= slack).select("node", "root", "shingle", "apart", "own", "total")

    bit = F.expr("shiftleft(1L, int(shiftright(shingle, 8) & 63))")
    word = F.col("shingle").bitwiseAND(MAP_WORDS - 1)
    maps = rows.groupBy("node").agg(*[F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0)).alias(f"m{i}") for i in range(MAP_WORDS)])
    prefix = checkpointed(prefix.join(maps, "node"))

    x, y = (prefix.select(*[F.col(c).alias(side + c) for c in prefix.columns]) for side in "xy")

    def not_common(one: str, other: str) -> Column:
        lacking = [F.bit_count(F.col(f"{one}m{i}").bitwiseAND(F.bitwise_not(f"{other}m{i}"))) for i in range(MAP_WORDS)]
        return F.col(f"{one}own") + sum(lacking[1:], lacking[0])

    def bounded(one: str, other: str) -> Column:
        return not_common(one, other) / (F.col(f"{one}total") - not_common(one, other))

    met = (F.col("xshingle") == F.col("yshingle")) & (F.col("xroot") < F.col("yroot")) & (F.col("xapart") + F.col("yapart") <= slack)
    met &= (not_common("x", "y") < F.col("xtotal")) & (not_common("y", "x") < F.col("ytotal"))
    met &= bounded("x", "y") + bounded("y", "x") <= slack
    return _ordered(x.join(y, met), "xnode", "ynode")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Columns key, class_id (the least key of the row's class) and class_texts (how many
    different texts the class has) for each row of ``docs``.

    A null text is no duplicate of anything: its class is its own key.  Texts without
    words are copies of each other.  Repeated rows share a class.  Rows with one key and
    different texts are told apart by their texts.  A null key is passed over when the
    least key is taken.  Other columns are not handed on; an empty table gives an empty
    result.
    """
    out = _classes(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), similarity)
    return out.select(F.col("_key").alias(key), F.coalesce("class_id", "_key").alias("class_id"), F.coalesce("class_texts", F.lit(1)).cast("long").alias("class_texts"))


def _classes(docs: DataFrame, similarity: float, more: tuple[str, ...] = ()) -> DataFrame:
    """Columns _key, those of ``more``, node, root (the same for all nodes of a class),
    class_id and class_texts for each row of ``docs`` (_key, _text and ``more``).  A row of
    null text has null in the last four."""
    signed = checkpointed(signatures(docs, "_key", "_text", more))
    reps = checkpointed(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("_key").alias("doc"), F.first("bands").alias("bands")))
    members = reps.select("node", F.explode("bands").alias("bucket"))
    lead = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "node").alias("o"), "node")).alias("m"), F.count("*").alias("n"))
    lead = lead.where("n > 1").select("bucket", F.col("m.node").alias("leader"))
    shared = checkpointed(members.join(lead, "bucket"))
    pairs = _ordered(shared.where("node != leader"), "node", "leader")

    # whole shingle sets of the nodes in shared buckets only, made from the texts again
    needed = shared.select("node").distinct()
    ids = needed.join(reps.select("node", "doc"), "node").select(F.col("doc").alias("_doc")).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, F.col("_key").eqNullSafe(F.col("_doc")), "left_semi").where("_text IS NOT NULL")
    sets = checkpointed(shingle_sets(texts, "_text").join(needed, "node", "left_semi").dropDuplicates(["node"]))

    tested = checkpointed(verified(pairs, sets))
    roots = components(tested.where(F.col("similarity") >= similarity))

    # hubs: the best-linked member of a bucket meets those that are not yet connected to it
    left = None
    for _ in range(HUB_ROUNDS):
        known = _rooted(shared.select("bucket", "node"), roots)
        split, size = _split(known)
        if not size or (left is not None and 2 * size > left):
            break
        left = size
        links = tested.where(F.col("similarity") >= similarity)
        degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
        held = checkpointed(known.join(split, "bucket").join(degree, "node", "left").fillna(0, "links"))
        hub = held.groupBy("bucket").agg(F.max(F.struct("links", F.xxhash64("node").alias("o"), "node", "root")).alias("h"))
        met = held.join(hub.select("bucket", F.col("h.node").alias("hub"), F.col("h.root").alias("hub_root")), "bucket")
        fresh = _ordered(met.where("root != hub_root"), "node", "hub").join(tested.select("a", "b"), ["a", "b"], "left_anti")
        fresh = checkpointed(verified(checkpointed(fresh), sets))
        tested = tested.unionByName(fresh)
        roots = components(fresh.where(F.col("similarity") >= similarity), roots)

    # what is still apart, by an exact filter on the shingle sets
    known = _rooted(shared.select("bucket", "node"), roots)
    split, size = _split(known)
    if size:
        apart = checkpointed(known.join(split, "bucket").select("node", "root").distinct())
        rest = checkpointed(_prefix_pairs(apart, sets, similarity).join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        roots = components(verified(rest, sets).where(F.col("similarity") >= similarity), roots)

    classed = reps.select("node", "doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = classed.groupBy("root").agg(F.min("doc").alias("class_id"), F.count("*").alias("class_texts"))
    named = classed.join(named, "root").select("node", "root", "class_id", "class_texts")
    return signed.select("_key", *more, "node").join(named, "node", "left")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each class, one row of the least key (null
    keys come last; of texts that share the key, the one of least digest).

    Rows are told apart by key and text together, so a row goes only if its own text has
    a class that another row stands for.  Of rows that repeat key and text, one stays;
    rows of null text are no duplicates unless they repeat a key.  All columns are handed
    on as they are.
    """
    same = F.unhex(F.sha2(F.col(text), 256))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), same.alias("_same"))
    classes = checkpointed(_classes(rows, SIMILARITY, ("_same",)).select("_key", "_same", "root"))
    who = F.struct(F.col("_key").isNull().alias("unnamed"), "_key", "_same")
    stands = classes.where("root IS NOT NULL").groupBy("root").agg(F.min(who).alias("_rep"), F.count("*").alias("_n"))
    stands = stands.where("_n > 1")
    few = stands.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    gone = classes.join(F.broadcast(stands) if few else stands, "root").where(who != F.col("_rep")).select(F.col("_key").alias("_gone"), F.col("_same").alias("_gone_same")).distinct()
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    met = F.col(key).eqNullSafe(F.col("_gone")) & (same == F.col("_gone_same"))
    kept = docs.join(F.broadcast(gone) if few else gone, met, "left_anti")
    named = F.col("_key").isNotNull() | F.col("_same").isNotNull()
    repeats = classes.where(named).groupBy("_key", "_same").count().where("count > 1")
    if repeats.isEmpty():
        return kept
    kept = kept.withColumns({"_key": F.col(key), "_same": same})
    return kept.where(named).dropDuplicates(["_key", "_same"]).unionByName(kept.where(~named)).drop("_key", "_same")
