"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector x is turned by one random rotation; its code is the signs of the result, a
unit vector c of values +-1/sqrt(d), and its correction factor is f = <x, c>.  For another
vector y, <y, c> / f is an unbiased estimate of <y, x> over rotations, and angles give
bounds of it that always hold: the angle of x and y is within angle(y, c) -+ arccos(f).
Pairs whose upper bound is below the threshold are dropped by codes alone; only the others
are computed again from the vectors.

Who meets whom is decided by the same signs, without loss.  The turned coordinates are cut
into bands.  Vectors at a distance D differ by at most D^2 / bands in squared distance in
some band, and where the signs of a coordinate differ, the distance there is at least the
size of either one's coordinate.  So the signs of one of the two turn into the signs of the
other by flips whose coordinates' squares sum up to at most half of that.  Each vector is
kept in its own cell of each band and looks into all cells that such flips lead to.

Crowds of copies are held together first: vectors of a full cell that are within half the
threshold's angle of their mean are a ball, all of whose members are linked to each other
whatever the rest is.  A ball is in each cell once, however many members it has, and for two
balls the angle of their centres tells most often for all members at once whether they are
linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.llm.cluster import checkpointed
from driftwood.llm.near_dedup import components

THRESHOLD, SEED = 0.93, 13
#: Coordinates to a band, and the least and most of them that name its cells.
BAND, FEWEST_BITS, MOST_BITS = 16, 5, 16
#: Vectors of a cell that make it worth to look for balls; members of a cell that are
#: compared in one task.
CROWD, TILE = 256, 4_096
#: Rows up to which a side of some bytes a row is broadcast.
BROADCAST_ROWS = 20_000
#: Slack of bounds, as vectors are computed in finite precision.
SLACK = 1e-6


@lru_cache(8)
def rotation(d: int) -> np.ndarray:
    """A random rotation of d dimensions, the same in all tasks."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, d)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def bands_of(d: int) -> list[tuple[int, int]]:
    n = max(1, math.ceil(d / BAND))
    return [(d * i // n, d * (i + 1) // n) for i in range(n)]


def with_unit(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` with ``unit`` in place of the column ``vector``: it as doubles of length 1;
    null if it is null or empty, has a component that is null or not finite, or only zeros."""
    fields = [f for f in rows.schema if f.name != vector]
    schema = T.StructType([*fields, T.StructField("unit", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(batch.schema.get_field_index(vector))
            units = []
            for v in given:
                x = None if v.as_py() is None else v.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
                # by the greatest component first, so that no square leaves the range of doubles
                most = np.abs(x).max() if x is not None and len(x) and np.isfinite(x).all() else 0
                scaled = x / most if most else None
                units.append(None if scaled is None else scaled / math.sqrt(scaled @ scaled))
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(units, pa.list_(pa.float64()))], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_size(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """The batch, cut by the length of its vectors."""
    sizes = np.diff(batch.column(batch.schema.get_field_index(name)).offsets.to_numpy())
    for d in np.unique(sizes):
        yield batch if (sizes == d).all() else batch.take(pa.array(np.flatnonzero(sizes == d)))


def _flips(x: np.ndarray, budget: float) -> list[int]:
    """The sums of bits of all sets of coordinates whose squares sum up to at most the
    budget, the empty one too."""
    found = [(0, budget)]
    for i, square in sorted(enumerate((x * x).tolist()), key=lambda p: p[1]):
        more = [(m | 1 << i, left - square) for m, left in found if left >= square]
        if not more:
            break
        found += more
    return [m for m, _ in found]


def _cells(bits: int, distance: float, band: int | None = None):
    """Rows node, band, cell and own of vectors (node, unit): the cell that a vector is kept
    in and those that it looks into; of one band its own cells only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_size(batch, "unit") if batch.num_rows else ():
                turned = _matrix(part.column(1)) @ rotation(_d := len(part.column(1)[0])).T
                nodes, all_bands = part.column(0).to_numpy(zero_copy_only=False), bands_of(_d)
                out: list[list] = [[], [], [], []]
                for k, (low, high) in enumerate(all_bands):
                    if band is not None and k != band % len(all_bands):
                        continue
                    values = turned[:, low : min(high, low + bits)]
                    own = (values > 0) @ (1 << np.arange(values.shape[1]))
                    for node, x, cell in zip(nodes.tolist(), values, own.tolist()):
                        looked = [] if band is not None else [cell ^ m for m in _flips(x, distance**2 / len(all_bands) / 2 + SLACK)]
                        out[0] += [node] * (1 + len(looked))
                        out[1] += [k] * (1 + len(looked))
                        out[2] += [cell, *looked]
                        out[3] += [True, *[False] * len(looked)]
                        if len(out[0]) >= 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _CELL)], names=["node", "band", "cell", "own"])
                            out = [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _CELL)], names=["node", "band", "cell", "own"])

    return run


_CELL = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
CELL = "node bigint, band int, cell int, own boolean"
CODE = "node bigint, code binary, factor double, coarse binary, step double, error double"


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each vector (node, unit) its code, the angle of its correction factor, and its
    turned coordinates in bytes with their step and their error."""
    for batch in batches:
        for part in _by_size(batch, "unit") if batch.num_rows else ():
            x = _matrix(part.column(1))
            turned = x @ rotation(x.shape[1]).T
            factor = np.abs(turned).sum(1) / math.sqrt(x.shape[1])
            step = np.abs(turned).max(1, keepdims=True) / 127
            coarse = np.rint(turned / step)
            error = np.linalg.norm(turned - coarse * step, axis=1)
            code, coarse = np.packbits(turned > 0, axis=1), coarse.astype(np.int8)
            columns = [part.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(np.arccos(np.minimum(1, factor))), pa.array([c.tobytes() for c in coarse], pa.binary()), pa.array(step[:, 0]), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "code", "factor", "coarse", "step", "error"])


def possible(coarse: np.ndarray, step: np.ndarray, error: np.ndarray, signs: np.ndarray, factor: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which vectors (rows) can be within an angle ``reach`` of which others (columns), of
    whom only codes and correction factors are known: never false where they are."""
    seen = (coarse @ signs.T) * (step[:, None] / math.sqrt(signs.shape[1]))
    # what is turned is off by at most ``error`` in the direction of any code
    apart = np.arccos(np.clip(seen + error[:, None] + SLACK, -1, 1))
    return apart - factor[None, :] <= reach


def _met(theta: float, tile: int):
    """Pairs (a, b), a < b, of what is kept in a cell and what looks into it whose bounds
    leave it open that they are linked.  Rows are in order of cells, kept ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, here, looking = None, [], []

        def pairs() -> Iterator[pa.RecordBatch]:
            if here and looking:
                d = len(here[0][3])
                coarse = np.frombuffer(b"".join(r[3] for r in here), np.int8).reshape(-1, d).astype(np.float64)
                nodes, radius, step, error = (np.array([r[i] for r in here]) for i in (0, 6, 4, 5))
                code = np.frombuffer(b"".join(r[1] for r in looking), np.uint8).reshape(len(looking), -1)
                signs = np.unpackbits(code, axis=1, count=d) * 2.0 - 1
                others, factor, more = (np.array([r[i] for r in looking]) for i in (0, 2, 6))
                open_ = possible(coarse, step, error, signs, factor, theta + radius[:, None] + more[None, :])
                i, j = np.nonzero(open_ & (nodes[:, None] != others[None, :]))
                if len(i):
                    a, b = np.minimum(nodes[i], others[j]), np.maximum(nodes[i], others[j])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            looking.clear()

        for batch in batches:
            for *cell, own, node, code, factor, coarse, step, error, radius in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != at:
                    yield from pairs()
                    at, here = cell, []
                row = (node, code, factor, coarse, step, error, radius)
                if own:
                    here.append(row)
                else:
                    looking.append(row)
                    if len(looking) >= tile:
                        yield from pairs()
        yield from pairs()

    return run


def _small(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _balls(vectors: DataFrame, bits: int, theta: float) -> tuple[DataFrame, DataFrame]:
    """``vectors`` (row, kin, unit) with node, the least row of a vector's ball or its own,
    and, for balls, node, unit (their centre), radius and size."""
    deepest = vectors.agg(F.max(F.size("unit"))).head()[0]
    left, found, balls = vectors, None, None
    for band in range(len(bands_of(deepest or 1))):
        cells = left.select(F.col("row").alias("node"), "unit").mapInArrow(_cells(bits, 0.0, band), CELL)
        placed = checkpointed(left.join(cells.select(F.col("node").alias("row"), "band", "cell"), "row"))
        full = placed.groupBy("kin", "band", "cell").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD)
        full = checkpointed(full)
        if full.isEmpty():
            break
        crowd = placed.join(_small(full), ["kin", "band", "cell"])
        # means by coordinate: sums are combined before they are shuffled
        sums = crowd.select("kin", "band", "cell", F.posexplode("unit").alias("i", "v")).groupBy("kin", "band", "cell", "i").agg(F.sum("v").alias("v"))
        centres = sums.groupBy("kin", "band", "cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centre"))
        centres = with_unit(centres, "centre").withColumnRenamed("unit", "centre")
        centres = checkpointed(centres.where("centre IS NOT NULL"))
        near = placed.join(_small(centres), ["kin", "band", "cell"]).withColumn("far", angle(F.col("unit"), F.col("centre")))
        near = checkpointed(near.where(F.col("far") <= theta / 2 - SLACK))
        made = near.groupBy("kin", "band", "cell").agg(F.min("row").alias("node"), F.max("far").alias("radius"), F.count("*").alias("size"))
        made = checkpointed(made.where("size > 1"))
        inside = near.join(_small(made.select("kin", "band", "cell", "node")), ["kin", "band", "cell"]).select("row", "kin", "unit", "node")
        inside = checkpointed(inside)
        own = made.join(centres, ["kin", "band", "cell"]).select("node", "kin", F.col("centre").alias("unit"), "radius", "size")
        found = inside if found is None else found.unionByName(inside)
        balls = own if balls is None else balls.unionByName(own)
        left = checkpointed(left.join(inside.select("row"), "row", "left_anti"))
    alone = left.select("row", "kin", "unit", F.col("row").alias("node"))
    none = alone.limit(0).select("node", "kin", "unit", F.lit(0.0).alias("radius"), F.lit(1).cast("bigint").alias("size"))
    members = alone if found is None else alone.unionByName(found)
    return members, none if balls is None else balls


def _open_pairs(members: DataFrame, nodes: DataFrame, bits: int, theta: float) -> DataFrame:
    """Distinct pairs (a, b) of nodes that may have linked members."""
    reach = 2 * math.sin(theta / 2)
    cells = members.select("node", "unit").mapInArrow(_cells(bits, reach), CELL).distinct()
    codes = nodes.select("node", "unit").mapInArrow(_codes, CODE)
    payload = checkpointed(codes.join(nodes.select("node", "kin", "radius"), "node"))
    rows = cells.join(payload, "node")
    rows = rows.select("kin", "band", "cell", "own", "node", F.when(~F.col("own"), F.col("code")).alias("code"), "factor", F.when(F.col("own"), F.col("coarse")).alias("coarse"), "step", "error", "radius")
    rows = checkpointed(rows)
    cell = ["kin", "band", "cell"]
    # cells that hold more than a task compares are cut: what is kept is dealt to parts, and
    # what looks into them goes to every part
    full = rows.where("own").groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    full = full.select(*cell, F.ceil(F.col("n") / TILE).cast("int").alias("parts"))
    rows = rows.join(_small(checkpointed(full)), cell, "left")
    parts = F.coalesce("parts", F.lit(1))
    part = F.explode(F.when(F.col("own"), F.array(F.pmod(F.xxhash64("node"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select(*cell, part.alias("part"), "own", "node", "code", "factor", "coarse", "step", "error", "radius")
    dealt = rows.repartition(*cell, "part").sortWithinPartitions(*cell, "part", F.desc("own"))
    return checkpointed(dealt.mapInArrow(_met(theta, TILE), "a bigint, b bigint").distinct())


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Columns key, n_links, component_id and kept for each row of ``vectors``.

    Rows of one label, not null, are linked if the cosine of their vectors, in doubles, is
    at least ``threshold`` (over 0).  Vectors that are null, empty or zero or hold null or
    non-finite components are linked to nothing, nor are vectors of different lengths.  Each
    row counts by itself: rows that repeat a key or a vector are linked as others are.  The
    least key of a component is its id; null keys are passed over.  An empty table gives an
    empty result; other columns are not handed on.
    """
    theta = math.acos(threshold)
    rows = with_unit(vectors.select(F.col(key).alias("_key"), F.col(label).alias("kin"), F.col(vector).alias("vector")), "vector")
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    # only vectors of one length are kin
    able = rows.where("kin IS NOT NULL AND unit IS NOT NULL").select("row", F.struct("kin", F.size("unit").alias("d")).alias("kin"), "unit")
    most = able.groupBy("kin").count().agg(F.max("count")).head()[0] or 1
    bits = min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(most / 64))))
    members, balls = _balls(able, bits, theta)
    members = checkpointed(members)
    alone = members.join(_small(balls.select("node")), "node", "left_anti")
    nodes = checkpointed(alone.select("node", "kin", "unit", F.lit(0.0).alias("radius"), F.lit(1).cast("bigint").alias("size")).unionByName(balls))

    met = _open_pairs(members, nodes, bits, theta)
    sides = [nodes.select(F.col("node").alias(s), F.col("unit").alias(f"{s}_unit"), F.col("radius").alias(f"{s}_radius"), F.col("size").alias(f"{s}_size")) for s in "ab"]
    met = met.join(sides[0], "a").join(sides[1], "b")
    apart, wide = F.col("apart"), F.col("a_radius") + F.col("b_radius")
    met = met.withColumns({"apart": angle(F.col("a_unit"), F.col("b_unit")), "cosine": dot(F.col("a_unit"), F.col("b_unit"))})
    single = (F.col("a_size") == 1) & (F.col("b_size") == 1)
    sure = F.when(single, F.col("cosine") >= threshold).when(apart <= theta - wide - SLACK, True).when(apart > theta + wide + SLACK, False)
    met = checkpointed(met.select("a", "b", "a_size", "b_size", sure.alias("linked")))
    whole = met.where("linked").select("a", "b", "a_size", "b_size")

    # balls of which some members are linked and others may not be: a member against the
    # other ball's centre first, and what that leaves open member by member
    mixed = met.where("linked IS NULL").select("a", "b")
    who = members.select("node", "row", "unit")
    first = mixed.join(who.toDF("a", "row", "unit"), "a").join(nodes.select(F.col("node").alias("b"), F.col("unit").alias("centre"), "radius", "size"), "b")
    first = first.withColumn("apart", angle(F.col("unit"), F.col("centre")))
    first = first.where(F.col("apart") <= theta + F.col("radius") + SLACK).withColumn("sure", F.col("apart") <= theta - F.col("radius") - SLACK)
    first = checkpointed(first.select("a", "b", "row", "unit", "size", "sure"))
    second = first.where("NOT sure").select("a", "b", "row", "unit").join(who.toDF("b", "other", "other_unit"), "b")
    second = checkpointed(second.where(dot(F.col("unit"), F.col("other_unit")) >= threshold).select("a", "b", "row", "other"))

    by_node = whole.select(F.col("a").alias("node"), F.col("b_size").alias("n")).unionByName(whole.select(F.col("b").alias("node"), F.col("a_size").alias("n")))
    by_node = by_node.unionByName(first.where("sure").select(F.col("b").alias("node"), F.lit(1).cast("bigint").alias("n")))
    by_node = by_node.unionByName(balls.select("node", (F.col("size") - 1).alias("n"))).groupBy("node").agg(F.sum("n").alias("by_node"))
    by_row = first.where("sure").select("row", F.col("size").alias("n"))
    one = F.lit(1).cast("bigint").alias("n")
    by_row = by_row.unionByName(second.select("row", one)).unionByName(second.select(F.col("other").alias("row"), one)).groupBy("row").agg(F.sum("n").alias("by_row"))
    edges = whole.select("a", "b").unionByName(first.where("sure").select("a", "b")).unionByName(second.select("a", "b")).distinct()
    roots = checkpointed(components(edges))

    linked = members.select("row", "node").join(by_node, "node", "left").join(by_row, "row", "left").join(roots, "node", "left")
    linked = linked.select("row", (F.coalesce("by_node", F.lit(0)) + F.coalesce("by_row", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    placed = checkpointed(rows.select("row", "_key").join(linked, "row", "left"))
    names = placed.where("n_links > 0").groupBy("root").agg(F.min("_key").alias("least"))
    out = placed.join(names, "root", "left").withColumn("component_id", F.coalesce("least", "_key"))
    return out.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("_key").eqNullSafe(F.col("component_id")).alias("kept"))
