"""Multi-line events: linking stack frames and payload bodies to the line that began them.

A line joins the event above it if it follows without a gap and either looks like a part
of it by itself or the event has a brace open.  A record joins only an event that a record
of the same identity began, and any other prefixed line none.  An event ends before the
first line that does not join it, after the line that closes its outermost brace, and after
``chain_cap`` lines.  What happens to a line thus depends on where events before it began,
and in a long run of records that may go back to the run's first line.

It is resolved by an associative scan, exactly, for runs of any length:

* where an event ends depends on its first line alone, and the next event begins at the
  first prefixed line from there on.  So in a block of lines each prefixed line points to
  the next one that begins an event if it does;
* followed to the block's end, these pointers make the block a function: from the line at
  which it is entered to the line at which the next block is.  Lines before an entry belong
  to the block before;
* the functions of blocks that follow each other are composed, group by group and then over
  the groups; what a group is entered at is handed down to its blocks;
* a block whose entry is known links its lines by following its pointers.

No task holds more than a block of lines and as many beyond it as an event can have, a block
hands on a few numbers, and only blocks with events of several lines hand back links.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.config import Config

#: Line numbers to a block, and blocks to a group.
BLOCK, GROUP = 8_192, 1_024

_EXCEPTION = r"(?:[A-Za-z0-9_$.]*\.)?[A-Za-z0-9_$]*(?:Exception|Error|Throwable)(?:$(?![\s\S])|:)"
_PYTHON = r'File "[\s\S]*?", line [0-9]'
#: What marks a line as part of the event above it (fixed values).
FRAME = rf"^[ \t]*(?:at |Caused by:|Suppressed:|Traceback \(most recent call last\):|\.\.\. [0-9]+(?U:\s*)more(?U:\s*)$(?![\s\S])|{_PYTHON}|{_EXCEPTION})"


def is_frame(text: Column) -> Column:
    return text.rlike(FRAME)


def is_python_frame(text: Column) -> Column:
    # only the first quote-comma after the file's name counts
    return text.rlike(r'^[ \t]*File "(?:(?!", line )[\s\S])*", line [0-9]')


def brace_effect(text: Column) -> tuple[Column, Column]:
    """How braces change a depth d that never falls below 0: to max(d + a, b)."""
    braces = F.regexp_replace(text, r"[^{}]", "")
    opened = F.length(F.replace(braces, F.lit("}"), F.lit("")))
    net = 2 * opened - F.length(braces)
    steps = F.split(braces, "")
    from_zero = F.aggregate(steps, F.lit(0), lambda d, c: F.when(c == "{", d + 1).when(c == "}", F.greatest(d - 1, F.lit(0))).otherwise(d))
    return F.when(braces == "", 0).otherwise(net), F.when(braces == "", 0).otherwise(from_zero)


def marks(text: Column, message: Column, prefixed: Column, identity: Column, rest_raw: Column) -> dict[str, Column]:
    """What linking needs of each plain line."""
    opens, floor = brace_effect(message)
    looks = F.when(identity.isNotNull(), rest_raw.rlike("^ [ \t]") | is_frame(message)).when(~prefixed, is_frame(text))
    return {
        "prefixed": prefixed,
        "identity": identity,
        "looks": F.coalesce(looks, F.lit(False)),
        "indented": ~prefixed & text.rlike("^[ \t]"),
        "file_frame": is_python_frame(message),
        "opens": opens.cast("int"),
        "floor": floor.cast("int"),
    }


MARKS = ("ordinal", "prefixed", "identity", "looks", "indented", "file_frame", "opens", "floor")
#: Where a block is entered: how many of its first line numbers belong to the event that
#: ``root`` began in the block before, and whether the cap kept the next line out of it.
_ENTRY = "entered int, root bigint, cut boolean"
_ENTRY_TYPE = "struct<entered:int,root:bigint,cut:boolean>"
_SUMMARY = f"source string, _block bigint, upto array<int>, leaves array<{_ENTRY_TYPE}>"


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """The rows of sorted batches by their first ``keys`` columns: key and other columns."""
    at, held = None, []
    for batch in batches:
        names = [batch.column(i).to_pylist() for i in range(keys)]
        rest = [c.to_numpy(zero_copy_only=False) for c in batch.columns[keys:]]
        edges = [0, *(i for i in range(1, batch.num_rows) if any(n[i] != n[i - 1] for n in names)), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            if low == high:
                continue
            key = tuple(n[low] for n in names)
            if key != at:
                if held:
                    yield at, [np.concatenate(c) for c in zip(*held)]
                at, held = key, []
            held.append([c[low:high] for c in rest])
    if held:
        yield at, [np.concatenate(c) for c in zip(*held)]


def _next(flags: np.ndarray) -> np.ndarray:
    """For each place and the one beyond the last, the first place after it with the flag."""
    n = len(flags)
    found = np.minimum.accumulate(np.where(flags, np.arange(n), n)[::-1])[::-1] if n else np.zeros(0, int)
    return np.append(found[1:], [n, n]) if n else np.array([0])


def _closing(net: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """For lines that leave a brace open, the line that closes the outermost one.

    With s the sum of effects, a line's mark is s less what it opens by itself.  The next
    line whose mark is not above it is the first one at which nothing is open but what that
    line has opened itself: if that is nothing it is the closing line, else the answer is
    that line's.
    """
    n = len(net)
    marks = (np.cumsum(net) - floor).tolist()
    opens, closing, stack = (floor > 0).tolist(), [n] * n, []
    for i in range(n - 1, -1, -1):
        while stack and marks[stack[-1]] > marks[i]:
            stack.pop()
        if stack and opens[i]:
            m = stack[-1]
            closing[i] = closing[m] if opens[m] else m
        stack.append(i)
    return np.array(closing)


class _Block:
    """A block's lines and those beyond it that its events can have: for each prefixed line,
    the events that begin there."""

    def __init__(self, columns: list[np.ndarray], end: int, cap: int):
        ordinal, prefixed, identity, looks, indented, file_frame, net, floor = columns
        n, self.ordinal, self.prefixed, self.end = len(ordinal), ordinal, prefixed.astype(bool), end
        near = np.append(False, np.diff(ordinal) == 1)
        # a prefixed line joins nothing unless it is of the last prefixed line's identity
        heads = np.flatnonzero(self.prefixed)
        kin = ~self.prefixed
        names = identity[heads]
        kin[heads[1:]] = [a is not None and a == b for a, b in zip(names[1:], names[:-1])]
        apart = ~near | ~kin
        by_itself = looks.astype(bool) | (indented.astype(bool) & np.append(False, file_frame[:-1].astype(bool)))
        opens = floor > 0
        stop, refused, opened = _next(apart)[:n], _next(apart | ~by_itself)[:n], _next(opens)[:n]
        places = np.arange(n)
        # the line of the event at which a brace is open first, if it gets that far
        first = np.where(opens, places, opened)
        reaches = opens | (opened < refused)
        closing = np.append(_closing(net, floor), n) if opens.any() else np.full(n + 1, n)
        stops = np.append(stop, n)
        inside = np.where(stops[first] <= closing[first], stops[first], np.minimum(closing[first] + 1, n))
        ends = np.where(reaches, inside, refused)
        self.cut = ends - places - 1 > cap
        self.ends = np.where(self.cut, places + cap + 1, ends)
        self.following = np.append(_next(self.prefixed)[:n], n)
        self.own = int(np.searchsorted(ordinal, end))

    def first_root(self, ordinal: int) -> int:
        """The place of the first prefixed line of at least this number."""
        at = int(np.searchsorted(self.ordinal, ordinal))
        return at if at < len(self.prefixed) and self.prefixed[at] else int(self.following[at - 1]) if at else self._first()

    def _first(self) -> int:
        found = np.flatnonzero(self.prefixed)
        return int(found[0]) if len(found) else len(self.prefixed)

    def next_root(self, root: int) -> int:
        return int(self.following[self.ends[root] - 1])

    def leaving(self, root: int) -> tuple[int, int, bool] | None:
        """How the next block is entered by the event of a root, if that is the last of the
        block's own."""
        if self.next_root(root) < self.own:
            return None
        after = int(self.ordinal[self.ends[root] - 1]) + 1
        if after < self.end or (after == self.end and not self.cut[root]):
            return 0, 0, False
        return after - self.end, int(self.ordinal[root]), bool(self.cut[root])

    def function(self, begin: int, cap: int) -> tuple[list[int], list[tuple]]:
        """For entries up to each of the first list's numbers, how the next block is entered."""
        roots = np.flatnonzero(self.prefixed[: self.own])
        leaves: dict[int, tuple] = {}
        for root in roots[::-1].tolist():
            leaves[root] = self.leaving(root) or leaves[self.next_root(root)]
        upto: list[int] = []
        found: list[tuple] = []
        for root in roots.tolist():
            place = int(self.ordinal[root]) - begin
            if found and found[-1] == leaves[root]:
                upto[-1] = place
            else:
                if upto and upto[-1] > cap + 1:
                    break
                upto.append(place)
                found.append(leaves[root])
        return upto, found

    def links(self, begin: int, entered: int, root: int, cut: bool) -> np.ndarray:
        """By line number: 4 times the distance to the event's first line, and 2 if the cap
        kept the line out of an event, and 1 if it begins one of several lines."""
        out = np.zeros(self.end - begin, np.int32)
        if entered or cut:
            out[:entered] = 4 * (begin + np.arange(entered) - root)
            if cut and entered < len(out):
                out[entered] = 2
        at = self.first_root(begin + entered)
        while at < self.own:
            end = int(self.ends[at])
            own = np.arange(at + 1, min(end, self.own))
            out[self.ordinal[own] - begin] = 4 * (self.ordinal[own] - self.ordinal[at])
            out[self.ordinal[at] - begin] |= end > at + 1
            if self.cut[at] and end < self.own:
                out[self.ordinal[end] - begin] |= 2
            at = self.next_root(at)
        return out


def events(columns: list[np.ndarray], cap: int) -> tuple[list, list, int | None]:
    """For lines in order (columns of ``MARKS``) that no event reaches into: the line that
    began the event of each line that is not its first, the event that the cap kept a line
    from, and the place of the last event's first line if it may go on behind the lines."""
    n = len(columns[0])
    lines, found, cut, last = _Block(columns, int(columns[0][-1]) + 1, cap), [None] * n, [None] * n, None
    at = lines.first_root(int(columns[0][0]))
    while at < n:
        end, root = int(lines.ends[at]), int(lines.ordinal[at])
        found[at + 1 : end] = [root] * (end - at - 1)
        if end == n:
            last = at
        elif lines.cut[at]:
            cut[end] = root
        at = lines.next_root(at)
    return found, cut, last


_NONE = (0, 0, False)


def _after(upto: list[int], leaves: list[tuple], entered: int) -> tuple:
    """What a block, or several, entered there hands on."""
    at = bisect_left(upto, entered)
    return leaves[at] if at < len(upto) else _NONE


def _summaries(size: int, cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (source, block), columns in _runs(batches, 2):
            begin = block * size + 1
            upto, leaves = _Block(columns, begin + size, cap).function(begin, cap)
            yield _rows([(source, block, upto, leaves)])

    return run


_LEAVES = pa.list_(pa.struct([("entered", pa.int32()), ("root", pa.int64()), ("cut", pa.bool_())]))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    source, block, upto, leaves = zip(*rows)
    named = [[{"entered": e, "root": r, "cut": c} for e, r, c in x] for x in leaves]
    return pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(block, pa.int64()), pa.array(upto, pa.list_(pa.int32())), pa.array(named, _LEAVES)], names=["source", "_block", "upto", "leaves"])


def _functions(batch: pa.RecordBatch) -> Iterator[tuple]:
    for *key, upto, leaves in zip(*(c.to_pylist() for c in batch.columns)):
        yield *key, upto, [(x["entered"], x["root"], x["cut"]) for x in leaves]


def _composed(size: int):
    """The function of each group, from those of its blocks in order: from the entry of its
    first number to that of the next group's.  A number without lines passes nothing on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, upto, leaves = None, None, [], []

        def group() -> pa.RecordBatch:
            whole = leaves if (last + 1) % size == 0 else [_NONE] * len(leaves)
            return _rows([(*at, upto, whole)])

        for batch in batches:
            for source, number, block, more, found in _functions(batch):
                if (source, number) != at:
                    if at is not None:
                        yield group()
                    at, last, upto, leaves = (source, number), block, more, found
                    if block % size:  # entered at its first line, whatever comes before the group
                        upto, leaves = [2**31 - 1], [_after(more, found, 0)]
                    continue
                if block != last + 1:
                    upto, leaves = [2**31 - 1], [_after(more, found, 0)]
                else:
                    # beyond the last number all is as after a block that hands on nothing
                    upto, leaves = [*upto, 2**31 - 1], [_after(more, found, x[0]) for x in [*leaves, _NONE]]
                    keep = [i for i in range(len(upto)) if i + 1 == len(upto) or leaves[i] != leaves[i + 1]]
                    upto, leaves = [upto[i] for i in keep], [leaves[i] for i in keep]
                last = block
        if at is not None:
            yield group()

    return run


def _entries(size: int):
    """Of functions in order by source and group, where each block is entered.  The first
    of a group is entered as the group is, which stands beside the functions, if there are
    any before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, entry = None, None, _NONE
        for batch in batches:
            out = []
            given = batch.column(batch.num_columns - 1).to_pylist()
            functions = batch.select(range(batch.num_columns - 1))
            for (source, number, block, upto, leaves), top in zip(_functions(functions), given):
                if (source, number) != at:
                    at, last, entry = (source, number), None, _NONE
                    if top is not None and block % size == 0:
                        entry = (top["entered"], top["root"], top["cut"])
                elif block != last + 1:
                    entry = _NONE
                out.append((source, block, *entry))
                last, entry = block, _after(upto, leaves, entry[0])
            columns = zip(*out) if out else ((),) * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["source", "_block", "entered", "root", "cut"])

    return run


def _entered(functions: DataFrame) -> DataFrame:
    """Rows source, _block, entered, root, cut, from the functions of blocks (``_SUMMARY``):
    groups of blocks are composed in tasks of their own, and only the groups of a source, a
    row each, are walked through by one task."""
    c = F.col
    blocks = functions.select("source", F.floor(c("_block") / GROUP).alias("_group"), "_block", "upto", "leaves")
    grouped = blocks.repartition("source", "_group").sortWithinPartitions("source", "_group", "_block")
    groups = grouped.mapInArrow(_composed(GROUP), _SUMMARY.replace("_block", "_group"))
    none = F.lit(None).cast(_ENTRY_TYPE)
    ordered = groups.repartition("source").sortWithinPartitions("source", "_group")
    tops = ordered.select("source", F.lit(0).cast("bigint").alias("_all"), "_group", "upto", "leaves", none.alias("_top")).mapInArrow(_entries(GROUP), f"source string, _block bigint, {_ENTRY}")
    tops = tops.select(c("source").alias("_of"), c("_block").alias("_in"), F.struct("entered", "root", "cut").alias("_top"))
    # dealt out after the join, which may be one that leaves rows where they are
    both = blocks.join(tops, c("source").eqNullSafe(c("_of")) & c("_group").eqNullSafe(c("_in"))).repartition("source", "_group").sortWithinPartitions("source", "_group", "_block")
    both = both.select("source", "_group", "_block", "upto", "leaves", "_top")
    return both.mapInArrow(_entries(GROUP), f"source string, _block bigint, {_ENTRY}")


def _resolved(size: int, cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (source, block), (entered, root, cut, *columns) in _runs(batches, 2):
            begin = block * size + 1
            links = _Block(columns, begin + size, cap).links(begin, int(entered[0]), int(root[0]), bool(cut[0]))
            if links.any():
                yield pa.RecordBatch.from_arrays([pa.array([source], pa.string()), pa.array([block], pa.int64()), pa.array([links], pa.list_(pa.int32()))], names=["source", "_block", "_links"])

    return run


def linked(lines: DataFrame, config: Config = Config()) -> DataFrame:
    """``lines`` (source, ordinal, the ``marks``, and any others, which stay) with
    continuation_of (the line that began the event of a line that is not its first),
    truncated_root (the event that the cap kept a line from) and chained (whether the
    line's event has several lines)."""
    cap, c = config.chain_cap, F.col
    size = max(BLOCK, cap + 2)
    block, place = F.floor((c("ordinal") - 1) / size), ((c("ordinal") - 1) % size).cast("int")
    key = lambda at: F.struct(c("source"), at.alias("block"))
    beyond = F.when(place <= cap + 1, F.array(block, block - 1)).otherwise(F.array(block))
    marks = lines.select(F.explode(F.transform(beyond, key)).alias("_key"), *MARKS).repartition("_key")
    order, columns = ("_key", "ordinal"), (c("_key.source"), c("_key.block").alias("_block"))
    functions = marks.sortWithinPartitions(*order).select(*columns, *MARKS).mapInArrow(_summaries(size, cap), _SUMMARY)
    entered = _entered(functions).select(key(c("_block")).alias("_at"), "entered", "root", "cut")
    placed = marks.join(entered, c("_key") == c("_at")).sortWithinPartitions(*order).select(*columns, "entered", "root", "cut", *MARKS)
    links = placed.mapInArrow(_resolved(size, cap), "source string, _block bigint, _links array<int>")
    # there is one row a block anyway; said so, the join goes where nobody asks for links
    links = links.groupBy(key(c("_block")).alias("_at")).agg(F.first("_links").alias("_links"))
    rows = lines.join(links.hint("shuffle_hash"), key(block) == c("_at"), "left")
    link = F.coalesce(F.get("_links", place), F.lit(0))
    far = F.shiftright(link, 2)
    return rows.select(
        *(n for n in lines.columns if n not in MARKS[1:]),
        F.when(far > 0, c("ordinal") - far).alias("continuation_of"),
        F.when(link.bitwiseAND(F.lit(2)) > 0, c("ordinal") - (cap + 1)).alias("truncated_root"),
        ((far > 0) | (link.bitwiseAND(F.lit(1)) > 0)).alias("chained"),
    )
