"""A live view that is kept up to date by changes: what a predicate shows of the lines that
are retained.

A line may show lines before it: when a member of an event is hit, its root and the members
up to it are shown once, and members after it as they come.  A line that is evicted leaves
the view; members whose root is evicted are lines by themselves from then on, shown if they
pass and are hit themselves.  Each batch gives the net changes it makes, so the sum of all
changes is the view, for any split into batches, and nothing is asked of the lines again.

The state of a source is bounded: a few numbers a line for the last ``keep`` lines, in
chunks that are written once and read again when they are evicted, beside the lines of the
last event, which may still be shown by one to come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from driftwood.config import Config

CHANGES = "source string, ordinal bigint, change int, reason string"
#: Lines to a chunk of the state.
CHUNK = 4_096
_LINE = np.dtype([("ordinal", "<i8"), ("root", "<i8"), ("passes", "?"), ("hit", "?"), ("shown", "?")])
_NO_ROOT = -1


def _rows(packed) -> np.ndarray:
    return np.frombuffer(bytes(packed), _LINE)


def settled(lines: np.ndarray, low: int) -> np.ndarray:
    """Which of ``lines``, whole events in order, are shown where ``low`` is the first
    number that is retained."""
    held = (lines["root"] != _NO_ROOT) & (lines["root"] >= low)
    event = np.where(held, lines["root"], lines["ordinal"])
    _, first, back = np.unique(event, return_index=True, return_inverse=True)
    hit = np.zeros(len(first), bool)
    np.logical_or.at(hit, back, lines["hit"])
    # the first line of an event is its root, or a line by itself
    return lines["passes"][first][back] & hit[back]


class _View(StatefulProcessor):
    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "chunk bigint", "lines binary")
        self.open = handle.getValueState("open", "lines binary")
        self.ends = handle.getValueState("ends", "first bigint, next bigint, n bigint, low bigint")

    def _front(self, first: int, end: int, excess: int, low: int) -> tuple[np.ndarray, int]:
        """The chunks that an eviction of ``excess`` lines changes, and the first one after
        them: those that lose lines, and those with members of a root that goes."""
        parts, n, at = [np.empty(0, _LINE)], 0, first
        while at < end and excess:
            if n > excess:
                every = np.concatenate(parts)
                if not _NO_ROOT < every["root"][-1] < every["ordinal"][excess]:
                    break
            parts.append(_rows(self.chunks.getValue((at,))[0]))
            n, at = n + len(parts[-1]), at + 1
        return np.concatenate(parts), at

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).sort_values("ordinal", kind="stable")
        new = np.zeros(len(came), _LINE)
        new["ordinal"], new["root"] = came["ordinal"], came["continuation_of"].fillna(_NO_ROOT)
        new["passes"], new["hit"] = came["passes"], came["hit"]
        first, end, n, low = self.ends.get() if self.ends.exists() else (0, 0, 0, int(new["ordinal"][0]))
        held = _rows(self.open.get()[0]) if self.open.exists() else new[:0]
        excess = max(0, n + len(new) - self.keep)
        front, at = self._front(first, end, excess, low)
        lines = np.concatenate([held, new])
        body = np.concatenate([front, lines])
        was = body["shown"].copy()
        body["shown"][len(front) :] = settled(lines, low)
        kept = body[excess:]
        low = int(kept["ordinal"][0]) if excess else low
        orphans = (kept["root"] != _NO_ROOT) & (kept["root"] < low)
        kept["shown"][orphans] = (kept["passes"] & kept["hit"])[orphans]

        # the last event stays open, all before it goes to chunks
        rest, lines = kept[: max(0, len(front) - excess)], kept[max(0, len(front) - excess) :]
        last = lines[-1]
        root = last["root"] if last["root"] >= low else last["ordinal"]
        begin = int(np.searchsorted(lines["ordinal"], root))
        for gone in range(first, at):
            self.chunks.removeKey((gone,))
        if len(rest):
            at -= 1
            self.chunks.updateValue((at,), (rest.tobytes(),))
        for i in range(0, begin, CHUNK):
            self.chunks.updateValue((end,), (lines[i : min(begin, i + CHUNK)].tobytes(),))
            end += 1
        self.open.update((lines[begin:].tobytes(),))
        self.ends.update((at, end, n + len(new) - excess, low))

        gone, came_in = body[:excess][was[:excess]], kept["shown"] & ~was[excess:]
        hidden = kept[~kept["shown"] & was[excess:]]
        ordinals = np.concatenate([gone["ordinal"], hidden["ordinal"], kept["ordinal"][came_in]])
        change = np.repeat([-1, -1, 1], [len(gone), len(hidden), int(came_in.sum())])
        reason = np.repeat(np.array(["evicted", "orphaned", "shown"], object), [len(gone), len(hidden), int(came_in.sum())])
        yield pd.DataFrame({"source": key[0], "ordinal": ordinals, "change": change.astype("int32"), "reason": reason})

    def close(self) -> None:
        pass


def live_view(lines: DataFrame, passes: Column, hit: Column, keep: int = Config().retention) -> DataFrame:
    """The changes (source, ordinal, change: 1 or -1, reason) of a view over a stream of
    ``lines`` (source, ordinal, continuation_of and what the tests look at, as
    ``linked_stream`` gives them).

    ``passes`` is asked of roots, ``hit`` of all lines; null is no.  An event is shown if
    its root passes and any of its lines is hit.  The last ``keep`` lines of each source are
    retained, at least one.  Numbers of a source have to go up from batch to batch, and the
    lines of an event follow each other.  A null source is a source.  The session needs a
    state store that keeps values of any kind (RocksDB's).
    """
    no = F.lit(False)
    rows = lines.select("source", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("continuation_of").cast("bigint").alias("continuation_of"), F.coalesce(passes, no).alias("passes"), F.coalesce(hit, no).alias("hit"))
    return rows.groupBy("source").transformWithStateInPandas(_View(max(1, keep)), CHANGES, outputMode="Append", timeMode="None")


def shown(changes: DataFrame) -> DataFrame:
    """The view (source, ordinal) that all ``changes`` so far make."""
    return changes.groupBy("source", "ordinal").agg(F.sum("change").alias("_n")).where("_n > 0").select("source", "ordinal")
