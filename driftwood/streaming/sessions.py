"""What a reader of live messages has received: lines once, and how many it has missed.

Messages are the envelopes of ``sources.sinks``: a snapshot begins each connection, lines
and gaps follow, ``ended`` closes the stream.  Numbers of lines go up by one for the life of
a producer.  A snapshot repeats lines that came before a reconnect; what it skips is missed.
One whose last number is below what was seen is of a producer that began anew: its lines are
of a new epoch and all of them count.  A gap message and the jump in numbers behind it tell
of the same lines, so a gap moves the number from which jumps are told.

The state of a source is three numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MESSAGE = "type string, lines array<struct<seq:bigint,text:string>>, lastSeq bigint, seq bigint, text string, count bigint"
#: Stands for a number that a message lacks.
_NO = -1
RECEIVED = "source string, at bigint, kind string, epoch int, seq bigint, text string, missing bigint, total bigint"


class Received:
    """Where a reader of one source is, and the rows that messages give it."""

    def __init__(self, last: int | None = None, epoch: int = 0, total: int = 0):
        self.last, self.epoch, self.total = last, epoch, total

    def _missed(self, n: int):
        if n > 0:
            self.total += n
            yield ("gap", None, None, n)

    def _line(self, seq: int, text: str | None):
        if self.last is not None:
            yield from self._missed(seq - self.last - 1)
        self.last = seq
        yield ("line", seq, text, 0)

    def take(self, kind, lines, last_seq, seq, text, count):
        """Rows (kind, seq, text, missing) of one message; none of unknown kinds and of
        messages that lack their numbers."""
        if kind == "line" and seq is not None:
            yield from self._line(seq, text)
        elif kind == "gap" and count and count > 0:
            yield from self._missed(count)
            self.last = None if self.last is None else self.last + count
        elif kind == "ended":
            yield ("ended", None, None, 0)
        elif kind == "snapshot" and last_seq is not None:
            if self.last is not None and last_seq < self.last:
                self.last, self.epoch = None, self.epoch + 1
            known = self.last
            for n, said in lines:
                if known is None or n > known:
                    yield from self._line(n, said)
            if known is not None and self.last is not None:
                yield from self._missed(last_seq - self.last)
            self.last = last_seq if self.last is None else max(self.last, last_seq)


class _Receiving(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "last bigint, epoch int, total bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reader = Received(*(self.place.get() if self.place.exists() else ()))
        new = pd.concat(list(rows)).sort_values("at", kind="stable")
        out = []
        for at, kind, lines, text, *numbers in new[["at", "type", "lines", "text", "lastSeq", "seq", "count"]].itertuples(index=False):
            last_seq, seq, count = (None if n == _NO else int(n) for n in numbers)
            said = [(int(x["seq"]), x["text"]) for x in lines]
            for what, n, line, missing in reader.take(kind, said, last_seq, seq, text, count):
                out.append((key[0], at, what, reader.epoch, n, line, missing, reader.total))
        self.place.update((reader.last, reader.epoch, reader.total))
        found = pd.DataFrame(out, columns=[c.split()[0] for c in RECEIVED.split(", ")])
        yield found.astype({"at": "int64", "epoch": "int32", "seq": "Int64", "missing": "int64", "total": "int64"})

    def close(self) -> None:
        pass


def received(messages: DataFrame) -> DataFrame:
    """Rows of ``RECEIVED`` for a stream of messages (source, at, message): each line once,
    each gap where it is noticed, with ``total``, the lines of the source missed so far.

    ``at`` orders the messages of a source and goes up from batch to batch; ``message`` is
    an envelope's JSON text.  Text that is no envelope gives no rows.  The session needs a
    state store that keeps values of any kind (RocksDB's).
    """
    rows = messages.select("source", F.col("at").cast("bigint").alias("at"), F.from_json("message", MESSAGE).alias("m")).where("m.type IS NOT NULL")
    numbers = (F.coalesce(F.col(f"m.{n}"), F.lit(_NO)).alias(n) for n in ("lastSeq", "seq", "count"))
    lines = F.coalesce(F.filter("m.lines", lambda x: x["seq"].isNotNull()), F.array().cast("array<struct<seq:bigint,text:string>>"))
    rows = rows.select("source", "at", "m.type", lines.alias("lines"), "m.text", *numbers)
    return rows.groupBy("source").transformWithStateInPandas(_Receiving(), RECEIVED, outputMode="Append", timeMode="None")
