"""Lines with their events as they arrive.

A line's event depends on lines before it only, so each line is emitted in the batch that
brings it.  The state of a source is what links need of the lines of its last event, while
that may go on: at most as many lines as an event can have.  A batch is resolved behind them
by the same code as a block of a table, so any split into batches gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from driftwood.config import Config
from driftwood.functions.core import added, parted
from driftwood.operators import chains
from driftwood.operators.detect import is_blank
from driftwood.operators.plain import plain_stages

_KINDS = (pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32())
_MARKS = chains.MARKS
LINKED = "source string, ordinal bigint, timestamp timestamp, level string, message string, continuation_of bigint, truncated_root bigint"


class _Linking(StatefulProcessor):
    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.event = handle.getValueState("event", "lines binary")

    def _held(self) -> pd.DataFrame | None:
        if not self.event.exists():
            return None
        with pa.ipc.open_stream(self.event.get()[0]) as reader:
            return reader.read_pandas()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("ordinal", kind="stable")
        held = self._held()
        every = new[list(_MARKS)] if held is None else pd.concat([held, new[list(_MARKS)]])
        columns = [every[n].to_numpy() for n in _MARKS]
        columns[2] = np.array([None if x is None or x != x else x for x in columns[2]], object)
        found, cut, open_ = chains.events(columns, self.cap)
        n = len(new)
        out = new[["source", "ordinal", "timestamp", "level", "message"]].copy()
        out["continuation_of"] = pd.array(found[-n:], "Int64")
        out["truncated_root"] = pd.array(cut[-n:], "Int64")
        if open_ is None:
            self.event.clear()
        else:
            kept = every.iloc[open_:]
            table = pa.table([pa.array(list(kept[c]), k, from_pandas=True) for c, k in zip(_MARKS, _KINDS)], names=list(_MARKS))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            self.event.update((sink.getvalue().to_pybytes(),))
        yield out

    def close(self) -> None:
        pass


def linked_stream(lines: DataFrame, reference: datetime | None = None, config: Config = Config(), tz_offset_minutes: int = 0) -> DataFrame:
    """Plain lines of a stream (source, ordinal, text) as they come: source, ordinal,
    timestamp, level, message, continuation_of and truncated_root.  Blank lines give none.

    Ordinals of a source have to go up from batch to batch; within a batch lines may come in
    any order.  The session needs a state store that keeps values of any kind
    (``spark.sql.streaming.stateStore.providerClass``: RocksDB's).
    """
    real = lines.where(~is_blank(F.col("text"))).select("source", F.col("ordinal").cast("bigint").alias("ordinal"), "text")
    parts = {"timestamp": F.col("_p_instant"), "level": F.col("_p_level"), "message": F.coalesce("_p_message", F.lit(""))}
    parts |= chains.marks(F.col("text"), F.col("_p_message"), F.col("_p_shape").isNotNull(), F.col("_p_identity"), F.col("_p_rest_raw"))
    rows = parted(added(real, plain_stages("text", "_p_", tz_offset_minutes, reference, config)), ["source", "ordinal"], parts)
    return rows.groupBy("source").transformWithStateInPandas(_Linking(config.chain_cap), LINKED, outputMode="Append", timeMode="None")
