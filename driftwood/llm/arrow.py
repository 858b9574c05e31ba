"""Small helpers around ``mapInArrow`` shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftwood.llm.worker import kept, released


def kept_fields(df: DataFrame, new: T.StructType, keep: list[str] | None) -> list[T.StructField]:
    """The input fields an operator hands on: those of ``keep`` (all if None), except
    that an output column replaces an input column of the same name, whatever its case."""
    taken = {f.name.lower() for f in new}
    wanted = None if keep is None else {k.lower() for k in keep}
    return [f for f in df.schema if f.name.lower() not in taken and (wanted is None or f.name.lower() in wanted)]


def add_columns(
    df: DataFrame,
    new: T.StructType,
    make: Callable[[pa.RecordBatch], list[pa.Array]],
    keep: list[str] | None = None,
    rows: int = 512,
    owner: str = "",
) -> DataFrame:
    """``df`` with the columns of ``new``, computed by ``make`` on slices of at most
    ``rows`` rows inside the tasks.  No shuffle; memory is bounded by one slice.  What the
    workers have kept for operators other than ``owner`` is dropped."""
    fields = kept_fields(df, new, keep)
    names = [f.name for f in fields]
    schema = T.StructType(fields + list(new))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(owner)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = make(part)
                cols = [part.column(part.schema.get_field_index(n)) for n in names] + made
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, arrow)], schema=arrow)
        released()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch, null as the empty string."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]
