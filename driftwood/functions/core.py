"""Keeping what is computed from being computed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns by name, added one group after the other: a later group uses those of earlier ones.
Stages = list[dict[str, Column]]


def added(df: DataFrame, stages: Stages) -> DataFrame:
    for stage in stages:
        df = df.withColumns(stage)
    return df


def settled(value: Column) -> Column:
    """For one column of a ``select``: ``value``, computed here and nowhere else.

    Filters above are not pushed through the generator that this makes, so what is asked
    of a parsed value does not parse it again, and the planner need not reason about it.
    """
    return F.explode_outer(F.array(value))


def parted(df: DataFrame, keys: list[str], parts: dict[str, Column]) -> DataFrame:
    """``keys`` and ``parts`` as columns, the parts settled."""
    whole = settled(F.struct(*(c.alias(n) for n, c in parts.items())))
    return df.select(*keys, whole.alias("_whole")).select(*keys, *(F.col("_whole")[n].alias(n) for n in parts))
