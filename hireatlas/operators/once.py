"""Expensive columns, worked out exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns whose expressions the optimizer does not copy.

    A filter or a later expression on a plain computed column makes the optimizer repeat the whole
    expression there. As the output of a generator the value is only referred to.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_fields(df: DataFrame, struct: Column) -> DataFrame:
    """Add the fields of a struct as columns; its expression is worked out exactly once per row."""
    return df.select("*", F.inline_outer(F.array(struct)))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an input over as many partitions as the session asks for; by default they stay as they were read.

    ``hireatlas.input.partitions`` is for files that cannot be split, such as test tables of one row group. Tables of many
    files or row groups need no such step.
    """
    partitions = df.sparkSession.conf.get("hireatlas.input.partitions", "")
    return df.repartition(int(partitions)) if partitions else df
