"""Keyed state of the streams: what a key has seen, kept in the state store and touched only by rows of that key.

The work of a batch depends on its own rows, never on how many came before. Rows are brought together inside each Arrow batch before they are
dealt out by key, so a key with a third of all rows sends a few rows per task to its place.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Tasks get this code with the function, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def columns_of(df: DataFrame, *more: str) -> str:
    """The columns of a frame as DDL, with further ones."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def in_batches(df: DataFrame, work: Callable) -> DataFrame:
    """Bring rows together inside each Arrow batch; `work` turns a pandas frame into one of the same columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        for batch in batches:
            if batch.num_rows:
                kept = work(batch.to_pandas(types_mapper=pd.ArrowDtype))  # whole numbers stay whole beside nulls
                yield pa.RecordBatch.from_pandas(kept, schema=batch.schema, preserve_index=False)

    return df.mapInArrow(run, df.schema)


def first_rows(keys: list[str], order: str) -> Callable:
    """Of rows that share the keys (null is a value of its own) the first by `order`, nulls first."""
    return lambda frame: frame.sort_values(order, kind="stable", na_position="first").drop_duplicates(keys)


def summed(keys: list[str], total: str, order: list[str]) -> Callable:
    """Totals per key, with the other columns of the first row by `order`."""

    def work(frame):
        first = frame.sort_values(order, kind="stable", na_position="first").drop_duplicates(keys)
        totals = frame.groupby(keys, dropna=False, as_index=False)[total].sum()
        return first.drop(columns=total).merge(totals, on=keys)[list(frame.columns)]

    return work


def _rank(*values) -> tuple:
    """Sorts nulls first, as Spark does."""
    return tuple((v is not None, v) if v is not None else (False, 0) for v in values)


class SeenKey(StatefulProcessor):
    """Passes on the rows of a key that `pick` chooses, each with whether an earlier batch had the key.

    A null key is never known. `ttl_ms` forgets a key that long after it was last met.
    """

    def __init__(self, pick: Callable[[Iterator[Row]], list[Row]], columns: list[str], flag: str, ttl_ms: int | None = None):
        self.pick, self.columns, self.flag, self.ttl_ms = pick, columns, flag, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "met boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = key[0] is not None and self.seen.exists()
        chosen = self.pick(rows)
        if key[0] is not None:
            self.seen.update((True,))
        for row in chosen:
            yield Row(**{c: row[c] for c in self.columns}, **{self.flag: known})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def first_of(order: str, key: str | None = None) -> Callable[[Iterator[Row]], list[Row]]:
    """The first row by `order`; with a key, of each of its values. One row per value is held."""

    def pick(rows: Iterator[Row]) -> list[Row]:
        best: dict = {}
        for row in rows:
            value = row[key] if key else None
            if value not in best or _rank(row[order]) < _rank(best[value][order]):
                best[value] = row
        return list(best.values())

    return pick


class Counters(StatefulProcessor):
    """Adds counter rows to those of their domain and passes on all counters of the domain.

    A domain has one counter per kind and name of a fixed vocabulary. A late row only adds to it, and is the first one if its number says so.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getMapState("counters", "kind string, name string", "n long, seq long, url string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {tuple(k): tuple(v) for k, v in self.counters.iterator()}
        changed = set()
        for row in rows:
            at, new = (row["kind"], row["name"]), (row["n"], row["seq"], row["url"])
            old = held.get(at)
            if old is not None:
                first = min(old[1:], new[1:], key=lambda x: _rank(*x))
                new = (old[0] + new[0], *first)
            held[at] = new
            changed.add(at)
        for at in changed:
            self.counters.updateValue(at, held[at])
        for (kind, name), (n, seq, url) in held.items():
            yield Row(domain=key[0], kind=kind, name=name, n=n, first=Row(seq=seq, url=url))

    def close(self) -> None:
        pass
