"""Ordered folds of a key's records, on a batch and on a stream by the same machine.

A machine takes records in order of their time, may wake at a time of its own, and gives rows. On a batch, records are dealt by key and sorted,
and a task goes through them one at a time, so it holds one machine, whatever the length of a key. On a stream, records wait until the
watermark has passed them; then they are taken in order, so late and shuffled input gives what a batch gives.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Later than any record.
NEVER = 1 << 62


class Machine(Protocol):
    def take(self, record: tuple) -> list[tuple]:
        """Rows that a record (at, ...) leads to; what is due before it comes first."""

    def advance(self, now: int) -> list[tuple]:
        """Rows that time alone leads to, up to and including now."""

    def due(self) -> int:
        """When time alone leads to something, or NEVER."""

    def end(self) -> list[tuple]:
        """Rows when nothing more comes."""


def _named(schema: str | StructType) -> list[str]:
    return (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).names


def batch(rows: DataFrame, keys: list[str], columns: list[str], new: Callable[[tuple], Machine], schema: str) -> DataFrame:
    """keys and the machine's rows (schema). columns: `at` first, whole milliseconds that aren't null, then what tells equal times apart.

    new makes a machine from a key. Records of one key and time go by the other columns, in their order, null first.
    """
    kinds, names = {f.name: f.dataType.simpleString() for f in rows.schema}, [*keys, *_named(schema)]
    n = len(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine, out = None, None, []
        for frame in frames:
            for row in _tuples(frame):
                if row[:n] != key:
                    if machine is not None:
                        out += [(*key, *x) for x in machine.end()]
                    key = row[:n]
                    machine = new(key)
                out += [(*key, *x) for x in machine.take(row[n:])]
            yield pd.DataFrame(out, columns=names)
            out = []
        if machine is not None:
            yield pd.DataFrame([(*key, *x) for x in machine.end()], columns=names)

    dealt = rows.select(*keys, *columns).repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, *columns)
    return dealt.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), schema]))


def stream(rows: DataFrame, keys: list[str], columns: list[str], new: Callable[[tuple], Machine], schema: str) -> DataFrame:
    """The same on a stream in append mode. rows must have a watermark on a timestamp of the same time as `at`; what is later than it is dropped.

    The state of a key is its machine and the records that the watermark hasn't passed.
    """
    kinds, n = {f.name: f.dataType.simpleString() for f in rows.schema}, len(keys)
    full = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), schema])
    names = _named(full)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine, held = pickle.loads(state.get[0]) if state.exists else (new(key), [])
        for frame in frames:
            held += [row[n:] for row in _tuples(frame[[*keys, *columns]])]
        mark = state.getCurrentWatermarkMs()
        held.sort(key=lambda r: [(x is not None, x) for x in r])
        ready = [r for r in held if r[0] <= mark]
        held, out = held[len(ready) :], []
        for row in ready:
            out += machine.take(row)
        out += machine.advance(mark)
        state.update((pickle.dumps((machine, held)),))
        wake = min(held[0][0] if held else NEVER, machine.due())
        if wake < NEVER:
            state.setTimeoutTimestamp(max(wake, mark + 1))
        yield pd.DataFrame([(*key, *x) for x in out], columns=names)

    return rows.groupBy(*keys).applyInPandasWithState(run, full, "machine binary", "append", GroupStateTimeout.EventTimeTimeout)


def _tuples(frame: pd.DataFrame) -> Iterator[tuple[Any, ...]]:
    """Rows as plain values; pandas' missing values are None."""
    for row in frame.itertuples(index=False, name=None):
        yield tuple(None if x is None or x != x else x for x in row)
