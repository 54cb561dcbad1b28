"""A user's Python functions over windows and groups, without gathering a group.

An aggregate is folded within each task and its accumulators are merged, so a hot group sends one row per task. A function
over a group's rows sees them one by one, in order, as they stream by; one group is one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType, _parse_datatype_string

HELD_GROUPS = 100_000


class Reduction:
    """A function of two values as an aggregate: it has to be associative."""

    def __init__(self, f):
        self.f = f.reduce if hasattr(f, "reduce") else f

    def create(self) -> None:
        return None

    def add(self, acc: tuple | None, value: Any) -> tuple:
        return (value,) if acc is None else (self.f(acc[0], value),)

    def merge(self, a: tuple | None, b: tuple | None) -> tuple | None:
        return b if a is None else a if b is None else (self.f(a[0], b[0]),)

    def result(self, acc: tuple | None) -> Any:
        return None if acc is None else acc[0]


def _known(key: tuple) -> tuple:
    """The key with NaNs that equal each other."""
    return tuple("NaN" if x != x else x for x in key)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of equal keys in rows that are sorted by them."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, run in groupby(rows, lambda r: _known(tuple(r[n] for n in names))):
        first = next(run)
        yield tuple(first[n] for n in names), (r for part in ((first,), run) for r in part)


def aggregate(rows: DataFrame, groups: list[str], f, value: str, to: str, returns: str) -> DataFrame:
    """One row per group: its columns and ``f``'s result over ``value``, in no certain order of the values."""
    fields = [rows.schema[g] for g in groups]
    partial = StructType([*fields, StructField("acc", BinaryType())])
    final = StructType([*fields, StructField(to, _parse_datatype_string(returns))])
    partial_arrow, final_arrow = to_arrow_schema(partial), to_arrow_schema(final)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[tuple, Any]] = {}

        def out() -> pa.RecordBatch:
            done = _batch([(*key, pickle.dumps(acc)) for key, acc in held.values()], partial_arrow)
            held.clear()
            return done

        for batch in batches:
            for *key, x in zip(*(batch.column(c).to_pylist() for c in (*groups, value)), strict=True):
                known = _known(tuple(key))
                first, acc = held[known] if known in held else (tuple(key), f.create())
                held[known] = (first, f.add(acc, x))
            if len(held) > HELD_GROUPS:
                yield out()
        yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for key, run in _groups(batches, groups):
            acc = pickle.loads(next(run)["acc"])
            for r in run:
                acc = f.merge(acc, pickle.loads(r["acc"]))
            done.append((*key, f.result(acc)))
            if len(done) >= 10_000:
                yield _batch(done, final_arrow)
                done = []
        yield _batch(done, final_arrow)

    parts = rows.select(*groups, value).mapInArrow(fold, partial)
    parts = parts.repartition(*groups).sortWithinPartitions(*groups) if groups else parts.coalesce(1)
    return parts.mapInArrow(merge, final)


def process(rows: DataFrame, groups: list[str], f: Callable[[dict, Iterator[dict]], Iterator[tuple]], schema: str, order: str | None) -> DataFrame:
    """The group's columns and what ``f`` gives for it; ``f`` takes the group's columns and an iterator of its rows."""
    kind = _parse_datatype_string(schema)
    final = StructType([*[rows.schema[g] for g in groups], *kind.fields])
    arrow = to_arrow_schema(final)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for key, run in _groups(batches, groups):
            for values in f(dict(zip(groups, key, strict=True)), run):
                done.append((*key, *values))
                if len(done) >= 10_000:
                    yield _batch(done, arrow)
                    done = []
        yield _batch(done, arrow)

    by = [F.col(order).asc_nulls_first()] if order else []
    return rows.repartition(*groups).sortWithinPartitions(*groups, *by).mapInArrow(each, final)
