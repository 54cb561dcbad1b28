"""Keyed processors on Spark's arbitrary stateful operator.

A ``Processor`` sees the rows of one key at a time with value, list, map and reducing state and timers; state
lives in the RocksDB store of the query's checkpoint, is read once and written once per key and micro-batch. A
micro-batch's rows of a key are put in order before they are processed, however the files hold them: sorted runs of
them go to a temporary file of the worker and are merged. What a key gives leaves the worker in packed blocks, as PySpark
holds all that a key gives in a micro-batch. On a bounded stream the same processor is run per key over the rows in order,
with state in memory; a key's rows are then streamed, not gathered, but one key is one task. Rows come as Python values:
nulls are None, integers stay integers, a null key is a key, and so is NaN.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StringType, StructField, StructType, _parse_datatype_string

from tidemark.errors import ConfigError, StateError

RUN_ROWS, RUN_BYTES = 1 << 16, 16 << 20  # a run that is sorted in memory: rows, or text and binary in them
SLICE_ROWS = 256  # read at once of each run
BLOCK_ROWS = 1 << 12  # of a key's output in a block


class Value:
    """One value per key."""

    def __init__(self, state):
        self.state = state

    def get(self) -> Any:
        row = self.state.get()
        return None if row is None else row[0]

    def set(self, value: Any) -> None:
        self.state.update((value,))

    update = set

    def clear(self) -> None:
        self.state.clear()


class ListOf:
    def __init__(self, state):
        self.state = state

    def get(self) -> list:
        return [row[0] for row in self.state.get()]

    def add(self, value: Any) -> None:
        self.state.appendValue((value,))

    def add_all(self, values: list) -> None:
        self.state.appendList([(v,) for v in values])

    def update(self, values: list) -> None:
        self.state.put([(v,) for v in values])

    def is_empty(self) -> bool:
        return not self.state.exists()

    def clear(self) -> None:
        self.state.clear()


class MapOf:
    def __init__(self, state):
        self.state = state

    def get(self, key: Any) -> Any:
        return self.state.getValue((key,))[0] if self.contains(key) else None

    def put(self, key: Any, value: Any) -> None:
        self.state.updateValue((key,), (value,))

    def remove(self, key: Any) -> Any:
        old = self.get(key)
        self.state.removeKey((key,))
        return old

    def contains(self, key: Any) -> bool:
        return self.state.containsKey((key,))

    def keys(self) -> list:
        return [k[0] for k in self.state.keys()]

    def values(self) -> list:
        return [v[0] for v in self.state.values()]

    def entries(self) -> list[tuple]:
        return [(k[0], v[0]) for k, v in self.state.iterator()]

    def is_empty(self) -> bool:
        return not self.state.exists()

    def clear(self) -> None:
        self.state.clear()


class Reducing:
    """A value to which others are added by a function of two."""

    def __init__(self, value: Value, f: Callable[[Any, Any], Any]):
        self.value, self.f = value, f

    def get(self) -> Any:
        return self.value.get()

    def add(self, x: Any) -> Any:
        old = self.value.get()
        self.value.set(x if old is None else self.f(old, x))
        return self.value.get()

    def clear(self) -> None:
        self.value.clear()


class _MemoryState:
    """What the handle of Spark gives, in memory, for bounded streams and tests; a key must be set."""

    def __init__(self, store: dict, owner: MemoryHandle, kind: str):
        self.store, self.owner, self.kind = store, owner, kind

    def _key(self):
        if self.owner.key is None:
            raise StateError("no current key")
        return self.owner.key

    def exists(self) -> bool:
        return self._key() in self.store and bool(self.store[self._key()])

    def get(self):
        return iter(self.store.get(self._key(), [])) if self.kind == "list" else self.store.get(self._key())

    def update(self, row: tuple) -> None:
        self.store[self._key()] = row

    def put(self, rows: list) -> None:
        self.store[self._key()] = list(rows)

    def appendValue(self, row: tuple) -> None:
        self.store.setdefault(self._key(), []).append(row)

    def appendList(self, rows: list) -> None:
        self.store.setdefault(self._key(), []).extend(rows)

    def clear(self) -> None:
        self.store.pop(self._key(), None)

    def getValue(self, key: tuple):
        return self.store.get(self._key(), {}).get(key)

    def containsKey(self, key: tuple) -> bool:
        return key in self.store.get(self._key(), {})

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.store.setdefault(self._key(), {})[key] = value

    def removeKey(self, key: tuple) -> None:
        self.store.get(self._key(), {}).pop(key, None)

    def iterator(self):
        return iter(list(self.store.get(self._key(), {}).items()))

    def keys(self):
        return iter(list(self.store.get(self._key(), {})))

    def values(self):
        return iter(list(self.store.get(self._key(), {}).values()))


class MemoryHandle:
    """State and timers in memory, with snapshot and restore."""

    def __init__(self):
        self.key: Any = None
        self.stores: dict[str, tuple[str, dict]] = {}
        self.timers: set[tuple[int, Any]] = set()

    def _state(self, name: str, kind: str) -> _MemoryState:
        return _MemoryState(self.stores.setdefault(name, (kind, {}))[1], self, kind)

    def getValueState(self, name: str, schema: str, ttl: int | None = None) -> _MemoryState:
        return self._state(name, "value")

    def getListState(self, name: str, schema: str, ttl: int | None = None) -> _MemoryState:
        return self._state(name, "list")

    def getMapState(self, name: str, keys: str, values: str, ttl: int | None = None) -> _MemoryState:
        return self._state(name, "map")

    def registerTimer(self, at: int) -> None:
        self.timers.add((at, self.key))

    def deleteTimer(self, at: int) -> None:
        self.timers.discard((at, self.key))

    def listTimers(self) -> Iterator[int]:
        return iter(sorted(t for t, k in self.timers if k == self.key))

    def snapshot(self) -> dict:
        import copy

        return {"stores": copy.deepcopy(self.stores), "timers": set(self.timers)}

    def restore(self, snapshot: dict) -> None:
        for name, (kind, store) in snapshot["stores"].items():
            held = self.stores.setdefault(name, (kind, {}))[1]
            held.clear()
            held.update(store)
        self.timers = set(snapshot["timers"])


class _HeldValue:
    """A value state that asks the store once per key and micro-batch, and writes back at the end."""

    def __init__(self, state):
        self.state = state
        self.forget()

    def forget(self) -> None:
        self.known = self.dirty = False
        self.row = None

    def get(self):
        if not self.known:
            self.row, self.known = self.state.get(), True
        return self.row

    def exists(self) -> bool:
        return self.get() is not None

    def update(self, row: tuple) -> None:
        self.row, self.known, self.dirty = row, True, True

    def clear(self) -> None:
        self.update(None)

    def flush(self) -> None:
        if self.dirty:
            self.state.clear() if self.row is None else self.state.update(self.row)
        self.dirty = False


class _HeldMap:
    """Likewise for the entries of a map state; what looks at the whole map writes back first."""

    def __init__(self, state):
        self.state = state
        self.forget()

    def forget(self) -> None:
        self.held: dict[tuple, tuple | None] = {}
        self.dirty: set[tuple] = set()

    def getValue(self, key: tuple):
        if key not in self.held:
            self.held[key] = self.state.getValue(key) if self.state.containsKey(key) else None
        return self.held[key]

    def containsKey(self, key: tuple) -> bool:
        return self.getValue(key) is not None

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.held[key] = value
        self.dirty.add(key)

    def removeKey(self, key: tuple) -> None:
        self.held[key] = None
        self.dirty.add(key)

    def flush(self) -> None:
        for key in self.dirty:
            value = self.held[key]
            if value is not None:
                self.state.updateValue(key, value)
            elif self.state.containsKey(key):
                self.state.removeKey(key)
        self.dirty.clear()

    def clear(self) -> None:
        self.forget()
        self.state.clear()

    def _whole(self, what: str):
        self.flush()
        return getattr(self.state, what)()

    def exists(self) -> bool:
        return self._whole("exists")

    def iterator(self):
        return self._whole("iterator")

    def keys(self):
        return self._whole("keys")

    def values(self):
        return self._whole("values")


class _HeldList:
    """Likewise for a list state; what is only added to is never read, and written back in parts."""

    PART = 1 << 12

    def __init__(self, state):
        self.state = state
        self.forget()

    def forget(self) -> None:
        self.rows: list[tuple] | None = None  # all of them, once read or put
        self.added: list[tuple] = []  # not yet written
        self.replaced = False

    def get(self):
        if self.rows is None:
            self.rows = [*self.state.get(), *self.added]
        return iter(self.rows)

    def exists(self) -> bool:
        return bool(self.rows or self.added) if self.rows is not None or self.added else self.state.exists()

    def put(self, rows: list) -> None:
        self.rows, self.added, self.replaced = list(rows), [], True

    def appendList(self, rows: list) -> None:
        if self.rows is not None:
            self.rows.extend(rows)
        if not self.replaced:
            self.added.extend(rows)
            if self.rows is None and len(self.added) >= self.PART:
                self.flush()

    def appendValue(self, row: tuple) -> None:
        self.appendList([row])

    def clear(self) -> None:
        self.put([])

    def flush(self) -> None:
        if self.replaced:
            self.state.put(self.rows) if self.rows else self.state.clear()
        elif self.added:
            self.state.appendList(self.added)
        self.added, self.replaced = [], False


class Context:
    """What a processor may use: state by name, timers, side outputs, the watermark and the processing time."""

    def __init__(self, handle, key: tuple = (), watermark_ms: int = -1, now_ms: int = -1):
        self.handle, self.key, self.watermark_ms, self.now_ms = handle, key, watermark_ms, now_ms
        self.held: list[_HeldValue | _HeldList | _HeldMap] = []
        self.sides: list[tuple[str, tuple]] = []

    def _hold(self, state, how: type):
        if isinstance(self.handle, MemoryHandle):
            return state
        self.held.append(how(state))
        return self.held[-1]

    def value(self, name: str, kind: str) -> Value:
        return Value(self._hold(self.handle.getValueState(name, f"v {kind}"), _HeldValue))

    def list(self, name: str, kind: str) -> ListOf:
        return ListOf(self._hold(self.handle.getListState(name, f"v {kind}"), _HeldList))

    def map(self, name: str, key: str, value: str) -> MapOf:
        return MapOf(self._hold(self.handle.getMapState(name, f"k {key}", f"v {value}"), _HeldMap))

    def reducing(self, name: str, kind: str, f: Callable[[Any, Any], Any]) -> Reducing:
        return Reducing(self.value(name, kind), f)

    def register_timer(self, at_ms: int) -> None:
        self.handle.registerTimer(at_ms)

    def delete_timer(self, at_ms: int) -> None:
        self.handle.deleteTimer(at_ms)

    def side_output(self, tag: str, *values: Any) -> None:
        """Give a row to the side output ``tag``, beside what ``process`` or ``on_timer`` yields."""
        self.sides.append((tag, values))


class Processor:
    """Override ``open`` to declare state, ``process`` for rows, ``on_timer`` for timers; each gives output tuples.

    ``order`` names the column by which the rows of a micro-batch are sorted before they are processed, nulls first.
    ``schema`` (DDL) names what it gives, where the caller doesn't.
    """

    order: str | None = None
    schema: str | None = None

    def open(self, context: Context) -> None:
        """Called once with a context for declaring state."""

    def process(self, key: tuple, row: dict, context: Context) -> Iterator[tuple]:
        raise NotImplementedError

    def on_timer(self, key: tuple, at_ms: int, context: Context) -> Iterator[tuple]:
        return iter(())

    def close(self) -> None:
        """Called at the end."""


class _Output:
    """Makes the output rows. With side outputs a row has its tag (``main`` or the side's) and a struct for each."""

    def __init__(self, kind: StructType, sides: dict[str, StructType]):
        if "main" in sides:
            raise ConfigError("a side output can't be named main")
        self.kind, self.sides = kind, sides
        self.schema = kind if not sides else StructType([StructField("tag", StringType()), StructField("main", kind), *[StructField(t, k) for t, k in sides.items()]])
        self.tags = ["main", *sides]

    def tagged(self, tag: str, values: tuple) -> tuple:
        if tag not in self.tags:
            raise ConfigError(f"unknown side output {tag!r}")
        kind = self.sides.get(tag, self.kind)
        return (tag, *[Row(*kind.names)(*values) if t == tag else None for t in self.tags])

    def rows(self, given: Iterator[tuple], context: Context) -> Iterator[tuple]:
        for values in given or ():
            yield self.tagged("main", values) if self.sides else tuple(values)
            yield from self.drained(context)
        yield from self.drained(context)

    def drained(self, context: Context) -> Iterator[tuple]:
        for tag, values in context.sides:
            yield self.tagged(tag, values)
        context.sides.clear()


class _Adapter(StatefulProcessor):
    """Gives blocks of packed rows, which ``_unpacked`` reads."""

    def __init__(self, processor: Processor, output: _Output):
        self.processor, self.output = processor, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        opened = Context(handle)
        self.processor.open(opened)
        self.held = opened.held

    def _run(self, key: tuple, timer_values, work: Callable[[Context], Iterator[tuple]]) -> Iterator[Row]:
        context = Context(self.handle, key, _time(timer_values.getCurrentWatermarkInMs), _time(timer_values.getCurrentProcessingTimeInMs))
        for state in self.held:
            state.forget()
        given = work(context)
        while rows := list(islice(given, BLOCK_ROWS)):
            yield Row(block=_packed(rows))
        for state in self.held:
            state.flush()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        def work(context: Context) -> Iterator[tuple]:
            for row in in_order(rows, self.processor.order):
                yield from self.output.rows(self.processor.process(tuple(key), row, context), context)

        return self._run(tuple(key), timerValues, work)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        return self._run(tuple(key), timerValues, lambda context: self.output.rows(self.processor.on_timer(tuple(key), at, context), context))

    def close(self) -> None:
        self.processor.close()


def _packed(rows: list[tuple]) -> bytes:
    data = pickle.dumps(rows, pickle.HIGHEST_PROTOCOL)
    return zlib.compress(data, 1 if len(data) > 1000 else 0)


def _unpacked(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for block in batch.column(0):
                rows += pickle.loads(zlib.decompress(block.as_py()))
                if len(rows) >= BLOCK_ROWS:
                    yield _batch(rows, schema)
                    rows = []
        yield _batch(rows, schema)

    return each


def in_order(rows: Iterable[Row], order: str | None) -> Iterator[dict]:
    """All rows, as dicts, by ``order``, nulls first, equal ones as they came. No more than a run of them is held, and
    a slice of each run before it; the runs lie in a temporary file."""
    rows = iter(rows)
    if order is None:
        yield from (r.asDict() for r in rows)
        return
    first = next(rows, None)
    if first is None:
        return
    names = first.__fields__
    at = names.index(order)
    rank = lambda r: (False,) if r[at] is None else (True, r[at])
    run, size, starts, file = [tuple(first)], _size(first), [], None
    try:
        for row in rows:
            if len(run) >= RUN_ROWS or size >= RUN_BYTES:
                file = file or tempfile.TemporaryFile(prefix="tidemark-")
                starts.append(_spill(file, sorted(run, key=rank)))
                run, size = [], 0
            run.append(tuple(row))
            size += _size(row)
        run.sort(key=rank)
        for row in heapq.merge(*(_spilled(file, slices) for slices in starts), run, key=rank) if starts else run:
            yield dict(zip(names, row, strict=True))
    finally:
        if file:
            file.close()


def _size(row: tuple) -> int:
    return sum(len(x) for x in row if isinstance(x, (str, bytes, bytearray, list, dict)))


def _spill(file, run: list[tuple]) -> list[int]:
    """Write a run at the end of ``file``; where its slices begin."""
    slices, some, size = [], [], 0
    for i, row in enumerate(run, 1):
        some.append(row)
        size += _size(row)
        if len(some) >= SLICE_ROWS or size >= RUN_BYTES >> 8 or i == len(run):
            slices.append(file.seek(0, 2))
            pickle.dump(some, file, pickle.HIGHEST_PROTOCOL)
            some, size = [], 0
    return slices


def _spilled(file, slices: list[int]) -> Iterator[tuple]:
    for start in slices:
        file.seek(start)
        yield from pickle.load(file)


def _time(get: Callable[[], int]) -> int:
    try:
        return get()
    except Exception:  # a mode without this clock
        return -1


def _same(a: tuple | None, b: tuple) -> bool:
    return a is not None and all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    plain = lambda x: Row(x=x).asDict(True)["x"] if isinstance(x, (Row, list, dict)) else x
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array([plain(x) for x in c], t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def run(df: DataFrame, keys: list[str], processor: Processor, schema: str | None = None, mode: str = "Append", time_mode: str = "None", sides: dict[str, str] | None = None) -> DataFrame:
    """Rows given by ``processor`` for each key of ``df``; ``schema`` (DDL) names them.

    With ``sides`` (schema by tag) the rows are (tag, main, a column per side). Bounded: rows per key in
    ``processor.order``; the input is one micro-batch, so all timers fire at its end, in order of time.
    """
    if not (schema or processor.schema):
        raise ConfigError("a processor needs the schema of what it gives")
    output = _Output(_parse_datatype_string(schema or processor.schema), {t: _parse_datatype_string(k) for t, k in (sides or {}).items()})
    arrow = to_arrow_schema(output.schema)
    if df.isStreaming:
        blocks = df.groupBy(*keys).transformWithState(statefulProcessor=_Adapter(processor, output), outputStructType=StructType([StructField("block", BinaryType())]), outputMode=mode, timeMode=time_mode)
        return blocks.mapInArrow(_unpacked(arrow), output.schema)

    # One pass over rows sorted by key and order: no key's rows are held together.
    order = [F.col(processor.order).asc_nulls_first()] if processor.order else []
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle, current, context = MemoryHandle(), None, None

        def finish() -> list[tuple]:
            out: list[tuple] = []
            while handle.timers:
                at, key = min(handle.timers, key=lambda x: x[0])
                handle.timers.discard((at, key))
                out += output.rows(processor.on_timer(current, at, context), context)
            for _, store in handle.stores.values():
                store.clear()
            return out

        processor.open(Context(handle))
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if not _same(current, key):
                    if current is not None:
                        out += finish()
                    handle.key = current = key
                    context = Context(handle, key)
                out += output.rows(processor.process(current, row, context), context)
            yield _batch(out, arrow)
        if current is not None:
            yield _batch(finish(), arrow)
        processor.close()

    return sorted_rows.mapInArrow(each, output.schema)


class RunningCount(Processor):
    """The count of a key after each of its rows; with ``form``, text such as ``{key}:{n}``."""

    def __init__(self, order: str | None = None):
        self.order = order

    def open(self, context: Context) -> None:
        self.count = context.value("count", "bigint")

    def process(self, key: tuple, row: dict, context: Context) -> Iterator[tuple]:
        n = (self.count.get() or 0) + 1
        self.count.set(n)
        yield (*key, n)


def reduce_groups(df: DataFrame, keys: list[str], order: str, f, value: str, to: str, returns: str) -> DataFrame:
    """``df`` with the running reduction by a Python function: one state per key, rows sorted, none gathered."""
    function = f.reduce if hasattr(f, "reduce") else f
    schema = StructType([*(x for x in df.schema.fields if x.name != to), StructField(to, _parse_datatype_string(returns))])
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, acc = None, None
        for batch in batches:
            out = []
            for *key, x in zip(*(batch.column(k).to_pylist() for k in keys), batch.column(value).to_pylist(), strict=True):
                acc = function(acc, x) if _same(current, tuple(key)) else x
                current = tuple(key)
                out.append(acc)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in schema.names[:-1]), pa.array(out, arrow.field(to).type)], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, F.col(order).asc_nulls_first()).mapInArrow(each, schema)
