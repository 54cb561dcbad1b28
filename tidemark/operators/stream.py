"""The stream API: lazy pipelines over DataFrames, bounded or unbounded.

A stream holds a DataFrame, the names of its value, time and arrival-order columns, and its place in the job
graph. Functions are names of the registry, callables on Columns, or objects of the protocols in
``functions.udf``; the first two stay in the plan, the last run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType, _parse_datatype_string

from tidemark.errors import ConfigError
from tidemark.functions import scalars, udf
from tidemark.operators import folds, windows
from tidemark.operators.scan import Running, running
from tidemark.plans.chains import ChainReport, report
from tidemark.plans.graph import JobConfig, JobGraph, Partition, RestartStrategy, Vertex

BROADCAST_BYTES = 64 << 20


class StreamEnvironment:
    """Where streams begin; keeps the job graph."""

    def __init__(self, spark: SparkSession, name: str = "job", config: JobConfig | None = None):
        self.spark, self.graph, self._n = spark, JobGraph(name, config=config or JobConfig()), 0

    def set_parallelism(self, n: int) -> StreamEnvironment:
        self.graph.config.parallelism = n
        return self

    def set_max_parallelism(self, n: int) -> StreamEnvironment:
        self.graph.config.max_parallelism = n
        return self

    def enable_checkpointing(self, interval_ms: int) -> StreamEnvironment:
        self.graph.config.checkpoint_interval_ms = interval_ms
        return self

    def set_restart_strategy(self, strategy: RestartStrategy) -> StreamEnvironment:
        self.graph.config.restart = strategy
        return self

    def vertex(self, operator: str, name: str, *inputs: tuple[str, Partition], **more: Any) -> Vertex:
        self._n += 1
        return self.graph.add(Vertex(f"{operator}-{self._n}", name, operator, **more), *inputs)

    def from_dataframe(self, df: DataFrame, name: str = "source", value: str = "value", time: str | None = None, order: str | None = None, **connector: Any) -> DataStream:
        return DataStream(self, df, self.vertex("source", name, connector=connector).id, value, time, order)

    def from_collection(self, rows: list, schema: str | StructType, **names: Any) -> DataStream:
        """An in-memory source that keeps its items; ``arrival`` numbers them if no order is named."""
        kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
        if not isinstance(kind, StructType):
            kind, rows = StructType().add("value", kind), [(x,) for x in rows]
        if "order" not in names:
            kind = StructType([*kind.fields, *StructType().add("arrival", "long").fields])
            rows, names["order"] = [(*x, i) for i, x in enumerate(rows)], "arrival"
        return self.from_dataframe(self.spark.createDataFrame(rows, kind), "collection", **names)

    def parquet(self, path: str, streaming: bool = False, schema: StructType | None = None, glob: str | None = None, **names: Any) -> DataStream:
        """Parquet files, whole or as they arrive; a stream needs the schema told."""
        from tidemark.sources.builders import parquet

        return self.from_dataframe(parquet(self.spark, path, streaming, schema, glob), "parquet", connector="file", path=path, **names)

    def add_source(self, builder, **names: Any) -> DataStream:
        """A stream of any source builder (generator, socket, kafka, pulsar)."""
        return self.from_dataframe(builder.load(self.spark), type(builder).__name__, **names)

    def generator_source(self, rate_ms: int = 100, **names: Any) -> DataStream:
        from tidemark.sources.builders import Generator

        return self.add_source(Generator(rate_ms), **names)

    def socket_source(self, host: str, port: int, mode: str = "server", **names: Any) -> DataStream:
        from tidemark.sources.builders import SocketSource

        return self.add_source(SocketSource(host, port, mode), **names)

    def kafka_source(self, brokers: str, topic: str, group: str, **names: Any) -> DataStream:
        from tidemark.sources.builders import KafkaSource

        return self.add_source(KafkaSource(brokers, topic, group), **names)

    def execute_plan(self) -> JobGraph:
        """The validated graph, uids and parallelism filled in."""
        graph = self.graph.built()
        graph.validate()
        return graph

    def chain_report(self) -> ChainReport:
        return report(self.execute_plan())


@dataclass(frozen=True)
class DataStream:
    env: StreamEnvironment
    df: DataFrame
    vertex: str
    value: str = "value"
    time: str | None = None
    order: str | None = None
    partition: Partition = Partition.FORWARD

    def _next(self, operator: str, name: str, df: DataFrame, **more: Any) -> DataStream:
        changes = {k: more.pop(k) for k in ("value", "time", "order") if k in more}
        vertex = self.env.vertex(operator, name, (self.vertex, self.partition), **more)
        return replace(self, df=df, vertex=vertex.id, partition=Partition.FORWARD, **changes)

    # Stateless operators

    def map(self, f: str | Callable[[Column], Column] | udf.MapFunction, on: str | None = None, to: str | None = None, returns: str | DataType = "string") -> DataStream:
        on = on or self.value
        if isinstance(f, str):
            column = scalars.map_function(f)(F.col(on))
        elif isinstance(f, udf.MapFunction):
            column = udf.map_udf(f, returns)(F.col(on))
        else:
            column = f(F.col(on))
        return self._next("map", "map", self.df.withColumn(to or on, column), config={"function": str(f)})

    def select(self, *columns: Column | str) -> DataStream:
        return self._next("map", "select", self.df.select(*columns))

    def filter(self, f: str | Column | Callable[[Column], Column] | udf.FilterFunction = "non_empty", value: str = "", on: str | None = None) -> DataStream:
        on = on or self.value
        if isinstance(f, Column):
            keep = f
        elif isinstance(f, str):
            keep = scalars.predicate(f, value)(F.col(on))
        else:
            keep = udf.filter_udf(f)(F.col(on)) if isinstance(f, udf.FilterFunction) else f(F.col(on))
        return self._next("filter", "filter", self.df.where(keep), config={"predicate": str(f), "value": value})

    def flat_map(self, f: str | Callable[[Column], Column] | udf.FlatMapFunction = "split_words", on: str | None = None, to: str | None = None, position: str | None = None, returns: str = "string") -> DataStream:
        """One row per element of the array that ``f`` gives; ``position`` adds its index."""
        on = on or self.value
        if isinstance(f, str):
            array = scalars.flat_map_function(f)(F.col(on))
        elif isinstance(f, udf.FlatMapFunction):
            array = udf.flat_map_udf(f, _parse_datatype_string(returns))(F.col(on))
        else:
            array = f(F.col(on))
        kept = [c for c in self.df.columns if c != (to or on)]
        exploded = F.posexplode(array).alias(position, to or on) if position else F.explode(array).alias(to or on)
        return self._next("flat_map", "flat_map", self.df.select(*kept, exploded), config={"function": str(f)})

    def process(self, f: str | Callable, schema: str | None = None) -> DataStream:
        """A registered function by name, or a function on batches (mapInPandas) with its output schema."""
        if isinstance(f, str):
            thing = udf.registered(f)
            if hasattr(thing, "columns"):
                return self.flat_map(thing.columns)
            if hasattr(thing, "column"):
                return self.map(thing.column)
            if isinstance(thing, udf.FlatMapFunction):
                return self.flat_map(thing)
            if isinstance(thing, udf.MapFunction):
                return self.map(thing)
            f = thing
        return self._next("process", getattr(f, "__name__", "process"), self.df.mapInPandas(f, schema))

    process_plugin = process

    def async_io(self, f: udf.AsyncFunction, returns: str, ordered: bool = True, timeout_ms: int = 5000, capacity: int = 100, on: str | None = None, to: str = "result") -> DataStream:
        """Call ``f`` for each value, ``capacity`` at a time; late answers get ``f.timeout``."""
        from tidemark.operators.asyncio_ops import call

        df = call(self.df, f, on or self.value, to, returns, ordered, timeout_ms, capacity)
        return self._next("async_io", "async_io", df, config={"ordered": ordered, "timeout_ms": timeout_ms, "capacity": capacity})

    def async_io_ordered(self, f: udf.AsyncFunction, returns: str, **more: Any) -> DataStream:
        return self.async_io(f, returns, ordered=True, **more)

    def async_io_unordered(self, f: udf.AsyncFunction, returns: str, **more: Any) -> DataStream:
        return self.async_io(f, returns, ordered=False, **more)

    # Time, partitioning

    def with_time(self, time: str, lateness: str | None = None) -> DataStream:
        """Name the event-time column; on an unbounded stream set the watermark behind it."""
        df = self.df
        if df.isStreaming:
            df = df.withColumn(time, F.col(time).cast("timestamp"))
            df = df.withWatermark(time, lateness) if lateness else df
        return replace(self, df=df, time=time)

    def shuffle(self, n: int | None = None) -> DataStream:
        return self.rebalance(n)

    def rebalance(self, n: int | None = None) -> DataStream:
        n = n or self.env.graph.config.max_parallelism
        return replace(self, df=self.df if self.df.isStreaming else self.df.repartition(n), partition=Partition.REBALANCE)

    def forward(self) -> DataStream:
        return replace(self, partition=Partition.FORWARD)

    def global_(self) -> DataStream:
        """All in one instance; only for results known to be small."""
        return replace(self, df=self.df.coalesce(1), partition=Partition.REBALANCE)

    def broadcast(self, most_bytes: int = BROADCAST_BYTES) -> DataStream:
        """Ask for a broadcast to all instances, if the optimizer's estimate is within ``most_bytes``."""
        size = int(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        df = F.broadcast(self.df) if not self.df.isStreaming and size <= most_bytes else self.df
        return replace(self, df=df, partition=Partition.BROADCAST)

    def key_by(self, *keys: str | Column | Callable[[Column], Column] | udf.KeySelector) -> KeyedStream:
        df, names = self.df, []
        for i, k in enumerate(keys):
            if isinstance(k, str):
                names.append(k)
            else:
                names.append(f"key{i or ''}")
                df = df.withColumn(names[-1], (k if isinstance(k, udf.KeySelector) else udf.KeySelector(k)).column(self.value))
        vertex = self.env.vertex("key_by", "key_by", (self.vertex, Partition.HASH))
        return KeyedStream(replace(self, df=df, vertex=vertex.id, partition=Partition.FORWARD), tuple(names))

    # Several streams

    def union(self, *others: DataStream) -> DataStream:
        """All rows of streams of one type; nothing is made distinct."""
        df = self.df
        for o in others:
            df = df.unionByName(o.df)
        vertex = self.env.vertex("union", "union", (self.vertex, self.partition), *[(o.vertex, o.partition) for o in others])
        return replace(self, df=df, vertex=vertex.id, partition=Partition.FORWARD)

    def connect(self, other: DataStream) -> ConnectedStreams:
        return ConnectedStreams(self, other)

    def side_output(self, **tags: Column) -> dict[str, DataStream]:
        """A stream per tag with the rows for which its condition holds, and the others as ``main``."""
        out = {tag: self._next("side_output", tag, self.df.where(F.coalesce(cond, F.lit(False)))) for tag, cond in tags.items()}
        rest = F.lit(True)
        for cond in tags.values():
            rest = rest & ~F.coalesce(cond, F.lit(False))
        return out | {"main": self._next("side_output", "main", self.df.where(rest))}

    def late(self, every: int, lateness_ms: int, ranges: int | None = None) -> tuple[DataStream, DataStream]:
        """(on time, late) by the watermark that the source would have emitted every ``every`` rows."""
        marked = windows.late_marks(self.df, self._need("time"), self._need("order"), every, lateness_ms, ranges)
        return self._next("filter", "on_time", marked.where(~F.col("late"))), self._next("side_output", "late", marked.where(F.col("late")))

    def count(self, to: str = "count", ranges: int | None = None) -> DataStream:
        """The number of rows so far, in arrival order."""
        return self._next("count", "count", running(self.df, [], self._need("order"), [Running(to, "count")], ranges))

    def _need(self, what: str) -> str:
        name = getattr(self, what)
        if name is None:
            raise ConfigError(f"the stream has no {what} column")
        return name

    # Settings and sinks

    def _set(self, **values: Any) -> DataStream:
        for k, v in values.items():
            setattr(self.env.graph.vertices[self.vertex], k, v)
        return self

    def uid(self, uid: str) -> DataStream:
        return self._set(uid=uid)

    def name(self, name: str) -> DataStream:
        return self._set(name=name)

    def set_parallelism(self, n: int) -> DataStream:
        return self._set(parallelism=n, parallelism_set=True)

    def set_max_parallelism(self, n: int) -> DataStream:
        return self._set(max_parallelism=n)

    def slot_sharing_group(self, group: str) -> DataStream:
        return self._set(slot_sharing_group=group)

    def disable_chaining(self) -> DataStream:
        return self._set(chaining=False)

    start_new_chain = disable_chaining

    def sink_to(self, builder, name: str = "sink"):
        """Write with a sink builder; a streaming query, or what a bounded write returns."""
        self.env.vertex("sink", name, (self.vertex, self.partition), connector={"type": type(builder).__name__})
        return builder.write(self.df, self.env)

    def print(self, prefix: str = "[SINK] "):
        from tidemark.sources.sinks import ConsoleSink

        return self.sink_to(ConsoleSink(prefix, self.value), "print")

    def kafka_sink(self, brokers: str, topic: str):
        from tidemark.sources.sinks import KafkaSink

        return self.sink_to(KafkaSink(brokers, topic))

    def socket_sink(self, host: str, port: int, mode: str = "server"):
        from tidemark.sources.sinks import SocketSink

        return self.sink_to(SocketSink(host, port, mode, self.value))


@dataclass(frozen=True)
class KeyedStream:
    stream: DataStream
    keys: tuple[str, ...]

    @property
    def df(self) -> DataFrame:
        return self.stream.df

    def into_stream(self) -> DataStream:
        return self.stream

    def _running(self, operator: str, aggregates: list[Running], ranges: int) -> DataStream:
        s = self.stream
        return s._next(operator, operator, running(s.df, list(self.keys), s._need("order"), aggregates, ranges))

    def sum(self, value: str, to: str = "sum", ranges: int | None = None) -> DataStream:
        """The running sum after each row; likewise the following."""
        return self._running("reduce", [Running(to, "sum", value)], ranges)

    def min(self, value: str, to: str = "min", ranges: int | None = None) -> DataStream:
        return self._running("reduce", [Running(to, "min", value)], ranges)

    def max(self, value: str, to: str = "max", ranges: int | None = None) -> DataStream:
        return self._running("reduce", [Running(to, "max", value)], ranges)

    def min_by(self, by: str, value: str, to: str = "min_by", ranges: int | None = None) -> DataStream:
        """``value`` of the row with the least ``by`` so far, the earliest of equals."""
        return self._running("reduce", [Running(to, "min_by", value, by)], ranges)

    def max_by(self, by: str, value: str, to: str = "max_by", ranges: int | None = None) -> DataStream:
        return self._running("reduce", [Running(to, "max_by", value, by)], ranges)

    def count(self, to: str = "count", ranges: int | None = None) -> DataStream:
        return self._running("count", [Running(to, "count")], ranges)

    def reduce(self, f: str | udf.ReduceFunction | Callable[[Any, Any], Any], value: str, to: str = "reduced", returns: str = "double") -> DataStream:
        """A running reduction: ``sum``, ``min`` or ``max`` by name, or a Python function, which takes the rows of a
        key one by one in arrival order."""
        if isinstance(f, str):
            return self._running("reduce", [Running(to, f, value)], None)
        from tidemark.streaming.stateful import reduce_groups

        s = self.stream
        return s._next("reduce", "reduce", reduce_groups(s.df, list(self.keys), s._need("order"), f, value, to, returns))

    def totals(self, *aggs: Column) -> DataStream:
        """One row per key; on an unbounded stream, the updated rows of each batch."""
        return self.stream._next("reduce", "totals", self.df.groupBy(*self.keys).agg(*aggs))

    def process(self, processor, schema: str | None = None, mode: str = "Append", time_mode: str = "None") -> DataStream:
        """A stateful processor (streaming.stateful) per key, or the name of a registered one."""
        from tidemark.streaming.stateful import run

        processor = udf.registered(processor) if isinstance(processor, str) else processor
        return self.stream._next("process", type(processor).__name__, run(self.df, list(self.keys), processor, schema, mode, time_mode))

    process_fn = process_rich = process_plugin_rich = process

    def process_with_sides(self, processor, sides: dict[str, str], schema: str | None = None, mode: str = "Append", time_mode: str = "None") -> dict[str, DataStream]:
        """A stateful processor with side outputs (schema by tag): a stream of each, and ``main``. It runs once: bounded
        results are written to the shared folder; of an unbounded stream, write the one that ``tagged`` holds and split that."""
        from tidemark.shared import written
        from tidemark.streaming.stateful import run

        processor = udf.registered(processor) if isinstance(processor, str) else processor
        df = run(self.df, list(self.keys), processor, schema, mode, time_mode, sides)
        df = df if df.isStreaming else written(df, "sides")
        one = lambda tag: self.stream._next("side_output", tag, df.where(F.col("tag") == tag).select(f"{tag}.*"), time=None, order=None)
        out = {tag: one(tag) for tag in ("main", *sides)}
        return out | {"tagged": self.stream._next("process", "tagged", df, time=None, order=None)} if df.isStreaming else out

    def window(self, spec: windows.Spec) -> WindowedStream:
        windows.check(spec)
        return WindowedStream(self, spec)

    def tumbling_window(self, size_ms: int) -> WindowedStream:
        return self.window(windows.Tumbling(size_ms))

    def sliding_window(self, size_ms: int, slide_ms: int) -> WindowedStream:
        return self.window(windows.Sliding(size_ms, slide_ms))

    def session_window(self, gap_ms: int) -> WindowedStream:
        return self.window(windows.Session(gap_ms))

    def global_window(self) -> WindowedStream:
        return self.window(windows.Global())

    def count_window(self, count: int, partial: bool = False) -> WindowedStream:
        return self.window(windows.Count(count, partial))

    def join(self, other: KeyedStream) -> JoinedStreams:
        return JoinedStreams(self, other)


@dataclass(frozen=True)
class WindowedStream:
    keyed: KeyedStream
    spec: windows.Spec

    def aggregate(self, *aggs: Column, ranges: int | None = None) -> DataStream:
        s = self.keyed.stream
        time = s._need("time") if isinstance(self.spec, windows.Tumbling | windows.Sliding | windows.Session) else s.time
        order = s._need("order") if isinstance(self.spec, windows.Count) else s.order
        df = windows.aggregate(s.df, list(self.keyed.keys), time, self.spec, list(aggs), order, ranges)
        return s._next("window", type(self.spec).__name__, df, config={"window": str(self.spec)}, time=None, order=None)

    def sum(self, value: str, to: str = "sum") -> DataStream:
        return self.aggregate(F.sum(value).alias(to))

    def count(self, to: str = "count") -> DataStream:
        return self.aggregate(F.count("*").alias(to))

    def _assigned(self, ranges: int | None = None):
        s = self.keyed.stream
        time = s._need("time") if isinstance(self.spec, windows.Tumbling | windows.Sliding | windows.Session) else s.time
        order = s._need("order") if isinstance(self.spec, windows.Count) else s.order
        return windows.assigned(s.df, list(self.keyed.keys), time, self.spec, order, ranges)

    def _folded(self, df: DataFrame) -> DataStream:
        return self.keyed.stream._next("window", type(self.spec).__name__, df, config={"window": str(self.spec)}, time=None, order=None)

    def reduce(self, f: str | udf.ReduceFunction | Callable[[Any, Any], Any], value: str, to: str = "reduced", returns: str = "double") -> DataStream:
        """``f``: sum, min or max, or an associative Python function of two values."""
        if isinstance(f, str):
            if f not in ("sum", "min", "max"):
                raise ConfigError(f"unknown window reduction {f!r}; give a function of your own")
            return self.aggregate(getattr(F, f)(value).alias(to))
        return self.aggregate_with(folds.Reduction(f), value, returns, to)

    def aggregate_with(self, f: udf.AggregateFunction, value: str, returns: str, to: str = "result") -> DataStream:
        """A user's aggregate: accumulators of each task, merged per window, so ``merge`` has to be right."""
        rows, groups = self._assigned()
        return self._folded(folds.aggregate(rows, groups, f, value, to, returns))

    def process(self, f: Callable[[dict, Any], Any], schema: str) -> DataStream:
        """A user's function over a window's contents: it takes the window's columns and an iterator over its rows, in
        order of arrival (of time, without one), and gives tuples of ``schema``. The rows stream by; none are gathered."""
        rows, groups = self._assigned()
        s = self.keyed.stream
        return self._folded(folds.process(rows, groups, f, schema, s.order or s.time))

    def top(self, n: int, by: Column, *columns: str) -> DataStream:
        """The ``n`` first rows of each window by ``by``; the optimizer keeps no more of a group before the shuffle."""
        rows = windows._assigned(self.keyed.df, self.keyed.stream._need("time"), self.spec)
        groups = ["window_start", "window_end", *self.keyed.keys]
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy(by, *columns))
        out = rows.withColumn("rank", rank).where(F.col("rank") <= n).select(*groups, "rank", *columns)
        return self.keyed.stream._next("window", "top", out, time=None, order=None)


@dataclass(frozen=True)
class ConnectedStreams:
    """Two streams of different types, mapped to a common one or processed with shared state."""

    first: DataStream
    second: DataStream

    def key_by(self, first: str, second: str) -> ConnectedStreams:
        """Give both the column ``key``."""
        return ConnectedStreams(replace(self.first, df=self.first.df.withColumn("key", F.col(first))), replace(self.second, df=self.second.df.withColumn("key", F.col(second))))

    def _vertex(self, operator: str) -> str:
        a, b = self.first, self.second
        return a.env.vertex(operator, operator, (a.vertex, a.partition), (b.vertex, b.partition)).id

    def map(self, first: list[Column], second: list[Column]) -> DataStream:
        """Rows of both, each projected to the common type."""
        df = self.first.df.select(*first).unionByName(self.second.df.select(*second))
        return replace(self.first, df=df, vertex=self._vertex("connect"), partition=Partition.FORWARD, time=None, order=None)

    def tagged(self) -> DataFrame:
        """One DataFrame with ``side`` 1 or 2; columns that only one has are null in the other."""
        return self.first.df.withColumn("side", F.lit(1)).unionByName(self.second.df.withColumn("side", F.lit(2)), allowMissingColumns=True)

    def process(self, processor, schema: str, key: str = "key", time_mode: str = "None") -> DataStream:
        """A stateful processor per key that sees rows of both sides."""
        from tidemark.streaming.stateful import run

        return replace(self.first, df=run(self.tagged(), [key], processor, schema, "Append", time_mode), vertex=self._vertex("co_process"), partition=Partition.FORWARD)


@dataclass(frozen=True)
class JoinedStreams:
    """An inner equi-join on the keys, within one tumbling window if a size is given, or within a bound of time."""

    first: KeyedStream
    second: KeyedStream
    size_ms: int | None = None
    within_ms: tuple[int, int] | None = None

    def window(self, size_ms: int) -> JoinedStreams:
        windows.check(windows.Tumbling(size_ms))
        return replace(self, size_ms=size_ms)

    def within(self, before_ms: int, after_ms: int) -> JoinedStreams:
        """Rows of the second side from ``before_ms`` before to ``after_ms`` after the time of the first side's; with
        watermarks on both sides the state of an unbounded join is bounded by it."""
        return replace(self, within_ms=(before_ms, after_ms))

    def apply(self, *columns: Column) -> DataStream:
        """``columns`` of each matching pair; the sides are ``a`` and ``b``."""
        a, b = self.first.stream, self.second.stream
        if len(self.first.keys) != len(self.second.keys):
            raise ConfigError("both sides need as many keys")
        left, right = a.df.alias("a"), b.df.alias("b")
        match = F.lit(True)
        for x, y in zip(self.first.keys, self.second.keys, strict=True):
            match = match & (F.col(f"a.{x}") == F.col(f"b.{y}"))
        if self.size_ms:
            spec = windows.Tumbling(self.size_ms)
            left = a.df.withColumn("window", windows.time_window(a._need("time"), spec)).alias("a")
            right = b.df.withColumn("window", windows.time_window(b._need("time"), spec)).alias("b")
            match = match & (F.col("a.window") == F.col("b.window"))
        if self.within_ms:
            at, other = F.col(f"a.{a._need('time')}"), F.col(f"b.{b._need('time')}")
            before, after = (F.expr(f"interval {ms} milliseconds") for ms in self.within_ms)
            match = match & (other >= at - before) & (other <= at + after)
        df = left.join(right, match).select(*columns)
        vertex = a.env.vertex("join", "join", (a.vertex, Partition.HASH), (b.vertex, Partition.HASH))
        return replace(a, df=df, vertex=vertex.id, partition=Partition.FORWARD, time=None, order=None)
