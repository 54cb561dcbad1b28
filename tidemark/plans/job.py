"""Declared jobs: a YAML, JSON or dict definition compiled to a stream."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import ConfigError, GraphError
from tidemark.functions.scalars import predicate
from tidemark.functions.udf import registered
from tidemark.operators.stream import DataStream, StreamEnvironment
from tidemark.operators.windows import Tumbling
from tidemark.plans.graph import Edge, JobConfig, JobGraph, Partition, RestartStrategy, Vertex
from tidemark.sources import builders, sinks

OPERATOR_NAMES = {"flatmap": "flat_map", "keyby": "key_by"}
CONNECTORS = ("socket", "kafka", "pulsar", "generator", "console", "file", "collection")


def load(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("YAML jobs need the yaml package; JSON ones don't") from e
    return yaml.safe_load(text)


def graph_of(job: dict) -> JobGraph:
    """The validated graph of a definition; what is unknown raises."""
    if "name" not in job:
        raise ConfigError("a job has a name")
    c = job.get("config") or {}
    parallelism = int(c.get("parallelism", 1))
    config = JobConfig(
        parallelism, int(c.get("max_parallelism") or parallelism * 4), int(c.get("checkpoint_interval_ms", 60_000)),
        RestartStrategy("fixed_delay", int(c.get("max_restarts", 3)), int(c.get("restart_delay_ms", 5000))),
    )
    graph = JobGraph(job["name"], config=config)
    for v in job.get("vertices", []):
        operator = OPERATOR_NAMES.get(v["operator"].lower(), v["operator"].lower())
        connector = v.get("connector") or {}
        if connector and connector.get("type") not in CONNECTORS:
            raise ConfigError(f"unknown connector {connector.get('type')!r}")
        graph.add(Vertex(v["id"], v.get("name", v["id"]), operator, int(v.get("parallelism", parallelism)), config=v.get("config") or {}, connector=connector, parallelism_set="parallelism" in v))
    for e in job.get("edges", []):
        try:
            graph.edges.append(Edge(e["from"], e["to"], Partition(e.get("partition", "forward"))))
        except ValueError as x:
            raise GraphError(f"unknown partition strategy {e.get('partition')!r}") from x
    graph.validate()
    return graph


def _source(spark: SparkSession, env: StreamEnvironment, v: Vertex, inputs: dict[str, DataFrame]) -> DataStream:
    if v.id in inputs:
        df = inputs[v.id]
        order = "arrival" if "arrival" in df.columns else None
        return env.from_dataframe(df, v.name, order=order)
    kind, p = v.connector.get("type"), v.connector.get("properties") or {}
    if kind == "socket":
        return env.add_source(builders.SocketSource(p.get("host", "0.0.0.0"), int(p["port"]), p.get("mode", "server")))
    if kind == "kafka":
        return env.add_source(builders.KafkaSource(p["brokers"], p["topic"], p.get("group_id")))
    if kind == "pulsar":
        return env.add_source(builders.PulsarSource(p.get("url", ""), p.get("topic", "")))
    if kind == "generator":
        rows = p.get("rows")
        return env.add_source(builders.Generator(int(p.get("rate_ms", 100)), int(rows) if rows else None), time="timestamp", order="arrival")
    if kind == "file":
        return env.from_dataframe(spark.read.format(p.get("format", "text")).load(p["path"]), v.name)
    raise ConfigError(f"source {v.id!r}: no connector {kind!r}")


def _apply(v: Vertex, ins: list[DataStream]) -> DataStream:
    s, c = ins[0], v.config
    if v.operator == "map":
        return s.map(c.get("function", "identity"))
    if v.operator == "flat_map":
        position = "_position" if s.order else None
        out = s.flat_map(c.get("function", "split_words"), position=position)
        if position:  # keep the arrival order total: position within the arrival
            order = (F.col(s.order).cast("long") * F.lit(1 << 24) + F.col("_position")).alias(s.order)
            out = out.select(*[x for x in out.df.columns if x not in (s.order, "_position")], order)
        return out
    if v.operator == "filter":
        return s.filter(c.get("predicate", "non_empty"), str(c.get("value", "")))
    if v.operator == "count":
        key = F.lower(F.col(s.value))
        keyed = s.key_by(key)
        if s.df.isStreaming or s.order is None:
            out = keyed.totals(F.count("*").alias("n"))
            return out.select(F.concat_ws(":", "key", "n").alias(s.value))
        out = keyed.count("n")
        return out.select(F.concat_ws(":", "key", "n").alias(s.value), s.order)
    if v.operator == "process":
        return s.process(c.get("function", v.name))
    if v.operator == "union":
        return s.union(*ins[1:])
    if v.operator == "key_by":
        return s.key_by(c.get("key", s.value)).into_stream()
    if v.operator == "window":
        if s.time is None:
            s = s.select("*", F.current_timestamp().alias("processing_time")).with_time("processing_time", "0 seconds")
        out = s.key_by(F.lit(0)).window(Tumbling(int(c.get("size_ms", 5000)))).count("n")
        return out.select(F.concat(F.lit("Window: "), F.col("n").cast("string"), F.lit(" elements")).alias(s.value))
    if v.operator == "reduce":
        return s.key_by(c.get("key", s.value)).reduce(c.get("function", "max"), c.get("on", s.value), to=s.value + "_reduced")
    if v.operator == "join":
        if len(ins) != 2:
            raise GraphError(f"{v.id!r} joins two inputs, not {len(ins)}")
        left, right = (x.key_by(F.lower(F.col(x.value)) if not c.get(k) else c[k]) for x, k in zip(ins, ("left_key", "right_key"), strict=True))
        joined = left.join(right)
        if c.get("size_ms"):
            joined = joined.window(int(c["size_ms"]))
        both = F.concat_ws(c.get("separator", " "), F.col(f"a.{ins[0].value}"), F.col(f"b.{ins[1].value}"))
        return joined.apply(both.alias(s.value))
    if v.operator == "connect":
        if len(ins) != 2:
            raise GraphError(f"{v.id!r} connects two inputs, not {len(ins)}")
        first, second = (x.map(c.get(k, "identity")) for x, k in zip(ins, ("first", "second"), strict=True))
        return first.connect(second).map([F.col(first.value).alias(s.value)], [F.col(second.value).alias(s.value)])
    if v.operator == "async_io":
        return s.async_io(registered(c["function"]), c.get("returns", "string"), bool(c.get("ordered", True)), int(c.get("timeout_ms", 5000)), int(c.get("capacity", 100)), to=s.value)
    if v.operator == "side_output":
        return s.side_output(side=predicate(c.get("predicate", "non_empty"), str(c.get("value", "")))(F.col(s.value)))[c.get("take", "side")]
    raise ConfigError(f"operator {v.operator!r} can't be declared")


def compile_job(spark: SparkSession, job: dict, inputs: dict[str, DataFrame] | None = None) -> dict[str, DataStream]:
    """The stream that reaches each sink. ``inputs`` stand in for sources by vertex id."""
    graph = graph_of(job)
    env = StreamEnvironment(spark, graph.name, graph.config)
    streams: dict[str, DataStream] = {}
    out: dict[str, DataStream] = {}
    for name in graph.order():
        v = graph.vertices[name]
        ins = []
        for e in graph.inputs(name):
            s = streams[e.source]
            ins.append(s.rebalance(v.parallelism) if e.partition is Partition.REBALANCE else s)
        if v.operator == "source":
            streams[name] = _source(spark, env, v, inputs or {})
        elif v.operator == "sink":
            out[name] = ins[0].union(*ins[1:]) if len(ins) > 1 else ins[0]
        else:
            streams[name] = _apply(v, ins)
    return out


def run_job(spark: SparkSession, job: dict, inputs: dict[str, DataFrame] | None = None) -> list[Any]:
    """Compile and start all sinks of a definition."""
    graph, started = graph_of(job), []
    for name, stream in compile_job(spark, job, inputs).items():
        c = graph.vertices[name].connector
        p = c.get("properties") or {}
        made = {
            "console": lambda: sinks.ConsoleSink(),
            "socket": lambda p=p: sinks.SocketSink(p.get("host", "0.0.0.0"), int(p["port"]), p.get("mode", "server")),
            "kafka": lambda p=p: sinks.KafkaSink(p["brokers"], p["topic"], checkpoint=p.get("checkpoint")),
            "pulsar": lambda p=p: sinks.PulsarSink(p.get("url", ""), p.get("topic", "")),
            "file": lambda p=p: sinks.FileSink(p["path"], p.get("format", "text"), p.get("checkpoint")),
        }
        started.append(stream.sink_to(made.get(c.get("type", "console"), made["console"])()))
    return started
