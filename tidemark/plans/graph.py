"""The job graph that a stream program leaves behind: for validation and reports, not for execution."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from enum import StrEnum

from tidemark.errors import GraphError


class Partition(StrEnum):
    FORWARD = "forward"
    REBALANCE = "rebalance"
    HASH = "hash"
    BROADCAST = "broadcast"


OPERATORS = ("source", "sink", "map", "flat_map", "filter", "key_by", "window", "reduce", "process", "count", "union", "connect", "co_process", "side_output", "async_io", "join")


@dataclass
class Vertex:
    id: str
    name: str
    operator: str
    parallelism: int = 1
    max_parallelism: int | None = None
    uid: str | None = None
    slot_sharing_group: str = "default"
    chaining: bool = True
    config: dict = field(default_factory=dict)
    connector: dict = field(default_factory=dict)
    parallelism_set: bool = False


@dataclass
class Edge:
    source: str
    target: str
    partition: Partition = Partition.FORWARD


@dataclass
class RestartStrategy:
    kind: str = "fixed_delay"
    max_attempts: int = 3
    delay_ms: int = 5000


@dataclass
class JobConfig:
    parallelism: int = 1
    max_parallelism: int = 128
    checkpoint_interval_ms: int = 60_000
    restart: RestartStrategy = field(default_factory=RestartStrategy)
    properties: dict[str, str] = field(default_factory=dict)

    def spark_conf(self) -> dict[str, str]:
        """What of it Spark has a setting for."""
        return {"spark.sql.shuffle.partitions": str(self.max_parallelism), **self.properties}


@dataclass
class JobGraph:
    name: str = "job"
    vertices: dict[str, Vertex] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)
    config: JobConfig = field(default_factory=JobConfig)

    def add(self, vertex: Vertex, *inputs: tuple[str, Partition]) -> Vertex:
        if vertex.operator not in OPERATORS:
            raise GraphError(f"unknown operator {vertex.operator!r}")
        if vertex.id in self.vertices:
            raise GraphError(f"vertex {vertex.id!r} occurs twice")
        self.vertices[vertex.id] = vertex
        self.edges += [Edge(source, vertex.id, Partition(partition)) for source, partition in inputs]
        return vertex

    def built(self) -> JobGraph:
        """A copy with uids in place of ids and the job's parallelism where an operator has none of its own."""
        names = {v.id: v.uid or v.id for v in self.vertices.values()}
        out = JobGraph(self.name, config=self.config)
        for v in self.vertices.values():
            p = self.config.parallelism if self.config.parallelism > 1 and not v.parallelism_set else v.parallelism
            out.add(Vertex(**asdict(v) | {"id": names[v.id], "parallelism": p}))
        out.edges = [Edge(names.get(e.source, e.source), names.get(e.target, e.target), e.partition) for e in self.edges]
        return out

    def validate(self) -> None:
        kinds = [v.operator for v in self.vertices.values()]
        if "source" not in kinds:
            raise GraphError("the graph has no source")
        if "sink" not in kinds:
            raise GraphError("the graph has no sink")
        for e in self.edges:
            for end in (e.source, e.target):
                if end not in self.vertices:
                    raise GraphError(f"edge {e.source} -> {e.target}: no vertex {end!r}")
        self.order()

    def inputs(self, vertex: str) -> list[Edge]:
        return [e for e in self.edges if e.target == vertex]

    def order(self) -> list[str]:
        """The vertices, each after its inputs."""
        waiting = {v: len(self.inputs(v)) for v in self.vertices}
        ready, out = [v for v, n in waiting.items() if n == 0], []
        while ready:
            out.append(v := ready.pop(0))
            for e in self.edges:
                if e.source == v:
                    waiting[e.target] -= 1
                    if waiting[e.target] == 0:
                        ready.append(e.target)
        if len(out) < len(self.vertices):
            raise GraphError("the graph has a cycle")
        return out

    def to_dict(self) -> dict:
        return asdict(self)
