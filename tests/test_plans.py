import json
from collections import Counter

import pytest

from tidemark.__main__ import main
from tidemark.errors import ConfigError, ConnectorUnavailable, GraphError
from tidemark.operators.stream import StreamEnvironment
from tidemark.plans.chains import report
from tidemark.plans.graph import Edge, JobGraph, Partition, Vertex
from tidemark.plans.job import compile_job, graph_of
from tidemark.plans.partitioner import Partitioner
from tidemark.sources import builders, sinks


def graph(*vertices, partitions=()):
    g = JobGraph()
    for i, (name, p) in enumerate(vertices):
        edges = [(vertices[i - 1][0], partitions[i - 1] if partitions else Partition.FORWARD)] if i else []
        g.add(Vertex(name, name, name, p), *edges)
    return g


def test_chains():
    r = report(graph(("source", 1), ("map", 1), ("filter", 1), ("sink", 1)))
    assert (len(r.chains), r.tasks_before, r.tasks_after, r.reduction) == (1, 4, 1, 75.0)
    r = report(graph(("source", 1), ("map", 2), ("sink", 2), partitions=(Partition.REBALANCE, Partition.FORWARD)))
    assert r.chains == [["source"], ["map", "sink"]] and r.slots == 2
    assert report(graph(("source", 1), ("map", 2), ("sink", 2), partitions=(Partition.REBALANCE, Partition.FORWARD)), slot_sharing=False).slots == 3


def test_fan_out_breaks_a_chain():
    g = graph(("source", 1), ("map", 1), ("sink", 1))
    g.add(Vertex("filter", "filter", "filter"), ("map", Partition.FORWARD))
    assert len(report(g).chains) == 3


def test_validation():
    for g in (graph(("map", 1), ("sink", 1)), graph(("source", 1), ("map", 1))):
        with pytest.raises(GraphError):
            g.validate()
    g = graph(("source", 1), ("sink", 1))
    g.edges.append(Edge("source", "nowhere"))
    with pytest.raises(GraphError):
        g.validate()
    g = graph(("source", 1), ("map", 1), ("filter", 1), ("sink", 1))
    g.edges.append(Edge("filter", "map"))
    with pytest.raises(GraphError, match="cycle"):
        g.validate()


def test_environment_builds_the_graph(spark):
    env = StreamEnvironment(spark).set_parallelism(4)
    s = env.from_collection(["a b", "c"], "string").uid("in").flat_map("split_words").set_parallelism(2)
    s.print()
    g = env.execute_plan()
    assert [(v.id, v.parallelism) for v in g.vertices.values()] == [("in", 4), ("flat_map-2", 2), ("sink-3", 4)]
    assert len(env.chain_report().chains) == 3


def test_partitioner():
    assert Partitioner(Partition.BROADCAST, 4).select() == [0, 1, 2, 3]
    p = Partitioner(Partition.HASH, 8)
    assert p.select(b"key") == p.select(b"key") and p.select() == [0]
    p = Partitioner(Partition.REBALANCE, 3)
    assert [p.select() for _ in range(4)] == [[0], [1], [2], [0]]
    assert Partitioner(Partition.FORWARD, 3).select(b"x") == [0]


JOB = {
    "name": "count",
    "config": {"parallelism": 2},
    "vertices": [
        {"id": "source", "operator": "source", "connector": {"type": "generator", "properties": {"rows": "14"}}},
        {"id": "count", "operator": "count"},
        {"id": "sink", "operator": "sink", "connector": {"type": "console"}},
    ],
    "edges": [{"from": "source", "to": "count", "partition": "rebalance"}, {"from": "count", "to": "sink"}],
}


def test_declared_job(spark):
    g = graph_of(JOB)
    assert (g.config.max_parallelism, g.config.checkpoint_interval_ms, g.config.restart.max_attempts) == (8, 60_000, 3)
    rows = {r.value for r in compile_job(spark, JOB)["sink"].df.collect()}
    assert rows == {f"{w}:{n}" for w in builders.GENERATOR_WORDS for n in (1, 2)}


def test_count_ignores_case(spark):
    s = StreamEnvironment(spark).from_collection(["Rust", "spark", "rust"], "string")
    job = {**JOB, "edges": [{"from": "source", "to": "count"}, {"from": "count", "to": "sink"}]}
    out = compile_job(spark, job, {"source": s.df})["sink"].df.orderBy("arrival")
    assert [r.value for r in out.collect()] == ["rust:1", "spark:1", "rust:2"]


@pytest.mark.parametrize(
    ("change", "error"),
    [({"vertices": [{"id": "x", "operator": "teleport"}]}, GraphError), ({"edges": [{"from": "source", "to": "count", "partition": "sideways"}]}, GraphError),
     ({"vertices": [{"id": "s", "operator": "source", "connector": {"type": "carrier pigeon"}}]}, ConfigError)],
)
def test_bad_jobs_raise(change, error):
    with pytest.raises(error):
        graph_of(JOB | change)


def test_command_line(tmp_path, capsys):
    path = tmp_path / "job.json"
    path.write_text(json.dumps(JOB))
    for command in ("check", "explain", "graph"):
        assert main([command, str(path)]) == 0
    assert "tasks 6 -> " in capsys.readouterr().out


def test_connector_settings(spark):
    source = builders.KafkaSource("b:9092", "t", "g", {"t": {"0": 5}}, config=builders.KafkaConfig("b:9092", "SASL_SSL", "PLAIN", "u", "p", {"client.id": "x"}))
    o = source.options()
    assert o["subscribe"] == "t" and o["startingOffsets"] == '{"t": {"0": 5}}' and o["kafka.group.id"] == "g" and o["kafka.client.id"] == "x" and "PlainLoginModule" in o["kafka.sasl.jaas.config"]
    assert sinks.KafkaSink("b", "t").options()["kafka.acks"] == "all"
    assert sinks.KafkaSink("b", "t", delivery=sinks.Delivery.EXACTLY_ONCE).options()["includeHeaders"] == "true"
    for builder in (source, builders.PulsarSource("u", "t")):
        with pytest.raises(ConnectorUnavailable):
            builder.load(spark)
    with pytest.raises(ConnectorUnavailable):
        sinks.PulsarSink("u", "t").write(spark.range(1))
    with pytest.raises(ConfigError):
        builders.SocketSource("h", 1, "sideways").load(spark)
    assert sinks.unquoted('"a\\"b"') == 'a"b' and sinks.unquoted("a") == "a" and sinks.unquoted('"') == '"'


def test_a_declared_count_shuffles_rows_once_and_joins_nothing(spark):
    """Also of words that differ in case, over lines whose arrival leaves wide gaps."""
    lines = [(i * i * 1000, "To be or not to BE" if i % 2 else "  be\tso ") for i in range(200)]
    source = {"id": "source", "operator": "source", "connector": {"type": "collection"}}
    sink = {"id": "sink", "operator": "sink", "connector": {"type": "console"}}
    steps = [{"id": "words", "operator": "flatmap", "config": {"function": "split_words"}}, {"id": "n", "operator": "count", "config": {}}]
    ids = ["source", "words", "n", "sink"]
    job = {"name": "j", "vertices": [source, *steps, sink], "edges": [{"from": a, "to": b} for a, b in zip(ids, ids[1:], strict=False)]}
    out = compile_job(spark, job, {"source": spark.createDataFrame(lines, "arrival long, value string")})["sink"].df
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    seen, expected = Counter(), []
    for _, text in lines:
        for word in text.lower().split():
            seen[word] += 1
            expected.append(f"{word}:{seen[word]}")
    assert Counter(r.value for r in out.collect()) == Counter(expected)
