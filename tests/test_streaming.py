import socket
import threading
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.errors import ConfigError, StateError
from tidemark.operators.stream import StreamEnvironment
from tidemark.plans.graph import RestartStrategy
from tidemark.sources.builders import Generator, SocketSource
from tidemark.sources.sinks import ConsoleSink, FileSink, SocketSink
from tidemark.sources.sockets import LineClient, LineServer
from tidemark.streaming.checkpoints import CheckpointStore, Coordinator
from tidemark.streaming.exactly_once import ExactlyOnceWriter, IdempotentTracker, MemoryTransactions, StagedSink
from tidemark.streaming.run import MetricsListener, available_now, collected, folder, with_restarts
from tidemark.streaming.stateful import Context, MemoryHandle, Processor


def test_transactions():
    sink = MemoryTransactions()
    t = sink.begin()
    sink.write(t, [1, 2, 3])
    sink.pre_commit(t)
    assert sink.committed == []
    sink.commit(t)
    assert sink.committed == [1, 2, 3]
    t = sink.begin()
    sink.write(t, [4])
    sink.abort(t)
    sink.commit(t)
    assert sink.committed == [1, 2, 3]
    with pytest.raises(StateError):
        sink.write(t, [5])
    t = sink.begin()
    sink.write(t, [6])
    sink.pre_commit(t)
    sink.recover([t])
    assert sink.committed[-1] == 6


def test_writer_commits_with_checkpoints():
    sink = MemoryTransactions()
    w = ExactlyOnceWriter(sink)
    w.write("a")
    w.barrier(1)
    w.write("b")
    w.barrier(2)
    w.write("c")
    assert sink.committed == []
    w.failed(2)
    w.complete(2)
    assert sink.committed == ["a"]
    w.end()
    assert sink.committed == ["a", "c"]


def test_tracker():
    t = IdempotentTracker(keep=1)
    assert t.mark(1, "r1") and t.mark(1, "r2") and not t.mark(1, "r1")
    assert t.is_duplicate(1, "r2") and not t.is_duplicate(1, "r3") and not t.is_duplicate(2, "r1")
    other = IdempotentTracker()
    other.restore(t.snapshot())
    assert other.is_duplicate(1, "r1")
    t.mark(3, "x")
    t.cleanup()
    assert 1 not in t.seen


def test_state():
    handle = MemoryHandle()
    c = Context(handle)
    with pytest.raises(StateError):
        c.value("v", "int").get()
    handle.key = "a"
    v, items, table, total = c.value("v", "int"), c.list("l", "int"), c.map("m", "string", "int"), c.reducing("r", "int", lambda a, b: a + b)
    assert v.get() is None and items.is_empty() and table.is_empty()
    v.set(42)
    items.add(1)
    items.add_all([2, 3])
    table.put("x", 1)
    assert (v.get(), items.get(), table.get("x"), table.get("y"), total.add(10), total.add(5)) == (42, [1, 2, 3], 1, None, 10, 15)
    saved = handle.snapshot()
    assert table.remove("x") == 1 and not table.contains("x")
    v.clear()
    handle.key = "b"
    assert v.get() is None and items.get() == []
    handle.key = "a"
    handle.restore(saved)
    assert v.get() == 42 and table.entries() == [("x", 1)] and table.keys() == ["x"] and table.values() == [1]


class Alarm(Processor):
    """Reports a key's events when its timer, ten seconds after the first, fires."""

    order = "i"

    def open(self, context: Context) -> None:
        self.n = context.value("n", "bigint")

    def process(self, key, row, context):
        n = self.n.get() or 0
        if n == 0:
            context.register_timer(int(row["ms"]) + 10_000)
        self.n.set(n + 1)
        return iter(())

    def on_timer(self, key, at_ms, context):
        yield key[0], at_ms, self.n.get()
        self.n.clear()


def batches(spark, tmp_path, *parts):
    """A stream of one file, and so one micro-batch, per part."""
    schema = "i long, ms long, key string"
    for j, rows in enumerate(parts):
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("ms"))
        df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/p={j}")
        time.sleep(0.05)
    kind = spark.read.parquet(f"file://{tmp_path}/in").drop("p").schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")


def test_event_time_timers_fire_behind_the_watermark(spark, tmp_path):
    df = batches(spark, tmp_path, [(0, 1000, "a"), (1, 2000, "b")], [(2, 3000, "a"), (3, 20_000, "c")], [(4, 60_000, "z")], [(5, 90_000, "z")])
    s = StreamEnvironment(spark).from_dataframe(df, value="key").with_time("ts", "0 seconds")
    out = s.key_by("key").process(Alarm(), "key string, fired_at long, n long", time_mode="EventTime").df
    got = {(r.key, r.fired_at, r.n) for r in collected(out, "alarm").collect()}
    assert {("a", 11_000, 2), ("b", 12_000, 1)} <= got


def test_bounded_and_unbounded_windows_agree(spark, tmp_path):
    rows = [(i, i * 700, "ab"[i % 2]) for i in range(50)]
    df = batches(spark, tmp_path, rows[:25], rows[25:], [(99, 10**9, "end")])
    s = StreamEnvironment(spark).from_dataframe(df, value="key").with_time("ts", "1 second")
    live = collected(s.key_by("key").tumbling_window(5000).count("n").df, "windows")
    whole = spark.createDataFrame(rows, "i long, ms long, key string").withColumn("ts", F.timestamp_millis("ms"))
    batch = StreamEnvironment(spark).from_dataframe(whole, value="key", time="ts").key_by("key").tumbling_window(5000).count("n").df
    assert {tuple(r) for r in live.where("key <> 'end'").collect()} == {tuple(r) for r in batch.collect()}


def test_restart_from_checkpoint(spark, tmp_path):
    """What is written before and after a restart is there once."""
    df = batches(spark, tmp_path, [(0, 0, "a")])
    sink, checkpoint = StagedSink(f"file://{tmp_path}/out"), folder(spark, "restart")
    available_now(df, sink, checkpoint)
    spark.createDataFrame([(1, 1, "b")], "i long, ms long, key string").withColumn("ts", F.timestamp_millis("ms")).coalesce(1).write.parquet(f"file://{tmp_path}/in/p=9")
    available_now(df, sink, checkpoint)
    assert sorted(r.i for r in sink.read(spark, df.schema).collect()) == [0, 1]
    assert len(sink.committed(spark)) == 2


def test_staged_batch_is_invisible_until_published(spark, tmp_path):
    sink, df = StagedSink(f"file://{tmp_path}/out"), spark.range(3)
    sink.stage(df, 0)
    assert sink.read(spark, df.schema).count() == 0
    sink.publish(spark, 0)
    sink(spark.range(100), 0)
    assert sink.read(spark, df.schema).count() == 3
    sink.stage(df, 1)
    sink.abort(spark, 1)
    assert sink.read(spark, df.schema).count() == 3


def free_port():
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def test_loopback(spark):
    """Lines written by a sink reach a line server."""
    server = LineServer("127.0.0.1", 0)
    df = spark.createDataFrame([(f"test-message-{i}",) for i in range(10)], "value string").coalesce(1)
    SocketSink("127.0.0.1", server.port, "client").write(df)
    end = time.monotonic() + 5
    while len(server.take(0)) < 10 and time.monotonic() < end:
        time.sleep(0.02)
    assert server.take(0) == [f"test-message-{i}" for i in range(10)]
    server.forget(4)
    assert server.take(4, 2) == ["test-message-4", "test-message-5"]
    server.close()


def test_a_full_line_server_slows_its_clients():
    """No more than the bound is held; what is forgotten makes room, and nothing is lost."""
    server = LineServer("127.0.0.1", 0, most_held=5)
    client = LineClient("127.0.0.1", server.port)
    client.send([str(i) for i in range(40)])
    client.close()
    got = []
    end = time.monotonic() + 5
    while len(got) < 40 and time.monotonic() < end:
        lines = server.take(len(got))
        assert len(lines) <= 5
        got += lines
        server.forget(len(got))
        time.sleep(0.01)
    assert got == [str(i) for i in range(40)]
    server.close()


def test_a_spool_tries_again(spark, tmp_path):
    from tidemark.sources.sockets import Spool

    server = LineServer("127.0.0.1", 0)
    spool = Spool(spark, server, f"file://{tmp_path}/spool", flush_ms=20)
    good, calls = spool.flush, []
    spool.flush = lambda: calls.append(1) or (_ for _ in ()).throw(OSError("away")) if len(calls) < 3 else good()
    client = LineClient("127.0.0.1", server.port)
    client.send(["a", "b"])
    client.close()
    end = time.monotonic() + 5
    while (not spool.files or spool.error) and time.monotonic() < end:
        time.sleep(0.02)
    assert spool.error is None and len(calls) == 3 and [r.value for r in spark.read.text(spool.folder).collect()] == ["a", "b"]
    spool.stop()


def test_line_server_as_a_stream(spark):
    port = free_port()
    df = SocketSource("127.0.0.1", port).load(spark)
    got = []
    query = df.writeStream.foreachBatch(lambda rows, _: got.extend(r.value for r in rows.collect())).start()

    def send():
        client = LineClient("127.0.0.1", port, 20_000)
        client.send(["one", "two"])
        client.close()

    threading.Thread(target=send).start()
    end = time.monotonic() + 40
    while len(got) < 2 and time.monotonic() < end:
        time.sleep(0.1)
    query.stop()
    assert got == ["one", "two"]


def test_generator(spark):
    rows = Generator(100, 9).load(spark).orderBy("arrival").collect()
    assert rows[7].value == rows[0].value and rows[1].timestamp - rows[0].timestamp == timedelta(milliseconds=100)
    assert Generator(100).load(spark).isStreaming


def test_sinks(spark, tmp_path, capsys):
    df = spark.createDataFrame([("a",)], "value string")
    assert ConsoleSink().write(df) == 1 and "[SINK] a" in capsys.readouterr().out
    FileSink(f"file://{tmp_path}/x").write(df)
    assert spark.read.parquet(f"file://{tmp_path}/x").count() == 1


def test_metrics():
    class P:
        id, numInputRows, batchDuration = "q", 10, 500

    class E:
        progress, id = P, "q"

    listener = MetricsListener()
    listener.onQueryStarted(E)
    listener.onQueryProgress(E)
    assert listener.by_query["q"].throughput == 20.0


class Slow:
    async def invoke(self, value):
        import asyncio

        await asyncio.sleep(0.3 if value == 0 else 0.0)
        return value

    def timeout(self, value):
        return -1


def test_async_io(spark):
    s = StreamEnvironment(spark).from_dataframe(spark.range(4).coalesce(1), value="id")
    assert [r.result for r in s.async_io_ordered(Slow(), "long").df.collect()] == [0, 1, 2, 3]
    assert [r.result for r in s.async_io_unordered(Slow(), "long").df.collect()] == [1, 2, 3, 0]
    assert [r.result for r in s.async_io_ordered(Slow(), "long", timeout_ms=50).df.collect()] == [-1, 1, 2, 3]


def test_checkpoints(spark, tmp_path):
    clock = [0.0]
    store = CheckpointStore(spark, f"file://{tmp_path}/chk")
    c = Coordinator(store, ["a", "b"], retained=2, timeout_ms=1000, min_pause_ms=500, now=lambda: clock[0])
    done = []
    for i in range(4):
        n = c.trigger()
        assert c.trigger() is None  # one at a time
        assert not c.acknowledge(n, "a", b"x%d" % i) and not c.acknowledge(n, "stranger", b"") and c.acknowledge(n, "b", b"y")
        assert c.trigger() is None  # too soon
        done.append(n)
        clock[0] += 0.6
    assert store.list() == done[-2:] and c.latest() == {"a": b"x3", "b": b"y"}
    n = c.trigger()
    c.acknowledge(n, "a", b"lost")
    clock[0] += 1.1
    assert not c.acknowledge(n, "b", b"late") and c.stats.failed == 1 and c.stats.completed == 4 and store.list() == done[-2:]


def test_restarts():
    from pyspark.errors import StreamingQueryException

    left, slept = [2], []

    class Query:
        def awaitTermination(self):
            if left[0]:
                left[0] -= 1
                raise StreamingQueryException("lost")

    assert with_restarts(Query, RestartStrategy("fixed_delay", 3, 5000), slept.append) == 2 and slept == [5.0, 5.0]
    left[0] = 9
    with pytest.raises(StreamingQueryException):
        with_restarts(Query, RestartStrategy("fixed_delay", 3, 0), slept.append)


def test_running_results_of_a_stream_are_refused(spark):
    df = Generator(100).load(spark)
    with pytest.raises(ConfigError):
        StreamEnvironment(spark).from_dataframe(df, order="arrival").count()


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_of_several_files_is_replayed_whole(spark, sf_dir, tmp_path, files):
    """A folder of files, as Spark writes a table; its rows in no order."""
    from tidemark import catalogue

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.orderBy(F.xxhash64("event_id")).repartition(files).write.parquet(f"{tmp_path}/events.parquet")
    expected = events.selectExpr("event_id", "event_type", "count(*) OVER (PARTITION BY event_type ORDER BY event_id) AS n").collect()
    got = catalogue.stream_rich_counter(spark, str(tmp_path)).collect()
    assert expected and sorted(map(tuple, got)) == sorted(map(tuple, expected))
