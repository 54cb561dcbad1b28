"""Order, nulls and large integers in keyed state; user functions over windows; sinks of many batches."""

import pickle
import random
import tracemalloc
import zlib
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import catalogue
from tidemark.catalogue import MeanOf, TypeCounter
from tidemark.errors import ConfigError
from tidemark.operators.stream import StreamEnvironment
from tidemark.plans.job import compile_job
from tidemark.shared import discard, folder, written
from tidemark.sources.sinks import Delivery, KafkaSink
from tidemark.streaming import stateful
from tidemark.streaming.exactly_once import StagedSink
from tidemark.streaming.run import collected
from tidemark.streaming.stateful import Context, ListOf, MemoryHandle, Processor, RunningCount

BIG = 2**53 + 1


def test_shuffled_rows_of_a_hot_key_are_put_in_order(spark, tmp_path):
    """Three times the rows of an Arrow batch, one key, in no order."""
    rows = spark.range(30_000).select(F.col("id").alias("event_id"), F.lit("hot").alias("event_type")).orderBy(F.xxhash64("id"))
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    s = StreamEnvironment(spark).parquet(f"file://{tmp_path}/in", True, rows.schema, order="event_id")
    out = collected(s.key_by("event_type").process(TypeCounter(), "event_id long, event_type string, n long").df)
    assert out.count() == 30_000 and out.where("n <> event_id + 1").count() == 0


class Echo(Processor):
    order = "i"

    def open(self, context: Context) -> None:
        self.n = context.value("n", "bigint")
        self.seen = context.map("seen", "string", "bigint")

    def process(self, key, row, context):
        self.n.set((self.n.get() or 0) + 1)
        self.seen.put("a", self.n.get())
        if self.n.get() == 2:
            self.seen.remove("a")
        yield key[0], row["i"], row["v"], self.n.get(), self.seen.get("a"), len(self.seen.keys())


@pytest.mark.parametrize("live", [False, True])
def test_null_keys_and_large_integers(spark, tmp_path, live):
    rows = [(None, 3, BIG), (BIG, 1, None), (BIG - 1, 2, BIG), (None, 1, 7), (None, None, 5)]
    df = spark.createDataFrame(rows, "k long, i long, v long").coalesce(1)
    if live:
        df.write.parquet(f"file://{tmp_path}/in")
        df = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    out = StreamEnvironment(spark).from_dataframe(df).key_by("k").process(Echo(), "k long, i long, v long, n long, a long, m long").df
    got = {tuple(r) for r in (collected(out) if live else out).collect()}
    assert got == {(None, None, 5, 1, 1, 1), (None, 1, 7, 2, None, 0), (None, 3, BIG, 3, 3, 1), (BIG, 1, None, 1, 1, 1), (BIG - 1, 2, BIG, 1, 1, 1)}


def test_reduce_by_a_function_with_null_and_nan_keys(spark):
    rows = [(None, 1, 5), (None, 2, 9), (None, 3, 2), (float("nan"), 4, BIG), (float("nan"), 5, 1), (1.0, 6, 3)]
    s = StreamEnvironment(spark).from_dataframe(spark.createDataFrame(rows, "k double, i long, v long"), order="i")
    got = {r.i: r.top for r in s.key_by("k").reduce(max, "v", "top", "long").df.collect()}
    assert got == {1: 5, 2: 9, 3: 9, 4: BIG, 5: BIG, 6: 3}


def test_bounded_counts_of_a_null_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (None, 3)], "k long, i long")
    out = StreamEnvironment(spark).from_dataframe(df).key_by("k").process(RunningCount("i"), "k long, n long").df
    assert sorted(r.n for r in out.collect()) == [1, 2, 3]


class Sides(Processor):
    schema = "i long"

    def process(self, key, row, context):
        if row["i"] % 2:
            context.side_output("odd", row["i"], "x")
        else:
            yield (row["i"],)


@pytest.mark.parametrize("live", [False, True])
def test_side_outputs_of_a_processor(spark, tmp_path, live):
    df = spark.range(10).select(F.col("id").alias("i"), F.lit(1).alias("k"))
    if live:
        df.write.parquet(f"file://{tmp_path}/in")
        df = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    keyed = StreamEnvironment(spark).from_dataframe(df).key_by("k")
    out = keyed.process_with_sides(Sides(), {"odd": "i long, what string"})
    rows = collected(out["tagged"].df) if live else None
    take = lambda tag: rows.where(F.col("tag") == tag).select(f"{tag}.*") if live else out[tag].df
    assert sorted(r.i for r in take("main").collect()) == [0, 2, 4, 6, 8]
    assert sorted((r.i, r.what) for r in take("odd").collect()) == [(i, "x") for i in (1, 3, 5, 7, 9)]
    with pytest.raises(ConfigError, match="main"):
        keyed.process_with_sides(Sides(), {"main": "i long"})
    with pytest.raises(ConfigError, match="schema"):
        keyed.process(Processor())


def windowed(spark, n=400):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(milliseconds=rng.randrange(20_000)), rng.choice(["a", "b", None]), rng.randrange(100)) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, ts timestamp_ntz, k string, v long").repartition(7)
    return rows, StreamEnvironment(spark).from_dataframe(df, time="ts", order="i").key_by("k")


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "session", "global", "count", "partial"])
def test_user_functions_over_every_window(spark, kind):
    """A merged aggregate, a reduction and a function over the contents agree with the built-in aggregates."""
    _, keyed = windowed(spark)
    w = {
        "tumbling": lambda: keyed.tumbling_window(3000), "sliding": lambda: keyed.sliding_window(4000, 1000), "session": lambda: keyed.session_window(90),
        "global": lambda: keyed.global_window(), "count": lambda: keyed.count_window(7), "partial": lambda: keyed.count_window(7, True),
    }[kind]()
    wanted = w.aggregate(F.expr("sum(v) div count(*)").alias("mean"), F.max("v").alias("top"), F.sort_array(F.collect_list(F.struct("i", "v"))).alias("all")).df
    names = [c for c in wanted.columns if c not in ("mean", "top", "all")]
    assert len(names) >= 1
    key = lambda r: tuple(r[n] for n in names)
    expected = {key(r): (r["mean"], r["top"], [x.v for x in r["all"]]) for r in wanted.collect()}
    assert {key(r): r["mean"] for r in w.aggregate_with(MeanOf(), "v", "long", "mean").df.collect()} == {k: x[0] for k, x in expected.items()}
    assert {key(r): r["top"] for r in w.reduce(max, "v", "top", "long").df.collect()} == {k: x[1] for k, x in expected.items()}
    contents = w.process(lambda window, rows: [([r["v"] for r in rows],)], "vs array<long>").df.collect()
    assert {key(r): r["vs"] for r in contents} == {k: x[2] for k, x in expected.items()}


def test_a_hot_group_sends_one_row_a_task(spark):
    df = spark.range(0, 10_000, 1, 4).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    s = StreamEnvironment(spark).from_dataframe(df).key_by("k").global_window()
    assert s.aggregate_with(MeanOf(), "v", "long").df.collect()[0].result == 4999
    assert s.reduce(lambda a, b: a + b, "v", returns="long").df.collect()[0].reduced == 9999 * 5000


def test_staged_batches_are_compacted(spark, tmp_path):
    sink = StagedSink(f"file://{tmp_path}/out")
    sink.COMPACT = 3
    for batch in (0, 1, 2, 3, 5):
        sink(spark.range(batch, batch + 1), batch)
        sink(spark.range(99), batch)
    sink.stage(spark.range(50), 6)
    schema = spark.range(1).schema
    assert sink.committed(spark) == [0, 1, 2, 3, 5]
    assert sorted(p.name for p in (tmp_path / "out" / "committed").iterdir() if not p.name.startswith(".")) == ["5", "upto=3"]
    assert sorted(r.id for r in sink.read(spark, schema).collect()) == [0, 1, 2, 3, 5] and sink.read(spark, schema).columns == ["id"]
    sink(spark.range(4, 5), 4)
    assert sink.committed(spark) == [*range(6)]


def test_kafka_headers_name_the_batch(spark):
    df = spark.createDataFrame([("a",)], "value string")
    row = KafkaSink("b", "t", delivery=Delivery.EXACTLY_ONCE, transactional_id_prefix="job").payload(df, 7).first()
    assert [(h.key, bytes(h.value)) for h in row.headers] == [("batch_id", b"job-7")]
    assert KafkaSink("b", "t").payload(df).columns == ["value"]


def test_declared_connect_and_side_output(spark):
    source = lambda i: {"id": i, "operator": "source", "connector": {"type": "collection"}}
    sink = {"id": "sink", "operator": "sink", "connector": {"type": "console"}}
    two = {"a": spark.createDataFrame([("x",), ("",)], "value string"), "b": spark.createDataFrame([("Y",)], "value string")}
    job = {"name": "j", "vertices": [source("a"), source("b"), {"id": "c", "operator": "connect", "config": {"first": "uppercase", "second": "lowercase"}}, {"id": "s", "operator": "side_output", "config": {"take": "main"}}, sink], "edges": [{"from": "a", "to": "c"}, {"from": "b", "to": "c"}, {"from": "c", "to": "s"}, {"from": "s", "to": "sink"}]}
    assert [r.value for r in compile_job(spark, job, two)["sink"].df.collect()] == [""]
    job["vertices"][3]["config"]["take"] = "side"
    assert sorted(r.value for r in compile_job(spark, job, two)["sink"].df.collect()) == ["X", "y"]


def test_written_tables_go_when_discarded(spark, tmp_path):
    df = written(spark.range(3), "gone")
    path = df._written_to.removeprefix("file://")
    assert df.count() == 3
    discard(df, None, spark.range(1))
    import os

    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ConfigError, match="spark.checkpoint.dir"):
        folder(Session(), "x")


@pytest.fixture(scope="module")
def scattered(tmp_path_factory, spark, sf_dir):
    """Events in several files, each over all of the month, some without user and type."""
    path = f"{tmp_path_factory.mktemp('scattered')}"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").repartition(5, "event_id")
    for c in ("user_id", "event_type"):
        rows = rows.withColumn(c, F.when(F.col("event_id") % 50 != 0, F.col(c)))
    rows.write.parquet(f"file://{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["stream_append_windows", "stream_timer"])
def test_replayed_events_of_several_files_are_never_late(spark, scattered, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{scattered}/events.parquet/*.parquet')")
    found = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert Counter(tuple(r) for r in catalogue.QUERIES[name](spark, scattered).select(*names).collect()) == Counter(found.fetchall())


def peak_mb(work) -> float:
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


class Timers:
    getCurrentWatermarkInMs = getCurrentProcessingTimeInMs = lambda self: -1


def test_rows_of_a_hot_key_are_not_held_together():
    """300,000 rows of one key in no order: their sorted runs lie in a file, and what they give leaves in packed blocks."""
    n = 300_000
    rows = lambda: (Row(event_id=(i * 7919) % n, event_type="hot") for i in range(n))
    adapter = stateful._Adapter(TypeCounter(), stateful._Output(StructType.fromDDL("event_id long, event_type string, n long"), {}))
    adapter.init(MemoryHandle())
    adapter.handle.key = ("hot",)
    blocks = []
    assert peak_mb(lambda: blocks.extend(adapter.handleInputRows(("hot",), rows(), Timers()))) < 40
    assert sum(len(b.block) for b in blocks) < 10 * n
    got = [x for b in blocks for x in pickle.loads(zlib.decompress(b.block))]
    assert got == [(i, "hot", i + 1) for i in range(n)]


def test_spilled_runs_keep_equal_rows_and_nulls_as_they_came(monkeypatch):
    monkeypatch.setattr(stateful, "RUN_ROWS", 50)
    monkeypatch.setattr(stateful, "SLICE_ROWS", 7)
    rng = random.Random(3)
    rows = [Row(i=rng.choice([None, 1, 2, BIG]), n=n, text="x" * rng.randrange(9)) for n in range(1001)]
    expected = sorted(rows, key=lambda r: (r.i is not None, r.i or 0, r.n))
    assert list(stateful.in_order(iter(rows), "i")) == [r.asDict() for r in expected]
    monkeypatch.setattr(stateful, "RUN_BYTES", 100)
    assert list(stateful.in_order(iter(rows), "i")) == [r.asDict() for r in expected]
    assert list(stateful.in_order(iter([]), "i")) == [] and [r["n"] for r in stateful.in_order(iter(rows), None)] == [*range(1001)]


class Nested(Processor):
    order, schema = "i", "k long, at timestamp, xs array<struct<a:long,b:string>>, m map<string,long>, raw binary"

    def process(self, key, row, context):
        yield key[0], datetime(2024, 1, 1) if row["i"] % 2 else None, [Row(a=row["i"], b="x")], {"a": BIG}, b"\x00"


def test_live_and_bounded_processors_give_the_same_nested_rows(spark, tmp_path):
    df = spark.range(9).select((F.col("id") % 2).alias("k"), F.col("id").alias("i"))
    df.write.parquet(f"file://{tmp_path}/in")
    live = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    env = StreamEnvironment(spark)
    run = lambda x: env.from_dataframe(x).key_by("k").process(Nested()).df
    key = lambda r: r.xs[0].a
    assert sorted(collected(run(live)).collect(), key=key) == sorted(run(df).collect(), key=key)


class CountedList:
    """A list state that counts what is asked of it."""

    def __init__(self, *rows):
        self.rows, self.calls = list(rows), []

    def get(self):
        self.calls.append("get")
        return iter(list(self.rows))

    def exists(self):
        self.calls.append("exists")
        return bool(self.rows)

    def put(self, rows):
        self.calls.append("put")
        self.rows = list(rows)

    def appendList(self, rows):
        self.calls.append("append")
        self.rows += rows

    def clear(self):
        self.calls.append("clear")
        self.rows = []


def test_a_list_is_read_and_written_once_per_key_and_batch():
    class Handle:
        state = CountedList((1,))

        def getListState(self, name, schema):
            return self.state

    processor, context = catalogue.LastThree(), Context(Handle())
    processor.open(context)
    totals = [total for i in range(100) for _, _, total in processor.process((7,), {"event_id": i, "cents": i}, context)]
    for held in context.held:
        held.flush()
    assert totals == [1, 2, *(3 * i - 3 for i in range(2, 100))]
    assert Handle.state.calls == ["get", "put"] and Handle.state.rows == [(97,), (98,), (99,)]


def test_a_held_list_does_what_a_plain_one_does():
    rng = random.Random(1)
    for _ in range(300):
        start = [(i,) for i in range(rng.randrange(3))]
        plain, held = ListOf(CountedList(*start)), ListOf(stateful._HeldList(CountedList(*start)))
        plain.state.appendValue = lambda row, s=plain.state: s.rows.append(row)
        held.state.PART = 5
        for _ in range(12):
            x = rng.randrange(100)
            does = rng.choice(["get", "is_empty", "add", "add", "add_all", "update", "clear", "flush"])
            if does == "flush":
                held.state.flush()
                assert held.state.state.rows == plain.state.rows
                if x % 2:
                    held.state.forget()
                continue
            args = {"add": [x], "add_all": [[x] * (x % 4)], "update": [[x] * (x % 3)]}.get(does, [])
            assert getattr(plain, does)(*args) == getattr(held, does)(*args), does
        held.state.flush()
        assert held.state.state.rows == plain.state.rows
