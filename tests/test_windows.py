import random
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.operators import scan
from tidemark.operators.scan import Running, order_ranges, running
from tidemark.operators.stream import DataStream, StreamEnvironment
from tidemark.operators.windows import Count, Session, Sliding, TimeWindow, Tumbling, check

EPOCH = datetime(1970, 1, 1)
# The event-time demo: arrival, milliseconds, key, value.
DEMO = [(0, 1000, "a", 1), (1, 2000, "b", 1), (2, 6000, "a", 5), (3, 3000, "a", 1), (4, 7000, "b", 2), (5, 10000, "a", 3), (6, 12000, "b", 1), (7, 4000, "b", 10), (8, 15000, "a", -1), (9, 16000, "b", 4)]


def stream(spark, rows):
    data = [(i, EPOCH + timedelta(milliseconds=ms), k, v) for i, ms, k, v in rows]
    df = spark.createDataFrame(data, "i long, ts timestamp_ntz, key string, value long")
    return StreamEnvironment(spark).from_dataframe(df, time="ts", order="i")


def ms(t):
    return round((t - EPOCH).total_seconds() * 1000)


def test_assignment():
    assert Tumbling(5000).assign(3000) == [TimeWindow(0, 5000)]
    assert Tumbling(5000).assign(7000) == [TimeWindow(5000, 10000)]
    assert set(Sliding(10000, 5000).assign(7000)) == {TimeWindow(5000, 15000), TimeWindow(0, 10000)}
    assert Sliding(10000, 5000).assign(2000) == [TimeWindow(0, 10000)]  # none before the epoch
    assert Sliding(1000, 5000).assign(4000) == []  # a gap
    w = TimeWindow(0, 10)
    assert w.max_timestamp == 9 and w.contains(0) and not w.contains(10)
    assert w.intersects(TimeWindow(9, 12)) and not w.intersects(TimeWindow(10, 12))
    assert w.merge(TimeWindow(5, 12)) == TimeWindow(0, 12)


@pytest.mark.parametrize("spec", [Tumbling(0), Sliding(10, 0), Session(-1), Count(0)])
def test_sizes_are_checked(spec):
    with pytest.raises(ConfigError):
        check(spec)


def test_demo_drops_late_events(spark):
    on_time, late = stream(spark, DEMO).late(3, 2000)
    assert sorted(r.i for r in late.df.collect()) == [3, 7]
    out = on_time.filter(F.col("value") > 0).select("ts", "key", (F.col("value") * 2).alias("v")).key_by("key").tumbling_window(5000).sum("v")
    got = sorted((ms(r.window_start), ms(r.window_end), r.key, r.sum) for r in out.df.collect())
    assert got == [(0, 5000, "a", 2), (0, 5000, "b", 2), (5000, 10000, "a", 10), (5000, 10000, "b", 4), (10000, 15000, "a", 6), (10000, 15000, "b", 2), (15000, 20000, "b", 8)]


def test_late_marks_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(100_000), "k", 1) for i in range(300)]
    expected, top, wm = [], 0, None
    for i, t, _, _ in rows:
        if wm is not None and t <= wm:
            expected.append(i)
        top = max(top, t)
        if i % 7 == 6:
            wm = top - 5000
    _, late = stream(spark, rows).late(7, 5000)
    assert sorted(r.i for r in late.df.collect()) == expected


def test_sessions(spark):
    rows = [(0, 0, "a", 1), (1, 10, "a", 2), (2, 21, "a", 4)]
    out = stream(spark, rows).key_by("key").session_window(10).sum("value").df.collect()
    assert sorted((ms(r.window_start), ms(r.window_end), r["sum"]) for r in out) == [(0, 11, 3), (21, 22, 4)]


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_sessions_against_a_loop(spark, ranges):
    rng = random.Random(2)
    rows = [(i, rng.randrange(20_000), rng.choice(["a", "b", None]), 1) for i in range(400)]
    expected = []
    for k in ("a", "b", None):
        times = sorted(t for _, t, key, _ in rows if key == k)
        start = last = None
        for t in [*times, 10**9]:
            if last is None or t > last + 60:
                if last is not None:
                    expected.append((start, last + 1, k, n))
                start, n = t, 0
            last, n = t, n + 1
    s = stream(spark, rows).key_by("key").session_window(60).aggregate(F.count("*").alias("n"), ranges=ranges)
    got = [(ms(r.window_start), ms(r.window_end), r.key, r.n) for r in s.df.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_sliding_with_gaps_and_without_negative_starts(spark):
    rows = [(0, 1000, "a", 1), (1, 7000, "a", 2), (2, 4500, "a", 4)]
    s = stream(spark, rows).key_by("key")
    got = sorted((ms(r.window_start), r["sum"]) for r in s.sliding_window(10000, 5000).sum("value").df.collect())
    assert got == [(0, 7), (5000, 2)]
    got = sorted((ms(r.window_start), r["sum"]) for r in s.sliding_window(2000, 5000).sum("value").df.collect())
    assert got == [(0, 1)] or got == [(0, 1), (5000, 0)]


def test_count_windows(spark):
    rows = [(i, i, "a", i) for i in range(7)]
    s = stream(spark, rows).key_by("key")
    assert sorted((r.window_index, r["sum"]) for r in s.count_window(3).sum("value").df.collect()) == [(0, 3), (1, 12)]
    assert sorted((r.window_index, r["sum"]) for r in s.count_window(3, partial=True).sum("value").df.collect()) == [(0, 3), (1, 12), (2, 6)]


def test_running_reduce(spark):
    rows = [(0, 0, "a", 1), (1, 0, "b", 5), (2, 0, "a", 2), (3, 0, "a", 3), (4, 0, "b", 1)]
    out = stream(spark, rows).key_by("key").reduce("sum", "value", "s").df.orderBy("i").collect()
    assert [(r.key, r.s) for r in out] == [("a", 1), ("b", 5), ("a", 3), ("a", 6), ("b", 6)]


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_running_against_a_loop(spark, ranges):
    rng = random.Random(3)
    rows = [(i * 3, rng.choice(["a", "b", None]), rng.choice([None, *range(5)])) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, k string, v long").repartition(5)
    got = running(df, ["k"], "i", [Running("n", "count"), Running("s", "sum", "v"), Running("lo", "min", "v"), Running("hi", "max", "v"), Running("lo_i", "min_by", "i", "v"), Running("hi_i", "max_by", "i", "v")], ranges)
    expected = []
    for j, (i, k, v) in enumerate(rows):
        seen = [(y, x) for x, kk, y in rows[: j + 1] if kk == k]
        known = [(y, x) for y, x in seen if y is not None]
        low, high = min(known, default=None), min(((-y, x) for y, x in known), default=None)
        expected.append((i, k, len(seen), sum(y for y, _ in known), low and low[0], high and -high[0], low and low[1], high and high[1]))
    rows_out = [(r.i, r.k, r.n, r.s or 0, r.lo, r.hi, r.lo_i, r.hi_i) for r in got.collect()]
    assert sorted(rows_out) == sorted(expected)


def test_running_on_an_empty_stream(spark):
    df = spark.createDataFrame([], "i long, v long")
    assert running(df, [], "i", [Running("n", "count")]).count() == 0


def test_a_stream_without_time_says_so(spark):
    df = spark.createDataFrame([(1,)], "value long")
    with pytest.raises(ConfigError):
        StreamEnvironment(spark).from_dataframe(df).key_by("value").tumbling_window(5).count()


def test_hot_key_is_spread(spark):
    """The scan of one hot key takes many partitions' worth of ranges, not one."""
    df = spark.range(1000).select(F.col("id").alias("i"), F.lit("hot").alias("k"))
    out = running(df, ["k"], "i", [Running("n", "count")], 16)
    assert out.where("n = i + 1").count() == 1000
    assert isinstance(StreamEnvironment(spark).from_dataframe(df), DataStream)


AGGREGATES = [Running("n", "count"), Running("s", "sum", "v"), Running("lo", "min_by", "id", "v"), Running("hi", "max_by", "id", "v")]


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "double", "decimal(12,3)", "long"])
def test_orders_of_any_kind_with_nulls_and_close_ties(spark, kind):
    """Rows without an order come first; orders half a second, or a thousandth, apart are told apart; one is far away."""
    rng = random.Random(4)
    step = {"date": "date_add(date'2024-01-01', cast(i as int))", "timestamp": "timestamp_millis(i * 500)", "timestamp_ntz": "cast(timestamp_millis(i * 500) as timestamp_ntz)"}.get(kind, f"cast(i / 1000 as {kind})" if kind != "long" else "i")
    rows = [(j, None if j < 2 else (100_000 if j == 2 else rng.randrange(10**6)), "ab"[j % 2], rng.randrange(3)) for j in range(150)]
    order = {j: n for n, j in enumerate(sorted((i, j) for j, i, _, _ in rows if i is not None))}
    df = spark.createDataFrame([(j, None if i is None else order[(i, j)] + (10**5 if (i, j) == max(order) else 0), k, v) for j, i, k, v in rows], "id long, i long, k string, v long")
    df = df.withColumn("o", F.expr(step)).drop("i")
    got = {r.id: (r.n, r.s, r.lo, r.hi) for r in running(df, ["k"], "o", AGGREGATES, 7).collect()}
    assert len(got) == 150
    ranks = {r.id: r.o for r in df.collect()}
    for key in "ab":
        mine = sorted(((ranks[j] is not None, ranks[j] or 0, j, v) for j, _, k, v in rows if k == key), key=lambda x: x[:2] if x[0] else (False,))
        for n in range(1, len(mine) + 1):
            seen = [(v, at, j) for at, (_, _, j, v) in enumerate(mine[:n])]
            assert got[mine[n - 1][2]] == (n, sum(v for v, _, _ in seen), min(seen)[2], min((-v, at, j) for v, at, j in seen)[2])


def test_an_order_of_text_is_refused(spark):
    with pytest.raises(ConfigError, match="numeric"):
        running(spark.createDataFrame([("a",)], "o string"), [], "o", [Running("n", "count")])


def test_ranges_follow_the_rows(spark, monkeypatch):
    """One outlier does not empty the other ranges; more rows give more ranges, known bounds need no job."""
    df = spark.range(20_000).select(F.when(F.col("id") == 19_999, 10**15).otherwise(F.col("id")).alias("o"))
    sizes = [r["count"] for r in df.groupBy(order_ranges(df, "o")).count().collect()]
    assert len(sizes) >= 30 and max(sizes) <= 2000
    monkeypatch.setattr(scan, "RANGE_ROWS", 50)
    sizes = [r["count"] for r in df.groupBy(order_ranges(df, "o")).count().collect()]
    assert len(sizes) > 300 and max(sizes) <= 400
    out = running(df, [], "o", [Running("n", "count")])
    assert out.agg(F.count("*"), F.countDistinct("n"), F.max("n")).first() == (20_000, 20_000, 20_000)
    ranges = order_ranges(df, "o", bounds=[100, 5000])
    assert sorted(r["count"] for r in df.groupBy(ranges).count().collect()) == [100, 4900, 15_000]


def test_sessions_leave_out_rows_without_a_time(spark):
    df = spark.createDataFrame([(None, 1), (EPOCH, 2), (EPOCH + timedelta(seconds=1), 4)], "ts timestamp_ntz, v long")
    s = StreamEnvironment(spark).from_dataframe(df.withColumn("key", F.lit("a")), time="ts")
    assert [r["sum"] for r in s.key_by("key").session_window(5000).sum("v").df.collect()] == [6]


def placed(spark, values, **more):
    """(order, range) of each value, by order, nulls and then numbers first."""
    df = spark.createDataFrame([(v,) for v in values], "o double")
    rows = df.select("o", order_ranges(df, "o", **more).alias("r")).collect()
    return sorted(((r.o, r.r) for r in rows), key=lambda x: (x[0] is not None, x[0] is not None and x[0] != x[0], x[0] or 0))


@pytest.mark.parametrize("ranges", [None, 40, 1000])
@pytest.mark.parametrize("kind", ["even", "outlier", "infinite", "squares"])
def test_ranges_grow_with_the_order_and_are_many(spark, kind, ranges):
    values = [float(i) for i in range(5000)]
    values = {"even": values, "outlier": [*values, 1e15], "infinite": [*values, float("inf"), float("-inf"), float("nan")], "squares": [x**6 for x in values]}[kind]
    got = placed(spark, [*values, None], ranges=ranges)
    places = [r for _, r in got]
    assert got[0] == (None, -1) and places == sorted(places)
    sizes = Counter(places)
    wanted = 32 if ranges is None else ranges
    assert len(sizes) >= min(wanted, 64) // 2 and max(sizes.values()) <= 3 * 5000 / min(wanted, 128)


@pytest.mark.parametrize("n", [3, 16, 17, 200])
def test_known_bounds_are_exact(spark, n):
    cuts = [float(i * i) for i in range(1, n + 1)]
    values = [0.0, *cuts, *(c - 0.5 for c in cuts), 1e9, float("inf"), float("nan")]
    assert [r for _, r in placed(spark, values, bounds=cuts)] == [sum(not v < c for c in cuts) for v in sorted(values[:-1])] + [n]


def test_the_range_of_a_row_is_a_small_expression(spark):
    """Nested conditions for every cut make a method that isn't compiled, and slow all of its stage."""
    df = spark.range(100_000).selectExpr("id AS o")
    for place in (order_ranges(df, "o", 1000), order_ranges(df, "o", bounds=[float(i) for i in range(0, 100_000, 500)])):
        plan = df.select(place)._jdf.queryExecution().optimizedPlan()
        assert plan.toString().count("CASE") <= 3


def test_a_running_aggregate_shuffles_rows_once_and_joins_nothing(spark):
    df = spark.range(1000).selectExpr("id AS i", "id % 7 AS k", "id AS v")
    plan = running(df, ["k"], "i", [Running("s", "sum", "v")])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_running_results_keep_types(spark):
    df = spark.createDataFrame([(i, i % 3, i, Decimal(i), i / 2, f"{i}") for i in range(60)], "i long, k int, v int, d decimal(9,2), f float, t string")
    kinds = [Running("n", "count"), Running("s", "sum", "v"), Running("sd", "sum", "d"), Running("sf", "sum", "f"), Running("lo", "min", "v"), Running("hi", "max", "t"), Running("at", "max_by", "t", "d")]
    out = running(df, ["k"], "i", kinds, 8)
    assert [t for _, t in out.dtypes[6:]] == ["bigint", "bigint", "decimal(30,2)", "double", "int", "string", "string"]
    last = {r.k: r for r in out.where("i >= 57").collect()}
    assert [(last[k].n, last[k].s, last[k].sd, last[k].sf, last[k].lo, last[k]["at"]) for k in range(3)] == [(20, 570 + 20 * k, Decimal(570 + 20 * k), 285 + 10 * k, k, f"{57 + k}") for k in range(3)]


def test_only_hot_keys_are_cut(spark, monkeypatch):
    """Rare keys bring no totals, and no row to put ahead of theirs; the results are those of the plain window."""
    monkeypatch.setattr(scan, "HOT_ROWS", 100)
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(None).cast("string"))
    df = spark.range(3000).select(F.when(F.col("id") > 4, F.col("id")).alias("i"), F.coalesce(hot, F.when(F.col("id") % 3 == 2, (F.col("id") % 500).cast("string"))).alias("k"), (F.col("id") % 11).alias("v"))
    place, cut = scan._ranges(df, "i", keys=["k"])
    placed = df.select("k", place.alias("r"), cut.alias("cut")).distinct().collect()
    assert {r.k for r in placed if r.cut} == {"hot", None} and {r.r for r in placed if not r.cut} == {0}
    assert len([r for r in placed if r.k == "hot"]) >= 16
    df = df.where("i IS NOT NULL")
    got = running(df, ["k"], "i", [Running("n", "count"), Running("s", "sum", "v")])
    plain = df.selectExpr("*", *(f"{f} OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS {n}" for n, f in (("n", "count(*)"), ("s", "sum(v)"))))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, plain.collect()))


def test_rare_keys_are_scanned_without_totals(spark):
    df = spark.range(5000).selectExpr("id AS i", "named_struct('k', id % 700).k AS k", "id AS v")
    out = running(df, ["k"], "i", [Running("s", "sum", "v"), Running("n", "count")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Aggregate" not in plan and plan.count("Window ") == 1
    assert out.agg(F.sum("n"), F.sum("s")).first() == df.selectExpr("count(*) OVER (PARTITION BY k ORDER BY i) AS n", "sum(v) OVER (PARTITION BY k ORDER BY i) AS s").agg(F.sum("n"), F.sum("s")).first()


@pytest.mark.parametrize("kind", ["double", "struct<x:bigint>", "array<bigint>", "string collate UTF8_LCASE"])
def test_equal_keys_are_cut_alike(spark, monkeypatch, kind):
    """Zeros of either sign, NaN, nested keys, and text that differs in case are one key each."""
    monkeypatch.setattr(scan, "HOT_ROWS", 100)
    key = {"double": "CASE id % 4 WHEN 0 THEN 0D WHEN 1 THEN -0D WHEN 2 THEN double('NaN') END", "struct<x:bigint>": "named_struct('x', id % 3)", "array<bigint>": "array(id % 3)"}.get(kind, "CASE id % 2 WHEN 0 THEN 'Hot' ELSE 'hOT' END COLLATE UTF8_LCASE")
    df = spark.range(1200).selectExpr("id AS i", f"{key} AS k")
    got = {r.i: r.n for r in running(df, ["k"], "i", [Running("n", "count")]).collect()}
    assert got == {r.i: r.n for r in df.selectExpr("i", "count(*) OVER (PARTITION BY k ORDER BY i) AS n").collect()}
