"""The registered queries of the engine and their DuckDB SQL, side by side."""

from __future__ import annotations

import asyncio
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.functions import scalars
from tidemark.functions.codecs import JsonCodec, codec, decode
from tidemark.functions.udf import KeySelector, register
from tidemark.operators.scan import Running, running
from tidemark.operators.stream import DataStream, StreamEnvironment
from tidemark.plans.job import compile_job
from tidemark.shared import folder, written
from tidemark.sources.builders import Generator
from tidemark.streaming.exactly_once import StagedSink, distinct_writes
from tidemark.streaming.run import available_now, collected
from tidemark.streaming.stateful import Context, Processor, RunningCount

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY, HOUR = 86_400_000, 3_600_000
_CENTS = "CAST(round(value * 100) AS BIGINT)"
_BUCKET = "to_timestamp(floor(epoch(ts) / {s}) * {s})::TIMESTAMP"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def cents() -> F.Column:
    return F.round(F.col("value") * 100).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str, **names) -> DataStream:
    return StreamEnvironment(spark).parquet(f"{sf_dir}/{name}.parquet", **names)


def events(spark: SparkSession, sf_dir: str) -> DataStream:
    return table(spark, sf_dir, "events", value="event_type", time="ts", order="event_id")


def with_cents(s: DataStream, *columns: str) -> DataStream:
    return s.select(*columns, cents().alias("cents"))


def parts(spark: SparkSession, sf_dir: str) -> DataStream:
    return table(spark, sf_dir, "part", value="p_name").select("p_partkey", "p_name")


def texts(spark: SparkSession, sf_dir: str) -> DataStream:
    return table(spark, sf_dir, "documents", value="text", order="doc_id").select("doc_id", "text")


# Named functions

for _name, _sql in {
    "uppercase": "upper(p_name)", "lowercase": "lower(p_name)", "reverse": "reverse(p_name)", "identity": "p_name",
    "word_count": r"p_name || ' -> ' || len(regexp_extract_all(p_name, '\S+')) || ' words'",
}.items():

    def _map(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        return parts(spark, sf_dir).map(name, to="result").select("p_partkey", "result").df

    _map.__name__ = f"map_{_name}"
    query(f"SELECT p_partkey, {_sql} AS result FROM part")(_map)


@query(r"SELECT doc_id, word FROM (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS word FROM documents) WHERE word <> ''")
def flatmap_split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).flat_map("split_words", to="word").select("doc_id", "word").df


@query(
    "SELECT doc_id, line FROM (SELECT doc_id, parts, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM"
    r" (SELECT doc_id, string_split_regex(text, '\r?\n') AS parts FROM documents)) WHERE NOT (i = len(parts) AND line = '')"
)
def flatmap_split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).flat_map("split_lines", to="line").select("doc_id", "line").df


@query("SELECT p_partkey, trim(unnest(string_split(p_name || ', ' || p_brand || ',,' || p_type, ','))) AS field FROM part")
def flatmap_split_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(", "), "p_brand", F.lit(",,"), "p_type").alias("value"))
    return s.flat_map("split_csv", to="field").select("p_partkey", "field").df


for _name, _value, _sql in (
    ("non_empty", "", r"regexp_matches(p_name, '\S')"), ("contains", "an", "contains(p_name, 'an')"), ("starts_with", "b", "starts_with(p_name, 'b')"),
    ("ends_with", "e", "ends_with(p_name, 'e')"), ("min_length", "11", "strlen(p_name) >= 11"),
):

    def _filter(spark: SparkSession, sf_dir: str, name: str = _name, value: str = _value) -> DataFrame:
        return parts(spark, sf_dir).filter(name, value).df

    _filter.__name__ = f"filter_{_name}"
    query(f"SELECT p_partkey, p_name FROM part WHERE {_sql}")(_filter)

_WORDS = r"(SELECT doc_id, pos, lower(w) AS word FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents)))"


def word_stream(spark: SparkSession, sf_dir: str) -> DataStream:
    s = texts(spark, sf_dir).flat_map("split_lower_words", to="word", position="pos")
    return s.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "word", (F.col("doc_id") * (1 << 24) + F.col("pos")).alias("arrival"))


@query(f"SELECT word, count(*) AS n FROM {_WORDS} GROUP BY word")
def wordcount_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_stream(spark, sf_dir).key_by("word").totals(F.count("*").alias("n")).df


@query(f"SELECT doc_id, pos, word, count(*) OVER (PARTITION BY word ORDER BY doc_id, pos ROWS UNBOUNDED PRECEDING) AS n FROM {_WORDS}")
def wordcount_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = word_stream(spark, sf_dir)
    s = DataStream(s.env, s.df, s.vertex, "word", None, "arrival")
    return s.key_by("word").count("n").select("doc_id", "pos", "word", "n").df


@query(f"SELECT word || ':' || count(*) || ' (ts=' || max(doc_id) || ')' AS line FROM {_WORDS} GROUP BY word")
def wordcount_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = word_stream(spark, sf_dir).key_by("word").totals(F.count("*").alias("n"), F.max("doc_id").alias("ts"))
    return counted.select(F.format_string("%s:%d (ts=%d)", "word", "n", "ts").alias("line")).df


@query("SELECT p_partkey, CASE WHEN length(p_type || ' ' || p_name) <= 20 THEN p_type || ' ' || p_name ELSE substr(p_type || ' ' || p_name, 1, 17) || '...' END AS line FROM part")
def truncate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "p_type", "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.truncate(text, 20).alias("line")).df


@query(
    "SELECT p_partkey, CASE WHEN n = 0 THEN '(empty line)' ELSE (CASE WHEN length(p_name) <= 40 THEN p_name ELSE substr(p_name, 1, 37) || '...' END) || ' -> ' || n || CASE WHEN n = 1 THEN ' word' ELSE ' words' END END AS line"
    r" FROM (SELECT *, len(regexp_extract_all(p_name, '\S+')) AS n FROM part)"
)
def line_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).map("line_summary", to="line").select("p_partkey", "line").df


@query(f"SELECT word, count(*) AS n FROM {_WORDS} GROUP BY word ORDER BY n DESC, word LIMIT 10")
def topk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of ten rows: the limit is the feature."""
    return wordcount_final(spark, sf_dir).orderBy(F.desc("n"), "word").limit(10)


@query(f"SELECT count(*) AS n_words, count(DISTINCT word) AS n_unique FROM {_WORDS}")
def word_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = wordcount_final(spark, sf_dir)
    return counts.agg(F.sum("n").alias("n_words"), F.count("*").alias("n_unique"))


@query(
    f"WITH w AS {_WORDS}, lines AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), firsts AS (SELECT doc_id, count(*) AS n FROM (SELECT word, min(doc_id) AS doc_id FROM w GROUP BY word) GROUP BY doc_id)"
    " SELECT doc_id, (sum(lines.n) OVER o)::BIGINT AS n_words, (sum(coalesce(firsts.n, 0)) OVER o)::BIGINT AS n_unique FROM lines LEFT JOIN firsts USING (doc_id) WINDOW o AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)"
)
def word_summary_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each text the words and the different words so far: a word is new in the first text that holds it."""
    words = word_stream(spark, sf_dir)
    lines = words.key_by("doc_id").totals(F.count("*").alias("n")).df
    firsts = words.key_by("word").totals(F.min("doc_id").alias("doc_id")).df.groupBy("doc_id").agg(F.count("*").alias("new"))
    both = written(lines.join(firsts, "doc_id", "left").select("doc_id", "n", F.coalesce("new", F.lit(0).cast("long")).alias("new")), "summary")
    return running(both, [], "doc_id", [Running("n_words", "sum", "n"), Running("n_unique", "sum", "new")]).select("doc_id", "n_words", "n_unique")


@query(r"SELECT i AS arrival, upper(w) AS value FROM (SELECT unnest(['to', 'be', 'or', 'not', 'to', 'be']) AS w, unnest(range(6)) AS i) WHERE w <> 'or'")
def collection_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = StreamEnvironment(spark).from_collection(["to", "be", "or", "not", "to", "be"], "string")
    return s.filter(F.col("value") != "or").map("uppercase").select("arrival", "value").df


# Running aggregates

_RUN = "OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT event_id, event_type, count(*) {_RUN} AS n FROM events")
def key_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).key_by("event_type").count("n").select("event_id", "event_type", "n").df


@query(f"SELECT event_id, event_type, (sum({_CENTS}) {_RUN})::BIGINT AS total FROM events")
def reduce_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_cents(events(spark, sf_dir), "event_id", "event_type")
    return s.key_by("event_type").reduce("sum", "cents", "total").select("event_id", "event_type", "total").df


@query(f"SELECT event_id, event_type, min(value) {_RUN} AS least FROM events")
def running_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).key_by("event_type").min("value", "least").select("event_id", "event_type", "least").df


@query(f"SELECT event_id, event_type, max(value) {_RUN} AS greatest FROM events")
def running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).key_by("event_type").max("value", "greatest").select("event_id", "event_type", "greatest").df


@query(f"SELECT event_id, event_type, (min({{'v': value, 'e': event_id, 'u': user_id}}) {_RUN}).u AS user_id FROM events")
def running_min_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).select("event_id", "event_type", "value", F.col("user_id").alias("u"))
    return s.key_by("event_type").min_by("value", "u", "user_id").select("event_id", "event_type", "user_id").df


@query(f"SELECT event_id, event_type, (max({{'v': value, 'e': -event_id, 'u': user_id}}) {_RUN}).u AS user_id FROM events")
def running_max_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).select("event_id", "event_type", "value", F.col("user_id").alias("u"))
    return s.key_by("event_type").max_by("value", "u", "user_id").select("event_id", "event_type", "user_id").df


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events")
def global_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).count("n").select("event_id", "n").df


# Windows

_DAYS = f"{_BUCKET.format(s=86400)} AS window_start, ({_BUCKET.format(s=86400)} + INTERVAL 1 DAY) AS window_end"


@query(f"SELECT window_start, window_end, event_type, sum(2 * c)::BIGINT AS total FROM (SELECT {_DAYS}, event_type, {_CENTS} AS c FROM events WHERE value > 100) GROUP BY ALL")
def demo_filter_map_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).filter(F.col("value") > 100).select("ts", "event_type", (cents() * 2).alias("cents"))
    return s.key_by("event_type").tumbling_window(DAY).sum("cents", "total").df


@query(f"SELECT window_start, window_end, event_type, sum(c)::BIGINT AS total FROM (SELECT {_DAYS}, event_type, {_CENTS} AS c FROM events) GROUP BY ALL")
def tumbling_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cents(events(spark, sf_dir), "ts", "event_type").key_by("event_type").tumbling_window(DAY).sum("cents", "total").df


@query(
    "SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, event_type, sum(c)::BIGINT AS total FROM"
    f" (SELECT unnest([{_BUCKET.format(s=21600)} - i * INTERVAL 6 HOUR for i in range(4)]) AS w, event_type, {_CENTS} AS c FROM events) GROUP BY ALL"
)
def sliding_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cents(events(spark, sf_dir), "ts", "event_type").key_by("event_type").sliding_window(DAY, 6 * HOUR).sum("cents", "total").df


_SESSIONS = (
    "SELECT min(ts) AS window_start, date_trunc('millisecond', max(ts)) + INTERVAL 1 MILLISECOND AS window_end, user_id, sum(c)::BIGINT AS total FROM"
    " (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 21600000000 THEN 0 ELSE 1 END AS s"
    f" FROM (SELECT event_id, ts, user_id, {_CENTS} AS c FROM events))) GROUP BY user_id, g"
)


@query(_SESSIONS)
def session_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cents(events(spark, sf_dir), "ts", "user_id").key_by("user_id").session_window(6 * HOUR).sum("cents", "total").df


@query(f"SELECT event_type, sum({_CENTS})::BIGINT AS total FROM events GROUP BY event_type")
def global_window_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cents(events(spark, sf_dir), "event_type").key_by("event_type").global_window().sum("cents", "total").df


@query(
    "SELECT window_index, user_id, sum(c)::BIGINT AS total FROM (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS window_index,"
    f" {_CENTS} AS c FROM events) GROUP BY ALL HAVING count(*) = 10"
)
def count_window_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cents(events(spark, sf_dir), "event_id", "user_id").key_by("user_id").count_window(10).sum("cents", "total").df


@query(f"SELECT window_start, window_end, event_type, max(value) AS greatest FROM (SELECT {_DAYS}, event_type, value FROM events) GROUP BY ALL")
def window_reduce_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).key_by("event_type").tumbling_window(DAY).reduce("max", "value", "greatest").df


@query(f"SELECT window_start, window_end, event_type, count(*) AS n FROM (SELECT {_DAYS}, event_type FROM events) GROUP BY ALL")
def window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).key_by("event_type").tumbling_window(DAY).count("n").df


@query(f"SELECT window_start, window_end, event_type, sum(c)::BIGINT // count(*) AS mean_cents FROM (SELECT {_DAYS}, event_type, {_CENTS} AS c FROM events) GROUP BY ALL")
def window_aggregate_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_cents(events(spark, sf_dir), "ts", "event_type").key_by("event_type").tumbling_window(DAY)
    return s.aggregate(F.expr("sum(cents) div count(*)").alias("mean_cents")).df


@query(
    f"SELECT window_start, window_end, event_type, rank::INTEGER AS rank, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY window_start, event_type ORDER BY n DESC, user_id) AS rank FROM"
    f" (SELECT window_start, window_end, event_type, user_id, count(*) AS n FROM (SELECT {_DAYS}, event_type, user_id FROM events) GROUP BY ALL)) WHERE rank <= 3"
)
def window_process_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = events(spark, sf_dir).key_by("event_type", "user_id").tumbling_window(DAY).count("n")
    s = DataStream(counted.env, counted.df, counted.vertex, time="window_start")
    return s.key_by("event_type").tumbling_window(DAY).top(3, F.desc("n"), "user_id", "n").df


# Late events: arrival is shuffled within runs of fifty

_ARRIVAL = "(event_id // 50) * 50 + (event_id * 37) % 50"
_MARKED = (
    "(SELECT *, coalesce(epoch_ms(ts) <= last_value(wm IGNORE NULLS) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM"
    " (SELECT *, CASE WHEN i % 20 = 0 THEN max(epoch_ms(ts)) OVER (ORDER BY arrival ROWS UNBOUNDED PRECEDING) - 3600000 END AS wm FROM"
    f" (SELECT *, {_ARRIVAL} AS arrival, row_number() OVER (ORDER BY {_ARRIVAL}) AS i FROM events)))"
)


def _late(spark: SparkSession, sf_dir: str) -> tuple[DataStream, DataStream]:
    arrival = F.expr("(event_id div 50) * 50 + (event_id * 37) % 50").alias("arrival")
    s = events(spark, sf_dir).select("*", arrival)
    return DataStream(s.env, s.df, s.vertex, s.value, "ts", "arrival").late(20, HOUR)


@query(f"SELECT window_start, window_end, event_type, count(*) AS n FROM (SELECT {_DAYS}, event_type FROM {_MARKED} WHERE NOT late) GROUP BY ALL")
def late_drop_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _late(spark, sf_dir)[0].key_by("event_type").tumbling_window(DAY).count("n").df


@query(f"SELECT event_id, arrival, ts FROM {_MARKED} WHERE late")
def late_events_side_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _late(spark, sf_dir)[1].select("event_id", "arrival", "ts").df


# Several streams


@query("SELECT event_id AS id, 'event' AS kind FROM events UNION ALL SELECT o_orderkey, 'order' FROM orders UNION ALL SELECT o_orderkey, 'order' FROM orders WHERE o_orderstatus = 'F'")
def union_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = events(spark, sf_dir).select(F.col("event_id").alias("id"), F.lit("event").alias("kind"))
    orders = table(spark, sf_dir, "orders")
    b = orders.select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"))
    c = orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"))
    return a.union(b, c).df


@query("SELECT event_id AS id, upper(event_type) AS label FROM events UNION ALL SELECT o_orderkey, lower(o_orderpriority) FROM orders")
def connect_comap(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = events(spark, sf_dir).connect(table(spark, sf_dir, "orders"))
    return both.map([F.col("event_id").alias("id"), F.upper("event_type").alias("label")], [F.col("o_orderkey").alias("id"), F.lower("o_orderpriority").alias("label")]).df


@query("SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'errors' WHEN value > 400 THEN 'large' END AS tag FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, event_type, 'large' FROM events WHERE value > 400 UNION ALL SELECT event_id, event_type, 'main' FROM events WHERE NOT (event_type = 'error') AND NOT (value > 400)")
def side_output_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir).side_output(errors=F.col("event_type") == "error", large=F.col("value") > 400)
    tagged = [s.select("event_id", "event_type", F.lit(tag).alias("tag")) for tag, s in out.items()]
    return tagged[0].union(*tagged[1:]).df


@query("SELECT o_orderkey, c_name, c_mktsegment, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey")
def keyed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "orders").key_by("o_custkey"), table(spark, sf_dir, "customer").key_by("c_custkey")
    return a.join(b).apply(F.col("a.o_orderkey"), F.col("b.c_name"), F.col("b.c_mktsegment"), F.col("a.o_orderpriority")).df


@query(
    "SELECT v.event_id AS view_id, p.event_id AS purchase_id, v.user_id FROM events v JOIN events p ON v.user_id = p.user_id"
    " AND floor(epoch(v.ts) / 3600) = floor(epoch(p.ts) / 3600) WHERE v.event_type = 'view' AND p.event_type = 'purchase'"
)
def windowed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir)
    views, purchases = s.filter(F.col("event_type") == "view").key_by("user_id"), s.filter(F.col("event_type") == "purchase").key_by("user_id")
    return views.join(purchases).window(HOUR).apply(F.col("a.event_id").alias("view_id"), F.col("b.event_id").alias("purchase_id"), F.col("a.user_id")).df


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def broadcast_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small sides are broadcast if their estimated size allows it, and shuffled otherwise."""
    nation = table(spark, sf_dir, "nation").broadcast().df.join(table(spark, sf_dir, "region").broadcast().df, F.expr("n_regionkey = r_regionkey"))
    s = table(spark, sf_dir, "customer")
    return s.df.join(nation, F.expr("c_nationkey = n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT n_name, count(*) AS n_orders, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_then_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are summed per customer before the join, so one row per customer is joined."""
    per_customer = table(spark, sf_dir, "orders").key_by("o_custkey").totals(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents")).df
    joined = per_customer.join(table(spark, sf_dir, "customer").df, F.expr("o_custkey = c_custkey")).join(table(spark, sf_dir, "nation").broadcast().df, F.expr("c_nationkey = n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum("n").alias("n_orders"), F.sum("cents").alias("cents"))


# Codecs and duplicates


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_decode_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(events(spark, sf_dir).df.select("event_id", "props"), JsonCodec("k BIGINT"), "props", "p").select("event_id", F.col("p.k").alias("k"))


@query("SELECT event_id, event_type, user_id FROM events")
def json_encode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = JsonCodec("event_id BIGINT, event_type STRING, user_id BIGINT")
    payload = events(spark, sf_dir).df.select(codec.encode(F.struct("event_id", "event_type", "user_id")).alias("value"))
    return decode(payload, codec).select("value.*")


@query("SELECT event_id, event_type, user_id, value FROM events")
def binary_encode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_codec = codec("bincode", "event_id BIGINT, event_type STRING, user_id BIGINT, value DOUBLE")
    payload = events(spark, sf_dir).df.select(with_codec.encode(F.struct("event_id", "event_type", "user_id", "value")).alias("value"))
    return decode(payload, with_codec).select("value.*")


@query("SELECT event_id // 100 AS checkpoint, event_id % 70 AS record, min(event_id) AS event_id FROM events GROUP BY ALL")
def idempotent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).df.select(F.expr("event_id div 100").alias("checkpoint"), (F.col("event_id") % 70).alias("record"), "event_id")
    return distinct_writes(rows.unionByName(rows.where("event_id % 3 = 0")), "checkpoint", "record", "event_id")


# User functions in Python


class Doubler:
    def map(self, value: int) -> int:
        return 2 * value


class Letters:
    def flat_map(self, value: str) -> list[str]:
        return value.split(" ")


class MeanOf:
    def create(self) -> list[int]:
        return [0, 0]

    def add(self, acc: list[int], value: int) -> list[int]:
        return [acc[0] + int(value), acc[1] + 1]

    def result(self, acc: list[int]) -> int:
        return acc[0] // max(1, acc[1])

    def merge(self, a: list[int], b: list[int]) -> list[int]:
        return [a[0] + b[0], a[1] + b[1]]


class Larger:
    def reduce(self, a: float, b: float) -> float:
        return max(a, b)


@query("SELECT p_partkey, 2 * p_partkey AS doubled FROM part")
def udf_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).map(Doubler(), on="p_partkey", to="doubled", returns=LongType()).select("p_partkey", "doubled").df


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def udtf_flatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).flat_map(Letters(), to="word").select("p_partkey", "word").df


@query(f"SELECT window_start, window_end, event_type, sum(c)::BIGINT // count(*) AS mean_cents FROM (SELECT {_DAYS}, event_type, {_CENTS} AS c FROM events) GROUP BY ALL")
def udaf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_cents(events(spark, sf_dir), "ts", "event_type").key_by("event_type").tumbling_window(DAY)
    return s.aggregate_with(MeanOf(), "cents", "long", "mean_cents").df


@query("SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS greatest FROM events")
def udf_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).select("event_id", "user_id", "value")
    return s.key_by("user_id").reduce(Larger(), "value", "greatest").select("event_id", "user_id", "greatest").df


class LongNames:
    def filter(self, value: str) -> bool:
        return len(value) > 12


@query("SELECT p_partkey, p_name FROM part WHERE length(p_name) > 12")
def udf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).filter(LongNames()).df


@query("SELECT substr(p_name, 1, 1) AS key, count(*) AS n FROM part GROUP BY ALL")
def key_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).key_by(KeySelector(lambda c: F.substring(c, 1, 1))).totals(F.count("*").alias("n")).df


@query(f"SELECT window_start, window_end, event_type, min(value) AS least FROM (SELECT {_DAYS}, event_type, value FROM events) GROUP BY ALL")
def window_reduce_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).key_by("event_type").tumbling_window(DAY).reduce(min, "value", "least").df


def rises(window: dict, rows: Iterator[dict]) -> Iterator[tuple]:
    """How often a value is above the one before it, and the last event of the window."""
    before = last = None
    n = 0
    for row in rows:
        n += before is not None and row["value"] > before
        before, last = row["value"], row["event_id"]
    yield n, last


@query(
    f"SELECT window_start, window_end, event_type, count(*) FILTER (value > before) AS n_rises, max(event_id) AS last_id FROM (SELECT {_DAYS}, event_type, event_id, value,"
    f" lag(value) OVER (PARTITION BY event_type, {_BUCKET.format(s=86400)} ORDER BY event_id) AS before FROM events) GROUP BY ALL"
)
def window_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).key_by("event_type").tumbling_window(DAY).process(rises, "n_rises long, last_id long").df


class Lookup:
    """Stands in for a service: the answer for a nation key."""

    async def invoke(self, value: int) -> str:
        await asyncio.sleep(0)
        return f"nation-{value}"

    def timeout(self, value: int) -> str:
        return "timeout"


@query("SELECT c_custkey, 'nation-' || c_nationkey AS result FROM customer")
def async_io_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").async_io_ordered(Lookup(), "string", on="c_nationkey").select("c_custkey", "result").df


@query("SELECT c_custkey, 'nation-' || c_nationkey AS result FROM customer")
def async_io_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").async_io_unordered(Lookup(), "string", on="c_nationkey").select("c_custkey", "result").df


@query("SELECT event_id, event_type FROM events")
def rebalance_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "event_type").rebalance(8).df


@query("SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY user_id")
def hash_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).key_by("user_id").totals(F.count("*").alias("n"), F.min("event_id").alias("first_id")).df


@query("SELECT p_partkey, upper(p_name) AS p_name FROM part")
def process_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).process_plugin("ToUppercase").df


@query("SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events")
def process_rich_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    class Numbered(RunningCount):
        def process(self, key: tuple, row: dict, context: Context) -> Iterator[tuple]:
            for _, n in super().process(key, row, context):
                yield row["event_id"], key[0], n

    s = events(spark, sf_dir).select("event_id", "event_type")
    return s.key_by("event_type").process(Numbered("event_id"), "event_id long, event_type string, n long").df


@register("LastThree")
class LastThree(Processor):
    """Each event with the sum of the last three of its user, kept in list state."""

    order, schema = "event_id", "event_id long, user_id long, total long"

    def open(self, context: Context) -> None:
        self.last = context.list("last", "bigint")

    def process(self, key: tuple, row: dict, context: Context) -> Iterator[tuple]:
        held = [*self.last.get(), row["cents"]][-3:]
        self.last.update(held)
        yield row["event_id"], key[0], sum(held)


_LAST_THREE = f"SELECT event_id, user_id, (sum({_CENTS}) OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING))::BIGINT AS total FROM events"


@query(_LAST_THREE)
def process_list_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stateful processor by its registered name."""
    return with_cents(events(spark, sf_dir), "event_id", "user_id").key_by("user_id").process_plugin_rich("LastThree").df


class Splitter(Processor):
    """Numbers a user's purchases; refunds of large amounts go to a side output."""

    order, schema = "event_id", "event_id long, n long"

    def open(self, context: Context) -> None:
        self.count = context.value("count", "bigint")

    def process(self, key: tuple, row: dict, context: Context) -> Iterator[tuple]:
        if row["value"] > 400:
            context.side_output("large", row["event_id"], key[0])
        if row["event_type"] == "purchase":
            n = (self.count.get() or 0) + 1
            self.count.set(n)
            yield row["event_id"], n


@query(
    "SELECT 'main' AS tag, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'large', event_id, user_id FROM events WHERE value > 400"
)
def process_side_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
    out = s.key_by("user_id").process_with_sides(Splitter(), {"large": "event_id long, user_id long"})
    large = out["large"].select(F.lit("large").alias("tag"), "event_id", F.col("user_id").alias("n"))
    return out["main"].select(F.lit("main").alias("tag"), "event_id", "n").union(large).df


# Unbounded streams, run over what is there


def live_events(spark: SparkSession, sf_dir: str) -> DataStream:
    """All events, whether the table is a file or a folder of files: a stream's path may be a file only as a pattern."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return StreamEnvironment(spark).parquet(f"{sf_dir}/{{events.parquet}}", True, schema, value="event_type", order="event_id")


@query(f"SELECT window_start, window_end, event_type, count(*) AS n, sum(c)::BIGINT AS total FROM (SELECT {_DAYS}, event_type, {_CENTS} AS c FROM events) GROUP BY ALL")
def stream_tumbling_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = live_events(spark, sf_dir).select("ts", "event_type", cents().alias("cents")).with_time("ts", "1 hour")
    out = s.key_by("event_type").tumbling_window(DAY).aggregate(F.count("*").alias("n"), F.sum("cents").alias("total")).df
    return _last(collected(out, "tumbling", "update"), ["window_start", "window_end", "event_type"])


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The latest row of each key of an update stream, times without zone."""
    columns = [c for c in rows.columns if c not in (*keys, "batch_id")]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch_id").alias("_r")).select(*keys, "_r.*")
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else c for c, kind in out.dtypes])


@query(_SESSIONS)
def stream_session_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of an unbounded stream have no update mode; all are given when the input is complete."""
    s = live_events(spark, sf_dir).select("ts", "user_id", cents().alias("cents")).with_time("ts")
    out = s.key_by("user_id").session_window(6 * HOUR).sum("cents", "total").df
    rows = collected(out, "sessions", "complete")
    last = rows.agg(F.max("batch_id").alias("batch_id"))
    rows = rows.join(last, "batch_id").drop("batch_id")
    return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else c for c, kind in rows.dtypes])


@query("SELECT e.event_id, e.event_type, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey")
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream enriched with a table."""
    s = live_events(spark, sf_dir)
    joined = s.key_by("user_id").join(table(spark, sf_dir, "customer").key_by("c_custkey")).apply(F.col("a.event_id"), F.col("a.event_type"), F.col("b.c_name"))
    return collected(joined.df, "join")


@query(
    "SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id"
    " AND floor(epoch(v.ts) / 3600) = floor(epoch(p.ts) / 3600) WHERE v.event_type = 'view' AND p.event_type = 'purchase'"
)
def stream_windowed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined within a window, watermarks on both."""
    views = live_events(spark, sf_dir).filter(F.col("event_type") == "view").with_time("ts", "1 hour").key_by("user_id")
    purchases = live_events(spark, sf_dir).filter(F.col("event_type") == "purchase").with_time("ts", "1 hour").key_by("user_id")
    joined = views.join(purchases).window(HOUR).apply(F.col("a.event_id").alias("view_id"), F.col("b.event_id").alias("purchase_id"))
    return collected(joined.df, "windowed-join")


class TypeCounter(Processor):
    """Each event with the number of events of its type so far."""

    order = "event_id"

    def open(self, context: Context) -> None:
        self.count = context.reducing("count", "bigint", lambda a, b: a + b)

    def process(self, key: tuple, row: dict, context: Context) -> Iterator[tuple]:
        yield row["event_id"], key[0], self.count.add(1)


@query(f"SELECT event_id, event_type, count(*) {_RUN} AS n FROM events")
def stream_rich_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = live_events(spark, sf_dir).select("event_id", "event_type")
    return collected(s.key_by("event_type").process(TypeCounter(), "event_id long, event_type string, n long").df, "counter")


@query(f"SELECT event_id, event_type, count(*) {_RUN} AS n FROM events")
def stream_counter_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same when the file holds the events in another order."""
    path = folder(spark, "shuffled")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    rows.orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(path)
    s = StreamEnvironment(spark).parquet(path, True, rows.schema, value="event_type", order="event_id")
    return collected(s.key_by("event_type").process(TypeCounter(), "event_id long, event_type string, n long").df, "counter")


@query(_LAST_THREE)
def stream_list_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = live_events(spark, sf_dir).select("event_id", "user_id", cents().alias("cents"))
    return collected(s.key_by("user_id").process("LastThree").df, "list-state")


@query(
    "SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id"
    " AND p.ts BETWEEN v.ts - INTERVAL 10 MINUTE AND v.ts + INTERVAL 2 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'"
)
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined within a bound of time, watermarks on both."""
    views = live_events(spark, sf_dir).filter(F.col("event_type") == "view").with_time("ts", "1 hour").key_by("user_id")
    purchases = live_events(spark, sf_dir).filter(F.col("event_type") == "purchase").with_time("ts", "1 hour").key_by("user_id")
    joined = views.join(purchases).within(600_000, 2 * HOUR).apply(F.col("a.event_id").alias("view_id"), F.col("b.event_id").alias("purchase_id"))
    return collected(joined.df, "interval-join")


class FirstSeen(Processor):
    """When a user is first seen, a timer is set; it reports the number of events up to then."""

    order = "event_id"

    def open(self, context: Context) -> None:
        self.count = context.value("count", "bigint")

    def process(self, key: tuple, row: dict, context: Context) -> Iterator[tuple]:
        n = self.count.get() or 0
        if not n:
            context.register_timer(FIRST_TIMER)
        self.count.set(n + 1)
        return iter(())

    def on_timer(self, key: tuple, at_ms: int, context: Context) -> Iterator[tuple]:
        yield key[0], at_ms, self.count.get()


FIRST_TIMER = 1_706_745_600_000  # 2024-02-01, after the last event


def replayed(spark: SparkSession, sf_dir: str, *columns: str) -> DataStream:
    """The events as a stream with event time, all in the first micro-batch: the files hold them in no order of time, and a
    watermark between two files would make rows of the second late. Beside them come two rows of the far future, in
    micro-batches of their own, whose watermark lets everything before them fire; nothing behind the watermark sees those."""
    path = folder(spark, "replay")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(*columns, F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(f"{path}/events")
    for year in (2200, 2201):
        last = spark.range(1).select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns], F.to_timestamp(F.lit(f"{year}-01-01")).alias("ts"))
        last.coalesce(1).write.mode("append").parquet(f"{path}/last")
    seen = spark.readStream.schema(rows.schema).parquet(f"{path}/events").withColumn("last", F.lit(False))
    last = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/last").withColumn("last", F.lit(True))
    s = StreamEnvironment(spark).from_dataframe(seen.union(last), "replay", "event_id", None, "event_id").with_time("ts", "0 seconds")
    # The time is part of the condition so that the optimizer leaves it behind the watermark.
    return s.filter(~(F.col("last") & (F.col("ts") >= F.lit("2200-01-01").cast("timestamp")))).select(*columns, "ts")


@query(f"SELECT user_id, {FIRST_TIMER} AS fired_at, count(*) AS n FROM events GROUP BY user_id")
def stream_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time timers of an unbounded stream fire behind the watermark."""
    s = replayed(spark, sf_dir, "event_id", "user_id")
    out = s.key_by("user_id").process(FirstSeen(), "user_id long, fired_at long, n long", time_mode="EventTime").df
    return collected(out, "timer")


@query(f"SELECT user_id, {FIRST_TIMER} AS fired_at, count(*) AS n FROM events GROUP BY user_id")
def bounded_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same processor on a bounded stream: timers fire at the end of the input, as by a last watermark."""
    s = events(spark, sf_dir).select("event_id", "user_id")
    return s.key_by("user_id").process(FirstSeen(), "user_id long, fired_at long, n long", time_mode="EventTime").df


@query(f"SELECT window_start, window_end, event_type, count(*) AS n FROM (SELECT {_DAYS}, event_type FROM events) GROUP BY ALL")
def stream_append_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window once, when the watermark has passed its end."""
    out = replayed(spark, sf_dir, "event_id", "event_type").key_by("event_type").tumbling_window(DAY).count("n").df
    rows = collected(out, "append")
    return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else c for c, kind in rows.dtypes])


class Balance(Processor):
    """Views and purchases of a user, counted in state that both sides share."""

    order = "event_id"

    def open(self, context: Context) -> None:
        self.seen = context.map("seen", "string", "bigint")

    def process(self, key: tuple, row: dict, context: Context) -> Iterator[tuple]:
        side = "views" if row["side"] == 1 else "purchases"
        self.seen.put(side, (self.seen.get(side) or 0) + 1)
        if row["side"] == 2:
            yield row["event_id"], key[0], self.seen.get("views") or 0, self.seen.get("purchases")


@query(
    "SELECT event_id, user_id, n_views::BIGINT AS n_views, n_purchases::BIGINT AS n_purchases FROM (SELECT *, count(*) FILTER (event_type = 'view') OVER w AS n_views, count(*) FILTER (event_type = 'purchase') OVER w AS n_purchases FROM events"
    " WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) WHERE event_type = 'purchase'"
)
def stream_coprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = live_events(spark, sf_dir).select("event_id", "user_id", "event_type")
    views, purchases = s.filter(F.col("event_type") == "view"), s.filter(F.col("event_type") == "purchase")
    both = views.connect(purchases).key_by("user_id", "user_id")
    return collected(both.process(Balance(), "event_id long, user_id long, n_views long, n_purchases long").df, "coprocess")


@query("SELECT event_id, event_type, value FROM events")
def stream_2pc_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch is written twice, as after a lost acknowledgement; what is published is there once."""
    df = live_events(spark, sf_dir).select("event_id", "event_type", "value").df
    sink = StagedSink(folder(spark, "2pc"))

    def twice(rows: DataFrame, batch: int) -> None:
        sink(rows, batch)
        sink(rows, batch)

    available_now(df, twice, folder(spark, "2pc-checkpoint"))
    return sink.read(spark, df.schema)


# Declared jobs


def _job(name: str, *operators: tuple[str, str, dict]) -> dict:
    vertices = [{"id": "source", "operator": "source", "connector": {"type": "collection"}}]
    vertices += [{"id": i, "operator": op, "config": config} for i, op, config in operators]
    vertices.append({"id": "sink", "operator": "sink", "connector": {"type": "console"}})
    ids = [v["id"] for v in vertices]
    return {"name": name, "vertices": vertices, "edges": [{"from": a, "to": b, "partition": "forward"} for a, b in zip(ids, ids[1:], strict=False)]}


@query(f"SELECT word || ':' || count(*) OVER (PARTITION BY word ORDER BY doc_id, pos ROWS UNBOUNDED PRECEDING) AS value FROM {_WORDS}")
def yaml_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = texts(spark, sf_dir).select(F.col("doc_id").alias("arrival"), F.col("text").alias("value")).df
    job = _job("wordcount", ("flatmap", "flatmap", {"function": "split_words"}), ("count", "count", {}))
    return compile_job(spark, job, {"source": lines})["sink"].select("value").df


@query("SELECT upper(p_name) AS value FROM part WHERE contains(p_name, 'a')")
def yaml_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parts(spark, sf_dir).select(F.col("p_name").alias("value")).df
    job = _job("echo", ("only", "filter", {"predicate": "contains", "value": "a"}), ("upper", "map", {"function": "uppercase"}))
    return compile_job(spark, job, {"source": lines})["sink"].select("value").df


@query("SELECT event_type AS value, max(event_type) OVER (ORDER BY event_id) AS value_reduced, event_id AS arrival FROM events")
def yaml_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared reduction of all rows, by a key that is the same for all."""
    lines = events(spark, sf_dir).select(F.col("event_type").alias("value"), F.col("event_id").alias("arrival"), F.lit(0).alias("one")).df
    job = _job("reduce", ("keyed", "key_by", {"key": "one"}), ("greatest", "reduce", {"key": "one", "function": "max"}))
    return compile_job(spark, job, {"source": lines})["sink"].select("value", "value_reduced", "arrival").df


@query("SELECT c_name || ' ' || n_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey")
def yaml_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared join of two sources."""
    source = lambda i: {"id": i, "operator": "source", "connector": {"type": "collection"}}
    job = {
        "name": "join",
        "vertices": [source("customers"), source("nations"), {"id": "both", "operator": "join", "config": {"left_key": "k", "right_key": "k"}}, {"id": "sink", "operator": "sink", "connector": {"type": "console"}}],
        "edges": [{"from": "customers", "to": "both"}, {"from": "nations", "to": "both"}, {"from": "both", "to": "sink"}],
    }
    sides = {
        "customers": table(spark, sf_dir, "customer").df.select(F.col("c_name").alias("value"), F.col("c_nationkey").alias("k")),
        "nations": table(spark, sf_dir, "nation").df.select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("k")),
    }
    return compile_job(spark, job, sides)["sink"].select("value").df


@query("SELECT list_extract(['hello', 'world', 'stream', 'streaming', 'data', 'rust', 'flink'], (i % 7 + 1)::INTEGER) AS value, i AS arrival FROM range(1000) t(i)")
def generator_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return StreamEnvironment(spark).add_source(Generator(100, 1000), time="timestamp", order="arrival").select("value", "arrival").df


@query()
def processing_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per wall-clock window: the rows depend on when it runs."""
    lines = parts(spark, sf_dir).select(F.col("p_name").alias("value")).df
    return compile_job(spark, _job("windows", ("window", "window", {"size_ms": 5000})), {"source": lines})["sink"].df
