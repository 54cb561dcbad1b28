import pytest
from pyspark.sql import functions as F

from tidemark.errors import ConfigError, ConnectorUnavailable
from tidemark.functions import scalars, udf
from tidemark.functions.codecs import JsonCodec, StringCodec, codec, decode


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("name", "text", "expected"),
    [("uppercase", "añ", "AÑ"), ("lowercase", "ÄB", "äb"), ("reverse", "abc", "cba"), ("word_count", "to be or", "to be or -> 3 words"), ("word_count", "", " -> 0 words"), ("identity", " x", " x"),
     ("truncate", "a" * 41, "a" * 37 + "..."), ("truncate", "a" * 40, "a" * 40), ("line_summary", " \t", "(empty line)"), ("line_summary", "one", "one -> 1 word")],
)
def test_maps(spark, name, text, expected):
    assert one(spark, text, scalars.map_function(name)) == expected


@pytest.mark.parametrize(
    ("name", "text", "expected"),
    [("split_words", "  a  b ", ["a", "b"]), ("split_words", "a b c", ["a", "b", "c"]), ("split_words", "", []), ("split_lines", "a\r\nb\n", ["a", "b"]), ("split_lines", "", []), ("split_lines", "a\n\n", ["a", ""]),
     ("split_csv", "a, b,,c", ["a", "b", "", "c"]), ("split_lower_words", "A b", ["a", "b"]), ("identity", "x y", ["x y"])],
)
def test_flat_maps(spark, name, text, expected):
    assert one(spark, text, scalars.flat_map_function(name)) == expected


@pytest.mark.parametrize(
    ("name", "value", "text", "expected"),
    [("non_empty", "", "\t ", False), ("non_empty", "", " x", True), ("contains", "b", "abc", True), ("starts_with", "b", "abc", False), ("ends_with", "c", "abc", True),
     ("min_length", "3", "é", False), ("min_length", "3", "éa", True), ("min_length", "x", "", True), ("all", "", "", True)],
)
def test_predicates(spark, name, value, text, expected):
    assert one(spark, text, scalars.predicate(name, value)) is expected


@pytest.mark.parametrize("build", [scalars.map_function, scalars.flat_map_function, scalars.predicate, udf.registered, codec])
def test_unknown_names_raise(build):
    with pytest.raises(ConfigError):
        build("no such thing")


def test_codecs(spark):
    df = spark.createDataFrame([(b'{"a": 1}',), (b"{oops",)], "value binary")
    assert [r.value.a for r in decode(df, JsonCodec("a int")).collect()] == [1]
    assert decode(df, StringCodec()).count() == 2
    with pytest.raises(ConnectorUnavailable):
        decode(df, codec("avro", '"string"'))


def test_binary_codec(spark):
    """Bytes written out by hand, then a round trip of every type; what is cut off or broken is null."""
    length = lambda n: n.to_bytes(8, "little")
    words = codec("bincode", "word string not null, count bigint not null")
    good = length(3) + "añ".encode() + (7).to_bytes(8, "little")
    df = spark.createDataFrame([(good,), (good + b"more",), (good[:-1],), (length(1 << 62) + b"x",), (length(1) + b"\xff" + bytes(8),), (b"",), (None,)], "value binary")
    assert [tuple(r.value) for r in decode(df, words).collect()] == [("añ", 7)] * 2
    kind = "a tinyint, b smallint, c int, d bigint, e float, f double, g boolean, h string, i binary, j array<int>, k map<string,bigint>, l struct<m:string>"
    rows = [(-1, 2, -3, 1 << 62, 0.5, -0.25, True, "é", b"\x00", [1, 2], {"x": 5, "y": 6}, ("z",)), (None,) * 12, (0, 0, 0, 0, 0.0, 0.0, False, "", b"", [], {}, (None,))]
    df = spark.createDataFrame(rows, kind)
    both = codec("bincode", kind)
    packed = df.select(both.encode(F.struct(*df.columns)).alias("value"))
    assert packed.collect()[1].value == bytes(12)
    assert sorted(decode(packed, both).select("value.*").collect(), key=str) == sorted(df.collect(), key=str)
    counts = codec("bincode", "bigint")
    n = spark.createDataFrame([(5,), (None,)], "n int").select(counts.encode(F.col("n")).alias("value"))
    assert [r.value for r in n.collect()] == [length(5), None]
    assert [r.value for r in decode(n, counts).collect()] == [5]
    missing = spark.createDataFrame([(None, 1)], "word string, count bigint")
    assert missing.select(words.encode(F.struct("word", "count")).alias("value")).first().value is None
    with pytest.raises(ConfigError):
        codec("bincode", "at timestamp").decode(F.col("value"))


def test_registry():
    @udf.register("twice")
    class Twice:
        def map(self, value):
            return 2 * value

    assert isinstance(udf.registered("twice"), udf.MapFunction)
    assert udf.registered("twice").map(2) == 4
