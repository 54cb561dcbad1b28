"""Source builders: each has ``load(spark)`` and gives a DataFrame, unbounded unless said otherwise."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.errors import ConfigError, ConnectorUnavailable
from tidemark.functions.codecs import StringCodec, decode

# The words that the generator goes round.
GENERATOR_WORDS = ("hello", "world", "stream", "streaming", "data", "rust", "flink")


def parquet(spark: SparkSession, path: str, streaming: bool = False, schema: StructType | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    if streaming and schema is None:
        raise ConfigError("a streaming file source needs its schema")
    if schema is not None:
        reader = reader.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


@dataclass(frozen=True)
class Generator:
    """One word every ``rate_ms``, round and round; with ``rows``, that many at once as a bounded stream."""

    rate_ms: int = 100
    rows: int | None = None
    words: tuple[str, ...] = GENERATOR_WORDS

    def load(self, spark: SparkSession) -> DataFrame:
        if self.rate_ms < 1 or not self.words:
            raise ConfigError("the generator needs a positive rate and words")
        if self.rows is None:
            numbers = spark.readStream.format("rate").option("rowsPerSecond", max(1, 1000 // self.rate_ms)).load()
            numbers = numbers.select("timestamp", F.col("value").alias("arrival"))
        else:
            numbers = spark.range(self.rows).select(F.timestamp_millis(F.col("id") * self.rate_ms).alias("timestamp"), F.col("id").alias("arrival"))
        word = F.element_at(F.array(*map(F.lit, self.words)), (F.col("arrival") % len(self.words) + 1).cast("int"))
        return numbers.select("timestamp", "arrival", word.alias("value"))


@dataclass(frozen=True)
class SocketSource:
    """Lines of text over TCP: ``client`` connects, ``server`` listens and takes all connections."""

    host: str
    port: int
    mode: str = "server"
    max_connections: int = 10
    connect_timeout_ms: int = 5000
    read_timeout_ms: int = 0

    def check(self) -> None:
        if self.mode not in ("server", "client"):
            raise ConfigError(f"unknown socket mode {self.mode!r}")

    def load(self, spark: SparkSession) -> DataFrame:
        self.check()
        if self.mode == "client":
            return spark.readStream.format("socket").option("host", self.host).option("port", self.port).load()
        from tidemark.sources.sockets import LineServer, Spool
        from tidemark.streaming.run import folder

        spool = Spool(spark, LineServer(self.host, self.port, self.max_connections, self.read_timeout_ms), folder(spark, "socket"))
        return spark.readStream.text(spool.folder)


@dataclass(frozen=True)
class KafkaConfig:
    """Connection settings shared by source and sink."""

    brokers: str
    security_protocol: str | None = None
    sasl_mechanism: str | None = None
    sasl_username: str | None = None
    sasl_password: str | None = None
    properties: dict[str, str] = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        out = {"kafka.bootstrap.servers": self.brokers}
        if self.security_protocol:
            out["kafka.security.protocol"] = self.security_protocol
        if self.sasl_mechanism:
            out["kafka.sasl.mechanism"] = self.sasl_mechanism
        if self.sasl_username:
            module = "org.apache.kafka.common.security.plain.PlainLoginModule"
            out["kafka.sasl.jaas.config"] = f'{module} required username="{self.sasl_username}" password="{self.sasl_password}";'
        return out | {f"kafka.{k}": v for k, v in self.properties.items()}


def _kafka(action):
    try:
        return action()
    except Exception as e:
        if "Failed to find data source: kafka" in str(e) or "DATA_SOURCE_NOT_FOUND" in str(e):
            raise ConnectorUnavailable("Kafka needs the spark-sql-kafka package on the class path") from e
        raise


@dataclass(frozen=True)
class KafkaSource:
    """Records of a topic; ``codec`` decodes the payload, ``starting_offsets`` is earliest, latest or offsets per partition."""

    brokers: str
    topic: str
    group_id: str | None = None
    starting_offsets: str | dict = "earliest"
    codec: object = StringCodec()
    lateness: str | None = "5 seconds"
    config: KafkaConfig | None = None

    def options(self) -> dict[str, str]:
        offsets = self.starting_offsets if isinstance(self.starting_offsets, str) else json.dumps(self.starting_offsets)
        out = (self.config or KafkaConfig(self.brokers)).options() | {"subscribe": self.topic, "startingOffsets": offsets}
        return out | ({"kafka.group.id": self.group_id} if self.group_id else {})

    def load(self, spark: SparkSession) -> DataFrame:
        df = _kafka(lambda: spark.readStream.format("kafka").options(**self.options()).load())
        rows = decode(df.select("key", "value", "timestamp", "partition", "offset"), self.codec)
        return rows.withWatermark("timestamp", self.lateness) if self.lateness else rows


class Subscription(StrEnum):
    EXCLUSIVE = "Exclusive"
    SHARED = "Shared"
    FAILOVER = "Failover"
    KEY_SHARED = "KeyShared"


class Position(StrEnum):
    EARLIEST = "Earliest"
    LATEST = "Latest"


@dataclass(frozen=True)
class PulsarSource:
    """Settings only: there is no Pulsar client."""

    url: str
    topic: str
    subscription: str = "default"
    subscription_type: Subscription = Subscription.EXCLUSIVE
    initial_position: Position = Position.EARLIEST

    def load(self, spark: SparkSession) -> DataFrame:
        raise ConnectorUnavailable("there is no Pulsar connector")
