"""Sink builders: each has ``write(df, env)``; unbounded streams start a query, bounded ones write at once."""

from __future__ import annotations

import json
from dataclasses import dataclass
from enum import StrEnum
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ConfigError, ConnectorUnavailable
from tidemark.functions.codecs import StringCodec
from tidemark.sources.builders import KafkaConfig, _kafka
from tidemark.sources.sockets import Broadcaster, LineClient


class Delivery(StrEnum):
    AT_LEAST_ONCE = "at_least_once"
    EXACTLY_ONCE = "exactly_once"


def unquoted(text: str) -> str:
    """A JSON string's text; anything else as it is."""
    if len(text) > 1 and text[0] == text[-1] == '"':
        try:
            return str(json.loads(text))
        except ValueError:
            return text
    return text


def _stream(df: DataFrame, env, mode: str = "append"):
    writer = df.writeStream.outputMode(mode).queryName(env.graph.name.replace("-", "_") if env else "stream")
    if env:
        writer = writer.trigger(processingTime=f"{env.graph.config.checkpoint_interval_ms} milliseconds")
    return writer


@dataclass(frozen=True)
class ConsoleSink:
    prefix: str = "[SINK] "
    value: str = "value"
    mode: str = "append"

    def write(self, df: DataFrame, env=None) -> Any:
        if df.isStreaming:
            return _stream(df, env, self.mode).format("console").option("truncate", "false").start()
        n = 0
        for row in df.toLocalIterator():
            print(f"{self.prefix}{row[self.value] if self.value in df.columns else row}")
            n += 1
        return n


@dataclass(frozen=True)
class MemorySink:
    name: str
    mode: str = "append"

    def write(self, df: DataFrame, env=None) -> Any:
        if not df.isStreaming:
            return df.createOrReplaceTempView(self.name)
        return df.writeStream.outputMode(self.mode).format("memory").queryName(self.name).start()


@dataclass(frozen=True)
class FileSink:
    path: str
    format: str = "parquet"
    checkpoint: str | None = None

    def write(self, df: DataFrame, env=None) -> Any:
        if not df.isStreaming:
            return df.write.mode("append").format(self.format).save(self.path)
        if not self.checkpoint:
            raise ConfigError("a streaming file sink needs a checkpoint folder")
        return _stream(df, env).format(self.format).option("path", self.path).option("checkpointLocation", self.checkpoint).start()


@dataclass(frozen=True)
class BatchSink:
    """A function on (DataFrame, batch id), such as an ``exactly_once`` writer."""

    function: Any
    checkpoint: str | None = None
    mode: str = "append"

    def write(self, df: DataFrame, env=None) -> Any:
        if not df.isStreaming:
            return self.function(df, 0)
        writer = _stream(df, env, self.mode).foreachBatch(self.function)
        return (writer.option("checkpointLocation", self.checkpoint) if self.checkpoint else writer).start()


@dataclass(frozen=True)
class SocketSink:
    """Lines of text: ``client`` writes to one peer, ``server`` to all that are connected. Sent by the driver, in
    row order, a batch at a time without holding it."""

    host: str
    port: int
    mode: str = "server"
    value: str = "value"

    def open(self) -> LineClient | Broadcaster:
        if self.mode not in ("server", "client"):
            raise ConfigError(f"unknown socket mode {self.mode!r}")
        return Broadcaster(self.host, self.port) if self.mode == "server" else LineClient(self.host, self.port)

    def write(self, df: DataFrame, env=None) -> Any:
        peer = self.open()

        def send(batch: DataFrame, _: int) -> None:
            lines: list[str] = []
            for row in batch.select(F.col(self.value).cast("string")).toLocalIterator():
                lines.append(unquoted(row[0] or ""))
                if len(lines) == 1000:
                    peer.send(lines)
                    lines = []
            peer.send(lines)

        if df.isStreaming:
            return _stream(df, env, "update").foreachBatch(send).start()
        send(df, 0)
        return peer.close()


@dataclass(frozen=True)
class KafkaSink:
    """Records to a topic, acknowledged by all replicas. Spark's Kafka sink delivers at least once; exactly once
    needs a consumer that drops repeated ``batch_id`` headers, or ``streaming.exactly_once``."""

    brokers: str
    topic: str
    codec: object = StringCodec()
    value: str = "value"
    key: str | None = None
    delivery: Delivery = Delivery.AT_LEAST_ONCE
    transactional_id_prefix: str | None = None
    checkpoint: str | None = None
    config: KafkaConfig | None = None

    def options(self) -> dict[str, str]:
        base = (self.config or KafkaConfig(self.brokers)).options() | {"topic": self.topic, "kafka.acks": "all", "kafka.enable.idempotence": "true"}
        if self.delivery is Delivery.EXACTLY_ONCE:
            base["includeHeaders"] = "true"
        return base | ({"checkpointLocation": self.checkpoint} if self.checkpoint else {})

    def payload(self, df: DataFrame, batch: int | None = None) -> DataFrame:
        """Value, key and, for ``batch``, the header that tells a consumer which records came before."""
        value = self.codec.encode(F.col(self.value) if self.value in df.columns else F.struct(*df.columns))
        key = [F.col(self.key).cast("binary").alias("key")] if self.key else []
        name = f"{self.transactional_id_prefix}-{batch}" if self.transactional_id_prefix else str(batch)
        header = F.array(F.struct(F.lit("batch_id").alias("key"), F.lit(name).cast("binary").alias("value"))).alias("headers")
        return df.select(*key, value.alias("value"), *([header] if batch is not None else []))

    def write(self, df: DataFrame, env=None) -> Any:
        once = self.delivery is Delivery.EXACTLY_ONCE
        send = lambda rows, batch: self.payload(rows, batch if once else None).write.format("kafka").options(**self.options()).save()
        if not df.isStreaming:
            return _kafka(lambda: send(df, 0))
        if once:
            query = _stream(df, env, "update").foreachBatch(send)
            return _kafka(lambda: (query.option("checkpointLocation", self.checkpoint) if self.checkpoint else query).start())
        return _kafka(lambda: _stream(self.payload(df), env, "update").format("kafka").options(**self.options()).start())


@dataclass(frozen=True)
class PulsarSink:
    url: str
    topic: str

    def write(self, df: DataFrame, env=None) -> Any:
        raise ConnectorUnavailable("there is no Pulsar connector")
