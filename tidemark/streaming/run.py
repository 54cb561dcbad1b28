"""Running unbounded pipelines over what is there, and watching them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.plans.graph import RestartStrategy
from tidemark.session import ROCKSDB
from tidemark.shared import folder


def available_now(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run ``df`` through ``sink`` until all data that is there has been read."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def collected(df: DataFrame, name: str = "stream", mode: str = "append") -> DataFrame:
    """The rows that an unbounded stream gives for all data that is there, through a staged sink.

    With ``update`` and ``complete`` each batch is kept with its id in ``batch_id``.
    """
    from pyspark.sql import functions as F

    from tidemark.streaming.exactly_once import StagedSink

    spark = df.sparkSession
    sink = StagedSink(folder(spark, name))
    write = sink if mode == "append" else lambda rows, batch: sink(rows.withColumn("batch_id", F.lit(batch)), batch)
    available_now(df, write, folder(spark, f"{name}-checkpoint"), mode)
    schema = df.schema if mode == "append" else df.schema.add("batch_id", "long")
    return sink.read(spark, schema)


def with_restarts(start: Callable[[], StreamingQuery], strategy: RestartStrategy, sleep: Callable[[float], None] = time.sleep) -> int:
    """Start a query and wait for it; after a failure start it again, from its checkpoint. The number of restarts."""
    attempts = 0
    while True:
        try:
            start().awaitTermination()
            return attempts
        except StreamingQueryException:
            if strategy.kind == "none" or attempts >= strategy.max_attempts:
                raise
            attempts += 1
            sleep(strategy.delay_ms / 1000)


@dataclass
class Metrics:
    """Records and batches per query, and records a second over its run time."""

    records: int = 0
    batches: int = 0
    ms: int = 0

    @property
    def throughput(self) -> float:
        return 1000 * self.records / self.ms if self.ms else 0.0


class MetricsListener(StreamingQueryListener):
    def __init__(self):
        self.by_query: dict[str, Metrics] = {}

    def onQueryStarted(self, event) -> None:
        self.by_query.setdefault(str(event.id), Metrics())

    def onQueryProgress(self, event) -> None:
        m = self.by_query.setdefault(str(event.progress.id), Metrics())
        m.records += event.progress.numInputRows
        m.batches += 1
        m.ms += event.progress.batchDuration

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
