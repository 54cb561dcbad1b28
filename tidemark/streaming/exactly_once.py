"""Two-phase sinks and duplicate tracking.

A transaction is begun, written, pre-committed with a checkpoint's id, and committed when the checkpoint is
complete or aborted when it failed. On Spark a checkpoint is a micro-batch: ``StagedSink`` stages a batch's files and
publishes them by one marker named by the batch id, so a batch that is run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.errors import StateError


class TransactionalSink(Protocol):
    def begin(self) -> str: ...

    def write(self, transaction: str, records: Iterable[Any]) -> None: ...

    def pre_commit(self, transaction: str) -> None: ...

    def commit(self, transaction: str) -> None: ...

    def abort(self, transaction: str) -> None: ...

    def recover(self, pending: Iterable[str]) -> None: ...


class MemoryTransactions:
    """Records are visible after commit only; recovery commits what was pre-committed."""

    def __init__(self):
        self.committed: list = []
        self.open: dict[str, list] = {}
        self.ready: dict[str, list] = {}
        self._n = 0

    def begin(self) -> str:
        self._n += 1
        self.open[f"txn-{self._n}"] = []
        return f"txn-{self._n}"

    def write(self, transaction: str, records: Iterable[Any]) -> None:
        if transaction not in self.open:
            raise StateError(f"{transaction} is not open")
        self.open[transaction].extend(records)

    def pre_commit(self, transaction: str) -> None:
        if transaction not in self.open:
            raise StateError(f"{transaction} is not open")
        self.ready[transaction] = self.open.pop(transaction)

    def commit(self, transaction: str) -> None:
        self.committed += self.ready.pop(transaction, [])

    def abort(self, transaction: str) -> None:
        self.open.pop(transaction, None)
        self.ready.pop(transaction, None)

    def recover(self, pending: Iterable[str]) -> None:
        for t in pending:
            self.commit(t)


@dataclass
class ExactlyOnceWriter:
    """Drives a transactional sink by barriers: pre-commit at the barrier, commit when it is complete."""

    sink: TransactionalSink
    current: str | None = None
    pending: dict[int, str] = field(default_factory=dict)

    def write(self, *records: Any) -> None:
        if self.current is None:
            self.current = self.sink.begin()
        self.sink.write(self.current, records)

    def barrier(self, checkpoint: int) -> None:
        if self.current is not None:
            self.sink.pre_commit(self.current)
            self.pending[checkpoint] = self.current
        self.current = self.sink.begin()

    def complete(self, checkpoint: int) -> None:
        for n in sorted(k for k in self.pending if k <= checkpoint):
            self.sink.commit(self.pending.pop(n))

    def failed(self, checkpoint: int) -> None:
        if checkpoint in self.pending:
            self.sink.abort(self.pending.pop(checkpoint))

    def end(self) -> None:
        for n in sorted(self.pending):
            self.sink.commit(self.pending.pop(n))
        if self.current is not None:
            self.sink.pre_commit(self.current)
            self.sink.commit(self.current)
            self.current = None


class IdempotentTracker:
    """Record ids per checkpoint; keeps those of the last ``keep`` checkpoints."""

    def __init__(self, keep: int = 3):
        self.keep, self.seen = keep, {}

    def mark(self, checkpoint: int, record: str) -> bool:
        """Whether the record is new to the checkpoint."""
        ids = self.seen.setdefault(checkpoint, set())
        new = record not in ids
        ids.add(record)
        return new

    def is_duplicate(self, checkpoint: int, record: str) -> bool:
        return record in self.seen.get(checkpoint, set())

    def cleanup(self) -> None:
        if self.seen:
            least = max(self.seen) - self.keep
            self.seen = {c: ids for c, ids in self.seen.items() if c >= least}

    def snapshot(self) -> dict[int, list[str]]:
        return {c: sorted(ids) for c, ids in self.seen.items()}

    def restore(self, snapshot: dict[int, list[str]]) -> None:
        self.seen = {int(c): set(ids) for c, ids in snapshot.items()}


def distinct_writes(df: DataFrame, checkpoint: str, record: str, order: str) -> DataFrame:
    """The first row, by ``order``, of each record id within a checkpoint; on a stream, of each id within the watermark."""
    if df.isStreaming:
        return df.dropDuplicatesWithinWatermark([checkpoint, record])
    first = df.groupBy(checkpoint, record).agg(F.min_by(F.struct(*df.columns), order).alias("_r"))
    return first.select("_r.*")


class StagedSink:
    """Writes each batch as Parquet below ``path/data/tidemark_batch=<id>`` and publishes it by ``path/committed/<id>``.

    Paths go through Hadoop's file systems, so any store that Spark writes to will do. Readers see published
    batches only. Every ``COMPACT`` batches the markers without a gap become one, ``upto=<id>``, so neither a write nor a
    read lists what a long life has left.
    """

    COMPACT = 100

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _fs(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    def _markers(self, spark: SparkSession) -> tuple[int, set[int]]:
        """All ids below the first number are published, and those of the set."""
        fs, p = self._fs(spark, f"{self.path}/committed")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        whole = max((int(n.removeprefix("upto=")) + 1 for n in names if n.startswith("upto=")), default=0)
        return whole, {int(n) for n in names if n.isdigit() and int(n) >= whole}

    def committed(self, spark: SparkSession) -> list[int]:
        whole, more = self._markers(spark)
        return [*range(whole), *sorted(more)]

    def _data(self, batch: int) -> str:
        return f"{self.path}/data/tidemark_batch={batch}"

    def stage(self, df: DataFrame, batch: int) -> None:
        """Pre-commit: all files of the batch, replacing those of an attempt that failed."""
        df.write.mode("overwrite").parquet(self._data(batch))

    def publish(self, spark: SparkSession, batch: int) -> None:
        fs, p = self._fs(spark, f"{self.path}/committed/{batch}")
        fs.create(p, True).close()
        if (batch + 1) % self.COMPACT == 0:
            self._compact(spark)

    def _compact(self, spark: SparkSession) -> None:
        whole, more = self._markers(spark)
        end = whole
        while end in more:
            end += 1
        if end > whole:
            fs, p = self._fs(spark, f"{self.path}/committed/upto={end - 1}")
            fs.create(p, True).close()
            for name in (*([f"upto={whole - 1}"] if whole else []), *map(str, range(whole, end))):
                fs, p = self._fs(spark, f"{self.path}/committed/{name}")
                fs.delete(p, False)

    def abort(self, spark: SparkSession, batch: int) -> None:
        fs, p = self._fs(spark, self._data(batch))
        fs.delete(p, True)

    def __call__(self, df: DataFrame, batch: int) -> None:
        """For ``foreachBatch``: a batch that is already published is left alone."""
        spark = df.sparkSession
        whole, more = self._markers(spark)
        if batch < whole or batch in more:
            return
        self.stage(df, batch)
        self.publish(spark, batch)

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """The published batches: one folder, of which the id, a partition column, leaves out what is not published."""
        whole, more = self._markers(spark)
        if not whole and not more:
            return spark.createDataFrame([], schema)
        at = F.col("tidemark_batch")
        rows = spark.read.schema(StructType([*schema.fields, StructField("tidemark_batch", LongType())])).parquet(f"{self.path}/data")
        return rows.where((at < whole) | at.isin(sorted(more))).select(*schema.names)
