"""Shared helpers of the training-data operators: tables, free column names, bounded samples, runs of rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import discard, folder
from tidemark.shared import written as written_at_once

__all__ = ["bounded_sample", "crc_mod", "discard", "filter_by_text", "first_rows", "folder", "lean", "numbered", "read", "slices", "small_batches", "written"]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back."""
    with small_batches(df.sparkSession):
        return written_at_once(df, name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered(df: DataFrame) -> tuple[list[Column], list[Column]]:
    """The columns of ``df`` under names that no added column has, and these under their own names again."""
    names = [f"_{i}" for i in range(len(df.columns))]
    quoted = ["`" + c.replace("`", "``") + "`" for c in df.columns]
    return [F.col(c).alias(n) for c, n in zip(quoted, names, strict=True)], [F.col(n).alias(c) for c, n in zip(df.columns, names, strict=True)]


ArrowFunction = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: ArrowFunction) -> ArrowFunction:
    """``run``, which at its end gives free memory back to the system: a worker lives on and serves other operators."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> Iterator[None]:
    """Actions in this context hand Python batches of at most ``rows`` rows and about ``size`` bytes, as the executor
    holds several copies of a batch outside its heap."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    old = {key: spark.conf.get(key, None) for key in limits}
    try:
        for key, most in limits.items():
            if not old[key] or not old[key].isdigit() or not 0 < int(old[key]) <= most:
                spark.conf.set(key, most)
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def filter_by_text(docs: DataFrame, judge: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows of ``docs`` whose text the function that ``judge`` makes, once a task, says yes to."""
    columns, back = numbered(docs)
    rows, at = docs.select(*columns), [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = judge()
        for batch in batches:
            yield batch.filter(pa.array([good(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return rows.mapInArrow(lean(run), rows.schema).select(*back)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column's decimal text modulo n; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def first_rows(rows: DataFrame, most: int, *order: str) -> list[dict]:
    """At most ``most`` distinct rows, the first by ``order`` and then by all columns, whatever the partitioning."""
    rest = [c for c in rows.columns if c not in order]
    return rows.distinct().orderBy(*order, *rest).limit(most).toArrow().to_pylist()


def bounded_sample(df: DataFrame, key: str, label: str, per_label: int, seed: int, *columns: Column, most_labels: int = 64) -> list[dict]:
    """About ``per_label`` rows of each non-null label, never over twice that, chosen by a seeded hash of ``key``.

    The label counts come from one aggregation; the rows are picked by a hash threshold, so that no label,
    however frequent, is gathered in one task. Of more than ``most_labels`` labels the most frequent are taken, ties
    by name. Equal rows count once; if a key with many different rows would exceed the bound, the first rows by hash,
    key and content are taken. The result does not depend on the partitioning.
    """
    known = df.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(label).count().orderBy(F.desc("count"), label).limit(most_labels).collect()}
    if not counts:
        return []
    scale = 1 << 30
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(scale))
    chosen = F.lit(False)
    for value, n in sorted(counts.items(), key=lambda kv: str(kv[0])):
        chosen = chosen | ((F.col(label) == F.lit(value)) & (draw < F.lit(min(scale, -(-scale * per_label // n)))))
    rows = known.where(chosen).select(F.col(key).alias("key"), F.col(label).alias("label"), draw.alias("draw"), *columns)
    return first_rows(rows, 2 * per_label * len(counts), "draw", "key", "label")


def slices(batch: pa.RecordBatch, *columns: str, max_bytes: int = 1 << 19, max_rows: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most ``max_rows`` rows whose values in ``columns`` hold about ``max_bytes``; a
    longer value gets a run of its own."""
    sizes = [sum(x) for x in zip(*(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_pylist() for c in columns), strict=True)]
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and (held + n > max_bytes or i - at >= max_rows):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if len(sizes) > at:
        yield batch.slice(at)
