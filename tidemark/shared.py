"""Folders and tables that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import ConfigError


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Where that is unset a local one is made, but only if driver and executors are one process: a cluster without
    a shared folder is refused, as its executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the driver ends."""
    store, p = _store(spark, path)
    store.deleteOnExit(p)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back. It goes by ``discard``, or with the driver."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    delete_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing will read any more; other tables are left alone."""
    for df in tables:
        path = getattr(df, "__dict__", {}).get("_written_to")
        if path:
            store, p = _store(df.sparkSession, path)
            store.delete(p, True)
