"""Calls of an asynchronous user function: bounded concurrency, a timeout with fallback, ordered or not."""

from __future__ import annotations

import asyncio
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tidemark.functions.udf import AsyncFunction


async def _call_all(f: AsyncFunction, values: list[Any], ordered: bool, timeout: float, capacity: int) -> list[tuple[int, Any]]:
    """(position, result): by position if ``ordered``, else as they complete."""
    gate, done = asyncio.Semaphore(capacity), []

    async def one(i: int, value: Any) -> None:
        async with gate:
            try:
                out = await asyncio.wait_for(f.invoke(value), timeout)
            except TimeoutError:
                out = f.timeout(value)
            done.append((i, out))

    await asyncio.gather(*(one(i, v) for i, v in enumerate(values)))
    return sorted(done, key=lambda x: x[0]) if ordered else done


def call(df: DataFrame, f: AsyncFunction, on: str, to: str, returns: str, ordered: bool, timeout_ms: int, capacity: int) -> DataFrame:
    """``df`` with ``to``, the answer for each value of ``on``. Errors of ``f`` other than a timeout fail the task."""
    columns = [c for c in df.columns if c != to]
    schema = StructType([*[df.schema[c] for c in columns], StructField(to, _parse_datatype_string(returns))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = asyncio.run(_call_all(f, batch[on].tolist(), ordered, timeout_ms / 1000, capacity))
            out = batch[columns].iloc[[i for i, _ in found]].copy()
            out[to] = [x for _, x in found]
            yield out

    return df.mapInPandas(run, schema)
