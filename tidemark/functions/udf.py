"""Protocols of user functions in Python and the registry by name.

Column expressions are the fast way; these run in Arrow batches where a job brings its own Python code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any, Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType

from tidemark.errors import ConfigError


@runtime_checkable
class MapFunction(Protocol):
    def map(self, value: Any) -> Any: ...


@runtime_checkable
class FlatMapFunction(Protocol):
    def flat_map(self, value: Any) -> Iterable[Any]: ...


@runtime_checkable
class FilterFunction(Protocol):
    def filter(self, value: Any) -> bool: ...


@runtime_checkable
class ReduceFunction(Protocol):
    def reduce(self, a: Any, b: Any) -> Any: ...


@runtime_checkable
class AggregateFunction(Protocol):
    def create(self) -> Any: ...

    def add(self, acc: Any, value: Any) -> Any: ...

    def result(self, acc: Any) -> Any: ...

    def merge(self, a: Any, b: Any) -> Any: ...


@runtime_checkable
class AsyncFunction(Protocol):
    """Called for each value; ``timeout`` gives the output for a value that took too long."""

    async def invoke(self, value: Any) -> Any: ...

    def timeout(self, value: Any) -> Any: ...


class KeySelector:
    """A key from a column name, a Column or a function of the row's value column."""

    def __init__(self, key: str | Column | Callable[[Column], Column]):
        self.key = key

    def column(self, value: str = "value") -> Column:
        if isinstance(self.key, str):
            return F.col(self.key)
        return self.key if isinstance(self.key, Column) else self.key(F.col(value))


def map_udf(function: MapFunction, returns: DataType | str):
    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        return values.map(function.map)

    return run


def filter_udf(function: FilterFunction):
    @F.pandas_udf(BooleanType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: bool(function.filter(v)))

    return run


def flat_map_udf(function: FlatMapFunction, returns: DataType):
    @F.pandas_udf(ArrayType(returns))
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: list(function.flat_map(v)))

    return run


def partial_aggregate(function: AggregateFunction, values: Iterable[Any]) -> Any:
    acc = function.create()
    for value in values:
        acc = function.add(acc, value)
    return acc


_REGISTRY: dict[str, Any] = {}


def register(name: str) -> Callable[[Any], Any]:
    """Decorator: make a function, or an instance of a class, known by name to declared jobs."""

    def add(thing: Any) -> Any:
        _REGISTRY[name] = thing() if isinstance(thing, type) else thing
        return thing

    return add


def registered(name: str) -> Any:
    if name not in _REGISTRY:
        raise ConfigError(f"no function is registered as {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]


@register("WordSplitter")
class WordSplitter:
    """Lower-case words of a line, as a Column expression."""

    def columns(self, c: Column) -> Column:
        from tidemark.functions.scalars import words

        return words(F.lower(c))


@register("ToUppercase")
class ToUppercase:
    def column(self, c: Column) -> Column:
        return F.upper(c)
