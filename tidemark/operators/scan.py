"""Running aggregates over an order, in two levels.

A window over a whole key would put a hot key, or a stream without keys, in one task. Here the order is cut
into ranges: the ranges' totals, one small row each, are scanned per key, and what came before a range is put ahead of
its rows as one more row, which the scan within (key, range) begins with. So the rows are shuffled and sorted once, and
not joined. The result is that of the plain window, nulls first in the order.

The ranges are cut at approximate quantiles, and each part between two of them into parts of equal width, so that an outlier
costs at most the share of one quantile. Their number grows with the rows: about ``RANGE_ROWS`` in each.

Only hot keys are cut: with most keys rare, there would be nearly as many totals as rows. The aggregation that finds the
quantiles also finds the most frequent hashes of keys, by a sketch that misses none above its bound. Which keys are cut
decides where rows are scanned, never the result.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, DecimalType, NumericType, StringType, TimestampNTZType, TimestampType

from tidemark.errors import ConfigError

RANGES = 32  # at least so many, if there are rows enough to tell
RANGE_ROWS = 1 << 18
QUANTILES = 128
MOST_WHENS = 16  # cuts in nested conditions
GRID = 16  # cells a range
HOT_ROWS, HOT_KEYS = 1 << 14, 1 << 12  # a hot key has more rows than that, and is one of so many of the most frequent


@dataclass(frozen=True)
class Running:
    """``kind``: sum, count, min, max, min_by, max_by; ``value`` the column, ``by`` what min_by and max_by compare."""

    name: str
    kind: str
    value: str | None = None
    by: str | None = None


def _fold(kind: str, c: Column) -> Column:
    folds = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "min_by": F.min, "max_by": F.max}
    if kind not in folds:
        raise ConfigError(f"unknown running aggregate {kind!r}")
    return folds[kind](c)


def _join(kind: str, before: Column, here: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(before + here, here, before)
    return (F.least if kind in ("min", "min_by") else F.greatest)(before, here)


def position(df: DataFrame, order: str) -> Column:
    """A number that grows with ``order``, which is numeric or a point in time: microseconds, days, or itself."""
    kind = df.schema[order].dataType
    if isinstance(kind, TimestampType | TimestampNTZType):
        return F.unix_micros(F.col(order).cast("timestamp"))
    if isinstance(kind, DateType):
        return F.unix_date(order).cast("long")
    if isinstance(kind, NumericType):
        return F.col(order)
    raise ConfigError(f"an order is numeric or a point in time, {order!r} is {kind.simpleString()}")


def _place(at: Column, cuts: Sequence[float], first: int = 0) -> Column:
    """How many of the ascending ``cuts`` are at or below ``at``, plus ``first``; by bisection."""
    if not cuts:
        return F.lit(first)
    if len(cuts) > MOST_WHENS:  # as nested conditions they would be a method too large for the JIT, with all of its stage
        steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
        edges = _literals([*map(float, cuts), *[math.inf] * (2 * steps[0] - 1 - len(cuts))], "double")
        found = F.aggregate(_literals(steps, "int"), F.lit(0), lambda n, step: F.when(at >= F.get(edges, n + step - 1), n + step).otherwise(n))
        return F.least(found, F.lit(len(cuts))) + F.lit(first)
    middle = len(cuts) // 2
    return F.when(at < F.lit(cuts[middle]), _place(at, cuts[:middle], first)).otherwise(_place(at, cuts[middle + 1 :], first + middle + 1))


def _literals(values: Sequence[float], kind: str) -> Column:
    """An array that the optimizer folds to one literal; a column for each element takes long to build."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _grid_place(at: Column, cuts: Sequence[float], least: float, most: float, within: int) -> Column | None:
    """Like ``_place``, each part again in ``within`` of equal width, but a cut may move up to the next edge of a grid, so
    that a place is one look into a table. None if bounds aren't finite, or the grid would bring cuts together."""
    cells = GRID * (len(cuts) + 1)
    width = (most - least) / cells
    if not math.isfinite(width) or width <= 0:
        return None
    ends = [min(max(math.ceil((c - least) / width), 0), cells) for c in cuts]
    if len(set(ends)) < len(ends):
        return None
    cell = F.greatest(F.least(F.floor((at - F.lit(least)) / F.lit(width)), F.lit(cells - 1)), F.lit(0)).cast("int")
    place = F.get(_literals([bisect_right(ends, i) for i in range(cells)], "int"), cell)
    if within == 1:
        return place
    edges = [least + width * end for end in (0, *ends, cells)]
    a, b = F.get(_literals(edges[:-1], "double"), place), F.get(_literals(edges[1:], "double"), place)
    part = F.greatest(F.least(F.floor((at - a) / (b - a) * within), F.lit(within - 1)), F.lit(0))
    return place.cast("long") * within + part


def order_ranges(df: DataFrame, order: str, ranges: int | None = None, bounds: Sequence[float] | None = None) -> Column:
    """The range of a row, growing with ``order``; -1 for a null order.

    ``bounds`` are known cuts of the order's position (see ``position``); without them one aggregation of ``df`` finds
    them. ``ranges`` is how many ranges to aim at; by default it grows with the rows.
    """
    return _ranges(df, order, ranges, bounds)[0]


def _hash(df: DataFrame, keys: Sequence[str]) -> Column | None:
    """A hash of the keys; None without keys, or where a type's equal values may differ in it."""
    kinds = [df.schema[k].dataType for k in keys]
    known = NumericType | BooleanType | BinaryType | DateType | TimestampType | TimestampNTZType
    sure = lambda t: t.collation == "UTF8_BINARY" if isinstance(t, StringType) else isinstance(t, known)
    return F.xxhash64(*keys) if kinds and all(map(sure, kinds)) else None


def _ranges(df: DataFrame, order: str, ranges: int | None = None, bounds: Sequence[float] | None = None, keys: Sequence[str] = ()) -> tuple[Column, Column]:
    """The range of a row, and whether its key is cut: with ``keys``, whether it is hot, and the range is 0 if not.

    A key that is not cut has at most ``HOT_ROWS`` rows, or about a ``HOT_KEYS``th of all rows.
    """
    at = position(df, order).cast("double")
    if bounds is not None:
        return F.coalesce(F.when(at.isNotNull(), _place(at, sorted(set(bounds)))), F.lit(-1)).cast("long"), F.lit(True)
    if ranges == 1:
        return F.when(at.isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long"), F.lit(True)
    parts = QUANTILES if ranges is None else min(QUANTILES, ranges)
    shares = [i / parts for i in range(1, parts)]
    key, cut = _hash(df, keys), F.lit(True)
    sketch = [] if key is None else [F.call_function("approx_top_k", key, F.lit(HOT_KEYS), F.lit(4 * HOT_KEYS))]
    rows, least, most, cuts, *top = df.agg(F.count(at), F.min(at), F.max(at), F.percentile_approx(at, F.array(*map(F.lit, shares)), F.lit(1000)), *sketch).first()
    if key is not None:
        hot = [r["item"] for r in top[0] or () if r["count"] > HOT_ROWS]
        if not hot:
            return F.lit(0).cast("long"), F.lit(False)
        cut = key.isin(hot)
    if not rows or least == most:
        return F.when(cut & at.isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long"), cut
    wanted = max(RANGES, -(-rows // RANGE_ROWS)) if ranges is None else ranges
    if ranges is None and wanted < parts:  # few rows: every so many quantiles
        cuts = cuts[:: -(-parts // wanted)]
    least, most = float(least), float(most)
    cuts = sorted({float(x) for x in cuts if math.isfinite(x)} - {least})
    within = max(1, -(-wanted // (len(cuts) + 1)))
    place = _grid_place(at, cuts, least, most, within)
    if place is None:
        edges = [x for x in (least, *cuts, most) if math.isfinite(x)]
        cuts = sorted({*cuts, *(a + (b - a) * i / within for a, b in zip(edges, edges[1:], strict=False) for i in range(1, within))} - {least})
        place = _place(at, cuts)
    return F.when(~cut, F.lit(0)).when(at.isNull(), F.lit(-1)).otherwise(place).cast("long"), cut


def running(df: DataFrame, keys: list[str], order: str, aggregates: list[Running], ranges: int | None = None, bounds: Sequence[float] | None = None) -> DataFrame:
    """``df`` with a column per aggregate over all rows of the same keys up to and with the row, by ``order``.

    ``order`` must be unique per key; rows without one come first. min_by and max_by give the value of the first row
    with the least or greatest ``by``. Null values are left out by sum, min and max. ``ranges`` or ``bounds`` cut all keys.
    """
    if df.isStreaming:
        raise ConfigError("running results of an unbounded stream come from streaming.stateful, or totals()")
    if not aggregates:
        return df
    place, cut = _ranges(df, order, ranges, bounds, keys if ranges is None else ())
    rows = df.withColumn("_range", place)
    at = position(df, order)
    if isinstance(df.schema[order].dataType, DecimalType):
        at = at.cast("decimal(38,6)")
    for a in aggregates:
        if a.kind == "count":
            c = F.lit(1).cast("long")
        elif a.kind in ("min_by", "max_by"):
            # Of equals the earliest: nulls come first, and a larger order loses.
            early = F.struct(at.isNotNull().cast("int").alias("known"), at.alias("at")) if a.kind == "min_by" else F.struct(at.isNull().cast("int").alias("known"), (-at).alias("at"))
            c = F.when(F.col(a.by).isNotNull(), F.struct(F.col(a.by).alias("by"), early.alias("tie"), F.col(a.value).alias("value")))
        else:
            c = F.col(a.value)
        rows = rows.withColumn(f"_v_{a.name}", c)
    totals = rows.where(cut).groupBy(*keys, "_range").agg(*[_fold(a.kind, F.col(f"_v_{a.name}")).alias(f"_t_{a.name}") for a in aggregates])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("*", *[_fold(a.kind, F.col(f"_t_{a.name}")).over(earlier).alias(f"_b_{a.name}") for a in aggregates])
    before = before.where(reduce(or_, [F.col(f"_b_{a.name}").isNotNull() for a in aggregates]))
    kinds = {a.name: before.select(_join(a.kind, F.col(f"_b_{a.name}"), F.col(f"_t_{a.name}"))).schema[0].dataType for a in aggregates}
    columns = [*df.columns, "_range"]
    ahead = before.select(
        *[F.col(c) if c in keys or c == "_range" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns],
        *[F.col(f"_b_{a.name}").cast(kinds[a.name]).alias(f"_v_{a.name}") for a in aggregates], F.lit(False).alias("_own"),
    )
    rows = rows.select(*columns, *[F.col(f"_v_{a.name}").cast(kinds[a.name]).alias(f"_v_{a.name}") for a in aggregates], F.lit(True).alias("_own"))
    within = Window.partitionBy(*keys, "_range").orderBy("_own", F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows.union(ahead).select("*", *[_fold(a.kind, F.col(f"_v_{a.name}")).over(within).alias(f"_h_{a.name}") for a in aggregates]).where("_own")
    out = []
    for a in aggregates:
        c = F.col(f"_h_{a.name}").cast(kinds[a.name])
        out.append((c["value"] if a.kind in ("min_by", "max_by") else c).alias(a.name))
    return scanned.select(*df.columns, *out)
