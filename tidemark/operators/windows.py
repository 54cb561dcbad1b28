"""Window specifications, assignment and aggregation by event time.

Windows are half-open, [start, end). Sessions end one millisecond after their last event.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.operators.scan import Running, order_ranges, running


@dataclass(frozen=True, order=True)
class TimeWindow:
    """[start, end) in milliseconds."""

    start: int
    end: int

    @property
    def max_timestamp(self) -> int:
        return self.end - 1

    def contains(self, ts: int) -> bool:
        return self.start <= ts < self.end

    def intersects(self, other: TimeWindow) -> bool:
        return self.start < other.end and other.start < self.end

    def merge(self, other: TimeWindow) -> TimeWindow:
        return TimeWindow(min(self.start, other.start), max(self.end, other.end))


@dataclass(frozen=True)
class Tumbling:
    size_ms: int

    def assign(self, ts: int) -> list[TimeWindow]:
        start = ts // self.size_ms * self.size_ms
        return [TimeWindow(start, start + self.size_ms)]


@dataclass(frozen=True)
class Sliding:
    size_ms: int
    slide_ms: int

    def assign(self, ts: int) -> list[TimeWindow]:
        last = ts // self.slide_ms * self.slide_ms
        starts = range(last, max(-1, ts - self.size_ms), -self.slide_ms)
        return [TimeWindow(s, s + self.size_ms) for s in starts]


@dataclass(frozen=True)
class Session:
    gap_ms: int


@dataclass(frozen=True)
class Global:
    """One window for all, complete at the end of the input."""


@dataclass(frozen=True)
class Count:
    """Every ``count`` rows of a key; a last window that isn't full is only given with ``partial``."""

    count: int
    partial: bool = False


Spec = Tumbling | Sliding | Session | Global | Count


def check(spec: Spec) -> None:
    sizes = [v for v in vars(spec).values() if not isinstance(v, bool)]
    if any(v <= 0 for v in sizes):
        raise ConfigError(f"sizes must be positive: {spec}")


def time_window(time: str, spec: Tumbling | Sliding) -> Column:
    if isinstance(spec, Tumbling):
        return F.window(time, f"{spec.size_ms} milliseconds")
    return F.window(time, f"{spec.size_ms} milliseconds", f"{spec.slide_ms} milliseconds")


def _assigned(df: DataFrame, time: str, spec: Tumbling | Sliding) -> DataFrame:
    """Rows once per window; a slide longer than the size leaves gaps, and no window starts before the epoch."""
    if isinstance(spec, Sliding) and spec.slide_ms > spec.size_ms:
        ms = F.unix_millis(F.col(time).cast("timestamp"))
        start = ms - F.pmod(ms, F.lit(spec.slide_ms))
        rows = df.withColumn("window_start", F.timestamp_millis(start)).withColumn("window_end", F.timestamp_millis(start + spec.size_ms))
        return rows.where(ms < start + spec.size_ms)
    rows = df.withColumn("_w", time_window(time, spec)).withColumn("window_start", F.col("_w.start")).withColumn("window_end", F.col("_w.end")).drop("_w")
    return rows if isinstance(spec, Tumbling) else rows.where(F.unix_millis(F.col("window_start").cast("timestamp")) >= 0)


def assigned(df: DataFrame, keys: list[str], time: str | None, spec: Spec, order: str | None = None, ranges: int | None = None) -> tuple[DataFrame, list[str]]:
    """Bounded: rows once per window, with the columns that name it, and the names of these and the keys."""
    check(spec)
    if df.isStreaming:
        raise ConfigError("functions over a window's contents take bounded streams; use a stateful processor on others")
    if isinstance(spec, Tumbling | Sliding):
        return _assigned(df, time, spec), ["window_start", "window_end", *keys]
    if isinstance(spec, Global):
        return df, list(keys)
    if isinstance(spec, Count):
        rows = running(df, keys, order, [Running("_n", "count")], ranges).withColumn("window_index", F.expr(f"(_n - 1) div {spec.count}")).drop("_n")
        if not spec.partial:
            size = F.count("*").over(Window.partitionBy("window_index", *keys))
            rows = rows.withColumn("_size", size).where(F.col("_size") == spec.count).drop("_size")
        return rows, ["window_index", *keys]
    rows = sessions(df, keys, time, spec.gap_ms, ranges)
    whole = Window.partitionBy(*keys, "_session")
    end = F.date_trunc("millisecond", F.max(time).over(whole).cast("timestamp")) + F.expr("interval 1 millisecond")
    rows = rows.withColumn("window_start", F.min(time).over(whole)).withColumn("window_end", end.cast(df.schema[time].dataType))
    return rows.drop("_session"), ["window_start", "window_end", *keys]


def aggregate(df: DataFrame, keys: list[str], time: str | None, spec: Spec, aggs: list[Column], order: str | None = None, ranges: int | None = None) -> DataFrame:
    """Window columns, keys and ``aggs``. Time windows give window_start and window_end, count windows window_index.

    Grouped aggregates combine before the shuffle, so a hot key is no hot task.
    """
    check(spec)
    if isinstance(spec, Tumbling | Sliding) and df.isStreaming:
        # The window column itself carries the watermark; its parts don't.
        out = df.groupBy(time_window(time, spec).alias("_w"), *keys).agg(*aggs)
        out = out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])
        return out.where(F.unix_millis("window_start") >= 0)
    if isinstance(spec, Tumbling | Sliding):
        return _assigned(df, time, spec).groupBy("window_start", "window_end", *keys).agg(*aggs)
    if isinstance(spec, Global):
        return df.groupBy(*keys).agg(*aggs)
    if isinstance(spec, Count):
        rows = running(df, keys, order, [Running("_n", "count")], ranges)
        rows = rows.withColumn("window_index", F.expr(f"(_n - 1) div {spec.count}"))
        out = rows.groupBy("window_index", *keys).agg(*aggs, F.count("*").alias("_size"))
        return (out if spec.partial else out.where(F.col("_size") == spec.count)).drop("_size")
    if df.isStreaming:
        session = F.session_window(time, f"{spec.gap_ms} milliseconds")
        out = df.groupBy(session.alias("_w"), *keys).agg(*aggs, F.max(time).alias("_last"))
        out = out.withColumn("window_start", F.col("_w.start")).withColumn("window_end", F.date_trunc("millisecond", "_last") + F.expr("interval 1 millisecond"))
        return out.select("window_start", "window_end", *[c for c in out.columns if c not in ("_w", "_last", "window_start", "window_end")])
    rows = sessions(df, keys, time, spec.gap_ms, ranges)
    out = rows.groupBy(*keys, "_session").agg(F.min(time).alias("window_start"), F.max(time).alias("_last"), *aggs)
    out = out.withColumn("window_end", (F.date_trunc("millisecond", F.col("_last").cast("timestamp")) + F.expr("interval 1 millisecond")).cast(df.schema[time].dataType))
    return out.select("window_start", "window_end", *keys, *[c for c in out.columns if c not in ("window_start", "window_end", "_last", "_session", *keys)])


def sessions(df: DataFrame, keys: list[str], time: str, gap_ms: int, ranges: int | None = None) -> DataFrame:
    """``df`` with ``_session``, the start of the row's session: a gap longer than ``gap_ms`` starts a new one.

    Gaps are looked for within (key, range of time); where a range begins, the last time of the ranges before
    decides, and a session that reaches over ranges is named by its first row in the first of them. Rows without a time are
    in no session.
    """
    columns, df = df.columns, df.where(F.col(time).isNotNull())
    rows = df.withColumn("_range", order_ranges(df, time, ranges)).withColumn("_us", F.unix_micros(F.col(time).cast("timestamp")))
    inside = Window.partitionBy(*keys, "_range").orderBy("_us")
    rows = rows.withColumn("_prev", F.lag("_us").over(inside))
    rows = rows.withColumn("_start", F.when(F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") > gap_ms * 1000), F.col("_us")))
    rows = rows.withColumn("_start", F.max("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*keys, "_range", "_start").agg(F.max("_us").alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_start")
    parts = parts.withColumn("_before", F.lag("_end").over(over))
    parts = parts.withColumn("_session", F.when(F.col("_before").isNull() | (F.col("_start") - F.col("_before") > gap_ms * 1000), F.col("_start")))
    parts = parts.withColumn("_session", F.max("_session").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    parts = parts.select(*names, F.col("_range").alias("_r"), F.col("_start").alias("_s"), "_session")
    match = (F.col("_range") == F.col("_r")) & (F.col("_start") == F.col("_s"))
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(parts, match).select(*columns, "_session")


def late_marks(df: DataFrame, time: str, order: str, every: int, lateness_ms: int, ranges: int | None = None) -> DataFrame:
    """``df`` with ``watermark``, the one in force when the row arrives, and ``late``: time <= watermark.

    After every ``every`` rows in arrival order the source emits the greatest time so far less ``lateness_ms``.
    ``order`` is the arrival order. Call it before any filter, as a source would.
    """
    rows = df.withColumn("_ms", F.unix_millis(F.col(time).cast("timestamp")))
    rows = running(rows, [], order, [Running("_i", "count"), Running("_top", "max", "_ms")], ranges)
    emitted = rows.where(F.col("_i") % every == 0).select(F.expr(f"_i div {every}").alias("_g"), (F.col("_top") - lateness_ms).alias("watermark"))
    out = rows.withColumn("_g", F.expr(f"(_i - 1) div {every}")).join(emitted, "_g", "left")
    return out.withColumn("late", F.coalesce(F.col("_ms") <= F.col("watermark"), F.lit(False))).select(*df.columns, "watermark", "late")
