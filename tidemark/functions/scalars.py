"""Named map, flat-map and predicate functions as Column builders; an unknown name raises."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import ConfigError

MapBuilder = Callable[[Column], Column]
PredicateBuilder = Callable[[Column, str], Column]


def words(c: Column) -> Column:
    """The runs of non-space (Unicode) as an array."""
    return F.array_remove(F.split(c, r"(?U)\s+"), "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(c: Column) -> Column:
    """Lines ended by LF or CR LF; the end of the last line starts no further one."""
    parts = F.split(c, r"\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def csv_fields(c: Column) -> Column:
    """Fields between commas, each stripped; empty ones stay."""
    return F.transform(F.split(c, ","), strip)


def truncate(c: Column, most: int) -> Column:
    """The text itself up to ``most`` characters, else its start and three dots."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 3), F.lit("...")))


def line_summary(c: Column, most: int = 40) -> Column:
    """``text -> n words`` for a line."""
    n = F.size(words(c))
    text = F.concat(truncate(c, most), F.lit(" -> "), n.cast("string"), F.when(n == 1, " word").otherwise(" words"))
    return F.when(n == 0, F.lit("(empty line)")).otherwise(text)


def _min_length(c: Column, value: str) -> Column:
    return F.octet_length(c) >= (int(value) if value.strip().isdigit() else 0)


MAPS: dict[str, MapBuilder] = {
    "uppercase": F.upper,
    "lowercase": F.lower,
    "word_count": lambda c: F.concat(c, F.lit(" -> "), F.size(words(c)).cast("string"), F.lit(" words")),
    "reverse": F.reverse,
    "identity": lambda c: c,
    "truncate": lambda c: truncate(c, 40),
    "line_summary": line_summary,
}
FLAT_MAPS: dict[str, MapBuilder] = {
    "split_words": words,
    "split_lines": lines,
    "split_csv": csv_fields,
    "split_lower_words": lambda c: words(F.lower(c)),
    "identity": lambda c: F.array(c),
}
PREDICATES: dict[str, PredicateBuilder] = {
    "non_empty": lambda c, value: c.rlike(r"(?U)\S"),
    "contains": lambda c, value: c.contains(value),
    "starts_with": lambda c, value: c.startswith(value),
    "ends_with": lambda c, value: c.endswith(value),
    "min_length": _min_length,
    "all": lambda c, value: F.lit(True),
}


def _named(table: dict, kind: str, name: str):
    if name not in table:
        raise ConfigError(f"unknown {kind} {name!r}; known: {', '.join(sorted(table))}")
    return table[name]


def map_function(name: str = "identity") -> MapBuilder:
    return _named(MAPS, "map function", name)


def flat_map_function(name: str = "split_words") -> MapBuilder:
    return _named(FLAT_MAPS, "flat-map function", name)


def predicate(name: str = "non_empty", value: str = "") -> MapBuilder:
    build = _named(PREDICATES, "predicate", name)
    return lambda c: build(c, value)
