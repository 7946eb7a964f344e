"""The grid of events: columns, value filters, search and sort."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordwood.functions.fields import resolve
from cordwood.functions.text import natural_sort_keys
from cordwood.operators.patterns import property_usage


@dataclass(frozen=True)
class ValueFilter:
    """Keeps (or with exclude leaves out) the events whose field has a value; None is no value."""

    field: str
    value: str | None
    exclude: bool = False


def default_columns(events: DataFrame, n: int = 4) -> list[str]:
    """The n properties that most events carry."""
    return [r.name for r in property_usage(events).limit(n).collect()]


def filtered(events: DataFrame, columns: list[str], filters: tuple[ValueFilter, ...] = (), search: str | None = None) -> DataFrame:
    """events that pass all filters and hold the search text in message, level or a shown column."""
    rows = events
    for f in filters:
        same = resolve(f.field).eqNullSafe(F.lit(f.value))
        rows = rows.where(~same if f.exclude else same)
    if not search:
        return rows
    needle = F.lit(search.lower())
    hit = F.lit(False)
    for c in (F.col("message"), F.col("level"), *[resolve(c) for c in columns]):
        hit = hit | F.coalesce(F.contains(F.lower(c), needle), F.lit(False))
    return rows.where(hit)


def grid(
    events: DataFrame, columns: list[str] | None = None, filters: tuple[ValueFilter, ...] = (), search: str | None = None, sort: str = "#Line", descending: bool = False
) -> DataFrame:
    """line_number, ts, level, the chosen properties, message of filtered events, sorted by one column. Nulls come last in either direction and lines of equal
    value keep their order. A property named like a fixed column is shown as property:name."""
    columns = default_columns(events) if columns is None else columns
    rows = filtered(events, columns, filters, search)
    fixed = {"line_number", "ts", "level", "message"}
    key = {"#Line": None, "Time": F.col("ts"), "Level": F.col("level"), "Message": F.col("message")}.get(sort, resolve(sort) if sort not in ("#Line",) else None)
    if sort == "#Line" or key is None:
        order = [F.desc("line_number") if descending else F.asc("line_number")]
    elif sort == "Time":
        order = [F.desc_nulls_last("ts") if descending else F.asc_nulls_last("ts"), F.asc("line_number")]
    else:
        order = [*natural_sort_keys(key, descending), F.asc("line_number")]
    shown = [resolve(c).alias(f"property:{c}" if c.lower() in fixed else c) for c in columns]
    return rows.orderBy(*order).select("line_number", "ts", "level", *shown, "message")
