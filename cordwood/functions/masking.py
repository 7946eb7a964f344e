"""Message shapes: masks for the changing parts of a message, and event signatures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cordwood.constants import FIELD_SEPARATOR, MASKS


def mask(text: Column) -> Column:
    """text with guids, addresses, times, quoted text, hex, ids and numbers masked and white space collapsed.

    Null gives an empty string.
    """
    masked = reduce(lambda c, m: F.regexp_replace(c, m[0], m[1]), MASKS, F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(masked, r"(?U)\s+", " "))


def signature(level: Column, template: Column, message: Column, properties: Column) -> Column:
    """Shape of an event: level and template, or level, masked message and sorted property names."""
    base = F.coalesce(level, F.lit(""))
    names = F.array_join(F.array_sort(F.map_keys(F.coalesce(properties, F.create_map().cast("map<string,string>")))), ",")
    return F.when(
        F.coalesce(template, F.lit("")) != "", F.concat(base, F.lit(FIELD_SEPARATOR), template)
    ).otherwise(F.concat(base, F.lit(FIELD_SEPARATOR), mask(message), F.lit(FIELD_SEPARATOR), names))
