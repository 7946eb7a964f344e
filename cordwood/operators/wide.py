"""Attribute-value rows into wide tables (problem 7).

Rows are resolved to one cell per entity and attribute (combined before the shuffle, so neither a hot entity nor a hot
attribute gathers in one task) and written once, partitioned by attribute into typed narrow tables and bucketed by
entity, so that all of them are co-partitioned. The outer joins that combine them need no exchange: groups of about the
square root of the number of attributes are outer-joined to the spine of entities, and the groups, which all hold the
whole spine, are joined pairwise as a balanced tree.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.functions.plan import fenced
from cordwood.session import scratch

TYPES = {"int": "bigint", "num": "double", "bool": "boolean", "time": "timestamp", "text": "string"}
# Spellings that mean there is no value, and spellings of truth values.
NO_VALUE = ("", "-", "n/a", "null")
TRUE, FALSE = ("true", "t", "yes", "y", "1", "on"), ("false", "f", "no", "n", "0", "off")

_DIGITS = r"(?:\d{1,3}(?:,\d{3})+|\d+)"
_INT = rf"^[+-]?{_DIGITS}(?:\.0*)?$"
_NUM = rf"^[+-]?(?:{_DIGITS}(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
_TIME = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:[.,](\d{1,9}))?\s*(?:[Zz]|([+-]\d{2}):?(\d{2}))?$"


def plain_name(name: Column) -> Column:
    """A name without letter case, blanks and _ - . (the form in which names are matched)."""
    return F.lower(F.regexp_replace(name, r"[\s_.\-]", ""))


def read_int(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, ",", ""), r"\.0*$", "")
    return F.when(text.rlike(_INT), plain.try_cast("bigint"))


def read_num(text: Column) -> Column:
    value = F.when(text.rlike(_NUM), F.regexp_replace(text, ",", "").try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def read_bool(text: Column) -> Column:
    return F.when(F.lower(text).isin(*TRUE), True).when(F.lower(text).isin(*FALSE), False)


def read_time(text: Column) -> Column:
    """Stamps with offset or Z (without: UTC), or bare numbers as milliseconds since 1970."""
    part = lambda i: F.regexp_extract(text, _TIME, i)
    wall = F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    shift = F.coalesce(part(4).try_cast("int"), F.lit(0)) * 3600 + F.coalesce(part(5).try_cast("int"), F.lit(0)) * F.when(part(4).startswith("-"), -60).otherwise(60)
    micros = F.rpad(F.substring(part(3), 1, 6), 6, "0").cast("long")
    stamp = F.timestamp_micros(F.unix_micros(wall) - shift.cast("long") * 1_000_000 + micros)
    number = F.when(text.rlike(r"^-?\d{1,15}$"), text.try_cast("bigint"))
    return F.coalesce(F.when(text.rlike(_TIME), stamp), F.timestamp_millis(number))


_READ = {"int": read_int, "num": read_num, "bool": read_bool, "time": read_time, "text": lambda c: c}


def write_value(kind: str, c: Column) -> Column:
    """A typed value as text: int in digits, num with three decimals, bool true or false, time as UTC to the second."""
    if kind == "num":
        digits = F.format_string("%.3f", c)
        return F.when(c.isNotNull(), F.when(digits == "-0.000", "0.000").otherwise(digits))
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") if kind == "time" else c.cast("string")


def cells(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """event_id, prop_name (as in the catalogue), prop_type and one typed column per type: one row per cell.

    rows: event_id, prop_name, prop_value, op, set_at, row_id. Names that match no catalogue name, blank or missing
    values and values that their type cannot read count as if the row were not there; of the rest the row with the
    latest set_at (null first), then row_id, holds, and an unset leaves no cell. Rows without event_id are dropped.
    """
    names = catalog.select(F.col("prop_name").alias("_name"), F.col("prop_type").alias("_type"), plain_name(F.col("prop_name")).alias("_k"))
    rows = rows.select("event_id", plain_name(F.col("prop_name")).alias("_k"), F.trim(F.regexp_replace("prop_value", r"(?U)^\s+|\s+$", "")).alias("_v"), "op", "set_at", "row_id")
    rows = rows.where("event_id is not null").join(names, "_k")  # the catalogue is small, as it is the table's header
    given = F.when(~F.lower(F.col("_v")).isin(*NO_VALUE), F.col("_v"))
    typed = {f"v_{k}": F.when((F.col("_type") == k) & (F.col("op") == "set"), read(given)) for k, read in _READ.items()}
    rows = fenced(rows, **typed)
    there = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in typed]) | (F.col("op") == "unset")
    best = F.max_by(F.struct("op", *typed), F.struct(F.col("set_at").isNotNull(), "set_at", "row_id")).alias("_b")
    held = rows.where(there).groupBy("event_id", "_name", "_type").agg(best)
    return held.where("_b.op = 'set'").select("event_id", F.col("_name").alias("prop_name"), F.col("_type").alias("prop_type"), *[F.col(f"_b.{c}").alias(c) for c in typed])


def _bucketed(rows: DataFrame) -> DataFrame:
    """rows as a table partitioned by prop_name and bucketed by event_id, in as many buckets as shuffles have
    partitions; every task writes one bucket."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    rows.repartition(n, "event_id").write.partitionBy("prop_name").bucketBy(n, "event_id").option("path", path).saveAsTable(name)
    return spark.table(name)


def widen(cell_rows: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """One row per event_id with one typed column per (name, type) of columns, from rows as cells() gives them.

    columns is the header of the result and thus bounded; a name must occur once. Events without any cell have no row.
    """
    held = _bucketed(cell_rows.drop("prop_type"))
    if not columns:
        return held.select("event_id").distinct()
    spine = held.select("event_id").distinct()
    width = max(1, math.isqrt(len(columns)))
    groups = []
    for i in range(0, len(columns), width):
        group = spine
        for name, kind in columns[i : i + width]:
            narrow = held.where(F.col("prop_name") == name).select("event_id", F.col(f"v_{kind}").alias(name))
            group = group.join(narrow, "event_id", "left")
        groups.append(group)
    while len(groups) > 1:
        pairs = [groups[i : i + 2] for i in range(0, len(groups), 2)]
        groups = [p[0].join(p[1], "event_id") if len(p) == 2 else p[0] for p in pairs]
    return groups[0]


def header(catalog: DataFrame) -> list[tuple[str, str]]:
    """(name, type) of the catalogue in order of name; it becomes the result's schema, so it has to be known here."""
    return [(r.prop_name, r.prop_type) for r in catalog.select("prop_name", "prop_type").distinct().orderBy("prop_name").collect()]


def found(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """event_id, prop_name, prop_value of every non-null cell of the wide table."""
    columns = header(catalog)
    wide = widen(cells(rows, catalog), columns)
    pairs = F.array(*[F.struct(F.lit(n).alias("prop_name"), write_value(t, F.col(f"`{n}`")).alias("prop_value")) for n, t in columns])
    return wide.select("event_id", F.inline(F.filter(pairs, lambda p: p["prop_value"].isNotNull())))
