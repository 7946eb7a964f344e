"""Schemas that drift between files (problem 4).

Every record becomes rows of path, raw type and value (variant_explode, inside the JVM). One aggregation by
application, file, field and type, combined before the shuffle, gives what each file holds; from there on only
these statistics move. A change is a difference between a file and the one before it. What went and what came in one
file is paired as renamed where type and values go on: numbers by their range, texts by MinHash of their vocabulary,
both of bounded size whatever the number of values. Events then come out in one table of typed maps and columns, renamed
fields under one name, with every value that its field's type cannot hold reported apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cordwood.functions.plan import fenced
from cordwood.session import cut

SLOTS = 16  # of the MinHash signature
TYPES = ("integer", "float", "string", "boolean", "array", "object")


def _type(shape: Column) -> Column:
    """The JSON type for what schema_of_variant says."""
    return (
        F.when(shape.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\\(\\d+,0\\))$"), "integer")
        .when(shape.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
        .when(shape.startswith("STRING"), "string")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape.startswith("OBJECT"), "object")
    )


def events(records: DataFrame) -> DataFrame:
    """app, file_no, record_no, event (variant: the whole object), properties (variant or null).

    Unreadable payloads and payloads that are no object have null event; exact copies of a record come once. An
    object with Properties, MessageTemplate or RenderedMessage and no @ time or message is a standard event, whose
    properties are the members of Properties; all others are compact.
    """
    rows = records.select("app", "file_no", "record_no", "payload").distinct()
    rows = fenced(rows, event=F.expr("try_parse_json(payload)"))
    rows = fenced(rows, _shape=F.expr("schema_of_variant(event)"))
    rows = rows.withColumn("event", F.when(F.col("_shape").startswith("OBJECT"), F.col("event")))
    has = lambda *names: F.col("_shape").rlike("(?:^OBJECT<|, )`?(?:" + "|".join(names) + ")`?: ")
    standard = has("Properties", "MessageTemplate", "RenderedMessage") & ~has("@t", "@m", "@mt")
    inner = F.expr("try_variant_get(event, '$.Properties', 'variant')")
    return fenced(rows, properties=F.when(standard, inner).otherwise(F.col("event")), standard=standard).drop("_shape")


def path_values(records: DataFrame) -> DataFrame:
    """app, file_no, record_no, field_name, kind (JSON type), value (variant) of every non-null property."""
    rows = events(records).where("event is not null and properties is not null")
    spark = records.sparkSession
    rows = rows.lateralJoin(spark.tvf.variant_explode(F.col("properties").outer()))
    rows = rows.where(F.col("key").isNotNull() & (F.col("standard") | ~F.col("key").startswith("@")))
    rows = rows.select("app", "file_no", "record_no", F.col("key").alias("field_name"), _type(F.expr("schema_of_variant(value)")).alias("kind"), "value")
    return rows.where("kind is not null")


def _number(kind: Column, text: Column) -> Column:
    inner = F.regexp_extract(text, r"(?:^\[|:)(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(kind.isin("integer", "float"), text.try_cast("double")).when(kind.isin("array", "object"), inner)


_SKETCH = [f"_m{i}" for i in range(SLOTS)]


def statistics(values: DataFrame) -> DataFrame:
    """app, file_no, field_name, kind, n, low, high and the slots of a MinHash: what a file holds of a field, by type."""
    rows = values.withColumn("_t", F.expr("to_json(value)"))
    rows = fenced(rows, _n=_number(F.col("kind"), F.col("_t")))
    word = F.when(F.col("_n").isNull(), F.col("_t"))
    rows = rows.withColumn("_w", word)
    mins = [F.min(F.when(F.col("_w").isNotNull(), F.xxhash64("_w", F.lit(i)))).alias(m) for i, m in enumerate(_SKETCH)]
    return rows.groupBy("app", "file_no", "field_name", "kind").agg(F.count("*").alias("n"), F.min("_n").alias("low"), F.max("_n").alias("high"), *mins)


def _likeness(a: tuple, b: tuple) -> float:
    """0..1: how far two fields of one type, given as (low, high, slots), hold the same values."""
    best = 0.0
    if a[0] == a[0] and b[0] == b[0]:  # both have numbers
        wide = max(a[1] - a[0], b[1] - b[0])
        gap = max(a[0], b[0]) - min(a[1], b[1])
        best = 1.0 if gap <= 0 else max(0.0, 0.9 - gap / wide) if wide > 0 else 0.0
        if gap <= 0:  # ranges that cover each other count for more than ranges that touch
            span = max(a[1], b[1]) - min(a[0], b[0])
            best = 0.5 + 0.5 * (-gap / span if span > 0 else 1.0)
    pairs = [x == y for x, y in zip(a[2], b[2]) if x == x and y == y]
    return max(best, sum(pairs) / len(pairs)) if pairs else best


def _pairs(gone: list[tuple], come: list[tuple], least: float) -> list[tuple[str, str, str]]:
    """(change_kind, field_name, other) of one file: what went and what came, as (name, kind, likeness' measures),
    paired as renamed where type and values go on, best pairs first."""
    found = []
    for a in gone:
        found += [(-score, a[0], b[0]) for b in come if a[1] == b[1] and (score := _likeness(a[2], b[2])) >= least]
    names: dict[str, str] = {}
    taken: set[str] = set()
    for _, a, b in sorted(found):
        if a not in names and b not in taken:
            names[a] = b
            taken.add(b)
    return [
        *(("renamed", a, b) for a, b in names.items()), *(("removed", a[0], "") for a in gone if a[0] not in names), *(("added", b[0], "") for b in come if b[0] not in taken),
    ]


_CHANGES = "app string, file_no int, change_kind string, field_name string, other string"


def _paired(moved: DataFrame, least: float) -> DataFrame:
    """The changes of rows app, file_no, field_name, change, kind, low, high and slots: many files a batch, each read
    with no more than its own changed fields."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, sides, out = None, ([], []), []

        def close() -> None:
            if file is not None:
                out.extend((*file, *c) for c in _pairs(*sides, least))
                sides[0].clear()
                sides[1].clear()

        for pdf in batches:
            measures = zip(pdf["low"].tolist(), pdf["high"].tolist(), pdf[_SKETCH].to_numpy().tolist())
            for app, no, name, change, kind, m in zip(pdf["app"], pdf["file_no"], pdf["field_name"], pdf["change"], pdf["kind"], measures):
                if (app, no) != file:
                    close()
                    file = (app, no)
                sides[change == "added"].append((name, kind, m))
            yield pd.DataFrame(out, columns=["app", "file_no", "change_kind", "field_name", "other"])
            out.clear()
        close()
        yield pd.DataFrame(out, columns=["app", "file_no", "change_kind", "field_name", "other"])

    return moved.repartition("app", "file_no").sortWithinPartitions("app", "file_no", "field_name").mapInPandas(run, _CHANGES)


def _rank() -> Column:
    return F.array_position(F.array(*map(F.lit, TYPES)), F.col("kind"))


def changes(records: DataFrame, least: float = 0.3) -> DataFrame:
    """app, file_no, change_kind, field_name, other: every change of a property against the file before it.

    Files follow each other by file_no; a file without any readable payload is a file without properties. The type of
    a field in a file is that of most of its values (ties: the type named first in TYPES). Two fields are paired as
    renamed if they have the same type and their values are alike by least or more, best pairs first. Groups that
    reach Python hold the changed fields of one file, never rows. Empty tables give an empty result.
    """
    return _changes(cut(statistics(path_values(records))), records, least)


def _changes(stats: DataFrame, records: DataFrame, least: float) -> DataFrame:
    """changes() from the statistics alone, which are exchanged once, by application and field."""
    order = W.partitionBy("app").orderBy("file_no")
    files = records.select("app", "file_no").distinct().select("app", "file_no", F.row_number().over(order).alias("seq"), F.lead("file_no").over(order).alias("next_no"))
    rows = stats.join(files, ["app", "file_no"]).repartition("app", "field_name")
    whole = W.partitionBy("app", "field_name", "kind")
    rows = rows.withColumns({"low": F.min("low").over(whole), "high": F.max("high").over(whole), **{m: F.min(m).over(whole) for m in _SKETCH}})
    measures = ["kind", "low", "high", *_SKETCH]
    held = rows.groupBy("app", "field_name", "file_no", "seq", "next_no").agg(F.max_by(F.struct(*measures), F.struct("n", -_rank())).alias("_k"))
    held = held.select("app", "field_name", "file_no", "seq", "next_no", *[F.col(f"_k.{c}").alias(c) for c in measures])
    along = W.partitionBy("app", "field_name").orderBy("seq")
    held = held.withColumns({"_was": F.lag("kind").over(along), "_then": F.lag("seq").over(along), "_next": F.lead("seq").over(along)})
    goes_on = F.coalesce(F.col("_then") == F.col("seq") - 1, F.lit(False))
    one = lambda kind, no, other: F.struct(F.lit(kind).alias("change"), F.col(no).alias("no"), other.alias("other"))
    told = F.array(
        F.when((F.col("seq") > 1) & ~goes_on, one("added", "file_no", F.lit(""))),
        F.when(goes_on & (F.col("_was") != F.col("kind")), one("retyped", "file_no", F.col("kind"))),
        F.when(F.col("next_no").isNotNull() & ~F.coalesce(F.col("_next") == F.col("seq") + 1, F.lit(False)), one("removed", "next_no", F.lit(""))),
    )
    held = held.withColumn("_told", F.explode(F.filter(told, lambda x: x.isNotNull())))
    held = cut(held.select("app", F.col("_told.no").alias("file_no"), "field_name", F.col("_told.change").alias("change"), F.col("_told.other").alias("other"), *measures))
    turned = held.where("change = 'retyped'").select("app", "file_no", F.col("change").alias("change_kind"), "field_name", "other")
    return _paired(held.where("change <> 'retyped'"), least).unionByName(turned)


# ---- the consistent table ---------------------------------------------------------------------------------------


def _names(stats: DataFrame, found: DataFrame) -> DataFrame:
    """app, file_no, field_name, name: what a field of a file is called in the end, where it was renamed later.

    A name counts as renamed in the files before the renaming; a chain of renamings ends in its last name. Where a
    file has the last name too, or two fields that would get it, the field keeps its own. Renamings of an application
    are few and are read in one group.
    """
    renamed = found.where("change_kind = 'renamed'")

    def chains(key, pdf):
        until: dict[str, list[tuple[int, str]]] = {}  # name -> (file from which on it is another, last name), latest first
        out = []
        for r in pdf.sort_values("file_no", ascending=False).itertuples():
            last = next((name for no, name in reversed(until.get(r.other, [])) if no > r.file_no), r.other)
            until.setdefault(r.field_name, []).append((r.file_no, last))
        for old, steps in until.items():
            before = [*(no for no, _ in steps[1:]), None]
            out += [(key[0], old, low, no, last) for (no, last), low in zip(steps, before)]
        return pd.DataFrame(out, columns=["app", "field_name", "_from", "_until", "name"]).astype({"_from": "Int64"})

    spans = renamed.groupBy("app").applyInPandas(chains, "app string, field_name string, _from long, _until long, name string")
    held = stats.select("app", "file_no", "field_name").distinct()
    now = held.join(spans, ["app", "field_name"]).where((F.col("file_no") < F.col("_until")) & (F.col("_from").isNull() | (F.col("file_no") >= F.col("_from"))))
    now = now.groupBy("app", "file_no", "name").agg(F.min("field_name").alias("field_name"))
    return now.join(held.withColumnRenamed("field_name", "name"), ["app", "file_no", "name"], "left_anti").select("app", "file_no", "field_name", "name")


def _fields(records: DataFrame, least: float) -> DataFrame:
    """app, file_no, fields (map: name in the file -> name, target type), one row per file with readable properties."""
    stats = cut(statistics(path_values(records)))
    named = stats.join(_names(stats, _changes(stats, records, least)), ["app", "file_no", "field_name"], "left").withColumn("name", F.coalesce("name", "field_name"))
    named = cut(named.select("app", "file_no", "field_name", "name", "kind", "n"))
    counts = named.groupBy("app", "name", "kind").agg(F.sum("n").alias("n"))
    target = counts.groupBy("app", "name").agg(F.max_by("kind", F.struct("n", -_rank())).alias("target"))
    each = named.select("app", "file_no", "field_name", "name").distinct().join(target, ["app", "name"])
    return each.groupBy("app", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("field_name", F.struct("name", "target")))).alias("fields"))


def consistent(records: DataFrame, least: float = 0.3) -> DataFrame:
    """One row per readable event: app, file_no, record_no, ts, level, template, exception, the properties as typed
    maps (integers, floats, texts, booleans, nested) and failed, which maps every property whose value its field's
    type cannot hold to the value as text.

    A field that changes() finds renamed stands under its last name in all files of the application. The type of a
    field is that of most of its values in the application. Integers are widened into float fields, and any scalar
    into string fields; all else fails. An event is read where it lies: it meets no more than the fields of its file.
    """
    rows = events(records).where("event is not null").join(_fields(records, least), ["app", "file_no"], "left")
    rows = fenced(rows, _e=F.map_entries(F.coalesce(F.expr("try_variant_get(properties, '$', 'map<string,variant>')"), F.expr("cast(map() as map<string,variant>)"))))
    kinds = F.transform("_e", lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"), F.call_function("schema_of_variant", e["value"]).alias("s")))
    known = F.filter(kinds, lambda e: F.col("standard") | ~e["k"].startswith("@"))
    rows = fenced(rows, _e=F.filter(F.transform(known, lambda e: F.struct(F.try_element_at(F.col("fields"), e["k"]).alias("f"), _type(e["s"]).alias("kind"), e["v"].alias("v"))), lambda e: e["kind"].isNotNull()))

    def place(e: Column) -> Column:
        kind, target = e["kind"], e["f"]["target"]
        nested = kind.isin("array", "object")
        fits = (kind == target) | ((target == "float") & (kind == "integer")) | ((target == "string") & ~nested)
        text = F.when(nested, F.call_function("to_json", e["v"])).otherwise(F.call_function("try_variant_get", e["v"], F.lit("$"), F.lit("string")))
        return F.struct(e["f"]["name"].alias("k"), text.alias("v"), F.when(fits, target).otherwise("failed").alias("goes"))

    rows = fenced(rows, _e=F.array_sort(F.transform("_e", place)))
    pick = lambda *goes: F.map_from_entries(F.transform(F.filter("_e", lambda e: e["goes"].isin(*goes)), lambda e: F.struct(e["k"], e["v"])))
    member = lambda *paths: F.coalesce(*[F.expr(f"try_variant_get(event, '{p}', 'string')") for p in paths])
    return rows.select(
        "app", "file_no", "record_no",
        F.try_to_timestamp(member('$["@t"]', "$.Timestamp")).alias("ts"), member('$["@l"]', "$.Level").alias("level"),
        member('$["@mt"]', "$.MessageTemplate").alias("template"), member('$["@x"]', "$.Exception").alias("exception"),
        F.transform_values(pick("integer"), lambda _, v: v.try_cast("bigint")).alias("integers"),
        F.transform_values(pick("float"), lambda _, v: v.try_cast("double")).alias("floats"), pick("string").alias("texts"),
        F.transform_values(pick("boolean"), lambda _, v: v == "true").alias("booleans"), pick("array", "object").alias("nested"), pick("failed").alias("failed"),
    )


_CAST = {"integer": ("integers", "bigint"), "float": ("floats", "double"), "string": ("texts", "string"), "boolean": ("booleans", "boolean"), "array": ("nested", "string"), "object": ("nested", "string")}


def _columns(names: list[str]) -> list[str]:
    """A column for each of names: "field:" and the name. Names are compared exactly and columns without regard to
    letter case, so where that leaves a column taken, the later name in order has #2, #3, ... behind it, and no field's
    own name is one of these."""
    plain = lambda c: c.upper().lower()
    taken, own, out = set(), {plain(n) for n in names}, {}
    for n in sorted(names):
        column, k = n, 1
        while plain(column) in taken or (k > 1 and plain(column) in own):
            k += 1
            column = f"{n}#{k}"
        taken.add(plain(column))
        out[n] = f"field:{column}"
    return [out[n] for n in names]


def projected(table: DataFrame, share: float = 0.05) -> DataFrame:
    """table, as consistent() gives it, with one typed column for each field that at least share of its applications
    have; all others stay in the maps. The type of a column is that of the field in most applications (ties: the type
    named first in TYPES); where an application holds the field in another type, its values stay in the maps too, or
    in failed. Names that differ in letter case only are columns of their own (see _columns). There are at most
    1 / share times as many columns as an application has fields."""
    table = cut(table)
    maps = {"integers": "integer", "floats": "float", "texts": "string", "booleans": "boolean", "nested": "object"}

    def names(c: str) -> Column:
        return F.transform(F.map_keys(c), lambda k: F.struct(k.alias("name"), F.lit(maps[c]).alias("kind")))

    def without(c: str, taken: list[str]) -> Column:
        return F.map_filter(c, lambda k, _: ~k.isin(taken)).alias(c) if taken else F.col(c)

    named = table.select("app", F.explode(F.concat(*map(names, maps))).alias("_f")).select("app", "_f.*").distinct()
    apps = table.select("app").distinct().count()
    top = named.groupBy("name", "kind").agg(F.count("*").alias("n")).groupBy("name").agg(F.sum("n").alias("apps"), F.max_by("kind", F.struct("n", -_rank())).alias("kind"))
    header = sorted((r.name, r.kind) for r in top.where(F.col("apps") >= max(1, share * apps)).collect())
    rest = [without(c, [n for n, k in header if _CAST[k][0] == c]) for c in maps]
    columns = [F.try_element_at(F.col(_CAST[k][0]), F.lit(n)).cast(_CAST[k][1]).alias(c) for (n, k), c in zip(header, _columns([n for n, _ in header]))]
    return table.select("app", "file_no", "record_no", "ts", "level", "template", "exception", *columns, *rest, "failed")
