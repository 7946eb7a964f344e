"""Small text functions: deltas, durations, hashes, cut texts, scores, sort keys, argument templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CUT_MARK = "…(truncated)"
_NUMBER = r"^\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def format_delta(us: Column) -> Column:
    """A signed time difference in microseconds as +12ms, +1.234s, +2m03s, +1h02m or +2d03h; null stays null."""
    a = F.abs(us)
    sign = F.when(us < 0, "-").otherwise("+")
    part = lambda unit, of: F.floor(a / unit % of).cast("int")
    ms = F.round(a / 1000).cast("long")
    return (
        F.when(us.isNull(), F.lit(None).cast("string"))
        .when(a < 1_000_000, F.concat(sign, F.floor(a / 1000).cast("string"), F.lit("ms")))
        .when(a < 60_000_000, F.concat(sign, F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("s")))
        .when(a < 3_600_000_000, F.concat(sign, part(60_000_000, 60).cast("string"), F.lit("m"), F.lpad(part(1_000_000, 60).cast("string"), 2, "0"), F.lit("s")))
        .when(a < 86_400_000_000, F.concat(sign, part(3_600_000_000, 24).cast("string"), F.lit("h"), F.lpad(part(60_000_000, 60).cast("string"), 2, "0"), F.lit("m")))
        .otherwise(F.concat(sign, F.floor(a / 86_400_000_000).cast("string"), F.lit("d"), F.lpad(part(3_600_000_000, 24).cast("string"), 2, "0"), F.lit("h")))
    )


def format_duration(us: Column) -> Column:
    """A span's duration: milliseconds with one decimal below a second, else seconds with two."""
    return F.when(us.isNull(), F.lit(None).cast("string")).when(us < 1_000_000, F.format_string("%.1f ms", us / 1000)).otherwise(F.format_string("%.2f s", us / 1e6))


def heat(us: Column) -> Column:
    """0..1 on a logarithmic scale of which five seconds are the end."""
    return F.when(us.isNotNull(), F.least(F.greatest(F.log10(us / 1000 + 1) / F.log10(F.lit(5001.0)), F.lit(0.0)), F.lit(1.0)))


def text_hash(text: Column) -> Column:
    """First 16 digits, in upper case, of the SHA-256 of a text."""
    return F.upper(F.substring(F.sha2(text, 256), 1, 16))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(CUT_MARK))).otherwise(text)


def fuzzy_score(name: Column, category: Column, query: str) -> Column:
    """Score of a name for a query: 1000 as beginning, 800 less its place inside, 500 less its place in the category,
    100 as scattered letters in order, else null."""
    q = query.strip().lower()
    if not q:
        return F.lit(0)
    inside, of_category = F.instr(F.lower(name), q), F.instr(F.lower(category), q)
    scattered = ".*".join("\\Q" + c + "\\E" for c in q)
    return (
        F.when(inside == 1, 1000).when(inside > 1, 801 - inside).when(of_category > 0, 501 - of_category)
        .when(F.lower(name).rlike(scattered), 100).otherwise(F.lit(None).cast("int"))
    )


def natural_sort_keys(value: Column, descending: bool = False) -> list[Column]:
    """Sort keys: numbers by value before texts without letter case, then exactly; nulls last in either direction."""
    number = F.when(value.rlike(_NUMBER), F.trim(value).try_cast("double"))
    keys = [number.isNull(), number, F.upper(value), value]
    return [value.isNull().asc(), *[k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]]


def build_args(template: str, file_path: str | None, line_number: int | None, line_text: str | None) -> str:
    """A command's arguments with {FilePath}, {LineNumber} and {LineText} filled in."""
    for hole, value in (("{FilePath}", file_path), ("{LineNumber}", line_number), ("{LineText}", line_text)):
        template = template.replace(hole, "" if value is None else str(value))
    return template
