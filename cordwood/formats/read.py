"""Format detection and lines -> events for any format."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordwood.constants import DETECT_LEAST, DETECT_LINES, DETECT_SHARE
from cordwood.formats import native
from cordwood.formats.parsers import PARSERS, CustomFormat, logfmt_pairs, members, parse_serilog, segments
from cordwood.formats.schema import EVENT_COLUMNS, EVENT_FIELDS, EVENT_SCHEMA
from cordwood.functions.ordered import running

_5424, _3164 = (re.compile(p.replace("(?s)", ""), re.S) for p in (native.RFC5424, native.RFC3164))


def _is_w3c() -> Callable[[str], bool]:
    width: list[int] = []

    def matches(text: str) -> bool:
        m = re.match(r"(?i)^#\s*fields\s*:(.*)", text)
        if m:
            width[:] = [len(m[1].split())]
            return False
        return bool(width) and not text.startswith("#") and len(re.findall(native._ROW, text)) >= width[0]

    return matches


def detect_format(lines: list[str], custom: tuple[CustomFormat, ...] = (), share: float = DETECT_SHARE, least: int = DETECT_LEAST) -> str | None:
    """The format of most of a source's first lines, None if no format has its share.

    Of the first DETECT_LINES lines blank ones are dropped; lines that begin with # and are no event of the format are
    not counted. The best share wins, ties go to the format tried first: custom ones in their order, then serilog,
    ndjson, w3c, syslog, logfmt.
    """
    sample = [x for x in lines[:DETECT_LINES] if x.strip()]
    tries: list[tuple[str, Callable[[str], object]]] = [(c.name, c.parser()) for c in custom if c.validate() is None]
    tries += [
        ("serilog", PARSERS["serilog"]), ("ndjson", PARSERS["ndjson"]), ("w3c", _is_w3c()),
        ("syslog", lambda x: _5424.match(x) or _3164.match(x)), ("logfmt", PARSERS["logfmt"]),
    ]
    best, name = 0.0, None
    for candidate, matches in tries:
        hits = [bool(matches(x)) for x in sample]
        counted = sum(h or not x.startswith("#") for h, x in zip(hits, sample))
        if counted >= least and sum(hits) / counted >= share and sum(hits) / counted > best:
            best, name = sum(hits) / counted, candidate
    return name


def is_serilog(lines: list[str]) -> bool:
    """Whether four fifths or more of at least three lines that are not blank are such events."""
    sample = [x for x in lines if x.strip()]
    return len(sample) >= 3 and sum(parse_serilog(x) is not None for x in sample) >= 0.8 * len(sample)


def detect_sources(lines: DataFrame, custom: tuple[CustomFormat, ...] = ()) -> DataFrame:
    """source, format of every source, by its first DETECT_LINES lines."""
    first = lines.where(F.col("line_number") <= DETECT_LINES).select("source", "line_number", "text")

    def per_source(key, pdf):
        texts = pdf.drop_duplicates("line_number").sort_values("line_number")["text"].fillna("").tolist()
        return pd.DataFrame({"source": [key[0]], "format": [detect_format(texts, custom)]})

    return first.groupBy("source").applyInPandas(per_source, "source string, format string")


def _by_python(lines: DataFrame, parse: Callable[[str], dict | None]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, n, e) for s, n, t in zip(pdf["source"], pdf["line_number"], pdf["text"]) if t is not None and (e := parse(t)) is not None]
            if not rows:
                continue
            yield pd.DataFrame(
                {"source": [r[0] for r in rows], "line_number": [r[1] for r in rows], **{c: pd.Series([r[2][c] for r in rows], dtype=object) for c in EVENT_COLUMNS}}
            )

    return lines.select("source", "line_number", "text").mapInPandas(run, EVENT_SCHEMA)


def parse(lines: DataFrame, fmt: str | CustomFormat | None, year: int = 1970) -> DataFrame:
    """Events of the lines that are in the format; others are left out. Without format: serilog, else plain text."""
    if isinstance(fmt, CustomFormat):
        return _by_python(lines, fmt.parser())
    if fmt in PARSERS:
        return _by_python(lines, PARSERS[fmt])
    if fmt == "syslog":
        return native.parse_syslog(lines, year)
    if fmt == "w3c":
        return native.parse_w3c(lines)
    if fmt == "plain":
        return native.parse_plain(lines)
    if fmt is None:
        return coalesce_events(parse(lines, "serilog"), native.parse_plain(lines))
    raise ValueError(f"unknown format {fmt}")


def coalesce_events(first: DataFrame, second: DataFrame) -> DataFrame:
    """Events of first, and those of second on lines that first has none of."""
    return first.unionByName(second.join(first.select("source", "line_number"), ["source", "line_number"], "left_anti"))


def join_continuations(lines: DataFrame, events: DataFrame) -> DataFrame:
    """lines with owner (the event line that a line belongs to) and level: lines that are no event and not blank
    belong to the event above them."""
    heads = events.select("source", "line_number", F.col("level").alias("_level"), F.lit(True).alias("_is"))
    rows = lines.join(heads, ["source", "line_number"], "left")
    rows = running(rows, ["source"], "line_number", lasts={"_o": F.when(F.col("_is"), F.struct("line_number", "_level"))})
    mine = F.col("_is").isNotNull() | (F.col("text") != "")
    return rows.select(*lines.columns, F.when(mine, F.col("_o.line_number")).alias("owner"), F.when(mine, F.col("_o._level")).alias("level"))


__all__ = ["EVENT_FIELDS", "coalesce_events", "detect_format", "detect_sources", "is_serilog", "join_continuations", "logfmt_pairs", "members", "parse", "segments"]
