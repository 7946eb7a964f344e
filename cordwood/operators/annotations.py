"""Bookmarks, notes, context windows, incident reports and exports."""

from __future__ import annotations

import datetime as dt
import html
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cordwood.functions.text import text_hash
from cordwood.operators import exceptions

MOST_MARKED, CONTEXT, MOST_GROUPS, NOTE_CAP = 500, 2, 10, 500


def bookmarks(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """source, line_number, note, text of every bookmark, by line; text is null if the line is gone."""
    return marks.select("source", "line_number", "note").join(lines.select("source", "line_number", "text"), ["source", "line_number"], "left").orderBy("source", "line_number")


def notes(lines: DataFrame, given: DataFrame) -> DataFrame:
    """source, line_number, note, text, line_changed: whether the line no longer has the text that the note was written on."""
    rows = given.select("source", "line_number", "note", "text_hash").join(lines.select("source", "line_number", "text"), ["source", "line_number"], "left")
    same = F.coalesce(text_hash(F.col("text")) == F.col("text_hash"), F.lit(False))
    return rows.select("source", "line_number", "note", "text", (~same).alias("line_changed"))


def new_note(text: str, by_tool: bool = False) -> str:
    """A note's text as it is kept: trimmed, cut, and marked if a tool wrote it."""
    return ("[AI] " if by_tool else "") + text.strip()[:NOTE_CAP]


def next_mark(marks: DataFrame, line_number: int, forward: bool = True) -> DataFrame:
    """line_number of the next mark, around the end if need be; null without any."""
    n = F.col("line_number")
    first, all_ = (F.min(F.when(n > line_number, n)), F.min(n)) if forward else (F.max(F.when(n < line_number, n)), F.max(n))
    return marks.agg(F.coalesce(first, all_).alias("line_number"))


def merge_windows(marked: DataFrame, context: int, total: int) -> DataFrame:
    """first, last: the windows of context lines around marked lines, made one where they overlap or touch. marked is
    what a user marked, a few hundred lines at most, so one window over it does."""
    rows = marked.select("line_number").distinct().select(F.greatest(F.col("line_number") - context, F.lit(1)).alias("a"), F.least(F.col("line_number") + context, F.lit(total)).alias("b"))
    order = W.orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("a") <= reach + 1, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(order))
    return rows.groupBy("_g").agg(F.min("a").alias("first"), F.max("b").alias("last")).drop("_g")


# ---- report -----------------------------------------------------------------------------------------------------


@dataclass
class Report:
    title: str
    source: str
    generated: dt.datetime
    total_lines: int
    bookmark_count: int
    note_count: int
    excerpts: list[list[dict]] = field(default_factory=list)  # number, text, marked, bookmarked, note
    groups: list[dict] = field(default_factory=list)
    total_groups: int = 0


def build_report(
    lines: DataFrame, title: str, source: str, marks: list[int] = (), noted: list[dict] = (), selected: list[int] = (), context: int = CONTEXT,
    most_groups: int = MOST_GROUPS, events: DataFrame | None = None, now: dt.datetime | None = None,
) -> Report:
    """The marked lines of a source with context, and its most frequent exceptions.

    noted: line_number, text_hash, note; a note counts only while its line has the text it was written on. At most
    MOST_MARKED marked lines are shown.
    """
    mine = lines.where(F.col("source") == source)
    total = mine.agg(F.max("line_number")).first()[0] or 0
    inside = lambda n: 1 <= n <= total
    booked = {n for n in marks if inside(n)}
    wanted = {x["line_number"]: x for x in noted if inside(x["line_number"])}
    hashes = {r.line_number: r.h for r in mine.where(F.col("line_number").isin(list(wanted))).select("line_number", text_hash(F.col("text")).alias("h")).collect()} if wanted else {}
    valid = {n: x["note"] for n, x in wanted.items() if hashes.get(n) == x["text_hash"]}
    chosen = {n for n in selected if inside(n)}
    marked = sorted(booked | valid.keys() | chosen)[:MOST_MARKED]
    windows: list[list[int]] = []
    for n in marked:
        a, b = max(1, n - context), min(total, n + context)
        if windows and a <= windows[-1][1] + 1:
            windows[-1][1] = max(windows[-1][1], b)
        else:
            windows.append([a, b])
    shown = [k for a, b in windows for k in range(a, b + 1)]
    texts = {r.line_number: r.text or "" for r in mine.where(F.col("line_number").isin(shown)).select("line_number", "text").collect()} if shown else {}
    excerpts = [
        [{"number": k, "text": texts.get(k, ""), "marked": k in booked or k in valid or k in chosen, "bookmarked": k in booked, "note": valid.get(k)} for k in range(a, b + 1)]
        for a, b in windows
    ]
    found = exceptions.groups(exceptions.occurrences(mine, events))
    top = [r.asDict() for r in found.orderBy(F.desc("count"), "first_line", "signature").limit(max(0, most_groups)).collect()]
    return Report(title, source, now or dt.datetime.now(dt.timezone.utc), total, len(booked), len(valid), excerpts, top, found.count())


def _inline(text: str) -> str:
    return re.sub(r"([\\`*_\[\]<>#|~])", r"\\\1", text.replace("\r", " ").replace("\n", " "))


def _code(text: str) -> str:
    ticks = "`" * (max([0, *map(len, re.findall("`+", text))]) + 1)
    pad = " " if "`" in text else ""
    return f"{ticks}{pad}{text}{pad}{ticks}"


def _fence(body: str, language: str = "text") -> str:
    ticks = "`" * max(3, max([0, *map(len, re.findall("`+", body))]) + 1)
    return f"{ticks}{language}\n{body}\n{ticks}\n"


def _range(excerpt: list[dict]) -> str:
    a, b = excerpt[0]["number"], excerpt[-1]["number"]
    return f"Line {a}" if a == b else f"Lines {a}–{b}"


def _time(at: dt.datetime | None) -> str:
    return "" if at is None else at.strftime("%Y-%m-%d %H:%M:%S")


def _facts(g: dict) -> list[tuple[str, str, bool]]:
    """What is said of an exception group: label, value, whether it is code."""
    facts = [("Occurrences", str(g["count"]), False), ("Lines", f"{g['first_line']}–{g['last_line']}", False)]
    if g["first_seen"] is not None:
        facts.append(("Seen", f"{_time(g['first_seen'])} – {_time(g['last_seen'])}", False))
    return facts + ([("Top frame", g["top_frame"], True)] if g["top_frame"] else [])


def report_markdown(r: Report) -> str:
    out = [
        f"# Incident report — {_inline(r.title)}", "", f"- **File:** {_code(r.source)}", f"- **Generated:** {_time(r.generated)}",
        f"- **Lines in file:** {r.total_lines}", f"- **Bookmarks:** {r.bookmark_count}, **Notes:** {r.note_count}", "", "## Marked lines", "",
    ]
    for e in r.excerpts:
        out += [f"### {_range(e)}", ""]
        said = [f"> **Line {x['number']}:** {_inline(x['note'])}" for x in e if x["note"]]
        out += ["\n>\n".join(said), ""] if said else []
        wide = len(str(e[-1]["number"]))
        out.append(_fence("\n".join(f"{'>' if x['marked'] else ' '} {x['number']:>{wide}}  {x['text']}" for x in e)))
    out += [] if r.excerpts else ["_No marked lines._", ""]
    out += ["## Exceptions", ""]
    out += [f"Top {len(r.groups)} of {r.total_groups} groups.", ""] if r.groups else ["_No exceptions found._", ""]
    for i, g in enumerate(r.groups, 1):
        out += [f"### {i}. {_inline(g['type'])} × {g['count']}", ""]
        out += [_inline(g["message"]), ""] if g["message"] else []
        out += [f"- **{label}:** {_code(value) if code else value}" for label, value, code in _facts(g)]
        out += ["", _fence(g["sample"].rstrip())]
    return "\n".join(out)


def report_html(r: Report) -> str:
    e = html.escape
    meta = (("File", f"<code>{e(r.source)}</code>"), ("Generated", _time(r.generated)), ("Lines in file", r.total_lines), ("Bookmarks", r.bookmark_count), ("Notes", r.note_count))
    out = [
        "<!DOCTYPE html>", f'<html><head><meta charset="utf-8"><title>{e(r.title)}</title>', "<style>pre{background:#f6f8fa;overflow-x:auto}.chosen{background:#fdf3c4}.no{color:#777;margin-right:1ch}</style>",
        "</head><body>", f"<h1>Incident report — {e(r.title)}</h1>", "<dl>", *[f"<dt>{k}</dt><dd>{v}</dd>" for k, v in meta], "</dl>", "<h2>Marked lines</h2>",
    ]
    for x in r.excerpts:
        out.append(f"<h3>{_range(x)}</h3>")
        out += [f"<div class=\"remark\"><strong>Line {y['number']}:</strong> {e(y['note'])}</div>" for y in x if y["note"]]
        body = "".join(f'<span class="{"row chosen" if y["marked"] else "row"}"><span class="no">{y["number"]}</span> {e(y["text"])}</span>\n' for y in x)
        out.append(f"<pre><code>{body}</code></pre>")
    out += [] if r.excerpts else ["<p>No marked lines.</p>"]
    out.append("<h2>Exceptions</h2>")
    out.append(f"<p>Top {len(r.groups)} of {r.total_groups} groups.</p>" if r.groups else "<p>No exceptions found.</p>")
    for i, g in enumerate(r.groups, 1):
        out.append(f"<h3>{i}. {e(g['type'])} × {g['count']}</h3>")
        out += [f"<p>{e(g['message'])}</p>"] if g["message"] else []
        out.append("<p>" + " · ".join(f"{label}: {e(value)}" for label, value, _ in _facts(g)) + "</p>")
        out.append(f"<pre><code>{e(g['sample'].rstrip())}</code></pre>")
    return "\n".join([*out, "</body></html>", ""])


# ---- exports ----------------------------------------------------------------------------------------------------


def export_text(lines: DataFrame) -> DataFrame:
    return lines.select(F.coalesce("text", F.lit("")).alias("value"))


def export_json(lines: DataFrame, events: DataFrame) -> DataFrame:
    """value: an event's fields as JSON, or lineNumber and text of a line that is none."""
    rows = lines.join(events.drop("ts_offset_min"), ["source", "line_number"], "left")
    event = F.to_json(F.struct(
        F.col("line_number").alias("lineNumber"), F.col("ts").alias("timestamp"), "level", F.col("message_template").alias("messageTemplate"), "message", "exception",
        "properties", F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"),
    ))
    plain = F.to_json(F.struct(F.col("line_number").alias("lineNumber"), "text"))
    return rows.select(F.when(F.col("message").isNotNull(), event).otherwise(plain).alias("value"))


def formatted(lines: DataFrame, events: DataFrame) -> DataFrame:
    """source, line_number, value of every line: yyyy-MM-dd HH:mm:ss.SSS [Level] message, and the exception below; an
    event without a time has no stamp, and a line that is no event stays as it is."""
    rows = lines.join(events.select("source", "line_number", "ts", "level", "message", "exception"), ["source", "line_number"], "left")
    head = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.concat(F.lit("["), F.coalesce("level", F.lit("Information")), F.lit("]")), "message")
    value = F.when(F.col("message").isNull(), F.col("text")).otherwise(F.concat_ws("\n", head, F.nullif("exception", F.lit(""))))
    return rows.select("source", "line_number", value.alias("value"))


def export_formatted(lines: DataFrame, events: DataFrame) -> DataFrame:
    """value of formatted, one row a line."""
    return formatted(lines, events).select("value")
