"""Multi-line entries and exception groups.

Every line is first put into one of a few classes by expressions inside the JVM (frame, Python frame, continuation,
traceback, exception header, indented, blank ...), so that what is left is a word over a small alphabet. Two transition
tables, one for exceptions and one for entries, say how such words are read; they run over parts of a source that begin
at lines from which on nothing above matters.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cordwood import constants as K
from cordwood.functions.fields import text_time
from cordwood.functions.ordered import safe_groups

# Shapes of the lines of stack traces.
HEADER = re.compile(r"((?:[A-Za-z_][\w$]*\.)*[A-Za-z_][\w$]*(?:Exception|Error|Fault))(?::\s*(.*))?")
FRAME = re.compile(r"^\s+at\s+(.+)$")
PY_FRAME = re.compile(r"^\s+File \"([^\"]+)\", line \d+(?:, in (.+))?")
MORE = re.compile(r"^\s*(?:Caused by:|---\s|\.\.\.\s*\d+\s+more|--- End of)")
TRACEBACK = re.compile(r"^Traceback \(most recent call last\):")
_PLACE = re.compile(r"\s+in\s+.+?:line\s+\d+$|:line\s+\d+$|\(([^():]+?)(?::\d+)+\)$")
_VARIABLE = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|\b0x[0-9a-fA-F]+\b|\d+")

# The classes of lines, tried in this order; a small letter is a line of the class that also holds an exception header.
STRUCTURED, BLANK, FRAMED, PY_FRAMED, MORE_INDENTED, MORE_PLAIN, TRACE, HEAD, INDENTED, OTHER = "XBFPCDTHIO"
_SAFE = (STRUCTURED, TRACE, OTHER, OTHER.lower())  # lines that end whatever came before
_INDENTED = "FfPpCcIi"
_JAVA_HEADER = r"[A-Za-z_][\w$]*(?:Exception|Error|Fault)"


def line_class(text: Column, structured: Column | None = None) -> Column:
    """The letter of a line's class; null texts are blank, and structured texts, where there are any, come first."""
    text = F.coalesce(text, F.lit(""))
    like = lambda pattern: text.rlike("(?sU)" + pattern)
    letter = lambda c: F.when(like(_JAVA_HEADER), c.lower()).otherwise(c)
    found = F.when(~like(r"\S"), BLANK)
    for pattern, c in ((FRAME.pattern, FRAMED), (PY_FRAME.pattern, PY_FRAMED), (r"^(?=\s)" + MORE.pattern[1:], MORE_INDENTED), (MORE.pattern, MORE_PLAIN)):
        found = found.when(like(pattern), letter(c))
    found = found.when(like(TRACEBACK.pattern), TRACE).when(like(r"^(?:[A-Za-z_][\w$]*\.)*" + _JAVA_HEADER), HEAD)
    found = found.when(like(r"^\s"), letter(INDENTED)).otherwise(letter(OTHER))
    return found if structured is None else F.when(structured.isNotNull(), STRUCTURED).otherwise(found)


def normalize_frame_text(frame: str) -> str:
    bare = _PLACE.sub(lambda m: f"({m[1]})" if m[1] else "", frame)
    return re.sub(r"\d+", "#", bare).strip()


def signature_of(kind: str, message: str, frames: list[str]) -> str:
    """Type and the first normalised frames, without frames type and masked message."""
    shapes = [normalize_frame_text(f) for f in frames[: K.EXCEPTION_FRAMES]]
    return "|".join([kind, *shapes]) if shapes else f"{kind}|{_VARIABLE.sub('#', message)}"


# ---- exceptions -------------------------------------------------------------------------------------------------

# The words of an exception: a header with frames and continuations, or a traceback with indented lines and the header
# that ends it. (state, classes of lines) -> (next state, what the line is); any other line ends the exception and is
# looked at as the first of another one.
_READ = {
    ("", "Hfpcdio"): ("headed", "header"), ("", TRACE): ("traced", "trace"), ("", STRUCTURED): ("", "whole"),
    ("headed", "Ff"): ("headed", "frame"), ("headed", "CcDd"): ("headed", "more"),
    ("traced", "Ff"): ("traced", "frame"), ("traced", "Pp"): ("traced", "pyframe"), ("traced", "CcIi"): ("traced", "more"), ("traced", HEAD): ("", "named"),
}
_STEP = {(state, c): to for (state, classes), to in _READ.items() for c in classes}


def stretches(classes: str) -> list[tuple[int, list[str]]]:
    """(place of the first line, what each line is) of every exception in a word of line classes."""
    out: list[tuple[int, list[str]]] = []
    state = ""
    for i, c in enumerate(classes):
        step = _STEP.get((state, c)) or _STEP.get(("", c))
        if step is None:
            state = ""
            continue
        if not state or (state, c) not in _STEP:
            out.append((i, []))
        out[-1][1].append(step[1])
        state = step[0]
    return out


def _told(rows: list[tuple], first: int, kinds: list[str]) -> tuple | None:
    """The exception of a stretch of (line, time, text, structured) rows; None for a header without frames."""
    number, at, _, structured = rows[first]
    texts = structured.replace("\r\n", "\n").split("\n") if kinds == ["whole"] else [r[2] or "" for r in rows[first : first + len(kinds)]]
    if kinds == ["whole"]:
        kinds = ["header", *("frame" if FRAME.match(t) else "more" for t in texts[1:])]
    frames = [FRAME.match(t)[1].strip() for t, k in zip(texts, kinds) if k == "frame"]
    if kinds[0] == "trace":
        found = [m for t, k in zip(texts, kinds) if k in ("frame", "pyframe") and (m := FRAME.match(t) or PY_FRAME.match(t))]
        frames = [" in ".join(x for x in m.groups() if x).strip() for m in found][::-1]
    named = HEADER.search(texts[0] if kinds[0] == "header" else texts[-1]) if kinds[0] == "header" or kinds[-1] == "named" else None
    if structured is None and (named is None or not frames):
        return None
    kind, message = (named[1], (named[2] or "").strip()) if named else (texts[0].strip(), "")
    sample = structured if structured is not None else "\n".join(texts[: K.EXCEPTION_SAMPLE_LINES]).rstrip()
    return (number, at, kind, message, signature_of(kind, message, frames), frames[0] if frames else None, sample)


def read(rows: list[tuple], classes: str) -> list[tuple]:
    """(line, time, type, message, signature, top frame, sample) of every exception in rows in order."""
    return [told for first, kinds in stretches(classes) if (told := _told(rows, first, kinds))]


def occurrences(lines: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """source, line_number, ts, type, message, signature, top_frame, sample of every exception.

    lines: source, line_number, text; copies of a line count once. With events, structured exception texts take the
    place of the text's own and their times come first. Headers without frames are no exceptions; null texts are
    blank. Lines of other classes only end what stands above them, so their texts stay behind.
    """
    rows = lines.select("source", "line_number", "text")
    if events is not None:
        mine = events.select("source", "line_number", F.col("ts").alias("_ts"), F.nullif("exception", F.lit("")).alias("_x"))
        rows = rows.join(mine, ["source", "line_number"], "left").withColumn("ts", F.coalesce("_ts", text_time(F.col("text"))))
    else:
        rows = rows.withColumns({"ts": text_time(F.col("text")), "_x": F.lit(None).cast("string")})
    rows = rows.withColumn("_class", line_class(F.col("text"), F.col("_x")))
    # a blank line of white space goes on with a traceback as an indented one does
    rows = rows.withColumn("_class", F.when((F.col("_class") == BLANK) & (F.col("text") != ""), INDENTED).otherwise(F.col("_class")))
    rows = rows.withColumn("text", F.when(~F.col("_class").isin(OTHER, BLANK, STRUCTURED), F.col("text")))
    parts = safe_groups(rows.select("source", "line_number", "ts", "text", "_x", "_class"), "source", "line_number", F.col("_class").isin(*_SAFE))

    def per_part(key, pdf):
        pdf = pdf.sort_values("line_number").drop_duplicates("line_number")
        none = lambda c: pdf[c].astype(object).where(pdf[c].notna(), None)
        found = read(list(zip(pdf["line_number"], none("ts"), none("text"), none("_x"))), "".join(pdf["_class"]))
        out = pd.DataFrame(found, columns=["line_number", "ts", "type", "message", "signature", "top_frame", "sample"])
        out.insert(0, "source", key[0])
        return out

    schema = "source string, line_number long, ts timestamp, type string, message string, signature string, top_frame string, sample string"
    return parts.groupBy("source", "_g").applyInPandas(per_part, schema)


def groups(found: DataFrame, n: int | None = None, by_first: bool = False) -> DataFrame:
    """Exceptions by signature: type, message, top frame and sample of the first, count, first and last line, times of
    the first and last with one, and at most EXCEPTION_LINES line numbers. Most frequent first, then last line (or
    first line, in reports)."""
    place = F.struct("line_number", "source")
    timed = F.when(F.col("ts").isNotNull(), place)
    summary = found.groupBy("signature").agg(
        F.count("*").alias("count"), F.min_by(F.struct("type", "message", "top_frame", "sample"), place).alias("_f"),
        F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"), F.min_by("ts", timed).alias("first_seen"), F.max_by("ts", timed).alias("last_seen"),
    )
    summary = summary.select(
        "signature", F.col("_f.type").alias("type"), F.col("_f.message").alias("message"), F.col("_f.top_frame").alias("top_frame"), F.col("_f.sample").alias("sample"),
        "count", "first_line", "last_line", "first_seen", "last_seen",
    )
    order = [F.desc("count"), F.asc("first_line") if by_first else F.desc("last_line"), "signature"]
    return summary.orderBy(*order).limit(n) if n is not None else summary


def group_lines(found: DataFrame, n: int = K.EXCEPTION_LINES) -> DataFrame:
    """signature, lines: the first n line numbers of each group."""
    ranked = found.withColumn("_r", F.row_number().over(W.partitionBy("signature").orderBy("line_number", "source"))).where(F.col("_r") <= n)
    return ranked.groupBy("signature").agg(F.array_sort(F.collect_list("line_number")).alias("lines"))


# ---- entries ----------------------------------------------------------------------------------------------------


# The words of an entry: a head, then frames and what goes on with them. A bare exception header right below a head is a
# head too until a frame or a traceback shows that it belongs to the entry above (lift). A blank line ends the entry.
_GOES_ON = {
    **{(state, c): ("trace", "lift" if state == "bare" else "join") for state in ("head", "bare", "trace") for c in "Ff"},
    **{(state, TRACE): ("python", "lift" if state == "bare" else "join") for state in ("head", "bare", "trace")},
    **{("trace", c): ("trace", "join") for c in "PpCcDdIi"},
    **{("python", c): ("python", "join") for c in _INDENTED},
    ("python", HEAD): ("head", "join"),
}


def heads(rows) -> list[int | None]:
    """For each (line, class, starts) of a source in order the line of the entry that it continues, None for heads and
    blank lines. starts: the line is known to begin an entry."""
    out: list[int | None] = []
    state, mine, above = "", None, None
    for number, c, starts in rows:
        step = None if starts else _GOES_ON.get((state, c))
        if c == BLANK:
            state, mine = "", None
        elif step is None:
            state, above, mine = "python" if c == TRACE else "bare" if c == HEAD and state else "head", mine, number
        else:
            state = step[0]
            if step[1] == "lift":
                out[-1] = mine = above
        out.append(mine if step and c != BLANK else None)
    return out


def group_entries(lines: DataFrame, starts: Column | None = None) -> DataFrame:
    """source, line_number, head_line: the line whose entry a line continues, null for heads and blank lines. Copies of
    a line count once; texts are read where they lie, and only the classes of lines move."""
    known = F.lit(False) if starts is None else F.coalesce(starts, F.lit(False))
    rows = lines.select("source", "line_number", line_class(F.col("text")).alias("_class"), known.alias("_starts"))
    parts = safe_groups(rows, "source", "line_number", F.col("_class").isin(OTHER, OTHER.lower()))

    def per_part(key, pdf):
        pdf = pdf.sort_values("line_number").drop_duplicates("line_number")
        found = heads(zip(pdf["line_number"], pdf["_class"], pdf["_starts"]))
        return pd.DataFrame({"source": key[0], "line_number": pdf["line_number"].values, "head_line": pd.array(found, dtype="Int64")})

    return parts.groupBy("source", "_g").applyInPandas(per_part, "source string, line_number long, head_line long")
