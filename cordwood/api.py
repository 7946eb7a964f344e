"""The questions asked of logs, as functions: a catalogue of documents, and one function for each question."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordwood.formats.read import detect_format, is_serilog, parse
from cordwood.functions.text import text_hash, truncate
from cordwood.functions.timequery import parse_time_query
from cordwood.operators import annotations, blocks, exceptions, patterns, search

TEXT_CAP = 4000
CONTEXT_CAP = 100
EXCEPTION_LINES_SHOWN = 20


@dataclass
class Document:
    """A source with its lines and, once its format is known, its events."""

    name: str
    lines: DataFrame
    format: str | None = None
    parsed: DataFrame | None = None

    def events(self) -> DataFrame:
        if self.parsed is None:
            self.parsed = parse(self.lines, self.format)
        return self.parsed

    def head(self, n: int = 30) -> list[str]:
        return [r.text or "" for r in self.lines.where(F.col("line_number") <= n).orderBy("line_number").select("text").collect()]


def open_document(name: str, lines: DataFrame) -> Document:
    doc = Document(name, lines)
    doc.format = detect_format(doc.head())
    return doc


def _cut(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", truncate(F.col("text"), TEXT_CAP)) if "text" in rows.columns else rows


class Logs:
    """The documents that are open, and what is asked of them."""

    def __init__(self, documents: list[Document], bookmarks: DataFrame | None = None, notes: DataFrame | None = None, alerts: DataFrame | None = None):
        self.documents = {d.name: d for d in documents}
        self.bookmarks, self.notes, self.alerts = bookmarks, notes, alerts

    def _doc(self, name: str) -> Document:
        if name not in self.documents:
            raise KeyError(f"no such document: {name}")
        return self.documents[name]

    def list_open_documents(self) -> list[dict]:
        return [{"name": d.name, "format": d.format} for d in self.documents.values()]

    def describe_source(self, name: str, lines: int = 10) -> dict:
        doc = self._doc(name)
        total = doc.lines.agg(F.max("line_number")).first()[0] or 0
        head = doc.head()
        return {"name": name, "format": doc.format, "is_serilog": is_serilog(head), "lines": total, "first_lines": head[: max(0, min(lines, CONTEXT_CAP))]}

    def list_structured_properties(self, name: str, sample: int = 2000) -> DataFrame:
        return patterns.list_properties(self._doc(name).events(), max(1, min(sample, 20_000)))

    def search(self, name: str, pattern: str, regex: bool = False, case: bool = False, prop: str | None = None, most: int = 100) -> tuple[DataFrame, bool]:
        hits = search.search(self._doc(name).lines, pattern, regex, case, prop)
        rows, more = search.cap(hits, search.clamp_rows(most), "line_number")
        return _cut(rows), more

    def get_line_context(self, name: str, line_number: int, before: int = 10, after: int = 10) -> DataFrame:
        from cordwood.sources.lines import line_window

        side = lambda n: max(0, min(n, CONTEXT_CAP))
        return _cut(line_window(self._doc(name).lines, line_number, side(before), side(after)).orderBy("line_number"))

    def pattern_occurrences(self, name: str, signature: str, most: int = 50) -> DataFrame:
        return patterns.pattern_occurrences(self._doc(name).events(), signature, search.clamp_rows(most))

    def top_patterns(self, name: str, min_level: str | None = None, most: int = 20) -> DataFrame:
        return patterns.top_patterns(self._doc(name).events(), min_level, search.clamp_rows(most))

    def top_error_sources(self, name: str, field: str = "SourceContext", min_level: str = "Error", most: int = 20) -> DataFrame:
        return patterns.top_error_sources(self._doc(name).events(), field, min_level, search.clamp_rows(most))

    def top_property_values(self, name: str, field: str, min_level: str | None = None, most: int = 20) -> DataFrame:
        return patterns.top_values(self._doc(name).events(), field, min_level, False, search.clamp_rows(most))

    def scan_blocks(self, name: str, field: str | None = None, gap_us: int = 2_000_000, most: int = 50) -> DataFrame:
        events = self._doc(name).events()
        made = blocks.blocks_by_correlation(events, field) if field else blocks.blocks_by_proximity(events, gap_us)
        return blocks.block_summary(made).orderBy("first_line", "block_id").limit(search.clamp_rows(most))

    def find_similar_blocks(self, name: str, line_number: int, target: str | None = None, field: str | None = None, most: int = 5) -> DataFrame:
        def scanned(doc: Document) -> DataFrame:
            return blocks.blocks_by_correlation(doc.events(), field) if field else blocks.blocks_by_proximity(doc.events())

        anchors = scanned(self._doc(name))
        mine = blocks.block_containing(anchors, line_number)
        anchor = anchors.join(mine, "block_id", "left_semi").drop("block_id")
        return blocks.similar_blocks(anchor, scanned(self._doc(target or name)), search.clamp_rows(most))

    def exception_groups(self, name: str, most: int = 20) -> DataFrame:
        found = exceptions.occurrences(self._doc(name).lines, self._doc(name).events())
        top = exceptions.groups(found, search.clamp_rows(most))
        return top.join(exceptions.group_lines(found.join(F.broadcast(top.select("signature")), "signature", "left_semi"), EXCEPTION_LINES_SHOWN), "signature").orderBy(F.desc("count"), F.desc("last_line"))

    def get_bookmarks(self, name: str, most: int = 100) -> DataFrame:
        return _cut(annotations.bookmarks(self._doc(name).lines, self.bookmarks.where(F.col("source") == name))).limit(search.clamp_rows(most))

    def get_notes(self, name: str, most: int = 100) -> DataFrame:
        return _cut(annotations.notes(self._doc(name).lines, self.notes.where(F.col("source") == name))).orderBy("line_number").limit(search.clamp_rows(most))

    def get_new_lines_since(self, name: str, after_line: int, most: int = 100) -> DataFrame:
        return _cut(search.new_lines_since(self._doc(name).lines, after_line, search.clamp_rows(most)))

    def query_time_range(self, name: str, start: str | None, end: str | None, most: int = 200) -> tuple[DataFrame, bool]:
        """Times as typed; relative ones count from the document's last time. Raises ValueError for what is no time."""
        doc = self._doc(name)
        events = doc.events().select("source", "line_number", "ts")
        timed = doc.lines.join(events, ["source", "line_number"], "left").withColumnRenamed("ts", "own_ts")
        last = search.latest_ts(timed).agg(F.max("ts")).first()[0]
        reference = last.replace(tzinfo=dt.timezone.utc) if last is not None else None
        bounds = []
        for text in (start, end):
            at = parse_time_query(text, reference) if text else None
            if text and at is None:
                raise ValueError(f"no time: {text}")
            bounds.append(at)
        rows, more = search.cap(search.time_range(timed, *bounds), search.clamp_rows(most), "line_number")
        return _cut(rows), more

    def get_alerts(self, most: int = 50) -> DataFrame:
        return self.alerts.orderBy(F.desc("at_us"), F.desc("line_number")).limit(min(search.clamp_rows(most), 200))

    def add_bookmark(self, name: str, line_number: int, note: str | None = None) -> DataFrame:
        one = self.bookmarks.sparkSession.createDataFrame([(name, line_number, note)], "source string, line_number long, note string")
        self.bookmarks = self.bookmarks.select("source", "line_number", "note").unionByName(one)
        return one

    def add_note(self, name: str, line_number: int, note: str) -> DataFrame:
        text = self._doc(name).lines.where(F.col("line_number") == line_number).select(text_hash(F.col("text")).alias("h")).first()
        if text is None:
            raise ValueError(f"no line {line_number}")
        one = self.notes.sparkSession.createDataFrame([(name, line_number, annotations.new_note(note, True), text.h)], "source string, line_number long, note string, text_hash string")
        self.notes = self.notes.select("source", "line_number", "note", "text_hash").unionByName(one)
        return one
