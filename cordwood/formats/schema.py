"""The schemas of lines and events."""

from __future__ import annotations

LINE_SCHEMA = "source string, line_number long, text string"
EVENT_FIELDS = (
    "ts timestamp, ts_offset_min int, level string, message_template string, message string, exception string, "
    "properties map<string,string>, trace_id string, span_id string"
)
EVENT_SCHEMA = "source string, line_number long, " + EVENT_FIELDS
EVENT_COLUMNS = [x.split()[0] for x in EVENT_FIELDS.split(", ")]
