"""Lines to events, one function per format: text -> event as a dict, or None if the line is none of the format's.

They keep the raw text of JSON numbers, arrays and objects, which no built-in function does, and run in Arrow batches;
syslog, W3C and plain text have no need of that and stay Columns (native.py).
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from cordwood.functions.levels import normalize_level_text

UTC = dt.timezone.utc

# Member and key names by role.
NDJSON_KEYS = {
    "level": ("level", "lvl", "severity", "loglevel", "levelname", "severitytext"),
    "message": ("message", "msg", "messagetemplate", "text", "body", "log", "@message"),
    "exception": ("exception", "error", "err", "stack", "stack_trace", "stacktrace"),
    "ts": ("timestamp", "ts", "time", "@timestamp", "date", "eventtime", "asctime"),
}
LOGFMT_KEYS = {
    "level": ("level", "lvl", "severity", "loglevel"),
    "message": ("msg", "message"),
    "exception": ("error", "err", "exception", "stacktrace", "stack"),
    "ts": ("ts", "time", "timestamp", "@timestamp", "t"),
}
CUSTOM_GROUPS = {
    "ts": ("timestamp", "ts", "datetime"), "level": ("level", "lvl", "severity", "loglevel"), "message": ("message", "msg"),
    "exception": ("exception", "error", "stacktrace"), "message_template": ("template", "messagetemplate"), "trace_id": ("traceid",), "span_id": ("spanid",),
}

_ISO = re.compile(r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})(?:[Tt ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?)?\s*(Z|z|[+-]\d{2}(?::?\d{2})?)?\s*$")
_HOLE = re.compile(r"\{[@$]?([0-9A-Za-z_]+)(?::[^}]*)?\}")


def parse_iso(text: str | None, zone: dt.tzinfo = UTC) -> dt.datetime | None:
    """An ISO 8601 stamp; without offset it is read in zone; digits beyond microseconds are cut."""
    m = _ISO.match(text or "")
    if not m:
        return None
    if m[8] and m[8] not in "Zz":
        digits = m[8][1:].replace(":", "").ljust(4, "0")
        zone = dt.timezone((-1 if m[8][0] == "-" else 1) * dt.timedelta(hours=int(digits[:2]), minutes=int(digits[2:])))
    elif m[8]:
        zone = UTC
    try:
        return dt.datetime(*(int(m[i] or 0) for i in range(1, 7)), int(((m[7] or "") + "000000")[:6]), tzinfo=zone)
    except ValueError:
        return None


def _epoch(n: int, micros: bool, millis: bool) -> dt.datetime | None:
    try:
        return dt.datetime(1970, 1, 1, tzinfo=UTC) + dt.timedelta(milliseconds=n // 1000 if micros else n if millis else n * 1000)
    except OverflowError:
        return None


def event(**given) -> dict:
    at = given.get("ts")
    out = dict.fromkeys(("ts", "ts_offset_min", "level", "message_template", "message", "exception", "properties", "trace_id", "span_id"))
    out.update(given)
    out["ts_offset_min"] = None if at is None else int(at.utcoffset().total_seconds() // 60)
    out["message"] = out["message"] or ""
    out["properties"] = out["properties"] or {}
    return out


# ---- JSON with raw member texts ---------------------------------------------------------------------------------

_DECODER = json.JSONDecoder(parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
_SPACE = re.compile(r"[ \t\r\n]*")


def members(text: str) -> list[tuple[str, object, str]] | None:
    """(name, value, raw text) of a JSON object's members in order, None if text is no such object."""
    at = _SPACE.match(text).end()
    if text[at : at + 1] != "{":
        return None
    out, at = [], _SPACE.match(text, at + 1).end()
    try:
        if text[at : at + 1] == "}":
            at += 1
        else:
            while True:
                name, at = _DECODER.raw_decode(text, at)
                at = _SPACE.match(text, at).end()
                if not isinstance(name, str) or text[at : at + 1] != ":":
                    return None
                start = _SPACE.match(text, at + 1).end()
                value, at = _DECODER.raw_decode(text, start)
                out.append((name, value, text[start:at]))
                at = _SPACE.match(text, at).end()
                mark = text[at : at + 1]
                at = _SPACE.match(text, at + 1).end()
                if mark == "}":
                    break
                if mark != ",":
                    return None
    except (ValueError, IndexError, RecursionError):
        return None
    return out if at >= len(text) or not text[at:].strip() else None


def flat(value: object, raw: str) -> str:
    return value if isinstance(value, str) else "" if value is None else raw


def fill(template: str | None, properties: dict[str, str]) -> str:
    """A template with its holes filled from properties; unknown holes stay."""
    return _HOLE.sub(lambda m: properties.get(m[1], m[0]), template or "")


def segments(template: str | None, properties: dict[str, str]) -> list[tuple[str, str | None]]:
    """The rendered template as (text, property name or None) pieces."""
    out, end = [], 0
    for m in _HOLE.finditer(template or ""):
        if m[1] in properties:
            if m.start() > end:
                out.append((template[end : m.start()], None))
            out.append((properties[m[1]], m[1]))
            end = m.end()
    if end < len(template or ""):
        out.append((template[end:], None))
    return out


def _promoted(properties: dict[str, str], trace: str | None, span: str | None) -> tuple[str | None, str | None]:
    found = []
    for name, value in (("TraceId", trace), ("SpanId", span)):
        value = properties.get(name) if value is None else value
        if value is not None:
            properties[name] = value
        found.append(value)
    return found[0], found[1]


def parse_serilog(text: str) -> dict | None:
    """Compact events (any of @t, @mt, @m) and standard ones (MessageTemplate or RenderedMessage)."""
    if not text.lstrip().startswith("{"):
        return None
    found = members(text)
    if found is None:
        return None
    top = {n: v for n, v, _ in found}
    word = lambda n: top[n] if isinstance(top.get(n), str) else None
    if top.keys() & {"@t", "@mt", "@m"}:
        properties = {n: flat(v, raw) for n, v, raw in found if not n.startswith("@")}
        trace, span = _promoted(properties, word("@tr"), word("@sp"))
        return event(
            ts=parse_iso(word("@t")), level=word("@l") if "@l" in top else "Information", message_template=word("@mt"),
            message=fill(word("@mt"), properties) if "@mt" in top else word("@m"), exception=word("@x"), properties=properties, trace_id=trace, span_id=span,
        )
    if not top.keys() & {"MessageTemplate", "RenderedMessage"}:
        return None
    inner = next((members(raw) for n, v, raw in reversed(found) if n == "Properties" and isinstance(v, dict)), None) or []
    properties = {n: flat(v, raw) for n, v, raw in inner}
    message = word("RenderedMessage")
    message = fill(word("MessageTemplate"), properties) if message is None else message
    trace, span = _promoted(properties, word("TraceId"), word("SpanId"))
    return event(
        ts=parse_iso(word("Timestamp")), level=word("Level") if "Level" in top else "Information", message_template=word("MessageTemplate"),
        message=message, exception=word("Exception"), properties=properties, trace_id=trace, span_id=span,
    )


def _role(name: str, keys: dict[str, tuple[str, ...]], taken: dict) -> str | None:
    low = name.lower()
    return next((r for r, names in keys.items() if taken.get(r) is None and low in names), None)


def parse_ndjson(text: str) -> dict | None:
    """Any JSON object: the first member of each role in document order, all else properties."""
    found = members(text)
    if found is None:
        return None
    got: dict = {}
    properties: dict[str, str] = {}
    for name, value, raw in found:
        role = _role(name, NDJSON_KEYS, got)
        if role == "ts":
            at = parse_iso(value) if isinstance(value, str) else None
            if isinstance(value, int) and not isinstance(value, bool):
                at = _epoch(value, value > 100_000_000_000_000, value > 100_000_000_000)
            if at is not None:
                got["ts"] = at
                continue
        elif role == "exception" and value is None:
            pass
        elif role:
            got[role] = normalize_level_text(flat(value, raw)) if role == "level" else flat(value, raw)
            continue
        properties[name] = flat(value, raw)
    if not properties and "message" not in got and "level" not in got:
        return None
    return event(**{"level": "Information", **got, "properties": properties})


_LOGFMT = re.compile(r"\s*([^\s=]+)=(?:\"((?:[^\"\\]|\\.)*)(?:\"|\\?$)|(\S*))|\s*=?\S+", re.S)


def logfmt_pairs(text: str) -> list[tuple[str, str]]:
    """key=value pairs; in quoted values \\n, \\t and \\r are escapes and any other escaped character is itself."""
    out = []
    for m in _LOGFMT.finditer(text):
        if m[1] is not None:
            quoted = m[2]
            out.append((m[1], m[3] if quoted is None else re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e[1], e[1]), quoted, flags=re.S)))
    return out


def parse_logfmt(text: str) -> dict | None:
    """Two pairs or more with a message or a level."""
    pairs = logfmt_pairs(text)
    if len(pairs) < 2:
        return None
    got: dict = {}
    properties: dict[str, str] = {}
    for name, value in pairs:
        role = _role(name, LOGFMT_KEYS, got)
        if role == "ts":
            at = parse_iso(value)
            if at is None and re.fullmatch(r"-?\d{1,19}", value):
                at = _epoch(int(value), len(value) >= 16, len(value) >= 13)
            if at is not None:
                got["ts"] = at
                continue
        elif role:
            got[role] = normalize_level_text(value) if role == "level" else value
            continue
        properties[name] = value
    if "message" not in got and "level" not in got:
        return None
    return event(**{"level": "Information", **got, "properties": properties})


# ---- formats of users' own --------------------------------------------------------------------------------------

_TO_STRPTIME = {
    "yyyy": "%Y", "yy": "%y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "M": "%m", "dddd": "%A", "ddd": "%a", "dd": "%d", "d": "%d",
    "HH": "%H", "H": "%H", "hh": "%I", "h": "%I", "mm": "%M", "m": "%M", "ss": "%S", "s": "%S", "tt": "%p", "zzz": "%z", "K": "%z",
}


def _strptime(pattern: str) -> str:
    def piece(m: re.Match) -> str:
        token = m[0]
        return "%f" if set(token) <= {"f"} or set(token) <= {"F"} else _TO_STRPTIME.get(token, token)

    return re.sub(r"y+|M+|d+|H+|h+|m+|s+|f+|F+|tt|z+|K", piece, pattern.replace("%", "%%"))


@dataclass(frozen=True)
class CustomFormat:
    """A line format by a regular expression with named groups, (?<name>...) or (?P<name>...)."""

    name: str
    pattern: str
    ignore_case: bool = False
    timestamp_format: str = ""  # one or more, parted by |
    timestamp_is_utc: bool = True
    join_continuation_lines: bool = False
    zone: dt.tzinfo = field(default=UTC, compare=False)

    def validate(self) -> str | None:
        """What is wrong with the format, None if nothing."""
        if not self.pattern.strip():
            return "The pattern is empty."
        try:
            compiled = self.compiled()
        except re.error as e:
            return str(e)
        if not compiled.groupindex:
            return "The pattern has no named groups - use (?<level>...), (?<message>...), (?<timestamp>...) etc."
        return None

    def compiled(self) -> re.Pattern:
        return re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", self.pattern), re.I if self.ignore_case else 0)

    def parser(self) -> Callable[[str], dict | None]:
        if wrong := self.validate():
            raise ValueError(wrong)
        compiled = self.compiled()
        return lambda text: self._parse(compiled, text)

    def _time(self, text: str) -> dt.datetime | None:
        zone = UTC if self.timestamp_is_utc else self.zone
        if self.timestamp_format:
            for one in self.timestamp_format.split("|"):
                try:
                    at = dt.datetime.strptime(text, _strptime(one.strip()))
                    return at if at.tzinfo else at.replace(tzinfo=zone)
                except ValueError:
                    continue
            return None
        at = parse_iso(re.sub(r"(?<=:\d{2}),(?=\d)", ".", text), zone)
        if at is None and re.fullmatch(r"\d+(?:\.\d+)?", text) and float(text) > 1e9:
            n = float(text)
            at = _epoch(int(n if n > 1e11 else n * 1000), False, True)
        return at

    def _parse(self, compiled: re.Pattern, text: str) -> dict | None:
        m = compiled.search(text)
        if not m:
            return None
        got: dict = {}
        properties: dict[str, str] = {}
        date = time = None
        for name, value in m.groupdict().items():
            if value is None:
                continue
            low = name.lower()
            role = next((r for r, names in CUSTOM_GROUPS.items() if low in names), None)
            if low == "time":
                time = value
            elif low == "date":
                date = value
            elif role:
                got.setdefault(role, value)
            elif value:
                properties[name] = value
        stamp = got.pop("ts", None) or (f"{date} {time}" if date and time else date or time)
        level = got.pop("level", None)
        return event(
            ts=self._time(stamp.strip()) if stamp else None, level=None if level is None else normalize_level_text(level),
            message=got.pop("message", text), properties=properties, **{k: v or None for k, v in got.items()},
        )


# Formats to start from.
EXAMPLES = (
    CustomFormat("log4j", r"^(?<timestamp>\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)\s+\[(?<thread>[^\]]+)\]\s+(?<level>[A-Za-z]+)\s+(?<logger>\S+)\s+-\s+(?<message>.*)$", join_continuation_lines=True),
    CustomFormat("python", r"^(?<timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (?<logger>\S+) - (?<level>[A-Z]+) - (?<message>.*)$", join_continuation_lines=True),
    CustomFormat("access", r"^(?<client>\S+) \S+ (?<user>\S+) \[(?<timestamp>[^\]]+)\] \"(?<method>[A-Z]+) (?<path>\S+)[^\"]*\" (?<status>\d{3}) (?<bytes>\d+|-)(?: \"(?<referer>[^\"]*)\" \"(?<agent>[^\"]*)\")?", timestamp_format="dd/MMM/yyyy:HH:mm:ss zzz"),
    CustomFormat("generic", r"^(?<timestamp>\d{4}-\d{2}-\d{2}[ T][\d:.,]+(?:Z|[+-]\d{2}:?\d{2})?)\s+\[?(?<level>TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|FATAL|CRIT(?:ICAL)?)\]?\s+(?<message>.*)$", ignore_case=True, join_continuation_lines=True),
)
PARSERS: dict[str, Callable[[str], dict | None]] = {"serilog": parse_serilog, "ndjson": parse_ndjson, "logfmt": parse_logfmt}
